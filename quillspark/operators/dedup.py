"""Near-duplicate pages of a request: by URL key, by title, by the SimHash of title and content."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.text import fnv1a_units, grams, hash_content, text_of, title_key, url_key

TITLE_LEAST, HAMMING_MOST = 0.7, 5


def best_rank() -> list[Column]:
    """Order of a group's members: score, length, has a date, has a city other than 全台, first come."""
    city = F.coalesce(F.col("city"), F.lit("全台")) != "全台"
    return [F.col("score").desc(), F.length(text_of(F.col("content"))).desc(), F.col("event_date").isNotNull().desc(), city.desc(), F.col("pos")]


def by_url(pages: DataFrame, group: str = "query_id", url: str = "url", score: str = "score", pos: str = "pos") -> DataFrame:
    """The best page of each URL key (first of equals), at the key's first position (``first_pos``)."""
    w = Window.partitionBy(group, "__key")
    keyed = pages.withColumn("__key", url_key(F.col(url))).withColumn("first_pos", F.min(pos).over(w)).withColumn("__n", F.row_number().over(w.orderBy(F.col(score).desc(), pos)))
    return keyed.filter("__n = 1").drop("__n", "__key")


def simhash(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, simhash): FNV-1a of lower-case character bigrams, a bit set if more than half have it; 0 without bigrams.

    Characters outside the basic plane would be two units; they count as their low 16 bits here.
    """
    rows = df.select(F.col(id_col).alias("id"), F.explode_outer(grams(F.lower(text_of(text)), 2)).alias("g"))
    pairs = rows.groupBy("id", "g").agg(F.count(F.lit(1)).alias("n"))
    unit = lambda c: F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("long").bitwiseAND(F.lit(0xFFFF))
    hashed = pairs.withColumn("h", fnv1a_units([unit(F.col("g").substr(1, 1)), unit(F.col("g").substr(2, 1))]))
    sums = hashed.groupBy("id").agg(*(F.sum(F.when(F.col("g").isNotNull(), F.col("n") * (F.shiftright("h", b).bitwiseAND(F.lit(1)) * 2 - 1))).alias(f"b{b}") for b in range(64)))
    bits = F.lit(0).cast("long")
    for b in range(64):
        value = F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")
        bits = bits.bitwiseOR(F.when(F.col(f"b{b}") > 0, value).otherwise(F.lit(0).cast("long")))
    return sums.select("id", bits.alias("simhash"))


def _simhash_arrow(texts: pa.Array) -> pa.Array:
    out = []
    for t in texts.to_pylist():
        units = np.frombuffer((t or "").lower().encode("utf-16-le"), dtype="<u2").astype(np.uint64)
        h = ((np.uint64(0xCBF29CE484222325) ^ units[:-1]) * np.uint64(0x100000001B3) ^ units[1:]) * np.uint64(0x100000001B3)
        ones = np.unpackbits(h.byteswap().view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big", signed=True))
    return pa.array(out, pa.int64())


def simhash_of(text: Column) -> Column:
    """The same hash of one column, without an explode: for the few pages of a request."""
    return F.arrow_udf(_simhash_arrow, "long")(text_of(text))


def _bigrams(s: str) -> set[str]:
    return {s[i : i + 2] for i in range(len(s) - 1)}


def _titles_alike(a: str, b: str) -> bool:
    if not a or not b:
        return False
    if a == b or a in b or b in a:
        return True
    x, y = _bigrams(a), _bigrams(b)
    return len(x & y) >= TITLE_LEAST * len(x | y) > 0


def _hashes_alike(a: int, b: int) -> bool:
    return ((a ^ b) & ((1 << 64) - 1)).bit_count() <= HAMMING_MOST


def pairs_within(hashes: DataFrame, radius: int = HAMMING_MOST, tiles: int = 24) -> DataFrame:
    """(distance, pairs) of the distinct values of ``simhash``, every pair of them tested once.

    SimHashes of prose agree in so many bits that bands let more pairs through than there are.  Values fall in tiles by
    their hash; a pair of tiles is a group of its own, which holds 2 / ``tiles`` of the values.
    """
    tile = F.pmod(F.xxhash64("simhash"), F.lit(tiles)).cast("int")
    cell = lambda i: F.struct(F.least("t", i).alias("i"), F.greatest("t", i).alias("j"))
    d = hashes.select("simhash").distinct().select("simhash", tile.alias("t"))
    dealt = d.select("simhash", "t", F.explode(F.transform(F.sequence(F.lit(0), F.lit(tiles - 1)), cell)).alias("c")).select("simhash", "t", "c.i", "c.j")

    def count(cell: pa.Table) -> pa.Table:
        h, t = cell.column("simhash").to_numpy().view(np.uint64), cell.column("t").to_numpy()
        n = np.zeros(65, np.int64)
        first, second = h[t == t[0]], h[t != t[0]]
        same = cell.column("i")[0] == cell.column("j")[0]
        for k, x in enumerate(first):
            differ = np.bitwise_count((first[k + 1 :] if same else second) ^ x)
            n += np.bincount(differ[differ <= radius], minlength=65)
        at = np.flatnonzero(n)
        return pa.table({"distance": pa.array(at, pa.int32()), "n": pa.array(n[at], pa.int64())})

    counted = dealt.repartition(tiles * 4, "i", "j").groupBy("i", "j").applyInArrow(count, "distance int, n long")
    return counted.groupBy("distance").agg(F.sum("n").alias("pairs"))


_CHUNK = 1 << 14  # leaders tested at once: their sketches stay in the processor's cache


class _Titles:
    """Leaders' titles as sketches of their bigrams, which let every pair that is alike through.

    Bigrams fall in 64 bins and in 1,024.  A set within another has its bins within the other's; sets that differ in d
    bigrams differ in d bins at most by the parity of what a bin holds, and a Jaccard index of 0.7 bounds d by 3/17 of
    both sizes.
    """

    def __init__(self, most: int):
        self.titles: list[str] = []
        self.bins, self.parity, self.wide, self.sizes = np.empty(most, np.uint64), np.empty(most, np.uint64), np.empty((most, 16), np.uint64), np.empty(most, np.int64)

    def _sketch(self, title: str) -> tuple[np.uint64, np.uint64, np.ndarray, int]:
        grams = _bigrams(title)
        bins = wide = 0
        for g in grams:
            h = (ord(g[0]) * 0x9E3779B97F4A7C15 + ord(g[1]) * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1) * 0xFF51AFD7ED558CCD
            bins |= 1 << (h >> 58 & 63)
            wide ^= 1 << (h >> 40 & 1023)
        words = np.array([wide >> 64 * i & (1 << 64) - 1 for i in range(16)], np.uint64)
        return np.uint64(bins), np.bitwise_xor.reduce(words), words, len(grams)

    def find(self, title: str) -> int | None:
        """The first leader that the title is alike to; without one, it becomes a leader."""
        bins, parity, wide, size = self._sketch(title)
        n, most = len(self.titles), int(3 / 17 * size * (1 + 1 / TITLE_LEAST) + 1e-6)
        for lo in range(0, n, _CHUNK):
            at = slice(lo, min(n, lo + _CHUNK))
            own = self.bins[at]
            both = own & bins
            test = (both == bins) | (both == own)
            maybe = np.flatnonzero(test | (np.bitwise_count(self.parity[at] ^ parity) <= most)) + lo
            if len(maybe):
                differ = np.bitwise_count(self.wide[maybe] ^ wide).sum(axis=1, dtype=np.int64)
                near = differ * 17 <= 3 * (self.sizes[maybe] + size)
                within = test[maybe - lo]
                keep = near | within
                for i, close in zip(maybe[keep].tolist(), near[keep].tolist()):
                    other = self.titles[i]
                    if _titles_alike(other, title) if close else other in title or title in other:
                        return i
        self.bins[n], self.parity[n], self.wide[n], self.sizes[n] = bins, parity, wide, size
        self.titles.append(title)
        return None


class _Hashes:
    def __init__(self, most: int):
        self.n, self.hashes = 0, np.empty(most, np.int64)

    def find(self, value: int) -> int | None:
        for lo in range(0, self.n, _CHUNK):
            own = self.hashes[lo : min(self.n, lo + _CHUNK)]
            near = np.bitwise_count((own ^ np.int64(value)).view(np.uint64)) <= HAMMING_MOST
            i = int(near.argmax())
            if near[i]:
                return lo + i
        self.hashes[self.n] = value
        self.n += 1
        return None


def leaders(pages: DataFrame, value: Column, alike: str, group: str = "query_id", pos: str = "pos") -> DataFrame:
    """Adds ``leader``: the position of the leader of each page; a page joins the first leader that it is alike to.

    Greedy in the order of ``pos`` within a group.  Pages with equal values have one leader, so a task gets only the
    distinct values of a group, each with its first position; a page with an empty title leads itself.
    """
    of = {"title": _Titles, "hash": _Hashes}[alike]
    kind = "string" if alike == "title" else "long"

    def elect(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["__p", "__v"])
        index, firsts, out = of(len(f)), [], []
        for p, v in zip(f["__p"].tolist(), f["__v"].tolist()):
            hit = index.find(v)
            if hit is None:
                firsts.append(p)
            out.append(p if hit is None else firsts[hit])
        return pd.DataFrame({"__g": f["__g"], "__w": f["__v"], "leader": out})

    made = pages.withColumn("__v", value.cast(kind)).withColumn(pos, F.col(pos).cast("long"))
    firsts = made.select(F.col(group).alias("__g"), "__v", pos).filter(F.col("__v") != "" if alike == "title" else F.col("__v").isNotNull()).groupBy("__g", "__v").agg(F.min(pos).alias("__p"))
    kinds = T.StructType([T.StructField("__g", made.schema[group].dataType), T.StructField("__w", made.schema["__v"].dataType), T.StructField("leader", T.LongType())])
    led = firsts.groupBy("__g").applyInPandas(elect, kinds)
    joined = made.join(led, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__v") == F.col("__w")), "left")
    return joined.withColumn("leader", F.coalesce("leader", pos)).drop("__g", "__v", "__w")


def best_of(led: DataFrame, group: str = "query_id", pos: str = "pos") -> DataFrame:
    """One page of each leader's group, at the leader's position."""
    w = Window.partitionBy(group, "leader").orderBy(*best_rank())
    kept = led.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    return kept.withColumn(pos, F.col("leader")).drop("leader")


def deduplicate(pages: DataFrame, group: str = "query_id", quick: bool = False) -> DataFrame:
    """URL, title and, unless quick, content stages; pages: group, pos, url, title, content, score, city, event_date."""
    first = by_url(pages, group).withColumn("pos", F.col("first_pos")).drop("first_pos")
    second = best_of(leaders(first, title_key(F.col("title")), "title", group), group)
    if quick:
        return second
    return best_of(leaders(second, simhash_of(hash_content(F.col("title"), F.col("content"))), "hash", group), group)
