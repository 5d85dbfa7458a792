"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

A window of a document has as many words as a benchmark item, or is the whole document if that has fewer; it matches the item if their fingerprints are within
``radius`` bits and the weighted Jaccard similarity of their shingles (five words; a shingle weighs as often as it
occurs) is ``similarity`` or more.  Words are split at ASCII white space, A-Z lower-cased.

* Multi-index: the 64 bits are 8 blocks; fingerprints within radius r agree in some block up to r // 8 bits, so
  each item is listed under all block values that near, and 8 look-ups find every item within the radius.  A
  similarity of 0.8 means 10 differing bits on average, three standard deviations are 18; the radius of 23 loses
  about one in 10^5.
* Which windows: two windows of s shingles with similarity t share at least 2 s t / (1 + t) of them, repeats
  counted.  Windows of fewer places whose shingle is one of an item's can't match it and get no fingerprint.
* A document of fewer words than an item, but five at least, is itself the window: with a and b shingles they must
  share (a + b) t / (1 + t) of them.
* Items of fewer than five words are one shingle and match where their words stand.  An item without words matches
  nothing.

The benchmark is a stated query set: it is read on the driver in blocks of at most ``block`` bytes of text, each
broadcast and held against all documents in a scan without any shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .wordarrays import rolled, slices, words_of

WIDTH = 5
BLOCKS = 8
_FILTER = 1 << 22
MATCH = "array<struct<item:long,similarity:double,hamming:int,start:int,words:int>>"


def simhash(hashes: np.ndarray) -> int:
    bits = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8)).reshape(-1, 64)
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(bits)).tobytes(), "big")


def shared_weight(a: np.ndarray, b: np.ndarray) -> int:
    """The sum of the lesser counts of what both hold."""
    av, ac = np.unique(a, return_counts=True)
    bv, bc = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(av, bv, assume_unique=True, return_indices=True)
    return int(np.minimum(ac[i], bc[j]).sum())


@dataclass
class MultiIndex:
    """Fingerprints by block value; ``near`` gives those within the radius, all of them."""

    prints: np.ndarray
    lists: list[list[np.ndarray]]

    @classmethod
    def of(cls, prints: list[int], radius: int) -> MultiIndex:
        values = np.array(prints, dtype=np.uint64)
        most = radius // BLOCKS
        lists = []
        for k in range(BLOCKS):
            own = (values >> np.uint64(8 * k) & np.uint64(255)).astype(np.uint8)
            lists.append([np.flatnonzero(np.bitwise_count(own ^ np.uint8(v)) <= most) for v in range(256)])
        return cls(values, lists)

    def near(self, fp: int, radius: int) -> list[tuple[int, int]]:
        found = np.unique(np.concatenate([self.lists[k][fp >> 8 * k & 255] for k in range(BLOCKS)]))
        distance = np.bitwise_count(self.prints[found] ^ np.uint64(fp))
        return [(int(i), int(d)) for i, d in zip(found, distance) if d <= radius]


class Items:
    """The searchable form of a block of the benchmark."""

    def __init__(self, ids: Sequence[int | None], texts: Sequence[str | None], radius: int, similarity: float):
        self.ids, self.radius, self.similarity = list(ids), radius, similarity
        w = words_of(pa.array(texts, pa.string()), lower=True)
        h = w.hashes()
        self.size = np.diff(w.first)
        self.shingles = [rolled(h[a:b], min(WIDTH, b - a)) if b > a else h[:0] for a, b in zip(w.first, w.first[1:])]
        self.short: dict[int, dict[int, list[int]]] = {}
        self.index: dict[int, tuple[MultiIndex, list[int]]] = {}
        self.need = np.zeros(len(self.ids), dtype=np.int64)
        by_size: dict[int, list[int]] = {}
        keys, of = [], []
        for i, s in enumerate(self.shingles):
            n = int(self.size[i])
            if 0 < n < WIDTH:
                self.short.setdefault(n, {}).setdefault(int(s[0]), []).append(i)
            elif n:
                by_size.setdefault(n, []).append(i)
                self.need[i] = max(1, int(np.ceil(2 * len(s) * similarity / (1 + similarity) - 1e-9)))
                own = np.unique(s)
                keys.append(own)
                of.append(np.full(len(own), i))
        for n, members in by_size.items():
            self.index[n] = MultiIndex.of([simhash(self.shingles[i]) for i in members], radius), members
        keys_all = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        of_all = np.concatenate(of) if of else np.zeros(0, np.int64)
        order = np.argsort(keys_all, kind="stable")
        self.keys, self.of = keys_all[order], of_all[order]
        self.filter = np.zeros(_FILTER, dtype=bool)
        self.filter[(self.keys % np.uint64(_FILTER)).astype(np.int64)] = True

    def windows(self, grams: np.ndarray, good: np.ndarray, doc: np.ndarray, first: np.ndarray) -> set[tuple[int, int, int]]:
        """(doc, words, start) of all windows with shingles enough of some item; start counts over the slice."""
        at = np.flatnonzero(self.filter[(grams & np.uint64(_FILTER - 1)).astype(np.int64)] & good)
        lo, hi = np.searchsorted(self.keys, grams[at], "left"), np.searchsorted(self.keys, grams[at], "right")
        times = hi - lo
        place = np.repeat(at, times)
        item = self.of[np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
        order = np.lexsort((place, item))
        place, item = place[order], item[order]
        need, shingles = self.need[item], self.size[item] - WIDTH + 1
        last = np.arange(len(place)) + need - 1
        fits = last < len(place)
        j = np.flatnonzero(fits)
        j = j[(item[last[j]] == item[j]) & (place[last[j]] - place[j] < shingles[j]) & (doc[place[last[j]]] == doc[place[j]])]
        out = set()
        for i, a, b in zip(item[j].tolist(), place[j].tolist(), place[last[j]].tolist()):
            d, n = int(doc[a]), int(self.size[i])
            for start in range(max(int(first[d]), b - (n - WIDTH)), min(a, int(first[d + 1]) - n) + 1):
                out.add((d, n, start))
        return out

    def whole(self, grams: np.ndarray, good: np.ndarray, doc: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
        """(doc, words of the item) of all documents that are shorter than an item and have shingles enough of it."""
        sizes, n = np.diff(first), max(1, len(self.ids))
        short = sizes[doc[: len(grams)]] < self.size.max(initial=0)
        at = np.flatnonzero(good & short & self.filter[(grams & np.uint64(_FILTER - 1)).astype(np.int64)])
        lo, hi = np.searchsorted(self.keys, grams[at], "left"), np.searchsorted(self.keys, grams[at], "right")
        times = hi - lo
        item = self.of[np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
        pair, places = np.unique(doc[np.repeat(at, times)] * n + item, return_counts=True)
        d, item = pair // n, pair % n
        own, other = sizes[d] - WIDTH + 1, self.size[item] - WIDTH + 1
        need = np.ceil((own + other) * self.similarity / (1 + self.similarity) - 1e-9)
        ok = (own < other) & (places >= need)
        return sorted(set(zip(d[ok].tolist(), self.size[item[ok]].tolist())))

    def matches(self, texts: pa.Array) -> list[list[dict]]:
        """For each text: its best window for each item, the earliest of equals; by item."""
        w = words_of(texts, lower=True)
        h, doc = w.hashes(), w.doc_of_word()
        best: list[dict[int, tuple]] = [{} for _ in range(len(texts))]

        def note(d: int, i: int, similarity: float, distance: int, start: int, words: int) -> None:
            new = (-similarity, start, distance, words)
            if i not in best[d] or new < best[d][i]:
                best[d][i] = new

        if len(w) >= WIDTH:
            grams = rolled(h, WIDTH)
            good = doc[: len(grams)] == doc[WIDTH - 1 :]
            windows = [(d, n, start, n) for d, n, start in sorted(self.windows(grams, good, doc, w.first))]
            windows += [(d, n, int(w.first[d]), int(w.first[d + 1] - w.first[d])) for d, n in self.whole(grams, good, doc, w.first)]
            for d, n, start, words in windows:
                own = grams[start : start + words - WIDTH + 1]
                index, members = self.index[n]
                for k, distance in index.near(simhash(own), self.radius):
                    other = self.shingles[members[k]]
                    both = shared_weight(own, other)
                    s = both / (len(own) + len(other) - both)
                    if s >= self.similarity:
                        note(d, members[k], s, distance, start - int(w.first[d]), words)
        for n, known in self.short.items():
            grams = rolled(h, n)
            keys = np.array(sorted(known), dtype=np.uint64)
            at = np.flatnonzero(np.isin(grams, keys) & (doc[: len(grams)] == doc[n - 1 :]))
            for p in at.tolist():
                for i in known[int(grams[p])]:
                    note(int(doc[p]), i, 1.0, 0, p - int(w.first[doc[p]]), n)
        return [[{"item": self.ids[i], "similarity": -s, "hamming": distance, "start": start, "words": words} for i, (s, start, distance, words) in sorted(own.items())] for own in best]


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, radius: int, similarity: float, block: int) -> Iterator[Items]:
    """The benchmark row by row from the driver's iterator, so only one block is held at a time."""
    ids, texts, size = [], [], 0
    for r in benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).toLocalIterator():
        if texts and size + len(r.t or "") > block:
            yield Items(ids, texts, radius, similarity)
            ids, texts, size = [], [], 0
        ids.append(r.i)
        texts.append(r.t)
        size += len(r.t or "")
    yield Items(ids, texts, radius, similarity)


def _search(shared) -> Column:
    kind = pa.list_(pa.struct([("item", pa.int64()), ("similarity", pa.float64()), ("hamming", pa.int32()), ("start", pa.int32()), ("words", pa.int32())]))

    @F.arrow_udf(MATCH)
    def search(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            found: list[list[dict]] = []
            for part in slices(iter([pa.RecordBatch.from_arrays([column], names=["text"])]), "text", 1 << 20):
                found += shared.value.matches(part.column("text"))
            yield pa.array(found, kind)

    return search


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", radius: int = 23, similarity: float = 0.8, block: int = 4 << 20) -> DataFrame:
    """(doc_id, item_id, similarity, hamming, start_word, n_words): the best window of each pair, the earliest of equals.

    Null and empty texts match nothing.  Null ids and repeated rows (of either side) stay and give rows of their own.
    """
    spark, out = docs.sparkSession, None
    text = F.col(text_col).cast("string")
    for items in item_blocks(benchmark, item_col, item_text_col, radius, similarity, block):
        search = _search(spark.sparkContext.broadcast(items))
        found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.explode(search(text)).alias("m"))
        part = found.select("doc_id", F.col("m.item").alias("item_id"), "m.similarity", "m.hamming", F.col("m.start").alias("start_word"), F.col("m.words").alias("n_words"))
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", radius: int = 23, similarity: float = 0.8, block: int = 4 << 20) -> DataFrame:
    """``docs`` without the documents that match an item; all other rows and all columns stay."""
    spark = docs.sparkSession
    for items in item_blocks(benchmark, item_col, item_text_col, radius, similarity, block):
        search = _search(spark.sparkContext.broadcast(items))
        docs = docs.filter(F.size(search(F.coalesce(F.col(text_col).cast("string"), F.lit("")))) == 0)
    return docs
