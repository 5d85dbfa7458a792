"""Near-duplicate documents by 64-bit SimHash, all links within a Hamming radius.

Fingerprints are embedded as the bit counts of their 32 two-bit segments, a vector of 0..2 each.  The Manhattan
distance of two vectors is a lower bound of the Hamming distance.  The vector is written in unary (0, 1, 3), so
that Manhattan distance is ``popcount(u ^ v)`` and a grid cell of unit side is a bit mask of ``u``.

Range join: split the segments into ``groups`` runs.  Vectors within Manhattan distance r differ in r runs at
most, so they agree in one of the choices of groups - r runs; each fingerprint goes to one grid cell per choice,
and the range join is an equi-join on cells that loses nothing.  In a cell, the Manhattan bound over all segments
is tested first, then the Hamming distance; a pair counts in one cell only.  Cells give a spanning forest of
their links, never all pairs: what leaves a cell is linear in its members, and no link between classes is lost.
Links are the same for any number of groups; ``grid`` takes the fewest that keep cells of random fingerprints small,
from their count: 15 rows for each of some millions, 210 for each of some billions.

* Only distinct fingerprints are joined: copies of one text are one member.
* A cell of more than ``tile`` members is split in tiles, each pair of tiles a task of its own.
* Classes are found by ``components``; no fingerprint goes to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import materialise
from .wordarrays import mix, slices

BITS, SEGMENT = 64, 2
_ODD = np.uint64(0x5555555555555555)
_CHOICES = 256  # the low byte of a cell's key is the number of its choice


def fingerprint(text: bytes, width: int = 4) -> int:
    """The signed 64-bit SimHash of lower-cased (A-Z) words, ``width`` to a shingle; see op5's contract."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        digests = xxhash.xxh64_digest(joined, 42)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(ends[:-width] + 1).tolist()]
        digest = xxhash.xxh64_digest
        digests = b"".join([digest(joined[s:e], 42) for s, e in zip(starts, ends[width - 1 :].tolist())])
    n = len(digests) // 8
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(digests), 8 << 14):
        bits = np.unpackbits(np.frombuffer(digests[at : at + (8 << 14)], dtype=np.uint8)).reshape(-1, BITS)
        ones += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            texts = batch.column("text").cast(pa.binary())
            out = np.fromiter((fingerprint(t.as_py() or b"", width) for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in batch.schema.names if c != "text"} | {"fp": pa.array(out)})

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(doc, k1, k2, fp) for every row: fp is 0 for null, empty and blank texts; k1, k2 hash (id, text)."""
    d = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    d = d.select("doc", F.xxhash64("doc", "text").alias("k1"), F.xxhash64("text", "doc", F.lit(1)).alias("k2"), "text")
    return d.mapInArrow(_fingerprints(width), "doc long, k1 long, k2 long, fp long")


def unary(x: np.ndarray) -> np.ndarray:
    """Bit counts of two-bit segments in unary: 0, 1, 3 for 0, 1, 2."""
    high = x >> np.uint64(1)
    return ((x | high) & _ODD) | ((x & high & _ODD) << np.uint64(1))


def grid(count: int, radius: int, members: int = 32) -> int:
    """The number of runs for ``count`` distinct fingerprints: the fewest with ``members`` in a random cell, 256 cells at most."""
    groups = radius + 1
    while math.comb(groups + 1, radius) <= _CHOICES:
        agree = (groups - radius) / groups * BITS / SEGMENT
        if count * 0.375**agree <= members:  # 3/8: two random segments have one bit count
            break
        groups += 1
    return groups


def masks(groups: int, radius: int) -> list[int]:
    """A bit mask for each choice of ``groups - radius`` of the runs of segments."""
    edges = [round(i * BITS / SEGMENT / groups) * SEGMENT for i in range(groups + 1)]
    runs = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(runs, groups - radius)]


def _first_choice(differ: np.ndarray, groups: int, radius: int) -> np.ndarray:
    """For u ^ v: the mask of the first groups - radius runs in which they agree."""
    edges = [round(i * BITS / SEGMENT / groups) * SEGMENT for i in range(groups + 1)]
    out, taken = np.zeros(len(differ), np.uint64), np.zeros(len(differ), np.int8)
    for lo, hi in zip(edges, edges[1:]):
        run = np.uint64(((1 << hi) - 1) ^ ((1 << lo) - 1))
        pick = ((differ & run) == 0) & (taken < groups - radius)
        out[pick] |= run
        taken += pick
    return out


def _cells(groups: int, radius: int):
    choices = masks(groups, radius)
    rows = max(1, (1 << 15) // len(choices))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fp), rows):
                part = fp[at : at + rows]
                u = unary(part)
                cell = np.empty(len(part) * len(choices), np.uint64)
                for i, m in enumerate(choices):
                    cell[i * len(part) : (i + 1) * len(part)] = mix((u & np.uint64(m)) + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & ~np.uint64(_CHOICES - 1) | np.uint64(i)
                yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(np.tile(part, len(choices)).view(np.int64))], names=["cell", "fp"])

    return run


def _forest(key: np.ndarray, fp: np.ndarray, radius: int, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside each key; rows are sorted by key."""
    choices = np.array(masks(groups, radius), dtype=np.uint64)
    f = fp.view(np.uint64)
    u = unary(f)
    label = np.arange(len(key))
    a, b = [], []
    step, near = 1, np.flatnonzero(key[1:] == key[:-1])
    while len(near):
        i = near[label[near] != label[near + step]]
        j = i + step
        differ = u[i] ^ u[j]
        ok = np.bitwise_count(differ) <= radius  # Manhattan
        i, j, differ = i[ok], j[ok], differ[ok]
        ok = np.bitwise_count(f[i] ^ f[j]) <= radius  # Hamming
        i, j, differ = i[ok], j[ok], differ[ok]
        ok = _first_choice(differ, groups, radius) == choices[key[i] & (_CHOICES - 1)]
        i, j = i[ok], j[ok]
        if len(i):
            a.append(fp[i])
            b.append(fp[j])
            while True:
                low = np.minimum(label[i], label[j])
                high = np.maximum(label[i], label[j])
                if (low == high).all():
                    break
                np.minimum.at(label, high, low)
                while (label != label[label]).any():
                    label = label[label]
        step += 1
        near = near[near + step < len(key)]
        near = near[key[near] == key[near + step]]
    empty = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


def _links(radius: int, groups: int, tile: int):
    """Streams rows sorted by key; holds one cell of ``tile`` members at most, and one batch.

    Gives links (a, b), and the members of larger cells with the number of their tile.
    """

    def found(key, fp) -> pa.RecordBatch:
        a, b = _forest(key, fp, radius, groups)
        return pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int32()), pa.array(a), pa.array(b)], names=["cell", "part", "a", "b"])

    def late(key, fp, seen: int) -> pa.RecordBatch:
        part = ((seen + np.arange(len(key))) // tile).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(part), pa.array(fp), pa.nulls(len(key), pa.int64())], names=["cell", "part", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        over, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "fp")]
            if over is not None:
                cut = int(np.searchsorted(rows[0], over, side="right"))
                if cut:
                    yield late(*(r[:cut] for r in rows), seen)
                seen += cut
                if cut == batch.num_rows:
                    continue
                rows, over = [r[cut:] for r in rows], None
            if held is not None:
                rows, held = [np.concatenate(x) for x in zip(held, rows)], None
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            if last:
                yield found(*(r[:last] for r in rows))
            tail = [r[last:].copy() for r in rows]
            if len(tail[0]) > tile:
                over, seen = int(tail[0][-1]), len(tail[0])
                yield late(*tail, 0)
            else:
                held = tail
        if held is not None:
            yield found(*held)

    return run


_LINKS = "cell long, part int, a long, b long"


def fingerprint_links(fps: DataFrame, radius: int = 4, groups: int | None = None, tile: int = 4096) -> DataFrame:
    """(a, b) of distinct fingerprints that connect all within ``radius``; ``fps`` has one long column fp."""
    count = fps.count()
    groups = grid(count, radius) if groups is None else groups
    if not 0 <= radius < groups <= BITS // SEGMENT or math.comb(groups, radius) > _CHOICES:
        raise ValueError("radius < groups <= 32 and 256 cells at most are needed")
    # spread first: a task expands some 2^18 rows, whatever the planner made of the small table
    spread = fps.repartition(max(1, count * math.comb(groups, radius) >> 18), "fp")
    cells = spread.mapInArrow(_cells(groups, radius), "cell long, fp long")
    out = materialise(cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_links(radius, groups, tile), _LINKS), "cells")
    late = out.filter("cell IS NOT NULL")
    parts = late.groupBy("cell").agg(F.max("part").alias("top"))
    other = F.explode(F.sequence(F.lit(0), F.col("top"))).alias("other")
    pairs = late.join(parts, "cell").select("cell", "part", F.col("a").alias("fp"), other)
    # key of the pair of tiles, with the cell's choice; a pair holds the members of both
    key = F.xxhash64("cell", F.least("part", "other"), F.greatest("part", "other")).bitwiseAND(F.lit(-_CHOICES).cast("long"))
    tiles = pairs.select(key.bitwiseOR(F.col("cell").bitwiseAND(F.lit(_CHOICES - 1).cast("long"))).alias("cell"), "fp")
    rest = tiles.repartition("cell").sortWithinPartitions("cell").mapInArrow(_links(radius, groups, 1 << 40), _LINKS)
    return out.filter("cell IS NULL").select("a", "b").unionByName(rest.select("a", "b"))


def classes(prints: DataFrame, radius: int = 4, groups: int | None = None, tile: int = 4096) -> DataFrame:
    """(fp, component_id) of every distinct fingerprint of ``prints`` (doc, fp); the least doc of the class."""
    first = materialise(prints.groupBy("fp").agg(F.min("doc").alias("first")), "fingerprints")
    found = components(fingerprint_links(first.select("fp"), radius, groups, tile))
    members = found.join(first, found.node == first.fp).select("fp", "root", "first")
    least = members.groupBy("root").agg(F.min("first").alias("least"))
    linked = members.join(least, "root").select("fp", "least")
    return first.join(linked, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, width: int = 4, groups: int | None = None, tile: int = 4096) -> DataFrame:
    """(doc, fingerprint hex, component_id) for every row of ``docs``.

    Null, empty and blank texts have fingerprint zero and link like any other.  Null ids are passed over in
    component_id, which is null where a class has no other.  Repeated rows stay.
    """
    prints = materialise(fingerprints(docs, id_col, text_col, width), "prints")
    out = prints.join(classes(prints.select("doc", "fp"), radius, groups, tile), "fp")
    return out.select("doc", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, width: int = 4, groups: int | None = None, tile: int = 4096) -> DataFrame:
    """``docs`` with one row of each class: the least id (nulls last), then the least hash of id and text.

    Of rows that agree in id and text, the one with the least hash of all its columns stays; columns of any name do.
    """
    prints = materialise(fingerprints(docs, id_col, text_col, width), "prints")
    tagged = prints.join(classes(prints.select("doc", "fp"), radius, groups, tile).withColumnRenamed("fp", "f"), F.col("fp") == F.col("f"))
    # a class is known by its least id; classes without one by their fingerprint
    rank = F.struct(F.col("doc").isNull().alias("n"), "doc", "k1", "k2")
    best = tagged.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("alone")).agg(F.min(rank).alias("w"))
    won = best.select(F.col("w.k1").alias("k1"), F.col("w.k2").alias("k2")).distinct()
    keyed = docs.select(
        F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string")).alias("k1"), F.xxhash64(F.col(text_col).cast("string"), F.col(id_col).cast("long"), F.lit(1)).alias("k2"), F.struct("*").alias("row"),
    )
    kept = keyed.join(won, ["k1", "k2"], "left_semi")
    said = F.to_json("row")
    return kept.groupBy("k1", "k2").agg(F.min_by("row", F.struct(F.xxhash64(said), F.xxhash64(F.lit(1), said))).alias("row")).select("row.*")
