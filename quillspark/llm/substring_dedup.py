"""Removal of word sequences that occur more than once, by compacting a de Bruijn graph.

Edges of the graph are windows of ``k`` words (nodes are their first and last k - 1 words).  An edge is
repeated if its word sequence starts at two places or more.  The graph is built the way minimizer-partitioned
compactors build it (Chikhi, Limasset, Medvedev 2016): every window goes to the bucket of the smallest hash
among its shorter ``m``-word seeds, so equal windows always meet, and consecutive windows of a text that share
a bucket travel as ONE row: source coordinates, and 8 bytes for each window.  In its bucket, repeated edges
are found and consecutive ones compact to a path piece; a second Spark join on the source coordinates glues the
pieces of a text to maximal repeated spans, which are then cut out.

* Exactness: windows are equal iff their bucket (64 bits) and their own hash (64 bits) agree.
* Skew: a bucket of more than ``hot`` windows isn't gathered; its windows are counted one by one with partial
  aggregation, spread by their own hashes.  Equal texts add no memory anywhere.
* Shuffles: about 10 bytes a window, once; the texts, once; the spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialise
from .wordarrays import packed, rolled, slices, unpacked, words_of

_RUNS = "mhash long, doc long, dkey long, start int, hashes binary"
_PIECES = "hot boolean, doc long, dkey long, start int, len int, whash long, mhash long"


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """min(values[i:i + width]) for every i."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def _runs(k: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            w = words_of(batch.column("text"))
            n = len(w) - k + 1
            if n <= 0:
                continue
            h = w.hashes()
            window = rolled(h, k)
            seed = _sliding_min(rolled(h, m), k - m + 1)
            doc = w.doc_of_word()
            valid = doc[:n] == doc[k - 1 :]
            at = np.flatnonzero(valid)
            if not len(at):
                continue
            s, d = seed[at], doc[at]
            new = np.ones(len(at), dtype=bool)
            new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
            first = np.flatnonzero(new)
            of = d[first]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(s[first].view(np.int64)),
                    batch.column("doc").take(pa.array(of)),
                    batch.column("dkey").take(pa.array(of)),
                    pa.array((at[first] - w.first[of]).astype(np.int32)),
                    packed(window[at].view(np.int64), np.append(first, len(at))),
                ],
                names=["mhash", "doc", "dkey", "start", "hashes"],
            )

    return run


def _pieces_of(rows: pa.Table, hot: bool) -> pa.RecordBatch:
    """The repeated path pieces of complete buckets; for a hot one, all its windows."""
    rows = rows.combine_chunks().to_batches()[0]
    m = rows.column("mhash").to_numpy()
    hashes, offsets = unpacked(rows.column("hashes"), np.int64)
    lengths = np.diff(offsets)
    of = np.repeat(np.arange(len(lengths)), lengths)
    inside = np.arange(len(hashes)) - np.repeat(offsets[:-1], lengths)
    start = rows.column("start").to_numpy()
    if hot:
        pick, length = np.arange(len(hashes)), np.ones(len(hashes), np.int32)
    else:
        key = hashes.view(np.uint64) + m[of].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        order = np.argsort(key)
        same = (key[order[1:]] == key[order[:-1]]) & (m[of[order[1:]]] == m[of[order[:-1]]])
        repeated = np.zeros(len(hashes), dtype=bool)
        repeated[order[1:][same]] = True
        repeated[order[:-1][same]] = True
        # consecutive repeated edges of one source compact to a piece
        opens = repeated.copy()
        opens[1:] &= ~(repeated[:-1] & (of[1:] == of[:-1]))
        pick = np.flatnonzero(opens)
        closes = repeated.copy()
        closes[:-1] &= ~(repeated[1:] & (of[1:] == of[:-1]))
        length = (np.flatnonzero(closes) - pick + 1).astype(np.int32)
    src = pa.array(of[pick])
    n = len(pick)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n, hot)),
            rows.column("doc").take(src),
            rows.column("dkey").take(src),
            pa.array((start[of[pick]] + inside[pick]).astype(np.int32)),
            pa.array(length),
            pa.array(hashes[pick] if hot else np.zeros(n, np.int64)),
            pa.array(m[of[pick]]),
        ],
        names=["hot", "doc", "dkey", "start", "len", "whash", "mhash"],
    )


def _pieces(hot: int):
    """Streams rows sorted by mhash; holds the windows of whole buckets, ``hot`` at most and one batch."""

    def windows(table: pa.Table) -> int:
        return sum(c.nbytes for c in table.column("hashes").chunks) // 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # rows whose bucket may go on
        over: int | None = None  # the bucket that is known to be hot
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if over is not None:
                cut = int(np.searchsorted(table.column("mhash").to_numpy(), over, side="right"))
                if cut:
                    yield _pieces_of(table.slice(0, cut), True)
                if cut == table.num_rows:
                    continue
                table, over = table.slice(cut), None
            if held is not None:
                table, held = pa.concat_tables([held, table]), None
            m = table.column("mhash").to_numpy()
            last = int(np.searchsorted(m, m[-1]))
            if last:
                yield _pieces_of(table.slice(0, last), False)
            tail = table.slice(last)
            if windows(tail) > hot:
                over = int(m[-1])
                yield _pieces_of(tail, True)
            else:
                held = tail
        if held is not None:
            yield _pieces_of(held, False)

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str, carry: Sequence[str] = ()) -> DataFrame:
    """dkey tells rows of one id apart; rows that agree in both have the same words and the same spans."""
    more = [F.col(c).alias(f"carried{i}") for i, c in enumerate(carry)]
    d = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"), *more)
    return d.withColumn("dkey", F.xxhash64("doc", "text"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 35, m: int = 8, hot: int = 2_000_000) -> DataFrame:
    """Spans (doc, dkey, spans array<long>) of window starts, each start << 32 | number of starts, unordered.

    A text of fewer than ``k`` words, an empty or null one has none.  Repeated rows count as separate places.
    """
    if not 0 < m <= k:
        raise ValueError("m must be in 1..k")
    runs = _keyed(docs, id_col, text_col).mapInArrow(_runs(k, m), _RUNS)
    pieces = materialise(runs.repartition("mhash").sortWithinPartitions("mhash").mapInArrow(_pieces(hot), _PIECES), "pieces")
    late = pieces.filter("hot")
    again = late.groupBy("mhash", "whash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("mhash", "whash")
    cold = pieces.filter("NOT hot").select("doc", "dkey", "start", "len")
    both = cold.unionByName(late.join(again, ["mhash", "whash"]).select("doc", "dkey", "start", "len"))
    span = F.shiftleft(F.col("start").cast("long"), 32).bitwiseOR(F.col("len").cast("long"))
    return both.groupBy("doc", "dkey").agg(F.collect_set(span).alias("spans"))


def _cut(k: int, carried: list[str]):
    def kept_of(text: bytes, spans: list[int] | None) -> tuple[list[bytes], int]:
        words = text.split()
        if spans is None:
            return words, len(words)
        gone = np.zeros(len(words) + 1, dtype=np.int32)
        packed_spans = np.asarray(spans, dtype=np.int64)
        start, n = packed_spans >> 32, packed_spans & 0xFFFFFFFF
        np.add.at(gone, start, 1)
        np.add.at(gone, start + n - 1 + k, -1)
        keep = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
        return [words[i] for i in keep.tolist()], len(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            out = [kept_of(t or b"", s) for t, s in zip(texts, batch.column("spans").to_pylist())]
            joined = [b" ".join(words) for words, _ in out]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc": batch.column("doc"),
                    "n_words": pa.array([n for _, n in out], pa.int64()),
                    "n_removed": pa.array([n - len(words) for words, n in out], pa.int64()),
                    "kept_sha256": pa.array([hashlib.sha256(j).hexdigest() for j in joined], pa.string()),
                    "kept": pa.array(joined, pa.binary()).cast(pa.string()),
                }
                | {c: batch.column(c) for c in carried}
            )

    return run


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 35, m: int = 8, hot: int = 2_000_000, carry: Sequence[str] = ()) -> DataFrame:
    """One row for every row of ``docs``: doc, n_words, n_removed, kept_sha256, kept (text), and ``carry``.

    Each word that a repeated window of ``k`` words covers is removed; kept words are joined by one space.
    Windows are judged on the input: all copies lose the passage.  Null and empty texts have no words and
    the hash of the empty string.  A null id stays null.  Repeated rows are kept, and repeat each other.
    """
    spans = repeated_spans(docs, id_col, text_col, k, m, hot).alias("s")
    d = _keyed(docs, id_col, text_col, carry).alias("d")
    joined = d.join(spans, F.col("d.doc").eqNullSafe(F.col("s.doc")) & (F.col("d.dkey") == F.col("s.dkey")), "left")
    carried = [f"carried{i}" for i in range(len(carry))]
    rows = joined.select("d.doc", "d.text", "s.spans", *(f"d.{c}" for c in carried))
    kinds = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in carried)
    out = rows.mapInArrow(_cut(k, carried), "doc long, n_words long, n_removed long, kept_sha256 string, kept string" + kinds)
    return out.select("doc", "n_words", "n_removed", "kept_sha256", "kept", *(F.col(c).alias(name) for c, name in zip(carried, carry)))
