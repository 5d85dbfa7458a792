"""Toxicity: class-conditional Kneser-Ney models over the characters of words.

Two models, one of toxic and one of ordinary documents, give each character of a word (its end included) a
probability from up to ``order - 1`` characters before it, from the word's start on, which is long enough for a stem.  Inflected and unseen forms
of an expression share its stem, which a model over whole words can't see.  Both are interpolated Kneser-Ney:
raw counts at the highest order (and of shorter histories at a word's start), continuation counts below it, and
at the bottom one distribution shared by both classes, from pooled counts, which smooths what either has rarely
seen.  Toxic documents are ordinary prose for the most part, so their likelihood takes each word from the toxic
model with probability ``SHARE`` and from the ordinary model else; the ordinary likelihood takes it from that
model alone.  A document's statistic is the difference of the two log-likelihoods per word.  A logistic curve,
fitted on a quarter of the sample that the counts leave out, and moved to the labels' class shares, makes it a
score.

The sample is balanced and bounded: ``most`` documents of each label, repeated texts once.  The model is a table
of the n-grams of that sample; its size is bounded by the sample, not by the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .labelled import sample
from .quality import logistic
from .wordarrays import Words, mix, slices, text_buffer

ORDER, MOST_ORDER = 8, 10
BITS = 6  # of a symbol
DISCOUNT = 0.75
SHARE = 0.01
_EDGE = 32
#: Letters without case, one symbol each; of two-byte characters the second byte counts, whose low half has no case.
_SYMBOL = np.full(256, 29, dtype=np.uint8)
_SYMBOL[_EDGE] = 1
_SYMBOL[97:123] = np.arange(2, 28)
_SYMBOL[48:58] = 28
_SYMBOL[0x80:0xC0] = 30 + (np.arange(64) & 31)
_SYMBOL[0xE0:] = 62
_SYMBOL[0xF0:] = 63
_DROPPED = np.zeros(256, dtype=bool)
_DROPPED[0xC2:0xE0] = True
_STRIP = np.zeros(256, dtype=bool)
_STRIP[[ord(c) for c in ".,!?%&$#*|;:()\"'"]] = True


def distinct_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words without marks around them: (symbols of distinct words, each with an edge before and after;
    their n + 1 offsets; the distinct word of each word; first word of each text)."""
    w = Words(data, offsets)
    n = len(w)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, np.int64), w.first
    # the next and the last place that isn't a mark
    position = np.arange(len(data) + 1)
    plain_after = np.minimum.accumulate(np.where(np.append(_STRIP[data], False), len(data), position)[::-1])[::-1]
    plain_before = np.maximum.accumulate(np.where(np.append(False, _STRIP[data]), 0, position))
    starts = np.minimum(plain_after[w.starts], w.ends)
    ends = np.maximum(plain_before[w.ends], starts)
    w.starts, w.ends = starts, ends
    _, first, inverse = np.unique(w.hashes(), return_index=True, return_inverse=True)
    lengths = (ends - starts)[first] + 2
    at = np.append(0, np.cumsum(lengths))
    out = np.full(at[-1], _EDGE, dtype=np.uint8)
    source = np.repeat(starts[first] - at[:-1] - 1, lengths) + np.arange(at[-1])
    inner = np.ones(at[-1], dtype=bool)
    inner[at[:-1]] = inner[at[1:] - 1] = False
    out[inner] = data[source[inner]]
    kept = ~_DROPPED[out]
    return _SYMBOL[out[kept]], np.append(0, np.cumsum(kept))[at], inverse, w.first


def grams(chars: np.ndarray, at: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol but a word's first edge: its history and itself packed in a uint64, and their length."""
    n = len(chars)
    start = np.repeat(at[:-1], np.diff(at))
    place = np.arange(n) - start
    code, length = chars.astype(np.uint64), np.minimum(place + 1, order)
    for back in range(1, min(order, n)):
        shifted = np.zeros(n, dtype=np.uint64)
        shifted[back:] = chars[: n - back].astype(np.uint64) << np.uint64(BITS * back)
        code |= np.where(place >= back, shifted, np.uint64(0))
    keep = place > 0
    return code[keep], length[keep]


class Places:
    """Where distinct keys stand in a list: by the high bits of their mixed values, mostly one look each."""

    def __init__(self, keys: np.ndarray):
        mixed = mix(keys)
        self.back = np.argsort(mixed)
        self.mixed = mixed[self.back]
        bits = max(1, (2 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.start = np.searchsorted(self.mixed >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for others."""
        mixed = mix(keys)
        slot = (mixed >> self.shift).astype(np.int64)
        at, end = self.start[slot], self.start[slot + 1]
        out, open_ = np.full(len(keys), -1, dtype=np.int64), np.flatnonzero(at < end)
        while len(open_):
            here = at[open_]
            hit = self.mixed[here] == mixed[open_]
            out[open_[hit]] = self.back[here[hit]]
            at[open_] += 1
            open_ = open_[~hit & (here + 1 < end[open_])]
        return out


@dataclass
class Level:
    """Counts of the grams of one length, by class, and the sums over each history."""

    keys: Places
    counts: np.ndarray  # (2, n), minus the discount
    histories: Places
    totals: np.ndarray  # (2, m)
    rest: np.ndarray  # (2, m): mass of the lower order


@dataclass
class Model:
    order: int
    levels: dict[int, Level] = field(default_factory=dict)
    single: np.ndarray = field(default_factory=lambda: np.full((2, 1 << BITS), 1 / (1 << BITS)))
    slope: float = 0.0
    shift: float = 0.0
    grams: np.ndarray | None = None  # what it is built of, and all that is sent to workers
    counts: np.ndarray | None = None
    sent: object = None

    def __getstate__(self) -> dict:
        """Differences of the sorted grams and counts, byte by byte, which compress to a few bytes a gram."""
        if self.grams is None:
            return {"order": self.order, "single": self.single}
        step = np.diff(self.grams, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
        return {"order": self.order, "grams": step.tobytes(), "counts": np.ascontiguousarray(self.counts, dtype=np.uint32).view(np.uint8).reshape(2, -1, 4).transpose(0, 2, 1).tobytes()}

    def __setstate__(self, state: dict) -> None:
        made = Model(state["order"])
        if "single" in state:
            made.single = state["single"]
        else:
            grams = np.cumsum(np.ascontiguousarray(np.frombuffer(state["grams"], np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)
            counts = np.ascontiguousarray(np.frombuffer(state["counts"], np.uint8).reshape(2, 4, -1).transpose(0, 2, 1)).view(np.uint32).reshape(2, -1)
            made = of_grams(grams, counts.astype(np.float64), state["order"])
        self.__dict__.update(made.__dict__)

    def broadcast(self, spark: SparkSession):
        """One broadcast for all uses; slope and shift aren't part of it."""
        self.sent = self.sent or spark.sparkContext.broadcast(self)
        return self.sent

    def ratios(self, chars: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary) of each word."""
        words = len(at) - 1
        if not words:
            return np.zeros(0)
        code, length = grams(chars, at, self.order)
        p = self.single[:, (code & np.uint64((1 << BITS) - 1)).astype(np.int64)]
        known = np.arange(len(code))  # places whose history of this order has been seen; a longer one only if so
        for k in range(2, self.order + 1):
            level = self.levels.get(k)
            if level is None:
                break
            known = known[length[known] >= k]
            gram = code[known] & np.uint64((1 << BITS * k) - 1)
            h = level.histories.find(gram >> np.uint64(BITS))
            seen = h >= 0
            known, gram, h = known[seen], gram[seen], h[seen]
            if not len(known):
                break
            g = level.keys.find(gram)
            for c in (0, 1):
                total = level.totals[c, h]
                own = np.where(g >= 0, level.counts[c, g], 0.0)
                with np.errstate(divide="ignore", invalid="ignore"):
                    p[c, known] = np.where(total > 0, own / total + level.rest[c, h] * p[c, known], p[c, known])
        ratio = np.log(p[1] / p[0])
        return np.add.reduceat(ratio, at[:-1] - np.arange(words))

    def statistics(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The difference of log-likelihoods per word, 0 without words."""
        chars, at, inverse, first = distinct_words(data, offsets)
        each = np.log1p(SHARE * np.expm1(np.minimum(self.ratios(chars, at), 50.0)))
        # summed anew for each text: equal texts get equal bits wherever they stand
        return np.array([each[inverse[a:b]].sum() / max(b - a, 1) for a, b in zip(first[:-1], first[1:])], dtype=np.float64)

    def score(self, statistic: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * statistic + self.shift, -35, 35)))


def build(code: np.ndarray, length: np.ndarray, counts: np.ndarray, order: int, discount: float = DISCOUNT) -> Model:
    """From distinct grams (code, length up to ``order``) and their counts (2, n) by class."""
    model = Model(order)
    pool = None
    upper_code, upper_length, upper = code, length, counts
    for k in range(order, 0, -1):
        if k == order:
            use = upper_length == k
            keys, own = upper_code[use], upper[:, use]
        else:
            # continuation counts: distinct characters before; and raw counts of what starts a word
            longer = upper_length == k + 1
            tail = upper_code[longer] & np.uint64((1 << BITS * k) - 1)
            starts = code[length == k] if k > 1 else code[:0]
            raw = counts[:, length == k] if k > 1 else counts[:, :0]
            keys, inverse = np.unique(np.concatenate([tail, starts]), return_inverse=True)
            own = np.zeros((2, len(keys)))
            for c in (0, 1):
                np.add.at(own[c], inverse[: len(tail)], (upper[c, longer] > 0).astype(float))
                np.add.at(own[c], inverse[len(tail) :], raw[c])
        upper_code, upper_length, upper = keys, np.full(len(keys), k), own
        if k == 1:
            pool = np.full(1 << BITS, 0.1)
            np.add.at(pool, keys.astype(np.int64), own.sum(axis=0))
            pool /= pool.sum()
            for c in (0, 1):
                total = own[c].sum()
                if total:
                    model.single[c] = discount * (own[c] > 0).sum() / total * pool
                    model.single[c][keys.astype(np.int64)] += np.maximum(own[c] - discount, 0) / total
                else:
                    model.single[c] = pool
            break
        order_of = np.argsort(keys)
        keys, own = keys[order_of], own[:, order_of]
        histories, inverse = np.unique(keys >> np.uint64(BITS), return_inverse=True)
        totals, kinds = np.zeros((2, len(histories))), np.zeros((2, len(histories)))
        for c in (0, 1):
            np.add.at(totals[c], inverse, own[c])
            np.add.at(kinds[c], inverse, (own[c] > 0).astype(float))
        with np.errstate(divide="ignore", invalid="ignore"):
            rest = np.where(totals > 0, discount * kinds / totals, 1.0)
        if len(keys):
            model.levels[k] = Level(Places(keys), np.maximum(own - discount, 0), Places(histories), totals, rest)
    return model


def of_grams(packed_grams: np.ndarray, counts: np.ndarray, order: int) -> Model:
    """From sorted grams with their length above ``order`` symbols, and their counts."""
    width = np.uint64(BITS * order)
    model = build(packed_grams & np.uint64((1 << BITS * order) - 1), (packed_grams >> width).astype(np.int64), counts, order)
    model.grams, model.counts = packed_grams, counts
    return model


def _gram_counts(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            labels = batch.column("label").to_numpy(zero_copy_only=False)
            data, offsets = text_buffer(batch.column("text"), True)
            chars, at, inverse, first = distinct_words(data, offsets)
            label = np.repeat(labels, np.diff(first))
            code, length = grams(chars, at, order)
            word = np.repeat(np.arange(len(at) - 1), np.diff(at) - 1)
            key, back = np.unique(code | length.astype(np.uint64) << np.uint64(BITS * order), return_inverse=True)
            for c in (0, 1):
                times = np.bincount(inverse[label == c], minlength=len(at) - 1)
                n = np.zeros(len(key))
                np.add.at(n, back, times[word])
                some = n > 0
                yield pa.RecordBatch.from_arrays([pa.array(key[some].view(np.int64)), pa.array(np.full(some.sum(), c, np.int32)), pa.array(n[some].astype(np.int64))], names=["gram", "label", "n"])

    return run


def train(docs: DataFrame, labels: DataFrame, usable: Column, label_col: str = "toxic", most: int = 8_000, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Counts over at most ``most`` documents of each label that ``usable`` (over ``labels``) admits.

    Without documents of both labels every text scores the share of label 1 (1/2 without labels).
    """
    if not 2 <= order <= MOST_ORDER:
        raise ValueError("order must be in 2..10")
    rows = sample(docs, labels, label_col, usable, most, True, id_col, text_col)
    rows = rows.groupBy("text").agg(F.max("label").alias("label")).withColumn("apart", F.xxhash64("text") % 4 == 0).persist()
    shares = dict(labels.filter(usable & F.col(label_col).isin(0, 1)).groupBy(F.col(label_col).cast("int")).count().collect())
    n0, n1 = shares.get(0, 0) + 1, shares.get(1, 0) + 1
    prior = float(np.log(n1 / n0))
    counted = rows.filter("NOT apart").mapInArrow(_gram_counts(order), "gram long, label int, n long")
    table = counted.groupBy("gram").pivot("label", [0, 1]).agg(F.sum("n")).na.fill(0).toArrow().sort_by("gram")
    packed_grams = table.column("gram").to_numpy().view(np.uint64)
    counts = np.array([table.column("0").to_numpy(), table.column("1").to_numpy()], dtype=np.float64)
    if not len(packed_grams) or not counts.sum(axis=1).all():
        rows.unpersist()
        return Model(order, slope=0.0, shift=prior)
    order_of = np.argsort(packed_grams)
    model = of_grams(packed_grams[order_of], counts[:, order_of], order)
    shared = model.broadcast(docs.sparkSession)
    held = rows.filter("apart").select("label", _statistic(shared)("text").alias("s")).toArrow()
    rows.unpersist()
    y, s = held.column("label").to_numpy(), held.column("s").to_numpy()
    place = np.lexsort((y, s))
    if len(set(y.tolist())) < 2:
        model.slope, model.shift = 1.0, prior
    else:
        model.slope, shift = logistic(s[place], y[place])
        model.shift = shift + prior - float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    return model


def _statistic(shared):
    @F.arrow_udf("double")
    def statistic(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            parts = slices(iter([pa.RecordBatch.from_arrays([column], names=["text"])]), "text", 1 << 20)
            found = [shared.value.statistics(*text_buffer(p.column("text"), True)) for p in parts]
            yield pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())

    return statistic


def scores(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """The score of a text column of ``docs``, 0 to 1; null, empty and blank texts have the score of no evidence."""
    shared = model.broadcast(docs.sparkSession)
    z = _statistic(shared)(F.col(text_col).cast("string")) * model.slope + model.shift
    return 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), z))))


def classify(docs: DataFrame, model: Model, held_out: Column, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; null ids and repeated rows stay."""
    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), scores(docs, model, text_col).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
