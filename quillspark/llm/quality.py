"""Quality classifier: a linear SVM over n-gram indicators scaled by naive Bayes log-count ratios.

Wang and Manning, "Baselines and bigrams" (2012), fitted by the dual coordinate descent of Hsieh et al. (2008)
for the hinge loss.  N-grams are of two alphabets: bytes (1 to 3), and word shapes (1 to 3), where the shape of a
word tells its case, its first and last kind of character, and whether it repeats the word before.
Every n-gram of the whole text sets one of ``BUCKETS`` hashed indicators.

The model is fitted on a bounded sample of labelled rows (``sample``, those with the least hashes of their ids),
in one task whose input that bound limits; it is 64-bit floats for ``BUCKETS`` indicators, so its broadcast has a
fixed size.  Margins become scores by a logistic curve fitted on a part of the sample that the SVM didn't see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import sample
from .wordarrays import Words, mix, packed, rolled, slices, text_buffer, unpacked

BUCKETS = 1 << 17
_KIND = np.zeros(256, dtype=np.uint64)  # of a byte: 0 other, 1 lower, 2 upper, 3 digit, 4 beyond ASCII, 5 sentence mark
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 4
_KIND[[ord(c) for c in ".,;:?'\"()-"]] = 5


@dataclass
class Model:
    weights: np.ndarray  # by bucket, log-count ratios included
    bias: float
    slope: float
    shift: float

    def score(self, active: np.ndarray) -> float:
        margin = float(self.weights[active].sum()) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -35, 35))))


def indicators(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The buckets that each text sets, ascending."""
    n = len(data)
    wide = data.astype(np.uint64)
    grams = [wide, np.zeros(n, np.uint64), np.zeros(n, np.uint64)]
    if n > 2:
        grams[1][: n - 1] = (wide[:-1] << np.uint64(8) | wide[1:]) + np.uint64(1 << 8)
        grams[2][: n - 2] = (wide[:-2] << np.uint64(16) | wide[1:-1] << np.uint64(8) | wide[2:]) + np.uint64(1 << 17)
    byte = [(mix(g) % np.uint64(BUCKETS)).astype(np.int64) for g in grams]
    w = Words(data, offsets)
    shapes = [np.zeros(0, np.int64)] * 3
    if len(w):
        upper = np.append(0, np.cumsum((data >= 65) & (data < 91)))
        lower = np.append(0, np.cumsum((data >= 97) & (data < 123)))
        big, small = upper[w.ends] - upper[w.starts], lower[w.ends] - lower[w.starts]
        case = np.select([(big == 0) & (small == 0), big == 0, small == 0], [0, 1, 2], 3).astype(np.uint64)
        h = w.hashes()
        repeats = np.zeros(len(w), dtype=np.uint64)
        repeats[1:] = h[1:] == h[:-1]
        shape = mix(((case * np.uint64(8) + _KIND[data[w.starts]]) * np.uint64(8) + _KIND[data[w.ends - 1]]) * np.uint64(2) + repeats + np.uint64(1 << 40))
        shapes = [(rolled(shape, k) % np.uint64(BUCKETS)).astype(np.int64) for k in (1, 2, 3)]
    for i in range(len(offsets) - 1):
        a, b = int(offsets[i]), int(offsets[i + 1])
        on = np.zeros(BUCKETS, dtype=bool)
        for k in range(3):
            on[byte[k][a : max(a, b - k)]] = True
        a, b = int(w.first[i]), int(w.first[i + 1])
        for k in range(3):
            on[shapes[k][a : max(a, b - k)]] = True
        yield np.flatnonzero(on).astype(np.int32)


def fit(rows: list[np.ndarray], labels: np.ndarray, c: float = 1.0, alpha: float = 1.0, epochs: int = 12, tolerance: float = 1e-4, seed: int = 0) -> Model:
    """labels are 0 and 1.  Without one of the two, the score is the share of 1 (1/2 without rows) for every text."""
    n, positive = len(rows), int(labels.sum())
    if not n or positive in (0, n):
        share = (positive + 1) / (n + 2)
        return Model(np.zeros(BUCKETS), 0.0, 0.0, float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    order = rng.permutation(n)
    apart = order[: n // 5] if n >= 50 else order  # for the logistic curve
    train = order[n // 5 :] if n >= 50 else order
    if len(set(labels[train].tolist())) < 2 or len(set(labels[apart].tolist())) < 2:
        train = apart = order
    p, q = np.full(BUCKETS, alpha), np.full(BUCKETS, alpha)
    for i in train.tolist():
        (p if labels[i] else q)[rows[i]] += 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    y = np.where(labels == 1, 1.0, -1.0)
    scaled = {i: ratio[rows[i]] for i in train.tolist()}
    norm = {i: float(v @ v) + 1 for i, v in scaled.items()}
    w, bias = np.zeros(BUCKETS), 0.0
    dual = np.zeros(n)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(train).tolist():
            v, at = scaled[i], rows[i]
            gradient = y[i] * (float(w[at] @ v) + bias) - 1
            new = min(max(dual[i] - gradient / norm[i], 0.0), c)
            step = (new - dual[i]) * y[i]
            if step:
                w[at] += step * v
                bias += step
                dual[i] = new
                worst = max(worst, abs(step))
        if worst < tolerance:
            break
    weights = w * ratio
    margin = np.array([weights[rows[i]].sum() + bias for i in apart.tolist()])
    slope, shift = logistic(margin, labels[apart])
    return Model(weights, bias, slope, shift)


def logistic(x: np.ndarray, labels: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Platt's curve: slope and shift of the log-odds, targets drawn in by one count, by Newton's method."""
    n1 = labels.sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (len(labels) - n1 + 2))
    scale = float(np.std(x)) or 1.0
    z = x / scale
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -35, 35)))
        g = np.array([((p - target) * z).sum() + 1e-3 * a, (p - target).sum()])
        d = p * (1 - p) + 1e-9
        hess = np.array([[(d * z * z).sum() + 1e-3, (d * z).sum()], [(d * z).sum(), d.sum() + 1e-9]])
        move = np.linalg.solve(hess, g)
        move = np.clip(move, -3, 3)
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-8:
            break
    return float(a / scale), float(b)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 1 << 20):
        rows = list(indicators(*text_buffer(batch.column("text"))))
        values = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        offsets = np.append(0, np.cumsum([len(r) for r in rows]))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("label"), packed(values, offsets)], names=["doc", "label", "active"])


def _fit_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs, labels, rows = [], [], []
    for batch in batches:
        values, offsets = unpacked(batch.column("active"), np.int32)
        rows += [values[a:b].copy() for a, b in zip(offsets, offsets[1:])]
        docs += batch.column("doc").to_pylist()
        labels += batch.column("label").to_pylist()
    order = np.argsort(np.array(docs, dtype=np.int64), kind="stable")  # the order of arrival is not fixed
    model = fit([rows[i] for i in order], np.array(labels, dtype=np.int64)[order])
    yield pa.RecordBatch.from_pydict({"w": pa.array([model.weights.tobytes()], pa.binary()), "b": [model.bias], "slope": [model.slope], "shift": [model.shift]})


def train(docs: DataFrame, labels: DataFrame, usable: Column, label_col: str = "quality", most: int = 12_000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most ``most`` labelled documents that ``usable`` (over ``labels``) admits, in one task."""
    rows = sample(docs, labels, label_col, usable, most, False, id_col, text_col)
    features = rows.mapInArrow(_features, "doc long, label int, active binary")
    r = features.repartition(1).mapInArrow(_fit_all, "w binary, b double, slope double, shift double").first()
    if r is None:
        return fit([], np.zeros(0, np.int64))
    return Model(np.frombuffer(r.w, dtype=np.float64), r.b, r.slope, r.shift)


def scores(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """The score of a text column of ``docs``, 0 to 1; null texts count as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            batch = pa.RecordBatch.from_arrays([column], names=["text"])
            yield pa.array([shared.value.score(x) for part in slices(iter([batch]), "text", 1 << 20) for x in indicators(*text_buffer(part.column("text")))], pa.float64())

    return score(F.col(text_col).cast("string"))


def classify(docs: DataFrame, model: Model, held_out: Column, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; null ids and repeated rows stay."""
    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), scores(docs, model, text_col).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
