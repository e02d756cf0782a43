"""Quality selection by ordinal cumulative-link regression on hashed text.

Graded ratings 0 < 1 < ... < G-1 share one weight vector; ordered thresholds cut its score: P(grade >= g) = sigmoid(score - threshold_g).
Features are hashed lower-cased runs of letters (present or not), hashed byte trigrams (root of their share) and a few plain shares; a
hashed feature takes part when it differs clearly between texts below and from some grade on, by a limit that follows the number of
features, not of rows. The model is fitted
on at most ``max_rated`` rated rows, those with the least hash of their id and text, on the driver; every text is scored where it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from comptoir.llm._hashing import _LOWER, as_bytes, mix, prefix_sums, range_hash, word_bounds, word_runs

WORD_BITS, GRAM_BITS, PLAIN = 16, 14, 8
SIZE = (1 << WORD_BITS) + (1 << GRAM_BITS) + PLAIN
#: Rows used to fit at most.
MAX_RATED = 6000


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text's features; indices are distinct."""
    raw = as_bytes(text)
    data = _LOWER[raw]
    start, end = word_bounds(data)
    count = len(start)
    distinct = np.zeros(0, np.uint64)
    if count:
        sums = prefix_sums(data)
        distinct = np.unique(range_hash(sums, *word_runs(data)))
        spread = len(np.unique(range_hash(sums, start, end))) / count
    else:
        spread = 0.0
    index = [np.unique(distinct >> np.uint64(64 - WORD_BITS)).astype(np.int64)]
    value = [np.ones(len(index[0]), dtype=np.float32)]
    if len(raw) >= 3:
        b = raw.astype(np.uint64)
        grams = mix(b[:-2] | b[1:-1] << np.uint64(8) | b[2:] << np.uint64(16)) >> np.uint64(64 - GRAM_BITS)
        found, times = np.unique(grams, return_counts=True)
        index.append(found.astype(np.int64) + (1 << WORD_BITS))
        value.append((2 * np.sqrt(times / len(grams))).astype(np.float32))
    n = max(1, len(raw))
    upper, digit = ((raw >= 65) & (raw <= 90)).sum() / n, ((raw >= 48) & (raw <= 57)).sum() / n
    marks = (((raw >= 33) & (raw <= 47)) | ((raw >= 58) & (raw <= 64)) | (raw >= 123) & (raw <= 126)).sum() / n
    plain = np.array([1, 4 * upper, 4 * digit, 4 * marks, spread, (np.log1p(count) / 10), min(4.0, n / max(1, count) / 8), float(count == 0)], dtype=np.float32)
    index.append(np.arange(SIZE - PLAIN, SIZE))
    value.append(plain)
    return np.concatenate(index), np.concatenate(value)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, text: str | None) -> np.ndarray:
        """P(grade >= g) for g = 1, 2, ..."""
        index, value = features(text)
        return _sigmoid(float(self.weights[index] @ value) - self.thresholds)


def _surprise(hits: np.ndarray, n: int) -> np.ndarray:
    """Log-likelihood of ``hits`` among ``n`` at their own rate."""
    rate = np.clip(hits / max(1, n), 1e-12, 1 - 1e-12)
    return hits * np.log(rate) + (n - hits) * np.log1p(-rate)


def _telling(row: np.ndarray, col: np.ndarray, val: np.ndarray, grades: np.ndarray, clear: float | None) -> np.ndarray:
    """Which features take part: the plain ones, and hashed ones whose score at some grade is above ``clear``.

    A word's score is the root of its log-likelihood ratio, a trigram's the z-score of its mean. The default limit lets about one of the
    features that stand in the rows pass by chance, whatever the number of rows.
    """
    words = 1 << WORD_BITS
    used = np.zeros(SIZE, dtype=bool)
    used[-PLAIN:] = True
    if clear is None:
        clear = np.sqrt(2 * np.log(max(2, np.count_nonzero(np.bincount(col, minlength=SIZE)[:-PLAIN]))))
    for g in range(1, int(grades.max()) + 1):
        side = (grades >= g)[row]
        means, spreads, hits, counts = [], [], [], []
        for mask, n in ((side, (grades >= g).sum()), (~side, (grades < g).sum())):
            mean = np.bincount(col[mask], weights=val[mask], minlength=SIZE) / max(1, n)
            means.append(mean)
            spreads.append((np.bincount(col[mask], weights=val[mask] ** 2, minlength=SIZE) / max(1, n) - mean**2 + 1 / max(1, n)) / max(1, n))
            hits.append(np.bincount(col[mask], minlength=SIZE)[:words].astype(np.float64))
            counts.append(n)
        ratio = 2 * (_surprise(hits[0], counts[0]) + _surprise(hits[1], counts[1]) - _surprise(hits[0] + hits[1], sum(counts)))
        used[:words] |= ratio > clear**2
        used[words:] |= np.abs(means[0] - means[1])[words:] > clear * np.sqrt(spreads[0] + spreads[1])[words:]
    return used


def fit_rows(texts: list[str], grades: np.ndarray, *, epochs: int = 500, rate: float = 0.05, decay: float = 1e-2, clear: float | None = None) -> Model:
    """Full-batch Adam on the cumulative log-likelihood, over the features that tell grades apart (``_telling``)."""
    return fit_features([features(t) for t in texts], grades, epochs=epochs, rate=rate, decay=decay, clear=clear)


def fit_features(parts: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, *, epochs: int = 500, rate: float = 0.05, decay: float = 1e-2, clear: float | None = None) -> Model:
    """``fit_rows`` on the features of the texts."""
    size = np.array([len(i) for i, _ in parts])
    row, col, val = np.repeat(np.arange(len(parts)), size), np.concatenate([i for i, _ in parts]), np.concatenate([v for _, v in parts])
    used = _telling(row, col, val, grades, clear)
    row, col, val = row[used[col]], col[used[col]], val[used[col]].astype(np.float64)
    top = int(grades.max())
    start = np.linspace(-1, 1, top) if top > 1 else np.zeros(1)
    theta = np.concatenate([np.zeros(SIZE), start[:1], np.log(np.diff(start))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, epochs + 1):
        score = np.bincount(row, weights=theta[col] * val, minlength=len(grades))
        cuts = theta[SIZE] + np.concatenate([[0], np.cumsum(np.exp(theta[SIZE + 1 :]))])
        tail = _sigmoid(score[:, None] - cuts)
        high = np.concatenate([np.ones((len(grades), 1)), tail], axis=1)
        low = np.concatenate([tail, np.zeros((len(grades), 1))], axis=1)
        here = np.arange(len(grades))
        p = np.maximum(high[here, grades] - low[here, grades], 1e-9)
        slope_high, slope_low = high[here, grades] * (1 - high[here, grades]), low[here, grades] * (1 - low[here, grades])
        by_score = -(slope_high - slope_low) / p / len(grades)
        by_cut = np.zeros(top)
        for g in range(1, top + 1):
            by_cut[g - 1] = (1 / p / len(grades) * ((grades == g) * slope_high - (grades == g - 1) * slope_low)).sum()
        back = np.cumsum(by_cut[::-1])[::-1]
        grad = np.concatenate([np.bincount(col, weights=by_score[row] * val, minlength=SIZE), back[:1], back[1:] * np.exp(theta[SIZE + 1 :])])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        theta[:SIZE] *= 1 - rate * decay
    return Model(theta[:SIZE].astype(np.float32), theta[SIZE] + np.concatenate([[0], np.cumsum(np.exp(theta[SIZE + 1 :]))]))


def grades_of(labels: DataFrame) -> DataFrame:
    """Rows (doc_id, grade): 0, 1 or 2, one for good quality and one for not being toxic. Several ratings of a document are averaged down."""
    grade = F.col("quality") + 1 - F.col("toxic")
    return labels.select("doc_id", grade.alias("grade")).dropna().groupBy("doc_id").agg(F.floor(F.avg("grade")).cast("int").alias("grade"))


def fit(df: DataFrame, grades: DataFrame, id_column: str = "doc_id", text: str = "text", *, max_rated: int = MAX_RATED) -> Model | None:
    """The model of the rows of ``df`` with at most ``max_rated`` of the ids in ``grades`` (doc_id, grade), those of least hash of id and grade.

    The ids are chosen before any text is read, and only theirs, at most ``max_rated``, are sent to the tasks, which give back features;
    so no text is shuffled or collected. Null texts, ids and grades are left out, and of equal features with one grade all but one. None
    if fewer than two grades are left.
    """
    known = df.select(F.col(f"`{id_column}`").alias("doc_id")).dropna().distinct()
    rated = grades.select("doc_id", F.col("grade").cast("int").alias("grade")).dropna().join(known, "doc_id").withColumn("h", F.xxhash64("doc_id", "grade"))
    chosen = F.broadcast(rated.orderBy("h", "doc_id").limit(max_rated))
    rows = df.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("t")).dropna().join(chosen, "doc_id").select("h", "grade", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [features(t.as_py()) for t in batch.column(2)]
            arrays = [pa.array([p[k].astype(kind).tobytes() for p in parts], pa.binary()) for k, kind in ((0, np.int64), (1, np.float64))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["h", "grade", "i", "v"])

    found = {(r.grade, bytes(r.i), bytes(r.v)): r.h for r in rows.mapInArrow(run, "h long, grade int, i binary, v binary").toLocalIterator()}
    ordered = sorted((h, *key) for key, h in found.items())
    labels = [o[1] for o in ordered]
    if len(set(labels)) < 2 or min(labels) < 0:
        return None
    return fit_features([(np.frombuffer(i, dtype=np.int64), np.frombuffer(v, dtype=np.float64)) for _, _, i, v in ordered], np.array(labels))


def score(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``df`` with ``expected_grade`` and ``p_top``, the probability of the highest grade. Without a model both are null. Null text counts
    as empty. No shuffle; columns of ``df`` with these names are replaced."""
    keep = [c for c in df.columns if c not in ("expected_grade", "p_top")]
    base = df.select(*[F.col(f"`{c}`") for c in keep])
    if model is None:
        return base.withColumn("expected_grade", F.lit(None).cast("double")).withColumn("p_top", F.lit(None).cast("double"))
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("expected_grade", T.DoubleType()), T.StructField("p_top", T.DoubleType())])
    sent = df.sparkSession.sparkContext.broadcast(model)
    at = keep.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tails = [sent.value.tails(x.as_py()) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([float(t.sum()) for t in tails], pa.float64()), pa.array([float(t[-1]) for t in tails], pa.float64())], names=schema.names)

    return base.mapInArrow(run, schema)


def select(df: DataFrame, model: Model | None, text: str = "text", *, least: float = 0.5) -> DataFrame:
    """The rows of ``df`` whose probability of the highest grade is ``least`` or more, with their scores; all rows without a model."""
    scored = score(df, model, text)
    return scored if model is None else scored.filter(F.col("p_top") >= least)
