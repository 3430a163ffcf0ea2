"""Cumulative-link (proportional odds) ordinal regression on hashed text features.

P(grade <= k) = sigmoid(threshold_k - w . x): one weight vector, shared by all grades, and ordered
thresholds. A document's features are the distinct hashed words of the whole text and a few
tokens that describe its shape. The model is fitted with numpy on a bounded sample of labelled
rows, whose features are made in Spark; scoring is a map over rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.llm import textops

#: log2 of the feature space, and most labelled rows a model is fitted on.
FEATURE_BITS = 18
MAX_LABELLED = 8_000

#: Bytes of the word beginnings that are features too, where shape tokens are not asked for.
PREFIXES = (4, 6, 8)

LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = True


def _levels(name: int, value: np.ndarray, edges: list[float]) -> np.ndarray:
    """A shape token for the interval each value lies in."""
    return textops.mix(np.searchsorted(edges, value, side="right").astype(np.uint64) + np.uint64(name * 1000 + 17))


def features(data: np.ndarray, offsets: np.ndarray, powers: textops.Powers, shape: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of each row, concatenated, with offsets."""
    rows = len(offsets) - 1
    start, end, row = textops.words(data, offsets)
    if not len(start):
        h = np.zeros(0, np.uint64)
    else:
        cum, down = textops.prefix_hash(data, textops.CODES_LOWER, powers)
        inner = np.where((end - start > 1) & ~LETTERS[data[end - 1]], end - 1, end)
        h = textops.span_hash(cum, down, start, inner)
    parts = [h]
    owners = [row]
    for n in PREFIXES if len(start) and not shape else ():
        far = inner - start > n  # a shorter word is its own prefix
        parts.append(textops.span_hash(cum, down, start[far], start[far] + n) ^ np.uint64(n))
        owners.append(row[far])
    if shape:
        n = np.maximum(1, np.diff(offsets))
        words = np.bincount(row, minlength=rows)
        count = lambda mask: np.add.reduceat(np.append(mask.astype(np.int64), 0), np.minimum(offsets[:-1], len(mask))) * (np.diff(offsets) > 0)
        distinct = np.diff(textops.distinct_by_row(h, row, rows)[1])
        values = [
            _levels(1, count(SYMBOL[data]) / n, [0.001, 0.005, 0.02, 0.05, 0.1, 0.2]),
            _levels(2, count((data >= 48) & (data < 58)) / n, [0.001, 0.01, 0.03, 0.1, 0.3]),
            _levels(3, np.log2(words + 1), [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13]),
            _levels(4, distinct / np.maximum(1, words), [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]),
            _levels(5, count((data >= 65) & (data < 91)) / n, [0.005, 0.01, 0.02, 0.05, 0.1, 0.3, 0.6]),
            _levels(6, count(data == 10) / n, [0.0005, 0.002, 0.005, 0.01, 0.03]),
            _levels(7, n / np.maximum(1, words), [2, 3, 4, 5, 6, 7, 8, 10, 15]),
        ]
        parts += values
        owners += [np.arange(rows)] * len(values)
    all_h, owner = np.concatenate(parts), np.concatenate(owners)
    slot = (textops.mix(all_h) >> np.uint64(64 - FEATURE_BITS)).astype(np.uint64)
    order = np.argsort(owner, kind="stable")
    return textops.distinct_by_row(slot[order], owner[order], rows)


def _featured(shape: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = textops.Powers()
        for batch in batches:
            data, offsets = textops.column_bytes(batch["text"])
            for i, j in textops.slices(offsets):
                f, off = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], powers, shape)
                yield pa.RecordBatch.from_arrays([batch["grade"].slice(i, j - i), textops.binary_array(f.astype(np.int32), off)], ["grade", "features"])

    return run


@dataclass
class Model:
    """weights by feature number, ordered thresholds, and the grades they part."""

    weights: np.ndarray
    thresholds: np.ndarray
    grades: list[int]
    shape: bool

    def at_most(self, score: np.ndarray) -> np.ndarray:
        """P(grade <= k) for all grades but the highest (rows x thresholds)."""
        return 1 / (1 + np.exp(-(self.thresholds[None, :] - score[:, None])))

    def expected(self, score: np.ndarray) -> np.ndarray:
        steps = np.diff(np.array(self.grades, float))
        return self.grades[0] + ((1 - self.at_most(score)) * steps).sum(axis=1)


def draw() -> Column:
    """A hash of the text, by which samples are drawn; null for a null text."""
    return F.when(F.col("text").isNotNull(), F.xxhash64("text", F.lit(7))).alias("draw")


def fit(rows: DataFrame, shape: bool, max_rows: int = MAX_LABELLED, min_docs: int = 3, l2: float = 1.0, steps: int = 250, min_z: float = 4.0) -> Model | None:
    """Fit on (text, grade) rows, at most `max_rows` different texts, those with the smallest hashes; copies of a text count once,
    with the grade that most of them have. Rows with a null text or grade teach nothing; None if fewer than two grades are left. Features in under `min_docs` rows, or whose rows' mean grade is
    under `min_z` standard errors from that of all, are not used."""
    own = "draw" if "draw" in rows.columns else draw()
    rows = rows.select("text", own, F.col("grade").cast("int").alias("grade")).where("draw is not null and grade is not null")
    last = rows.select("draw").distinct().orderBy("draw").limit(max_rows).agg(F.max("draw")).first()[0]
    drawn = rows.where(F.col("draw") <= last).groupBy("draw").agg(F.min("text").alias("text"), F.mode("grade", True).alias("grade"))
    got = drawn.select("text", "grade").mapInArrow(_featured(shape), "grade int, features binary").toPandas()
    return fit_features(got["grade"].to_numpy(), [np.frombuffer(x, np.int32) for x in got["features"]], shape, min_docs, l2, steps, min_z)


def fit_features(grade: np.ndarray, lists: list[np.ndarray], shape: bool, min_docs: int, l2: float, steps: int, min_z: float) -> Model | None:
    """Fit on the grade and the distinct feature numbers of each row, by gradient steps over all rows."""
    grades = sorted(set(grade.tolist()))
    if len(grades) < 2:
        return None
    order = np.array(sorted(range(len(lists)), key=lambda i: (grade[i], lists[i].tobytes())))
    lists = [lists[i] for i in order]
    y = np.searchsorted(grades, grade[order])
    f, row = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    df = np.bincount(f, minlength=1 << FEATURE_BITS)
    off = np.bincount(f, weights=(y - y.mean())[row], minlength=1 << FEATURE_BITS) / (y.std() * np.sqrt(np.maximum(1, df)))
    use = ((df >= min_docs) & (np.abs(off) >= min_z))[f]
    f, row = f[use], row[use]
    columns, f = np.unique(f, return_inverse=True)
    w = np.zeros(len(columns))
    share = np.cumsum(np.bincount(y, minlength=len(grades)))[:-1] / len(y)
    theta = np.log(share / (1 - share))
    gaps = np.log(np.maximum(1e-3, np.diff(theta)))
    base = theta[:1].copy()
    moments = [np.zeros_like(x) for x in (w, base, gaps) for _ in range(2)]
    for step in range(1, steps + 1):
        theta = np.concatenate((base, base + np.cumsum(np.exp(gaps))))
        score = np.bincount(row, weights=w[f], minlength=len(y))
        bound = np.concatenate(([-np.inf], theta, [np.inf]))
        hi, lo = (1 / (1 + np.exp(-(bound[y + d] - score))) for d in (1, 0))
        p = np.maximum(hi - lo, 1e-9)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p  # of log p by the upper and lower bound
        g_score = d_hi - d_lo  # of -log p by the score
        g_w = np.bincount(f, weights=g_score[row], minlength=len(w)) + l2 * w
        g_theta = np.bincount(y, weights=-d_hi, minlength=len(grades))[:-1] + np.bincount(y, weights=d_lo, minlength=len(grades))[1:]
        g_gaps = np.cumsum(g_theta[::-1])[::-1][1:] * np.exp(gaps)
        for k, (x, g) in enumerate(((w, g_w), (base, g_theta.sum(keepdims=True)), (gaps, g_gaps))):
            m, v = moments[2 * k], moments[2 * k + 1]
            m += 0.1 * (g - m)
            v += 0.02 * (g * g - v)
            x -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.98**step)) + 1e-8) * min(1.0, 4 * (1 - step / (steps + 1)))
    weights = np.zeros(1 << FEATURE_BITS, np.float32)
    weights[columns] = w
    return Model(weights, np.concatenate((base, base + np.cumsum(np.exp(gaps)))), grades, shape)


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = textops.Powers()
        for batch in batches:
            data, offsets = textops.column_bytes(batch["text"])
            for i, j in textops.slices(offsets):
                f, off = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], powers, model.shape)
                score = np.bincount(np.repeat(np.arange(j - i), np.diff(off)), weights=model.weights[f.astype(np.int64)], minlength=j - i)
                tail = pa.array((1 - model.at_most(score)).tolist(), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch["key"].slice(i, j - i), pa.array(model.expected(score)), tail], ["key", "expected", "tails"])

    return run


def score(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, expected grade, tails: P(grade > k) for all grades but the highest) of every row.

    A null text counts as empty; a null key is kept; repeated rows are scored alike; other columns are ignored.
    Without a model both values are null.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    if model is None:
        return rows.select("key", F.lit(None).cast("double").alias("expected"), F.lit(None).cast("array<double>").alias("tails"))
    return rows.mapInArrow(_scored(model), "key long, expected double, tails array<double>")
