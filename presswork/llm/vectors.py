"""Embedding near-duplicates by randomised-rotation binary codes.

Unit vectors are rotated by one random orthonormal map. Stored for each different vector are the signs as packed bits, the
code's own inner product with the vector as a correction factor, and the rotated values in a byte each: a code's product with another vector's
bytes, divided by the code's factor, is an unbiased estimate of their inner product, up to the rounding of the bytes, with an error bound that follows from the factor. Bands
of code bits bucket the vectors (within a label). Buckets move codes, not vectors: pairs whose estimate and bounds
stay under the threshold are rejected, and only rows with a pair that is left fetch their vectors, for the cosine in double precision.

Bucketing is a search with a recall below 1: `tables` bands are taken so that a pair just at the
threshold is missed with a probability of at most `miss`. Large buckets are split into blocks that are
joined pairwise, equal vectors collapse first, and a bucket returns counts and a spanning star of
its links, not its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.llm import common

BLOCK_ROWS = 1024
#: Rows a bucket is aimed at, and standard errors of the confidence bound.
BUCKET_ROWS = 256
ERRORS = 3.5
#: Rotated values that are worked on at once.
MOST_VALUES = 1 << 21


class Rotation:
    """A random orthonormal map of `dim` values into `bits` >= 2 * dim values, the same in every task: three rounds of random
    signs and a Walsh-Hadamard transform, so that a long vector needs no matrix."""

    def __init__(self, dim: int, seed: int = 10) -> None:
        self.bits = max(128, 1 << (2 * dim - 1).bit_length())
        self.flips = np.random.default_rng([seed, dim]).choice([-1.0, 1.0], (3, self.bits))

    def rotate(self, unit: np.ndarray) -> np.ndarray:
        x = np.zeros((len(unit), self.bits))
        x[:, : unit.shape[1]] = unit
        for flip in self.flips:
            x *= flip
            half = 1
            while half < self.bits:
                pairs = x.reshape(len(x), -1, 2, half)
                x = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(len(x), -1)
                half *= 2
            x /= math.sqrt(self.bits)
        return x

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(packed sign bits, correction factors, rotated values as bytes, their scales)."""
        rotated = self.rotate(unit)
        scale = np.abs(rotated).max(axis=1) / 127
        return np.packbits(rotated >= 0, axis=1), np.abs(rotated).sum(axis=1) / math.sqrt(self.bits), np.rint(rotated / scale[:, None]).astype(np.int8), scale

    def estimates(self, positive: np.ndarray, factor: np.ndarray, near: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """Estimated inner products of codes (rows; unpacked bits) with bytes (columns)."""
        return (positive * np.float32(2) - np.float32(1)) @ near.T * (scale[None, :] / math.sqrt(self.bits)) / factor[:, None]

    def errors(self, factor: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """Bounds of the estimates: ERRORS standard errors of the code, and the most that rounding adds."""
        code = ERRORS * np.sqrt(np.maximum(0.0, 1 - factor**2)) / factor / math.sqrt(self.bits - 1)
        return code[:, None] + math.sqrt(self.bits) / 2 * scale[None, :] / factor[:, None]

    def bands(self, positive: np.ndarray, tables: int, width: int) -> np.ndarray:
        """Band keys (rows x tables): `width` code bits chosen at random for each table."""
        rng = np.random.default_rng([tables, width, self.bits])
        pick = np.stack([rng.choice(self.bits, width, replace=False) for _ in range(tables)]) if width else np.zeros((tables, 0), int)
        return ((positive[:, pick] > 0).astype(np.int64) << np.arange(width)).sum(axis=2)


@lru_cache(maxsize=16)
def _rotation(dim: int) -> Rotation:
    return Rotation(dim)


def _unit(vectors: pa.Array, dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors.to_pylist()), np.float64).reshape(-1, dim)
    return x / np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(axis=1, keepdims=True)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes of doubles; rows with a null, not finite or zero vector go."""
    for batch in batches:
        rows, raw, dims = [], [], []
        for i, v in enumerate(batch["vector"].to_pylist()):
            if v and None not in v:
                x = np.array(v, np.float64) + 0.0
                if np.isfinite(x).all() and x.any():
                    rows.append(i)
                    raw.append(x.tobytes())
                    dims.append(len(x))
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([batch["id"].take(at), batch["label"].take(at), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())], ["id", "label", "dim", "vector"])


CODED = "id long, label string, dim int, copies long, code binary, factor double, near binary, scale double"


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for dim in np.unique(batch["dim"].to_numpy()).tolist():
            every, rotation = batch.filter(pa.array(batch["dim"].to_numpy() == dim)), _rotation(dim)
            as_bytes = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
            step = max(1, MOST_VALUES // rotation.bits)
            for at in range(0, every.num_rows, step):
                own = every.slice(at, step)
                code, factor, near, scale = rotation.encode(_unit(own["vector"], dim))
                yield pa.RecordBatch.from_arrays([own["id"], own["label"], own["dim"], own["copies"], as_bytes(code), pa.array(factor), as_bytes(near), pa.array(scale)], ["id", "label", "dim", "copies", "code", "factor", "near", "scale"])


def _bits(codes: pa.Array) -> np.ndarray:
    """Rows of 0 and 1."""
    raw = codes.to_pylist()
    return np.unpackbits(np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1), axis=1)


def _banded(tables: int, width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim in np.unique(batch["dim"].to_numpy()).tolist():
                own = batch.filter(pa.array(batch["dim"].to_numpy() == dim))
                bands = _rotation(dim).bands(_bits(own["code"]), tables, width)
                for t in range(tables):
                    n = own.num_rows
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(np.full(n, t, np.int32)), pa.array(bands[:, t])], [*own.schema.names, "t", "band"])

    return run


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest member index of each of n points' component under links (i, j)."""
    top = np.arange(n)
    while True:
        before = top.copy()
        low = np.minimum(top[i], top[j])
        np.minimum.at(top, i, low)
        np.minimum.at(top, j, low)
        top = top[top]
        if (top == before).all():
            return top


def _grouped(settle: Callable) -> Callable:
    """Runs `settle` on the rows of each group, which come one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None
        for batch in batches:
            group = np.array(batch["group"].to_pylist(), object)
            if not len(group):
                continue
            cuts = np.flatnonzero(group[1:] != group[:-1]) + 1
            for a, b in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(group)])), strict=True):
                if held and group[a] != at:
                    yield from settle(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    held = []
                at = group[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from settle(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run


PLACE = "group string, id long, copies long, code binary, block int, dim int, t int, lo int, hi int"


def _undecided(threshold: float) -> Callable:
    """The rows of one block pair of one bucket that have a pair whose estimate and bounds reach the threshold. Codes alone decide."""

    def settle(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n = rows.num_rows
        if n < 2:
            return
        dim, lo, hi = (rows[c][0].as_py() for c in ("dim", "lo", "hi"))
        rotation = _rotation(dim)
        side, factor, scale = (rows[c].to_numpy() for c in ("block", "factor", "scale"))
        positive = _bits(rows["code"])
        near = np.frombuffer(b"".join(rows["near"].to_pylist()), np.int8).reshape(n, -1).astype(np.float32)
        left = np.zeros(n, bool)
        for a in range(0, n, 256):
            b = min(n, a + 256)
            maybe = rotation.estimates(positive[a:b], factor[a:b], near, scale) + rotation.errors(factor[a:b], scale) >= threshold
            maybe[np.arange(b - a), np.arange(a, b)] = False
            if lo != hi:
                maybe &= side[a:b, None] != side[None, :]
            left[a:b] |= maybe.any(axis=1)
            left |= maybe.any(axis=0)
        if left.any():
            yield rows.select([c.split(" ")[0] for c in PLACE.split(", ")]).filter(pa.array(left))

    return _grouped(settle)


def _links(threshold: float, tables: int, width: int) -> Callable:
    """(id, links, root) of the vectors left in one block pair of one bucket."""

    def settle(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n = rows.num_rows
        if n < 2:
            return
        rows = rows.take(pa.array(np.argsort(rows["id"].to_numpy(), kind="stable")))
        dim, t, lo, hi = (rows[c][0].as_py() for c in ("dim", "t", "lo", "hi"))
        ids, copies, side = rows["id"].to_numpy(), rows["copies"].to_numpy(), rows["block"].to_numpy()
        x = _unit(rows["vector"], dim)
        found_i, found_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a in range(0, n, 256):
            b = min(n, a + 256)
            close = x[a:b] @ x.T >= threshold - 1e-9
            close &= np.arange(a, b)[:, None] < np.arange(n)[None, :]
            if lo != hi:
                close &= side[a:b, None] != side[None, :]
            i, j = np.nonzero(close)
            i += a
            for s in range(0, len(i), 200_000):
                p, q = i[s : s + 200_000], j[s : s + 200_000]
                exact = np.einsum("ij,ij->i", x[p], x[q]) >= threshold
                found_i.append(p[exact])
                found_j.append(q[exact])
        i, j = np.concatenate(found_i), np.concatenate(found_j)
        bands = _rotation(dim).bands(_bits(rows["code"]), tables, width)
        first = ~(bands[i, :t] == bands[j, :t]).any(axis=1)  # else an earlier table has counted the pair
        i, j = i[first], j[first]
        if not len(i):
            return
        links = np.bincount(i, weights=copies[j], minlength=n) + np.bincount(j, weights=copies[i], minlength=n)
        some = np.flatnonzero(links > 0)
        root = _roots(n, i, j)
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some].astype(np.int64)), pa.array(ids[root[some]])], ["id", "links", "root"])

    return _grouped(settle)


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98, miss: float = 0.002) -> DataFrame:
    """(key, n_links, component_id, kept) of every row with a key.

    Rows link when their labels are equal and not null and their cosine is at least `threshold`; only
    vectors of the same length can link. A vector that is null, empty or zero or holds a null or a component
    that is not finite links with nothing. n_links counts other rows, copies among them; component_id is the
    smallest key reachable, kept marks it. Keys must be unique: rows that repeat one count as
    copies of each other. Rows with a null key are left out, other columns ignored; an empty table gives an empty one.
    """
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("vector")).where("id is not null")
    good = common.stored(rows.where("label is not null and vector is not null").mapInArrow(_pack, "id long, label string, dim int, vector binary"))
    classes = common.stored(good.groupBy("label", "dim", "vector").agg(F.min("id").alias("id"), F.count("*").alias("copies")))
    largest = classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    width = min(30, max(0, math.ceil(math.log2(max(1, largest / BUCKET_ROWS)))))
    alike = (1 - math.acos(min(1.0, threshold)) / math.pi) ** width
    tables = 1 if alike >= 1 else max(1, math.ceil(math.log(miss) / math.log(1 - alike)))

    codes = common.stored(classes.mapInArrow(_coded, CODED))
    banded = common.stored(codes.mapInArrow(_banded(tables, width), f"{CODED}, t int, band long"))
    bucket = ["label", "dim", "t", "band"]
    sizes = banded.groupBy(*bucket).agg(F.count("*").alias("rows")).where("rows > 1")
    # blocks of long vectors have fewer rows
    blocks = F.ceil(F.col("rows") / F.greatest(F.lit(4), F.least(F.lit(BLOCK_ROWS), F.floor(MOST_VALUES / 4 / F.col("dim"))))).cast("int")
    spread = (
        banded.join(sizes, bucket)
        .withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
        .withColumn("group", F.md5(F.concat_ws("/", F.col("label"), "dim", "t", "band", "lo", "hi")))
        .select("group", "id", "copies", "code", "block", "dim", "t", "lo", "hi", "factor", "near", "scale")
    )
    by_group = lambda df: df.repartition("group").sortWithinPartitions("group")
    left = common.stored(by_group(spread).mapInArrow(_undecided(threshold), PLACE))
    fetched = left.join(classes.select("id", "vector"), "id")
    found = common.stored(by_group(fetched).mapInArrow(_links(threshold, tables, width), "id long, links long, root long"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    parts = common.components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    by_class = classes.join(links, "id", "left").join(parts.withColumnRenamed("node", "id"), "id", "left")
    by_class = by_class.select("label", "dim", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    named = good.join(by_class, ["label", "dim", "vector"]).select("id", "n_links", "component_id")
    named = named.groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = rows.select("id").join(named, "id", "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.select(F.col("id").alias(key), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def op10_rotated_codes(spark, sf_dir: str) -> DataFrame:
    return near_vectors(common.table(spark, sf_dir, "embeddings"))


def brute_force(rows: list[tuple], threshold: float) -> dict[int, tuple[int, int]]:
    """(links, component) by id from (id, vector, label), comparing all pairs."""
    good = [(k, np.array(v, float), lab) for k, v, lab in rows if lab is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    top = {k: k for k, _, _ in rows}
    links = dict.fromkeys(top, 0)

    def root(k: int) -> int:
        while top[k] != k:
            k = top[k]
        return k

    for a in range(len(good)):
        for b in range(a + 1, len(good)):
            (k, x, p), (m, y, q) = good[a], good[b]
            if p == q and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links[k] += 1
                links[m] += 1
                u, v = sorted((root(k), root(m)))
                top[v] = u
    return {k: (links[k], root(k)) for k in top}
