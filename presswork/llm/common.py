"""Helpers shared by the operators: tables, written intermediates, fixed-size filters, components."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.functions.shared import shared_dir

#: Words as the contracts define them.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: lineage ends, lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bitmap(df: DataFrame, column: str, most_bits: int = 27) -> np.ndarray:
    """Bitmap of the hashes of a long column: some 16 bits a row, 2**most_bits (16 MB) at most.

    It is only ever a filter ahead of an exact step: a fuller bitmap lets more through.
    """
    log2_bits = min(most_bits, max(16, (16 * df.count()).bit_length()))
    slot = F.pmod(F.xxhash64(F.col(column)), F.lit(1 << log2_bits))
    rows = (
        df.select(slot.alias("slot"))
        .select(F.shiftright("slot", 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .toPandas()
    )
    words = np.zeros(1 << (log2_bits - 6), dtype=np.int64)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return words


def may_be_in(words: np.ndarray, column: str) -> Column:
    """Whether a long column may be in a bitmap(); a null is not. Only this column goes to Python."""

    def test(values: pa.Array) -> pa.Array:
        return pa.array(in_bitmap(words, values.fill_null(0).to_numpy(zero_copy_only=False)) & values.is_valid().to_numpy(zero_copy_only=False))

    return F.arrow_udf(test, "boolean")(F.col(column).cast("long"))


def spark_xxhash64(values: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of a long column, seed 42, for int64 values."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def rot(x: np.ndarray, r: int) -> np.ndarray:
        return (x << np.uint64(r)) | (x >> np.uint64(64 - r))

    with np.errstate(over="ignore"):
        v = np.ascontiguousarray(values).view(np.uint64)
        h = np.uint64(42) + p5 + np.uint64(8)
        h = h ^ (rot(v * p2, 31) * p1)
        h = rot(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return h ^ (h >> np.uint64(32))


def in_bitmap(words: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which int64 values may be in a bitmap() of them."""
    slot = (spark_xxhash64(values) & np.uint64(len(words) * 64 - 1)).astype(np.int64)
    return (words[slot >> 6] >> (slot & 63)) & 1 == 1


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node in `edges`: component is the smallest node reachable.

    Each round maps every node to its smallest neighbour twice over and contracts the graph, so
    the graph left over shrinks geometrically; only its edge count comes to the driver. Self-loops
    are allowed and make a component of one. Null ends are ignored.
    """
    pairs = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null")
    pairs = stored(pairs.distinct())
    labels = stored(pairs.select("a").union(pairs.select("b")).distinct().select(F.col("a").alias("node"), F.col("a").alias("component")))
    live = pairs.where("a <> b")
    while not live.isEmpty():
        both = live.union(live.select(F.col("b"), F.col("a")))
        step = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to"))
        hop = step.select(F.col("a").alias("to"), F.col("to").alias("further"))
        step = stored(step.join(hop, "to", "left").select("a", F.coalesce("further", "to").alias("to")))
        as_b = step.select(F.col("a").alias("b"), F.col("to").alias("to_b"))
        live = stored(
            live.join(step, "a").join(as_b, "b").select(F.col("to").alias("a"), F.col("to_b").alias("b")).where("a <> b")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        )
        labels = stored(
            labels.join(step.withColumnRenamed("a", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        )
    return labels


def without(docs: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """`docs` without the rows whose key is in `dropped`; only rows that may be go through the join."""
    may = may_be_in(bitmap(dropped.select(F.col(key).cast("long").alias("gone")), "gone"), key)
    return docs.where(~may).union(docs.where(may).join(dropped.select(key), key, "left_anti").select(*docs.columns))
