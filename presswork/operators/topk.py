"""First rows and places within groups of which one may hold most rows: no task sorts a group as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswork.functions.shared import stored


def top_per_group(rows: DataFrame, group: tuple[str, ...], k: Column, order: tuple[Column, ...], key: tuple[str, ...], name: str = "rn") -> DataFrame:
    """The first k rows of each group (k may differ by group, null: none) with their place from 1. Every group is dealt to as many parts as a shuffle has,
    each part is cut to its first k, and the places are taken among what is left: at most parts x k rows a group.
    `order` has to be total; `key` deals the rows out."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64(*key), F.lit(max(2, parts)))
    some = rows.withColumn("_part", part).withColumn("_rn", F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order))).where(F.col("_rn") <= k)
    return some.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= k).drop("_part", "_rn")


def places(rows: DataFrame, group: str, order: tuple[Column, ...], name: str = "place") -> DataFrame:
    """Every row with its place from 1 within its group. `order` has to be total.

    Rows are dealt to ranges of (group, order) and numbered within each range; the rows that a group has in the ranges before are added. One row a
    range and group is all that is looked at together.
    """
    spread = stored(rows).repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    numbered = stored(spread.select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_at")))
    sizes = numbered.groupBy(group, "_range").agg(F.min("_at").alias("first"), F.count("*").alias("n"))
    ranges = sizes.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("_range", "first", "n"))).alias("r"))
    ahead = F.transform("r", lambda x, i: F.struct(x["_range"].alias("_r"), x["first"].alias("_first"), F.aggregate(F.slice("r", F.lit(1), i), F.lit(0).cast("long"), lambda s, y: s + y["n"]).alias("_before")))
    offsets = ranges.select(F.col(group).alias("_g"), F.inline(ahead))
    met = numbered.join(offsets, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    return met.withColumn(name, F.col("_at") - F.col("_first") + F.col("_before") + 1).drop("_g", "_r", "_range", "_at", "_first", "_before")
