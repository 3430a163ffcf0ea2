"""Mixing sources to target weights by Pareto order sampling.

Every document of a source has an expected number of copies; its whole part is certain, and the
rest is an inclusion probability. Documents are ranked by random odds over inclusion odds
and taken in that order until the source's remaining words are reached; the document that would
exceed them gives way to the later one whose size comes nearest to the rest. The rank at which a
source stops is found by narrowing a histogram of ranks, round by round, so no source is ever
sorted or gathered as a whole. Decisions need the source's threshold alone, not a join by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswork.llm import common

#: Bins of one round of narrowing, and rounds; ranks have BITS * ROUNDS bits.
BITS = 12
ROUNDS = 4


def size_of(text: str | Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(common.WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, weight, target) from (source, size): weights repeat over the sources by code
    point, null last; a target stops at `most` times its source, the excess is shared again by weight."""
    # one row a source; sources are a catalogue, so ordering them by name in one task is bounded by it
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    place = F.row_number().over(everything.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    # water filling: sources reach their cap in the order of cap / weight, so one running sum settles all rounds
    cap = F.col("source_size") * most
    full = common.stored(by_source.withColumn("weight", weight).withColumn("cap", cap))
    order = everything.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    words = F.sum("source_size").over(everything) * share
    level = (words - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    filled = full.withColumn("level", level).withColumn("place", F.row_number().over(order))
    stop = F.min(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct("place", "level"))).over(everything)
    target = F.when(F.col("place") < stop["place"], F.col("cap")).otherwise(F.coalesce(stop["level"] * F.col("weight"), F.col("cap")))
    return filled.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, preference: Column | None = None, seed: int = 8) -> DataFrame:
    """The input's columns and _size, _source_size, _target, _copies (a whole number, 0 to ceil(most)).

    `preference` is a positive factor (default: all alike) that tilts a source's expected copies: they stay within 0 and `most`, differ
    as the preference differs from its mean by words, as far as that allows, and a source's expected words stay its target. A null text has size 0, a null source is a source of
    its own, a null key is sampled by its text; rows that repeat both key and text are taken alike. Reruns agree. Columns of
    the input that are named like the four added ones are replaced, others may have any name; an empty table gives an empty one.
    """
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("_size", "_source_size", "_target", "_copies")]
    like = F.lit(1.0) if preference is None else F.greatest(preference.cast("double"), F.lit(1e-9))
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key).cast("string"), F.when(F.col(key).isNull(), F.col(text))), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    # the input's columns travel in one struct, so that none can clash with those made here
    rows = docs.select(F.struct(*own).alias("row"), F.col(source).alias("source"), size_of(text).alias("size"), like.alias("like"), uniform.alias("uniform"))
    small = common.stored(rows.select("source", "size", "like", "uniform"))
    goal = targets(small.select("source", "size"), weights, share, most)
    sums = small.groupBy(F.col("source").alias("s")).agg(F.try_divide(F.sum(F.col("like") * F.col("size")), F.sum("size")).alias("mean_like"), F.max("like").alias("most_like"))
    # the tilt is the largest that keeps the copies of the least and the most preferred document within 0 and most
    even = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    above = F.try_divide("most_like", "mean_like") - 1
    tilt = F.coalesce(F.least(even, F.when(above > 1e-12, (most - even) / above)), F.lit(0.0))
    goal = common.stored(goal.join(sums, F.col("source").eqNullSafe(F.col("s"))).select("source", "source_size", "weight", "target", even.alias("even"), F.coalesce("mean_like", F.lit(1.0)).alias("mean_like"), tilt.alias("tilt")))

    def ranked(df: DataFrame, like: Column, uniform: Column) -> DataFrame:
        """Adds certain (whole copies) and rank (a long of BITS * ROUNDS bits; null: can't be drawn)."""
        expected = F.least(F.lit(float(most)), F.greatest(F.lit(0.0), F.col("even") + F.col("tilt") * (like / F.col("mean_like") - 1)))
        part = expected - F.floor(expected)
        odds = F.try_divide(uniform / (1 - uniform), part / (1 - part))
        rank = F.least(F.floor(odds / (1 + odds) * F.lit(float(1 << (BITS * ROUNDS)))), F.lit((1 << (BITS * ROUNDS)) - 1))
        return df.withColumn("certain", F.floor(expected)).withColumn("_rank", F.when(part > 0, rank.cast("long")))

    def with_goal(df: DataFrame, goal: DataFrame) -> DataFrame:
        return df.join(goal.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")

    drawn = ranked(with_goal(small, goal), F.col("like"), F.col("uniform"))
    certain = drawn.groupBy(F.col("source").alias("s")).agg(F.sum(F.col("certain") * F.col("size")).alias("sure"))
    state = goal.join(certain, F.col("source").eqNullSafe(F.col("s"))).select("source", (F.col("target") - F.col("sure")).alias("left"), F.lit(0).cast("long").alias("low"), F.lit(True).alias("open"))
    pool = common.stored(drawn.where("_rank is not null and size > 0").select("source", "size", "_rank"))
    for k in range(ROUNDS):
        shift = BITS * (ROUNDS - 1 - k)
        state = common.stored(state)
        # only rows of a source's current bin are looked at: all of them at first, then 2**-BITS of those
        here = pool.join(state.toDF("s", "left", "low", "open"), F.col("source").eqNullSafe(F.col("s"))).where(F.col("open") & (F.shiftright("_rank", shift + BITS) == F.col("low")))
        bins = here.groupBy("source", F.shiftright("_rank", shift).alias("bin")).agg(F.sum("size").alias("words"))
        upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        bins = bins.withColumn("upto", F.sum("words").over(upto))
        at = bins.join(state.toDF("s", "left", "low", "open"), F.col("source").eqNullSafe(F.col("s")))
        cross = at.where("upto > left").groupBy(F.col("source").alias("s")).agg(F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("before"), "words")).alias("hit"))
        # no bin crosses: the whole of the current bin is taken, and narrowing ends behind it
        behind = (F.col("low") + 1) * (1 << BITS)
        step = state.join(cross, F.col("source").eqNullSafe(F.col("s")), "left")
        found = F.col("open") & F.col("hit").isNotNull()
        state = step.select(
            "source", F.when(found, F.col("left") - F.col("hit.before")).otherwise(F.col("left")).alias("left"),
            F.when(found, F.col("hit.bin")).when(F.col("open"), behind).otherwise(F.col("low") * (1 << BITS)).alias("low"), found.alias("open"),
        )
    # ranks under `low` are taken, and the one later document that comes nearest to what is still left
    state = common.stored(state.select(F.col("source").alias("s"), "left", "low"))
    rest = pool.join(state, F.col("source").eqNullSafe(F.col("s"))).where("_rank >= low and abs(size - left) < left")
    pick = rest.groupBy(F.col("source").alias("p")).agg(F.min(F.struct(F.abs(F.col("size") - F.col("left")), "_rank"))["_rank"].alias("pick"))
    stops = goal.join(state, F.col("source").eqNullSafe(F.col("s"))).join(pick, F.col("source").eqNullSafe(F.col("p")), "left").drop("s", "p", "left")
    stops = common.stored(stops)
    out = ranked(with_goal(rows, stops), F.col("like"), F.col("uniform"))
    copies = F.col("certain") + F.when((F.col("_rank") < F.col("low")) | (F.col("_rank") == F.col("pick")), 1).otherwise(0)
    return out.select("row.*", F.col("size").alias("_size"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), copies.cast("long").alias("_copies"))


def fuller(text: str | Column) -> Column:
    """The query's preference: from 0.5 for a text without words to 1 for one of 200 words or more."""
    return 0.5 + 0.5 * F.least(size_of(text), F.lit(200)) / 200


def op8_pareto_mix(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return mix(docs, preference=fuller("text")).select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"))
