"""Filter interaction audit: what each filter removes alone, in every order, and its fair share.

The filters' removal game gives a coalition of filters the documents that any of them removes. Its Hart-Mas-Colell
potential is found by recursion over the coalitions, P(S) = (v(S) + sum of P(S without i)) / |S|, and a filter's
Shapley value is the potential of all filters minus the potential without it. A step of an order removes the
difference of two coalitions' values. Documents are only counted: by part and by the set of filters they fail.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.llm import common

SPACES = "\t\n\x0b\x0c\r"


def text_failures(text: Column) -> dict[str, Column]:
    """A: under 200 words; B: under half of the words are distinct; C: over 2 % capital letters A-Z; D: holds one of #$%&*|."""
    pieces = F.split(F.translate(text, SPACES, " " * len(SPACES)), " ")
    words = F.size(pieces) - F.size(F.filter(pieces, lambda w: w == ""))
    distinct = F.array_distinct(pieces)
    n_distinct = F.size(distinct) - F.array_contains(distinct, "").cast("int")
    capitals = F.octet_length(text) - F.octet_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": words < 200,
        "B": F.lit(100) * n_distinct.cast("long") < F.lit(50) * words.cast("long"),
        "C": F.lit(100) * capitals.cast("long") > F.lit(2) * F.length(text).cast("long"),
        "D": F.length(F.translate(text, "#$%&*|", "")) < F.length(text),
    }


def outcome_counts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> tuple[DataFrame, str]:
    """((part, mask, docs, good, toxic), letters): documents by the set of filters they fail; bit i of mask is letter i.

    The last filter, E, fails a text that a smaller key has too, table-wide. A null text is empty, a null part is the part '', a null key is
    neither smaller nor larger than others, so it never fails E and has no label; rows that repeat key and text count one by one, and none of them
    fails E through the other. A document is good or toxic if any of its labels is 1. Other columns, whatever their names, are not looked at.
    Copies meet as pairs (digest, smallest key), so no task holds a group of copies.
    """
    failed = text_failures(F.coalesce(F.col(text), F.lit("")))
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failed.values())), F.lit(0))
    digest = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
    rows = common.stored(docs.select(F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), digest.alias("digest"), mask.alias("mask")))
    # the first of each text, as a pair of its own: a join on both columns has no hot key
    first = rows.where("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # null ids meet nothing; a salt parts them
    salt = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(1 << 20))).otherwise(0)
    seen = rows.withColumn("salt", salt).join(first.withColumn("salt", F.lit(0).cast("long")), ["id", "digest", "salt"], "left").join(marks.withColumn("salt", F.lit(0).cast("long")), ["id", "salt"], "left")
    repeated = F.col("id").isNotNull() & F.col("first").isNull()
    full = F.col("mask") + F.when(repeated, 1 << len(failed)).otherwise(0)
    one = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return seen.groupBy("part", full.alias("mask")).agg(F.count("*").alias("docs"), one("good").alias("good"), one("toxic").alias("toxic")), "".join([*failed, "E"])


def potential(values: Column, n: int) -> Column:
    """n! times the Hart-Mas-Colell potential of every coalition of n players, from an array of the coalitions' values
    (index: bit mask; the empty one is 0). The potential's denominators divide n!, so whole numbers stay exact."""

    def step(done: Column, s: Column) -> Column:
        without = F.transform(F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.getbit(s, i) == 1), lambda i: F.get(done, s.bitwiseXOR(F.call_function("shiftleft", F.lit(1), i))))
        total = F.get(values, s) * factorial(n) + F.aggregate(without, F.lit(0).cast("long"), lambda a, x: a + x)
        return F.concat(done, F.array(F.call_function("div", total, F.bit_count(s))))

    return F.aggregate(F.sequence(F.lit(1), F.lit((1 << n) - 1)), F.array(F.lit(0).cast("long")), step)


def audit(counts: DataFrame, letters: str) -> DataFrame:
    """One row per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley (in units of 1 / n!).

    An empty table gives no row. Work grows with the parts: 2**n values and n * n! rows each, whatever the documents.
    """
    n, spark = len(letters), counts.sparkSession
    coalitions = counts.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit((1 << n) - 1))))
    hit = F.col("mask").bitwiseAND(F.col("s")) != 0
    values = coalitions.groupBy("part", "s").agg(*[F.sum(F.when(hit, F.col(c)).otherwise(0)).alias(c) for c in ("docs", "good", "toxic")], F.sum("docs").alias("total"))
    arrays = values.groupBy("part").agg(F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("s", "docs", "good", "toxic"))).alias("v"))  # 2**n entries
    arrays = arrays.select("part", "total", *[F.col(f"v.{c}").alias(c) for c in ("docs", "good", "toxic")])
    games = common.stored(arrays.withColumn("potential", potential(F.col("docs"), n)))
    steps = [
        ("".join(order), k + 1, letters.index(f), sum(1 << letters.index(x) for x in order[:k]), sum(1 << letters.index(x) for x in order[: k + 1]))
        for order in permutations(letters) for k, f in enumerate(order)
    ]
    plan = spark.createDataFrame(steps, "filter_order string, step int, filter int, before int, s int")
    # each coalition of a part meets the steps that end in it
    rows = games.withColumn("s", F.explode(F.sequence(F.lit(1), F.lit((1 << n) - 1)))).join(F.broadcast(plan), "s")
    at = lambda c, s: F.get(F.col(c), s)
    own, everything = F.call_function("shiftleft", F.lit(1), F.col("filter")), F.lit((1 << n) - 1)
    lost = lambda c: at(c, F.col("s")) - at(c, F.col("before"))
    return rows.select(
        "part", "filter_order", "step", (F.col("total") - at("docs", F.col("s"))).alias("kept"), lost("docs").alias("removed"), (at("docs", own) - lost("docs")).alias("redundant"),
        (at("docs", everything) - at("docs", everything.bitwiseXOR(own))).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"),
        (at("potential", everything) - at("potential", everything.bitwiseXOR(own))).alias("shapley"),
    )


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(*outcome_counts(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")))


SQL = r"""
    WITH words AS (
        SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
    ), marked AS (
        SELECT part, CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT) + 4 * CAST(100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) AS INT)
            + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INT) AS mask,
            coalesce(g.good, false) AS good, coalesce(g.toxic, false) AS toxic
        FROM words LEFT JOIN (SELECT doc_id AS id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1) g ON g.id = doc_id
    ), counts AS (
        SELECT part, mask, count(*) AS docs, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM marked GROUP BY 1, 2
    ), f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(x, bit)), orders AS (
        SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
    ), steps AS (
        SELECT filter_order, CAST(step AS INT) AS step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM orders, (SELECT unnest(range(1, 6)) AS step)
    ), told AS (
        SELECT part, filter_order, step, own, CAST(coalesce(sum(docs) FILTER (mask & (before | own) = 0), 0) AS BIGINT) AS kept, CAST(coalesce(sum(docs) FILTER (mask & own <> 0 AND mask & before = 0), 0) AS BIGINT) AS removed,
            CAST(coalesce(sum(docs) FILTER (mask & own <> 0 AND mask & before <> 0), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(docs) FILTER (mask = own), 0) AS BIGINT) AS unique_fails,
            CAST(coalesce(sum(good) FILTER (mask & own <> 0 AND mask & before = 0), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (mask & own <> 0 AND mask & before = 0), 0) AS BIGINT) AS toxic_lost
        FROM counts, steps GROUP BY 1, 2, 3, 4
    )
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM told"""
