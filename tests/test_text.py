"""Text predicates against their plain forms."""

import random

from pyspark.sql import functions as F

from presswork.functions import text
from presswork.operators import quality


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_blacklist_is_the_pattern_behind_plain_pieces(spark):
    rng = random.Random(11)
    parts = ["opinion", "editorial", "éditorial", "advertorial", "sponsored", "publicité", "publicity", "partner", "content", "paid", "post", "é", "x", "_", "7", " ", "\n", "-", "", " "]
    rows = [("".join(rng.choice(parts) for _ in range(rng.randint(0, 5))),) for _ in range(3000)]
    df = spark.createDataFrame(rows, "t string")
    for unicode_boundaries in (False, True):
        pair = df.select(F.col("t").rlike(text.blacklist_pattern(unicode_boundaries)).alias("want"), text.has_blacklisted(F.col("t"), unicode_boundaries).alias("got"))
        counts = {r[:2]: r[2] for r in pair.groupBy("want", "got").count().collect()}
        assert set(counts) == {(True, True), (False, False)}
    assert "contains(" in _plan(df.where(quality.is_blacklisted("t", "t"))).lower()


def test_gate_judges_an_article_once_and_moves_no_text(spark):
    topics = spark.createDataFrame([(k, "en", "machine", "", "", 72, 30) for k in range(3)], "id int, lang string, query string, includes string, excludes string, freshness_hours int, max_items int")
    articles = spark.range(9).select("id", F.lit("en").alias("lang"), F.lit("A fine machine title").alias("title"), F.lit("machine learning models " * 10).alias("summary"), F.lit(None).cast("timestamp").alias("published_at"))
    rows = quality.gate(articles, topics)
    assert {(r.topic_id, r.reason) for r in rows.collect()} == {(k, None) for k in range(3)} and rows.count() == 27
    assert "_blacklisted" not in rows.columns and "strategy=broadcast" in _plan(rows)
    assert _plan(rows).count("éditorial") == 1
