"""Toxicity: ordinal regression on severity grades from sparse word features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.llm import common, ordinal


def severities(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, grade): 0 not toxic, 1 toxic, 2 toxic and of low quality. The labels have two binary columns;
    the third grade is the worse of the toxic texts. Repeated labels of a document: the highest counts."""
    grade = F.when(F.col("toxic") == 0, 0).when((F.col("toxic") == 1) & (F.col("quality") == 0), 2).when(F.col("toxic") == 1, 1)
    one = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(grade).alias("grade"))
    # the draw is made ahead of the join, so that only drawn texts move
    return docs.select("doc_id", "text", ordinal.draw()).join(one, "doc_id").select("text", "draw", "grade")


def grade_toxicity(docs: DataFrame, labels: DataFrame, flag: float = 0.3, max_rows: int = ordinal.MAX_LABELLED) -> DataFrame:
    """(doc_id, expected_severity, p_toxic, toxic) of every document; p_toxic = P(severity > 0), toxic: p_toxic >= flag.

    A null or empty text has no features and so the severity of the thresholds alone; without usable labels scores
    are null and nothing is flagged.
    """
    out = ordinal.score(docs, ordinal.fit(severities(docs, labels), shape=False, max_rows=max_rows, min_z=3.0))
    p = F.get("tails", F.lit(0))
    return out.select(F.col("key").alias("doc_id"), F.col("expected").alias("expected_severity"), p.alias("p_toxic"), F.coalesce(p >= flag, F.lit(False)).alias("toxic"))


def op7_ordinal_toxicity(spark, sf_dir: str) -> DataFrame:
    return grade_toxicity(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
