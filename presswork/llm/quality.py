"""Quality classifier: ordinal regression on graded ratings, for selection by expected grade or tail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.llm import common, ordinal


def graded(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, grade): 0 for low quality, 1 for good but toxic, 2 for good. The labels have two binary
    columns; this is the order in which a training set wants them. Repeated labels of a document: the lowest counts."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    one = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(grade).alias("grade"))
    # the draw is made ahead of the join, so that only drawn texts move
    return docs.select("doc_id", "text", ordinal.draw()).join(one, "doc_id").select("text", "draw", "grade")


def grade_documents(docs: DataFrame, labels: DataFrame, keep: float = 0.25, max_rows: int = ordinal.MAX_LABELLED) -> DataFrame:
    """(doc_id, expected_grade, p_good, selected) of every document; p_good = P(grade > 0).

    `selected` is p_good >= keep. A null or empty text is scored by its (missing) features; without usable
    labels the scores are null and everything is selected.
    """
    out = ordinal.score(docs, ordinal.fit(graded(docs, labels), shape=True, max_rows=max_rows))
    p = F.get("tails", F.lit(0))
    return out.select(F.col("key").alias("doc_id"), F.col("expected").alias("expected_grade"), p.alias("p_good"), F.coalesce(p >= keep, F.lit(True)).alias("selected"))


def op2_ordinal_quality(spark, sf_dir: str) -> DataFrame:
    return grade_documents(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
