"""Failure tracking of sources (inventory R3, R4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def failure_reason(status: Column, disallowed: Column | None = None, message: Column | None = None) -> Column:
    """robots_disallow, else the message of an error cut to 100 characters, else http_ and a status other than 200."""
    reason = F.when(disallowed, "robots_disallow") if disallowed is not None else F
    reason = reason.when(message.isNotNull(), F.substring(message, 1, 100)) if message is not None else reason
    return reason.when(status != 200, F.concat(F.lit("http_"), status.cast("string")))


def failure_state(attempts: DataFrame) -> DataFrame:
    """Failures since the last success, last times and the current reason, by source. Two aggregates with
    map-side combining and a join on the source instead of a window over its attempts."""
    last = attempts.groupBy("source_id").agg(F.max(F.when(F.col("status") == 200, F.struct("ts", "id"))).alias("ok"), F.max(F.when(F.col("status") != 200, F.struct("ts", "id", "status"))).alias("bad"))
    after = attempts.join(last.select("source_id", "ok"), "source_id").where((F.col("status") != 200) & (F.col("ok").isNull() | (F.struct("ts", "id") > F.col("ok"))))
    runs = after.groupBy("source_id").agg(F.count("*").alias("n"))
    return last.join(runs, "source_id", "left").select(
        "source_id", F.coalesce("n", F.lit(0)).alias("consecutive_failures"), F.col("ok.ts").alias("last_success_at"), F.col("bad.ts").alias("last_failure_at"), F.when(F.col("n") > 0, failure_reason(F.col("bad.status"))).alias("failure_reason")
    )


STATE = """SELECT source_id, CAST(count(CASE WHEN status <> 200 AND (ok IS NULL OR ts > ok OR (ts = ok AND id > ok_id)) THEN 1 END) AS BIGINT) AS consecutive_failures, max(ok) AS last_success_at, max(CASE WHEN status <> 200 THEN ts END) AS last_failure_at,
    CASE WHEN count(CASE WHEN status <> 200 AND (ok IS NULL OR ts > ok OR (ts = ok AND id > ok_id)) THEN 1 END) > 0 THEN 'http_' || CAST(arg_max(CASE WHEN status <> 200 THEN status END, CASE WHEN status <> 200 THEN epoch_us(ts) * 1000 + id % 1000 END) AS VARCHAR) END AS failure_reason
    FROM (SELECT a.*, max(CASE WHEN status = 200 THEN ts END) OVER (PARTITION BY source_id) AS ok, max(CASE WHEN status = 200 THEN id END) OVER (PARTITION BY source_id, ts) AS ok_id FROM attempts a) GROUP BY 1"""
