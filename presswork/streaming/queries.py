"""The streaming forms as queries: bounded streams over the derived tables in several micro-batches, against their batch meaning.

Tables come in order of time, three micro-batches of ten days or so; windows and sessions are given once the watermark has closed them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.functions.text import SPACE_CLASS, blacklist_pattern
from presswork.operators import extraction, quality
from presswork.operators.failures import STATE
from presswork.sources.fixtures import AS_OF, AS_OF_EPOCH
from presswork.streaming import ingest

#: Moments that part the micro-batches, in seconds since 1970.
CUTS = (AS_OF_EPOCH - 20 * 86_400, AS_OF_EPOCH - 10 * 86_400)
LIMIT = 4


def by_time(df: DataFrame, column: str) -> list[DataFrame]:
    at = F.unix_seconds(column)
    return [df.where(at < CUTS[0]), df.where((at >= CUTS[0]) & (at < CUTS[1])), df.where(at >= CUTS[1])]


def extracted(v) -> DataFrame:  # noqa: ANN001
    pages = [v.tagged_pages.where(F.col("page_id") % 3 == k) for k in range(3)]
    return ingest.run_to_end(ingest.extracted_articles(ingest.micro_batches(pages), v.topics)).select("page_id", "topic_id")


def distinct_urls(v) -> DataFrame:  # noqa: ANN001
    """Every URL comes again an hour later, and a third of them once more in a late batch: behind the watermark of the batch before, it is dropped."""
    first = v.articles.select("canonical_url", "first_seen_at")
    again = first.select("canonical_url", F.timestamp_seconds(F.unix_seconds("first_seen_at") + 3600).alias("first_seen_at"))
    late = v.articles.where("id % 3 = 0").select(F.concat("canonical_url", F.lit("?late")).alias("canonical_url"), "first_seen_at")
    rows = ingest.run_to_end(ingest.distinct_urls(ingest.micro_batches([*by_time(first.union(again), "first_seen_at")[1:], late])))
    return rows.groupBy("canonical_url").agg(F.count("*").alias("times"))


def fresh(v) -> DataFrame:  # noqa: ANN001
    return ingest.run_to_end(ingest.fresh_only(ingest.micro_batches(by_time(v.articles.select("id", "published_at"), "published_at")[1:]), 72, None)).select("id")


def outcome_counts(v) -> DataFrame:  # noqa: ANN001
    rows = quality.gate(v.articles, v.topics).select("topic_id", F.coalesce("reason", F.lit("passed")).alias("outcome"), F.col("first_seen_at").alias("ts"))
    return ingest.run_to_end(ingest.hourly_outcomes(ingest.micro_batches(by_time(rows, "ts")[1:]))).select("start", "topic_id", "outcome", "n")


def sessions(v) -> DataFrame:  # noqa: ANN001
    return ingest.run_to_end(ingest.crawl_sessions(ingest.micro_batches(by_time(v.attempts.select("ts", "source_id"), "ts")))).select("source_id", "start", "n")


def failures(v) -> DataFrame:  # noqa: ANN001
    """The state of each source after its last micro-batch, with the moment it was disabled."""
    rows = ingest.run_to_end(ingest.failure_events(ingest.micro_batches(by_time(v.attempts, "ts")), LIMIT), "update")
    return rows.groupBy("source_id").agg(F.max_by("failures", "batch").alias("failures"), F.min("disabled_at").alias("disabled_at"), F.count("disabled_at").alias("events"), F.sum("heard").alias("attempts"))


DLANG = extraction.DLANG
TOKENS = f"len(list_filter(regexp_split_to_array(summary, '{SPACE_CLASS}+'), lambda x: x <> ''))"
GATED = f"""SELECT page_id, topic_id FROM (SELECT x.*, t.id AS topic_id, freshness_hours, replace(query, ' ', '|') || CASE WHEN includes <> '' THEN '|' || includes ELSE '' END AS rx
        FROM ({extraction.EXTRACTED}) x JOIN (SELECT page_id, {DLANG} AS lang FROM tagged_pages) l ON l.page_id = x.page_id JOIN topics t ON t.lang = l.lang)
    WHERE length(title) >= 10 AND (published_at IS NULL OR epoch({AS_OF}) - epoch(published_at) <= freshness_hours * 3600) AND {TOKENS} BETWEEN 20 AND 10000
        AND NOT regexp_matches(lower(title || ' ' || summary), '{blacklist_pattern()}') AND (regexp_matches(lower(title), rx) OR regexp_matches(lower(summary), rx))"""
URLS = f"""SELECT canonical_url, CAST(1 AS BIGINT) AS times FROM articles UNION ALL SELECT canonical_url || '?late', 1 FROM articles WHERE id % 3 = 0
    AND epoch(first_seen_at) > (SELECT max(epoch(first_seen_at)) - {7 * 86_400} FROM (SELECT first_seen_at FROM articles UNION ALL SELECT first_seen_at + INTERVAL 1 HOUR FROM articles) WHERE epoch(first_seen_at) < {CUTS[1]})"""
HOURS = f"""SELECT start, topic_id, outcome, count(*) AS n FROM (SELECT date_trunc('hour', first_seen_at) AS start, topic_id, coalesce(reason, 'passed') AS outcome FROM ({quality.GATE}) g JOIN articles a USING (id))
    WHERE start + INTERVAL 1 HOUR <= (SELECT max(first_seen_at) FROM articles JOIN topics USING (lang)) - INTERVAL 1 HOUR GROUP BY ALL"""
SESSIONS = """SELECT source_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY source_id ORDER BY ts, id) AS s FROM (
        SELECT *, coalesce(ts >= lag(ts) OVER (PARTITION BY source_id ORDER BY ts, id) + INTERVAL 30 MINUTE, true) AS fresh FROM attempts)) GROUP BY source_id, s HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM attempts) - INTERVAL 1 HOUR"""
FAILURES = f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ts, id) - coalesce(max(CASE WHEN status = 200 THEN place END) OVER (PARTITION BY source_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING), 0) AS run
        FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ts, id) AS place FROM attempts))
    SELECT f.source_id, consecutive_failures AS failures, disabled_at, CAST(disabled_at IS NOT NULL AS BIGINT) AS events, attempts FROM ({STATE}) f LEFT JOIN (SELECT source_id, min(ts) AS disabled_at FROM r WHERE run >= {LIMIT} GROUP BY 1) d ON d.source_id = f.source_id
    JOIN (SELECT source_id, count(*) AS attempts FROM attempts GROUP BY 1) c ON c.source_id = f.source_id"""

QUERIES = {
    "w01_extracted": (extracted, GATED),
    "w02_distinct_urls": (distinct_urls, URLS),
    "w04_fresh": (fresh, f"SELECT id FROM articles WHERE published_at >= {AS_OF} - INTERVAL 72 HOUR"),
    "w05_hourly_outcomes": (outcome_counts, HOURS),
    "w06_crawl_sessions": (sessions, SESSIONS),
    "w07_failure_events": (failures, FAILURES),
}
