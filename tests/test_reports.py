"""Reports take every row of their window, its first moment too."""

import datetime as dt

from pyspark.sql import functions as F

from presswork.operators import reports
from presswork.sources.fixtures import AS_OF_EPOCH


def _ago(hours):
    return dt.datetime.fromtimestamp(AS_OF_EPOCH - hours * 3600, dt.timezone.utc)


def _crawls(spark):
    rows = [(1, _ago(1), True, 6, 2), (2, _ago(2), False, 1, 3), (3, _ago(24), None, 1, 1), (4, _ago(700), True, 4, 9)]
    return spark.createDataFrame(rows, "id long, started_at timestamp, ok_bool boolean, kept long, duplicates long")


def _articles(spark):
    rows = [(k, f"https://h{k % 2}.example/{k}", _ago(h), _ago(p) if p else None) for k, (h, p) in enumerate([(1, 2), (24, 26), (24, 40), (168, 170), (2, None), (3, 13)])]
    return spark.createDataFrame(rows, "id long, canonical_url string, first_seen_at timestamp, published_at timestamp")


def test_duplicate_rate_takes_failed_and_running_crawls(spark):
    assert [r[:] for r in reports.duplicate_rate(_crawls(spark)).collect()] == [(8, 6, 42.86)]
    assert [r[:] for r in reports.duplicate_rate(_crawls(spark), only_ok=True).collect()] == [(6, 2, 25.0)]


def test_publish_latency_takes_the_first_moment_of_its_window(spark):
    lone = _articles(spark).where("id = 3")
    assert [r[:] for r in reports.publish_latency(lone).collect()] == [(2.0, 2.0, 2.0)]


def test_articles_per_host_take_the_first_moment_of_their_window(spark):
    assert [r[:] for r in reports.articles_per_host(_articles(spark)).collect()] == [("h0.example", 3), ("h1.example", 2)]


def test_freshness_has_five_buckets_and_the_first_moment_of_its_window(spark):
    assert {r.bucket: r.articles for r in reports.freshness_buckets(_articles(spark)).collect()} == {"0-3h": 1, "12-24h": 1, "24-48h": 2, "48h+": 2}


def test_silent_topics_are_those_without_an_article_too(spark):
    topics = spark.createDataFrame([(1, "a", True), (2, "b", False), (3, "c", True), (4, "d", False)], "id int, slug string, enabled boolean")
    links = spark.createDataFrame([(1, _ago(1)), (2, _ago(5)), (2, _ago(9))], "topic_id int, added_at timestamp")
    rows = reports.silent_topics(topics, links).select("id", "slug", (F.lit(AS_OF_EPOCH) - F.unix_timestamp("last_added")).alias("age")).collect()
    assert sorted(r[:] for r in rows) == [(2, "b", 5 * 3600), (3, "c", None), (4, "d", None)]


def test_crawl_success_is_over_all_crawls(spark):
    rows = lambda *a: sorted((str(r.ok_bool), r.crawls, r.avg_kept) for r in reports.crawl_success(_crawls(spark), *a).collect())
    assert rows() == [("False", 1, 1.0), ("None", 1, 1.0), ("True", 2, 5.0)]
    assert rows(24) == [("False", 1, 1.0), ("True", 1, 6.0)]
