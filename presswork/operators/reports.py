"""Feeds and reports: the read side of the news corpus (inventory H1-H37).

All functions take DataFrames and an explicit `as_of`; limits and windows are parameters. Feeds end in
a sort with a unique last key, so they are reproducible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.functions.text import any_keyword
from presswork.operators.failures import STATE, failure_state
from presswork.operators.keyword_index import checked
from presswork.operators.topk import top_per_group
from presswork.sources.fixtures import AS_OF



def now(as_of: Column | None = None) -> Column:
    """The moment that is asked for; the fixtures' moment by default."""
    return F.expr(AS_OF) if as_of is None else as_of


WINDOWS = {"24h": 24, "48h": 48, "7d": 168}


def hours_before(hours: float, as_of: Column | None = None) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(now(as_of)) - int(hours * 3600))


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def topic_feed(links: DataFrame, articles: DataFrame, sources: DataFrame, topics: DataFrame, topic_id: int, window: str = "48h", lang: str | None = None) -> DataFrame:
    """H1: visible articles of a topic, published within a window (unknown window: 48h; all: of any or no date), newest link first, cut to max_items; keywords
    filter after the cut. Where a keyword is no pattern, articles that no keyword before it hits are left out, as the gate can't judge them."""
    topic = checked(topics.where(F.col("id") == topic_id))
    written = articles.select(F.col("id").alias("article_id"), "canonical_url", "title", "summary", "source_id", "lang", "published_at", "first_seen_at")
    rows = links.where((F.col("topic_id") == topic_id) & ~F.col("hidden_bool")).select("topic_id", "article_id", "added_at").join(written, "article_id")
    if window != "all":
        rows = rows.where(F.col("published_at") >= hours_before(WINDOWS.get(window, 48)))
    if lang:
        rows = rows.where(F.col("lang") == lang)
    rows = rows.join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.col("domain").alias("source_domain")), "source_id", "left")
    one = topic.select("max_items", "keys", "broken")
    # one topic row (ids are unique): its settings ride along, as the driver doesn't know them
    first = top_per_group(rows.crossJoin(F.broadcast(one)), ("topic_id",), F.col("max_items"), (F.desc("added_at"), F.desc("article_id")), ("article_id",))
    kept = first.where(((F.size("keys") > 0) | ~F.col("broken")) & any_keyword("keys", F.col("title"), F.col("summary")))
    return kept.select("article_id", "canonical_url", "title", "summary", "source_name", "source_domain", F.col("lang"), "published_at", "first_seen_at", "added_at")


def feed_age_minutes(feed: DataFrame, as_of: Column | None = None) -> DataFrame:
    """H2: minutes since the first item of a feed was published; 0 for an empty feed."""
    first = feed.agg(F.max_by("published_at", F.struct("added_at", "article_id")).alias("p"))
    return first.select(F.coalesce(F.floor((F.unix_timestamp(now(as_of)) - F.unix_timestamp("p")) / 60), F.lit(0)).cast("long").alias("minutes"))


def home_feed(links: DataFrame, articles: DataFrame, sources: DataFrame, hours: int = 48, n: int = 50) -> DataFrame:
    """H3: distinct articles of all topics that were published lately, newest first; hidden ones too."""
    linked = links.select(F.col("article_id").alias("id"))
    recent = articles.where(F.col("published_at") >= hours_before(hours)).join(linked, "id", "left_semi")
    first = top(recent.select("id", "canonical_url", "title", "summary", "source_id", "lang", "published_at", "first_seen_at"), n, F.desc("published_at"), F.desc("id"))
    named = first.join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.col("domain").alias("source_domain")), "source_id", "left")
    return named.drop("source_id").orderBy(F.desc("published_at"), F.desc("id"))


def crawl_report(crawls: DataFrame, sources_topics: DataFrame, sources: DataFrame, links: DataFrame, articles: DataFrame, failures: DataFrame, as_of: Column | None = None, hours: int = 1) -> DataFrame:
    """H4: every crawl with all sources of its topic: the source's failures, the number of its articles that were added while the crawl ran, and their list,
    newest first. A crawl that runs reaches to as_of; one that ends before it starts has no article.

    An interval join: crawls are rows of each bucket of so many hours that they touch, links rows of their own bucket, so they meet
    by topic and bucket; the exact moment decides among those.
    """
    bucket = lambda t: F.floor(F.unix_seconds(t) / (hours * 3600))
    until = F.coalesce("finished_at", now(as_of))
    ran = crawls.select(F.col("id").alias("crawl_id"), "topic_id", "started_at", until.alias("until")).where("started_at <= until")
    ran = ran.withColumn("bucket", F.explode(F.sequence(bucket(F.col("started_at")), bucket(F.col("until")))))
    written = articles.select(F.col("id").alias("article_id"), "source_id", "title", "canonical_url", "published_at")
    added = links.select("topic_id", "article_id", "added_at", bucket(F.col("added_at")).alias("bucket")).join(written, "article_id")
    met = ran.join(added, ["topic_id", "bucket"]).where(F.col("added_at").between(F.col("started_at"), F.col("until")))
    found = met.groupBy("crawl_id", "source_id").agg(F.sort_array(F.collect_list(F.struct("added_at", "article_id", "title", "canonical_url", "published_at")), asc=False).alias("article_list"))
    shown = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), "domain")
    every = crawls.select(F.col("id").alias("crawl_id"), "topic_id").join(sources_topics, "topic_id").join(shown, "source_id").join(failures, "source_id", "left")
    return every.join(found, ["crawl_id", "source_id"], "left").select(
        "crawl_id", "source_name", "domain", F.coalesce("consecutive_failures", F.lit(0)).alias("consecutive_failures"), "last_failure_at", "last_success_at", "failure_reason",
        F.coalesce(F.size("article_list"), F.lit(0)).cast("long").alias("articles"), "article_list",
    )


def listed_articles(report: DataFrame) -> DataFrame:
    """The report with its list as one text: a line of id, second of adding, URL and title each."""
    line = lambda a: F.concat_ws(" ", a["article_id"].cast("string"), F.unix_seconds(a["added_at"]).cast("string"), a["canonical_url"], a["title"])
    return report.withColumn("article_list", F.array_join(F.transform(F.coalesce("article_list", F.array()), line), "\n"))


def recent_crawls(crawls: DataFrame, topics: DataFrame, hours: int = 48, n: int = 50) -> DataFrame:
    """H5, H6: crawls that finished lately, or run and started lately, with their status."""
    since = hours_before(hours)
    rows = crawls.where((F.col("finished_at") >= since) | (F.col("finished_at").isNull() & (F.col("started_at") >= since)))
    rows = rows.join(topics.select(F.col("id").alias("topic_id"), "slug"), "topic_id", "left")
    return top(rows.select("id", "slug", crawl_status("ok_bool").alias("status"), "started_at"), n, F.desc("started_at"), F.desc("id"))


def crawl_status(ok: str) -> Column:
    return F.when(F.col(ok).isNull(), "running").when(F.col(ok), "success").otherwise("failed")


def crawl_runs_report(runs: DataFrame, n: int = 100) -> DataFrame:
    """H7: the newest runs with a metadata field."""
    return top(runs.select("id", "workflow_name", "started_at", F.get_json_object("metadata", "$.k").cast("long").alias("k")), n, F.desc("started_at"), F.desc("id"))


def candidate_list(candidates: DataFrame) -> DataFrame:
    """H8, H9: candidates by score, unknown scores last."""
    return candidates.select("id", "domain", "score", "last_seen_at").orderBy(F.desc_nulls_last("score"), F.desc_nulls_last("last_seen_at"), "id")


def newest_sources(sources: DataFrame) -> DataFrame:
    """A listing newest first."""
    return sources.select("id", "domain", "created_at").orderBy(F.desc("created_at"), "id")


def top_sources(sources: DataFrame, n: int = 20) -> DataFrame:
    """H11."""
    return top(sources.select("id", "name", "domain", "points", "last_seen_at", "enabled"), n, F.desc("points"), "id")


def duplicate_rate(crawls: DataFrame, hours: int = 24, only_ok: bool = False) -> DataFrame:
    """Duplicates as a share of what crawls (with `only_ok` the successful ones) kept or found again, from their JSON statistics."""
    recent = crawls.where(F.col("started_at") >= hours_before(hours))
    stats = (recent.where("ok_bool") if only_ok else recent).select(F.to_json(F.struct("kept", F.col("duplicates").alias("skippedDuplicates"))).alias("stats_json"))
    num = lambda k: F.coalesce(F.sum(F.get_json_object("stats_json", f"$.{k}").cast("long")), F.lit(0))
    return stats.agg(num("kept").alias("kept"), num("skippedDuplicates").alias("duplicates")).withColumn("rate", F.round(100.0 * F.col("duplicates") / F.nullif(F.col("kept") + F.col("duplicates"), F.lit(0)), 2))


def publish_latency(articles: DataFrame, hours: int = 168) -> DataFrame:
    """Hours from publication to first sight, of articles first seen in the window, its first moment included."""
    lag = (F.unix_timestamp("first_seen_at") - F.unix_timestamp("published_at")) / 3600.0
    rows = articles.where(F.col("first_seen_at") >= hours_before(hours)).select(lag.alias("h"))
    return rows.agg(F.round(F.avg("h"), 6).alias("avg_hours"), F.round(F.min("h"), 6).alias("min_hours"), F.round(F.max("h"), 6).alias("max_hours"))


def articles_per_host(articles: DataFrame, hours: int = 24, n: int = 20) -> DataFrame:
    """Articles first seen in the window, its first moment included, by the host of their URL."""
    host = F.regexp_extract("canonical_url", "^[a-zA-Z]+://([^/]+)", 1)
    return top(articles.where(F.col("first_seen_at") >= hours_before(hours)).groupBy(host.alias("host")).agg(F.count("*").alias("articles")), n, F.desc("articles"), "host")


def freshness_buckets(articles: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Articles first seen in 7 days by the age of their publication in five buckets; an unknown date is old."""
    age = F.unix_timestamp(now(as_of)) - F.unix_timestamp("published_at")
    bucket = F.when(age < 3 * 3600, "0-3h").when(age < 12 * 3600, "3-12h").when(age < 24 * 3600, "12-24h").when(age < 48 * 3600, "24-48h").otherwise("48h+")
    return articles.where(F.col("first_seen_at") >= hours_before(168, as_of)).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("articles")).orderBy("bucket")


def stale_sources(sources: DataFrame, days: int = 7) -> DataFrame:
    """Enabled sources not seen for days, or never, those with most points first."""
    rows = sources.where(F.col("enabled") & (F.col("last_seen_at").isNull() | (F.col("last_seen_at") < hours_before(24 * days))))
    return rows.select("id", "name", "domain", "last_seen_at", "points").orderBy(F.desc("points"), "id")


def review_list(candidates: DataFrame, probes: DataFrame, low: int = 40, high: int = 60, n: int = 50) -> DataFrame:
    """H17."""
    rows = candidates.where((F.col("score") >= low) & (F.col("score") < high)).join(probes, candidates.id == probes.domain_id, "left")
    return top(rows.select("id", "domain", "score", "has_sitemap", "jsonld_news"), n, F.desc("score"), "id")


def failing_topics(crawls: DataFrame, hours: int, at_least: int = 3) -> DataFrame:
    """Topics with several failed crawls lately."""
    rows = crawls.where((F.col("started_at") > hours_before(hours)) & ~F.col("ok_bool"))
    return rows.groupBy("topic_id").agg(F.count("*").alias("failures")).where(F.col("failures") >= at_least)


def silent_topics(topics: DataFrame, links: DataFrame, hours: float = 2) -> DataFrame:
    """Topics, enabled or not, whose last article was added before the window, or that never had one."""
    last = links.groupBy("topic_id").agg(F.max("added_at").alias("last_added"))
    rows = topics.join(last, topics.id == last.topic_id, "left")
    return rows.where(F.col("last_added").isNull() | (F.col("last_added") < hours_before(hours))).select("id", "slug", "last_added")


def failing_crawls(crawls: DataFrame, hours: int = 24) -> DataFrame:
    """Crawls with more errors than kept articles."""
    return crawls.where((F.col("started_at") > hours_before(hours)) & (F.col("errors") > F.col("kept"))).select("id", "topic_id", "errors", "kept")


def articles_per_source(articles: DataFrame, sources: DataFrame, hours: int = 24) -> DataFrame:
    """Articles first seen lately by the domain of their source."""
    rows = articles.where(F.col("first_seen_at") > hours_before(hours)).join(sources.select(F.col("id").alias("source_id"), "domain"), "source_id")
    return rows.groupBy("domain").agg(F.count("*").alias("articles"))


def crawl_success(crawls: DataFrame, hours: int | None = None) -> DataFrame:
    """All crawls, or with `hours` those that started lately, by their outcome (null: running), with what they kept on average."""
    return (crawls if hours is None else crawls.where(F.col("started_at") > hours_before(hours))).groupBy("ok_bool").agg(F.count("*").alias("crawls"), F.round(F.avg("kept"), 6).alias("avg_kept"))


def good_candidates(candidates: DataFrame, least: int = 40) -> DataFrame:
    """H23."""
    return candidates.where(F.col("score") >= least).select("domain", "score").orderBy(F.desc("score"), "domain")


def topic_sources(sources_topics: DataFrame, sources: DataFrame, articles: DataFrame, links: DataFrame, topic_id: int, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Articles linked to the topic by each of its sources, zero counts kept, in an optional window."""
    linked = links.where(F.col("topic_id") == topic_id)
    if since is not None:
        linked = linked.where(F.col("added_at").between(since, until))
    linked = linked.join(articles.select(F.col("id").alias("article_id"), "source_id"), "article_id").select("source_id", "article_id")
    rows = sources_topics.where(F.col("topic_id") == topic_id).join(sources.select(F.col("id").alias("source_id"), "domain"), "source_id").join(linked, "source_id", "left")
    return rows.groupBy("domain").agg(F.count("article_id").alias("links"), F.countDistinct("article_id").alias("articles"))


def coverage(counts: DataFrame) -> DataFrame:
    """Share of a topic's sources with an article."""
    return counts.agg(F.count_if(F.col("articles") > 0).alias("covered"), F.count("*").alias("sources")).withColumn("pct", F.round(100.0 * F.col("covered") / F.nullif(F.col("sources"), F.lit(0)), 2))


def shared_sources(sources_topics: DataFrame) -> DataFrame:
    """Sources in more than one topic."""
    return sources_topics.groupBy("source_id").agg(F.count("*").alias("topics")).where("topics > 1")


def crawl_time(topics: DataFrame, sources_topics: DataFrame, sources: DataFrame, seconds: int = 10) -> DataFrame:
    """Enabled sources of each topic, the estimated crawl time, and the limits it fits."""
    on = sources_topics.join(sources.where("enabled").select(F.col("id").alias("source_id")), "source_id").groupBy("topic_id").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return topics.join(on, topics.id == on.topic_id, "left").select("slug", n.alias("sources"), (n * seconds).alias("seconds"), (n * seconds <= 300).alias("fits_300"), (n * seconds <= 2700).alias("fits_2700"))


def visibility(links: DataFrame) -> DataFrame:
    """H29."""
    return links.groupBy("topic_id").agg(F.count_if(~F.col("hidden_bool")).alias("visible"), F.count_if("hidden_bool").alias("hidden"), F.count("*").alias("total"))


def recent_counts(links: DataFrame, articles: DataFrame) -> DataFrame:
    """Visible articles of each topic that were published within each window; zeros are kept."""
    visible = links.where(~F.col("hidden_bool")).select("topic_id", F.col("article_id").alias("id"))
    rows = visible.join(articles.select("id", "published_at"), "id")
    return rows.groupBy("topic_id").agg(*[F.count_if(F.col("published_at") >= hours_before(h)).alias(f"last_{k}") for k, h in WINDOWS.items()])


def unlinked_hits(articles: DataFrame, links: DataFrame, topic_id: int, term: str, hours: float | None = None) -> DataFrame:
    """Articles with the term that are not linked to the topic; with `hours` only those first seen lately."""
    hit = F.col("title").ilike(f"%{term}%") | F.col("summary").ilike(f"%{term}%")
    rows = articles.where(hit if hours is None else hit & (F.col("first_seen_at") >= hours_before(hours)))
    return rows.join(links.where(F.col("topic_id") == topic_id).select(F.col("article_id").alias("id")), "id", "left_anti").select("id", "first_seen_at")


def foreign_hits(articles: DataFrame, sources_topics: DataFrame, topic_id: int, term: str, n: int = 10) -> DataFrame:
    """Sources that are not the topic's, by articles with the term; a null source matches nothing."""
    hit = (F.col("title").ilike(f"%{term}%") | F.col("summary").ilike(f"%{term}%")) & F.col("source_id").isNotNull()
    rows = articles.where(hit).join(sources_topics.where(F.col("topic_id") == topic_id), "source_id", "left_anti")
    return top(rows.groupBy("source_id").agg(F.count("*").alias("articles")), n, F.desc("articles"), "source_id")


def links_per_day(links: DataFrame) -> DataFrame:
    """Visible links of each topic by the day on which they were added; those without a day have a null one."""
    return links.where(~F.col("hidden_bool")).groupBy("topic_id", F.date_format("added_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("links"))


def latest_crawls(crawls: DataFrame) -> DataFrame:
    """The latest crawl of each topic, by a hash aggregate instead of a window over the topic."""
    return crawls.groupBy("topic_id").agg(F.max_by(F.struct("id", "ok_bool"), F.struct("started_at", "id")).alias("c")).select("topic_id", "c.id", crawl_status("c.ok_bool").alias("status"))


def crawls_since(crawls: DataFrame, since: Column) -> DataFrame:
    """Crawls finished after a moment, and those that run now."""
    return crawls.where((F.col("finished_at") > since) | F.col("finished_at").isNull()).select("id", F.col("finished_at").isNull().alias("running"))


CONFIG = "articlePattern string, learned boolean, confidence double, sitemapPaths array<string>, indexPaths array<string>"


def learned_configs(sources: DataFrame, domains: list[str] | None = None) -> DataFrame:
    """Learnt patterns with defaults; lacking marks sources without a learnt config."""
    rows = sources if domains is None else sources.where(F.col("domain").isin(domains))
    c = F.from_json("api_config", CONFIG)
    return rows.select("domain", F.coalesce(c["articlePattern"], F.lit("")).alias("pattern"), F.coalesce(c["confidence"], F.lit(0.0)).alias("confidence"), (~F.coalesce(c["learned"], F.lit(False))).alias("lacking"))


H48 = f"{AS_OF} - INTERVAL 48 HOUR"
STATUS = "CASE WHEN ok_bool IS NULL THEN 'running' WHEN ok_bool THEN 'success' ELSE 'failed' END AS status"
FEED = f"""SELECT article_id, canonical_url, title, summary, source_name, source_domain, lang, published_at, first_seen_at, added_at FROM (
    SELECT l.article_id, a.canonical_url, a.title, a.summary, s.name AS source_name, s.domain AS source_domain, a.lang, a.published_at, a.first_seen_at, l.added_at, row_number() OVER (ORDER BY l.added_at DESC, l.article_id DESC) AS rn
    FROM topic_articles l JOIN articles a ON a.id = l.article_id LEFT JOIN sources s ON s.id = a.source_id WHERE l.topic_id = 1 AND NOT l.hidden_bool AND a.published_at >= {H48}) f
    WHERE rn <= 30 AND (regexp_matches(lower(title), 'thing|tion|ther|onth') OR regexp_matches(lower(summary), 'thing|tion|ther|onth'))"""
PER_SOURCE = """SELECT s.domain, count(x.article_id) AS links, count(DISTINCT x.article_id) AS articles FROM sources_topics st JOIN sources s ON s.id = st.source_id
    LEFT JOIN (SELECT l.article_id, a.source_id FROM topic_articles l JOIN articles a ON a.id = l.article_id WHERE l.topic_id = 1 {0}) x ON x.source_id = st.source_id WHERE st.topic_id = 1 GROUP BY 1"""
HIT = "(lower(title) LIKE '%thing%' OR lower(summary) LIKE '%thing%')"

QUERIES = {
    "h01_topic_feed": (lambda v: topic_feed(v.topic_articles, v.articles, v.sources, v.topics, 1), FEED),
    "h02_feed_age": (lambda v: feed_age_minutes(topic_feed(v.topic_articles, v.articles, v.sources, v.topics, 1)), f"SELECT coalesce((SELECT CAST(floor(epoch({AS_OF} - published_at) / 60) AS BIGINT) FROM ({FEED}) ORDER BY added_at DESC, article_id DESC LIMIT 1), 0) AS minutes"),
    "h03_home_feed": (lambda v: home_feed(v.topic_articles, v.articles, v.sources), f"SELECT DISTINCT a.id, canonical_url, title, summary, s.name AS source_name, s.domain AS source_domain, a.lang, published_at, first_seen_at FROM articles a JOIN topic_articles l ON l.article_id = a.id LEFT JOIN sources s ON s.id = a.source_id WHERE published_at >= {H48} ORDER BY published_at DESC, a.id DESC LIMIT 50"),
    "h04_crawl_report": (lambda v: listed_articles(crawl_report(v.crawls, v.sources_topics, v.sources, v.topic_articles, v.articles, failure_state(v.attempts))), f"""SELECT c.id AS crawl_id, s.name AS source_name, s.domain, coalesce(f.consecutive_failures, 0) AS consecutive_failures, f.last_failure_at, f.last_success_at, f.failure_reason,
        count(x.article_id) AS articles, coalesce(string_agg(x.article_id || ' ' || CAST(floor(epoch(x.added_at)) AS BIGINT) || ' ' || x.canonical_url || ' ' || x.title, chr(10) ORDER BY x.added_at DESC, x.article_id DESC), '') AS article_list
        FROM crawls c JOIN sources_topics st ON st.topic_id = c.topic_id JOIN sources s ON s.id = st.source_id LEFT JOIN ({STATE}) f ON f.source_id = s.id
        LEFT JOIN (SELECT l.topic_id, a.source_id, l.article_id, l.added_at, a.canonical_url, a.title FROM topic_articles l JOIN articles a ON a.id = l.article_id) x ON x.topic_id = c.topic_id AND x.source_id = st.source_id AND x.added_at BETWEEN c.started_at AND coalesce(c.finished_at, {AS_OF})
        GROUP BY ALL"""),
    "h05_recent_crawls": (lambda v: recent_crawls(v.crawls, v.topics), f"SELECT c.id, slug, {STATUS}, started_at FROM crawls c LEFT JOIN topics t ON t.id = c.topic_id WHERE finished_at >= {H48} OR (finished_at IS NULL AND started_at >= {H48}) ORDER BY started_at DESC, c.id DESC LIMIT 50"),
    "h06_crawl_status": (lambda v: v.crawls.select("id", crawl_status("ok_bool").alias("status")), f"SELECT id, {STATUS} FROM crawls"),
    "h07_crawl_runs": (lambda v: crawl_runs_report(v.crawl_runs), "SELECT id, workflow_name, started_at, CAST(json_extract_string(metadata, '$.k') AS BIGINT) AS k FROM crawl_runs ORDER BY started_at DESC, id DESC LIMIT 100"),
    "h08_candidate_list": (lambda v: candidate_list(v.candidate_domains), "SELECT id, domain, score, last_seen_at FROM candidate_domains"),
    "h09_discoveries": (lambda v: v.candidate_domains.where("score is not null").select("domain", "score").orderBy(F.desc("score"), "domain"), "SELECT domain, score FROM candidate_domains WHERE score IS NOT NULL"),
    "h10_newest_sources": (lambda v: newest_sources(v.sources), "SELECT id, domain, created_at FROM sources"),
    "h11_top_sources": (lambda v: top_sources(v.sources), "SELECT id, name, domain, points, last_seen_at, enabled FROM sources ORDER BY points DESC, id LIMIT 20"),
    "h12_duplicate_rate": (lambda v: duplicate_rate(v.crawls, 72), f"SELECT CAST(coalesce(sum(kept), 0) AS BIGINT) AS kept, CAST(coalesce(sum(duplicates), 0) AS BIGINT) AS duplicates, round(100.0 * sum(duplicates) / nullif(sum(kept) + sum(duplicates), 0), 2) AS rate FROM crawls WHERE started_at >= {AS_OF} - INTERVAL 72 HOUR"),
    "h12_duplicate_rate_ok": (lambda v: duplicate_rate(v.crawls, 72, True), f"SELECT CAST(coalesce(sum(kept), 0) AS BIGINT) AS kept, CAST(coalesce(sum(duplicates), 0) AS BIGINT) AS duplicates, round(100.0 * sum(duplicates) / nullif(sum(kept) + sum(duplicates), 0), 2) AS rate FROM crawls WHERE started_at >= {AS_OF} - INTERVAL 72 HOUR AND ok_bool"),
    "h13_publish_latency": (lambda v: publish_latency(v.articles), f"SELECT round(avg(h), 6) AS avg_hours, round(min(h), 6) AS min_hours, round(max(h), 6) AS max_hours FROM (SELECT epoch(first_seen_at - published_at) / 3600.0 AS h FROM articles WHERE first_seen_at >= {AS_OF} - INTERVAL 168 HOUR)"),
    "h14_articles_per_host": (lambda v: articles_per_host(v.articles), f"SELECT regexp_extract(canonical_url, '^[a-zA-Z]+://([^/]+)', 1) AS host, count(*) AS articles FROM articles WHERE first_seen_at >= {AS_OF} - INTERVAL 24 HOUR GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"),
    "h15_freshness_buckets": (lambda v: freshness_buckets(v.articles), f"""SELECT CASE WHEN age < 3 THEN '0-3h' WHEN age < 12 THEN '3-12h' WHEN age < 24 THEN '12-24h' WHEN age < 48 THEN '24-48h' ELSE '48h+' END AS bucket, count(*) AS articles
        FROM (SELECT epoch({AS_OF} - published_at) / 3600.0 AS age FROM articles WHERE first_seen_at >= {AS_OF} - INTERVAL 168 HOUR) GROUP BY 1"""),
    "h16_stale_sources": (lambda v: stale_sources(v.sources, 0), f"SELECT id, name, domain, last_seen_at, points FROM sources WHERE enabled AND (last_seen_at IS NULL OR last_seen_at < {AS_OF})"),
    "h17_review_list": (lambda v: review_list(v.candidate_domains, v.candidate_probes), "SELECT c.id, c.domain, c.score, p.has_sitemap, p.jsonld_news FROM candidate_domains c LEFT JOIN candidate_probes p ON p.domain_id = c.id WHERE score >= 40 AND score < 60 ORDER BY score DESC, c.id LIMIT 50"),
    "h18_failing_topics": (lambda v: failing_topics(v.crawls, 72), f"SELECT topic_id, count(*) AS failures FROM crawls WHERE started_at > {AS_OF} - INTERVAL 72 HOUR AND NOT ok_bool GROUP BY 1 HAVING count(*) >= 3"),
    "h19_silent_topics": (lambda v: silent_topics(v.topics, v.topic_articles.where("hidden_bool")), f"SELECT t.id, t.slug, max(l.added_at) AS last_added FROM topics t LEFT JOIN topic_articles l ON l.topic_id = t.id AND l.hidden_bool GROUP BY 1, 2 HAVING max(l.added_at) IS NULL OR max(l.added_at) < {AS_OF} - INTERVAL 2 HOUR"),
    "h20_failing_crawls": (lambda v: failing_crawls(v.crawls, 72), f"SELECT id, topic_id, errors, kept FROM crawls WHERE started_at > {AS_OF} - INTERVAL 72 HOUR AND errors > kept"),
    "h21_articles_per_source": (lambda v: articles_per_source(v.articles, v.sources), f"SELECT s.domain, count(*) AS articles FROM articles a JOIN sources s ON s.id = a.source_id WHERE a.first_seen_at > {AS_OF} - INTERVAL 24 HOUR GROUP BY 1"),
    "h22_crawl_success": (lambda v: crawl_success(v.crawls), "SELECT ok_bool, count(*) AS crawls, round(avg(kept), 6) AS avg_kept FROM crawls GROUP BY 1"),
    "h22_recent_crawl_success": (lambda v: crawl_success(v.crawls, 480), f"SELECT ok_bool, count(*) AS crawls, round(avg(kept), 6) AS avg_kept FROM crawls WHERE started_at > {AS_OF} - INTERVAL 480 HOUR GROUP BY 1"),
    "h23_good_candidates": (lambda v: good_candidates(v.candidate_domains), "SELECT domain, score FROM candidate_domains WHERE score >= 40"),
    "h24_topic_sources": (lambda v: topic_sources(v.sources_topics, v.sources, v.articles, v.topic_articles, 1), PER_SOURCE.format("")),
    "h25_coverage": (lambda v: coverage(topic_sources(v.sources_topics, v.sources, v.articles, v.topic_articles, 1)), f"SELECT count(CASE WHEN articles > 0 THEN 1 END) AS covered, count(*) AS sources, round(100.0 * count(CASE WHEN articles > 0 THEN 1 END) / nullif(count(*), 0), 2) AS pct FROM ({PER_SOURCE.format('')})"),
    "h26_topic_sources_window": (lambda v: topic_sources(v.sources_topics, v.sources, v.articles, v.topic_articles, 1, hours_before(48), now()), PER_SOURCE.format(f"AND l.added_at BETWEEN {H48} AND {AS_OF}")),
    "h27_shared_sources": (lambda v: shared_sources(v.sources_topics), "SELECT source_id, count(*) AS topics FROM sources_topics GROUP BY 1 HAVING count(*) > 1"),
    "h28_crawl_time": (lambda v: crawl_time(v.topics, v.sources_topics, v.sources), "SELECT slug, n AS sources, n * 10 AS seconds, n * 10 <= 300 AS fits_300, n * 10 <= 2700 AS fits_2700 FROM (SELECT t.slug, count(s.id) AS n FROM topics t LEFT JOIN sources_topics st ON st.topic_id = t.id LEFT JOIN sources s ON s.id = st.source_id AND s.enabled GROUP BY 1)"),
    "h29_visibility": (lambda v: visibility(v.topic_articles), "SELECT topic_id, count(CASE WHEN NOT hidden_bool THEN 1 END) AS visible, count(CASE WHEN hidden_bool THEN 1 END) AS hidden, count(*) AS total FROM topic_articles GROUP BY 1"),
    "h30_recent_counts": (lambda v: recent_counts(v.topic_articles, v.articles), f"SELECT topic_id, {', '.join(f'count(CASE WHEN published_at >= {AS_OF} - INTERVAL {h} HOUR THEN 1 END) AS last_{k}' for k, h in WINDOWS.items())} FROM topic_articles l JOIN articles a ON a.id = l.article_id WHERE NOT hidden_bool GROUP BY 1"),
    "h31_unlinked_hits": (lambda v: unlinked_hits(v.articles, v.topic_articles, 3, "thing"), f"SELECT id, first_seen_at FROM articles WHERE {HIT} AND id NOT IN (SELECT article_id FROM topic_articles WHERE topic_id = 3)"),
    "h31_recent_unlinked_hits": (lambda v: unlinked_hits(v.articles, v.topic_articles, 3, "thing", 72), f"SELECT id, first_seen_at FROM articles WHERE {HIT} AND first_seen_at >= {AS_OF} - INTERVAL 72 HOUR AND id NOT IN (SELECT article_id FROM topic_articles WHERE topic_id = 3)"),
    "h32_foreign_hits": (lambda v: foreign_hits(v.articles, v.sources_topics, 1, "thing"), f"SELECT source_id, count(*) AS articles FROM articles WHERE {HIT} AND source_id NOT IN (SELECT source_id FROM sources_topics WHERE topic_id = 1) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"),
    "h33_links_per_day": (lambda v: links_per_day(v.topic_articles), "SELECT topic_id, strftime(added_at, '%Y-%m-%d') AS day, count(*) AS links FROM topic_articles WHERE NOT hidden_bool GROUP BY 1, 2"),
    "h34_latest_crawls": (lambda v: latest_crawls(v.crawls), f"SELECT topic_id, id, {STATUS} FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY started_at DESC, id DESC) AS rn FROM crawls) WHERE rn = 1"),
    "h35_crawls_since": (lambda v: crawls_since(v.crawls, hours_before(72)), f"SELECT id, finished_at IS NULL AS running FROM crawls WHERE finished_at > {AS_OF} - INTERVAL 72 HOUR OR finished_at IS NULL"),
    "h36_learned_configs": (lambda v: learned_configs(v.sources).where(~F.col("lacking")).select("domain", "pattern", "confidence"), "SELECT domain, coalesce(json_extract_string(api_config, '$.articlePattern'), '') AS pattern, coalesce(CAST(json_extract_string(api_config, '$.confidence') AS DOUBLE), 0.0) AS confidence FROM sources WHERE json_extract_string(api_config, '$.learned') = 'true'"),
    "h37_lacking_configs": (lambda v: learned_configs(v.sources).where("lacking").select("domain"), "SELECT domain FROM sources WHERE coalesce(json_extract_string(api_config, '$.learned'), 'false') <> 'true'"),
}
