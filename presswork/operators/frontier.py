"""Crawl frontier (inventory F1-F6): which URLs of a topic's sites to fetch next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswork.functions.urls import strip_tracking
from presswork.operators.extraction import allowed
from presswork.operators.reports import hours_before, now
from presswork.operators.topk import top_per_group
from presswork.sources.fixtures import AS_OF


def sites(topics: DataFrame, sources_topics: DataFrame, sources: DataFrame, cap: int = 30) -> DataFrame:
    """enabled sources of enabled topics, with their index paths (default: /) and cap."""
    paths = F.coalesce(F.from_json("api_config", "indexPaths array<string>")["indexPaths"], F.array(F.lit("/")))
    s = sources.where("enabled").select(F.col("id").alias("source_id"), "domain", F.array_join(paths, ",").alias("index_paths"))
    return topics.where("enabled").select(F.col("id").alias("topic_id"), "freshness_hours").join(sources_topics, "topic_id").join(s, "source_id").select("topic_id", "domain", "index_paths", "freshness_hours", F.lit(cap).alias("cap"))


def first_per_domain(rows: DataFrame, n: Column | int, *order: Column) -> DataFrame:
    """The first n rows of each domain. Spark's window group limit cuts before the shuffle where n is a number."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("domain").orderBy(*order))).where(F.col("rn") <= n)


def recent_sitemap_urls(entries: DataFrame, hours: int = 72, n: int = 30) -> DataFrame:
    """newest entries of each domain with a date inside the window; duplicates are dropped before the cut."""
    rows = entries.where(F.col("lastmod") >= hours_before(hours)).groupBy("domain", "url").agg(F.max("lastmod").alias("lastmod"))
    return first_per_domain(rows, n, F.desc("lastmod"), F.col("url"))


def index_page_urls(entries: DataFrame, n: int = 30, paths: int = 3) -> DataFrame:
    """URLs of the first index pages in order of page and place."""
    rows = entries.where(F.col("path_no") < paths).groupBy("domain", "url").agg(F.min(F.struct("path_no", "place")).alias("at"))
    return first_per_domain(rows, n, F.col("at.path_no"), F.col("at.place"), F.col("url"))


def frontier(entries: DataFrame, index: DataFrame, seen: DataFrame, hours: int = 72, cap: int = 30, rules: DataFrame | None = None, canonicalize: bool = False) -> DataFrame:
    """Sitemap URLs; a domain with under half its cap is filled with index URLs; seen and forbidden URLs go.

    Raw URLs are compared with canonical ones unless canonicalize is set.
    """
    maps = recent_sitemap_urls(entries, hours, cap).select("domain", "url", "rn")
    have = maps.groupBy("domain").agg(F.count("*").alias("have"))
    more = index_page_urls(index, cap).select("domain", "url", "rn").join(have, "domain", "left")
    more = more.where((F.coalesce("have", F.lit(0)) < cap / 2) & (F.col("rn") <= cap - F.coalesce("have", F.lit(0))))
    urls = maps.select("domain", "url").union(more.select("domain", "url")).dropDuplicates(["url"])
    key = strip_tracking(F.col("url")) if canonicalize else F.col("url")
    urls = urls.withColumn("key", key).join(seen.select(F.col("canonical_url").alias("key")), "key", "left_anti").select("domain", "url")
    return urls if rules is None else allowed(urls, rules).where("allowed").select("domain", "url")


def topic_frontiers(site: DataFrame, entries: DataFrame, index: DataFrame, seen: DataFrame, rules: DataFrame, paths: int = 3, canonicalize: bool = False, as_of: Column | None = None) -> DataFrame:
    """F6 with F1-F5, D9 and E21: (topic_id, domain, url) to fetch for every topic of sites().

    A site's sitemap URLs within its topic's freshness come first, newest first, up to the site's cap; a site with under half of it is filled with URLs of its first
    index pages (path_no counts its index paths); a URL that two sites of a topic list counts once, under the first domain; seen and forbidden URLs go. A
    site's URLs are cut in parts, so one domain may hold most of them.
    """
    site = site.select("topic_id", "domain", "freshness_hours", "cap", F.least(F.lit(paths), F.size(F.split("index_paths", ","))).alias("paths"))
    per_site = ("topic_id", "domain")
    fresh = entries.join(site, "domain").where(F.unix_seconds("lastmod") >= F.unix_seconds(now(as_of)) - F.col("freshness_hours") * 3600)
    maps = fresh.groupBy(*per_site, "cap", "url").agg(F.max("lastmod").alias("lastmod"))
    maps = top_per_group(maps, per_site, F.col("cap"), (F.desc("lastmod"), F.asc("url")), ("url",)).select(*per_site, "url")
    have = maps.groupBy(*per_site).agg(F.count("*").alias("have"))
    thin = site.join(have, [*per_site], "left").withColumn("have", F.coalesce("have", F.lit(0))).where(F.col("have") < F.col("cap") / 2)
    listed = index.join(thin, "domain").where(F.col("path_no") < F.col("paths")).groupBy(*per_site, (F.col("cap") - F.col("have")).alias("room"), "url").agg(F.min(F.struct("path_no", "place")).alias("at"))
    more = top_per_group(listed, per_site, F.col("room"), (F.asc("at"), F.asc("url")), ("url",)).select(*per_site, "url")
    urls = maps.union(more).groupBy("topic_id", "url").agg(F.min("domain").alias("domain"))
    key = strip_tracking(F.col("url")) if canonicalize else F.col("url")
    new = urls.withColumn("key", key).join(seen.select(F.col("canonical_url").alias("key")), "key", "left_anti")
    return allowed(new.select("topic_id", "domain", "url"), rules).where("allowed").select("topic_id", "domain", "url")


SITEMAP = f"SELECT domain, url, rn FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY lastmod DESC, url) AS rn FROM (SELECT domain, url, max(lastmod) AS lastmod FROM sitemap_urls WHERE lastmod >= {AS_OF} - INTERVAL 72 HOUR GROUP BY 1, 2)) WHERE rn <= {{0}}"
INDEX = "SELECT domain, url, rn FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY path_no, place, url) AS rn FROM index_urls WHERE path_no < 3) WHERE rn <= {0}"
FRONTIER = f"""SELECT domain, url FROM (SELECT domain, url FROM ({SITEMAP.format(8)}) UNION SELECT i.domain, i.url FROM ({INDEX.format(8)}) i LEFT JOIN (SELECT domain, count(*) AS have FROM ({SITEMAP.format(8)}) GROUP BY 1) h ON h.domain = i.domain
    WHERE coalesce(have, 0) < 4 AND rn <= 8 - coalesce(have, 0)) WHERE url NOT IN (SELECT canonical_url FROM articles WHERE first_seen_at < {AS_OF} - INTERVAL 48 HOUR)"""

SITES = """SELECT t.id AS topic_id, s.domain, t.freshness_hours, 8 AS cap, least(3, coalesce(len(CAST(json_extract(api_config, '$.indexPaths') AS VARCHAR[])), 1)) AS paths FROM topics t JOIN sources_topics st ON st.topic_id = t.id JOIN sources s ON s.id = st.source_id WHERE t.enabled AND s.enabled"""
TOPIC_FRONTIER = f"""WITH st AS ({SITES}), m AS (SELECT topic_id, domain, url FROM (SELECT *, row_number() OVER (PARTITION BY topic_id, domain ORDER BY lastmod DESC, url) AS rn FROM (
        SELECT topic_id, u.domain, url, cap, max(lastmod) AS lastmod FROM sitemap_urls u JOIN st ON st.domain = u.domain WHERE lastmod >= {AS_OF} - to_hours(freshness_hours) GROUP BY ALL)) WHERE rn <= cap),
    i AS (SELECT topic_id, domain, url FROM (SELECT *, row_number() OVER (PARTITION BY topic_id, domain ORDER BY path_no, place, url) AS rn FROM (
        SELECT st.topic_id, u.domain, url, cap, coalesce(n, 0) AS have, min_by(path_no, path_no * 1000000 + place) AS path_no, min_by(place, path_no * 1000000 + place) AS place FROM index_urls u JOIN st ON st.domain = u.domain
        LEFT JOIN (SELECT topic_id, domain, count(*) AS n FROM m GROUP BY 1, 2) h ON h.topic_id = st.topic_id AND h.domain = st.domain WHERE path_no < paths GROUP BY st.topic_id, u.domain, url, cap, have)) WHERE have < cap / 2.0 AND rn <= cap - have),
    u AS (SELECT topic_id, url, min(domain) AS domain FROM (SELECT * FROM m UNION ALL SELECT * FROM i) GROUP BY 1, 2)
    SELECT topic_id, domain, url FROM u WHERE url NOT IN (SELECT canonical_url FROM articles WHERE first_seen_at < {AS_OF} - INTERVAL 36 HOUR) AND (
        EXISTS (SELECT 1 FROM robots_rules r WHERE r.domain = u.domain AND kind = 'allow' AND starts_with(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^#]*)', 1), path))
        OR NOT EXISTS (SELECT 1 FROM robots_rules r WHERE r.domain = u.domain AND kind = 'disallow' AND starts_with(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^#]*)', 1), path)))"""

QUERIES = {
    "f01_sites": (lambda v: sites(v.topics, v.sources_topics, v.sources), "SELECT t.id AS topic_id, s.domain, coalesce(array_to_string(CAST(json_extract(api_config, '$.indexPaths') AS VARCHAR[]), ','), '/') AS index_paths, t.freshness_hours, 30 AS cap FROM topics t JOIN sources_topics st ON st.topic_id = t.id JOIN sources s ON s.id = st.source_id WHERE t.enabled AND s.enabled"),
    "f02_sitemap_urls": (lambda v: recent_sitemap_urls(v.sitemap_urls).select("domain", "url", F.col("rn").cast("long").alias("rn")), SITEMAP.format(30)),
    "f03_index_urls": (lambda v: index_page_urls(v.index_urls, 10).select("domain", "url", F.col("rn").cast("long").alias("rn")), INDEX.format(10)),
    "f04_filled": (lambda v: frontier(v.sitemap_urls, v.index_urls, v.articles.where(F.col("first_seen_at") < hours_before(24 * 90)), cap=8), FRONTIER.replace("INTERVAL 48 HOUR", "INTERVAL 2160 HOUR")),
    "f05_unseen": (lambda v: v.sitemap_urls.join(v.articles.where(F.col("first_seen_at") < hours_before(48)).select(F.col("canonical_url").alias("url")), "url", "left_anti").select("url"), f"SELECT url FROM sitemap_urls WHERE url NOT IN (SELECT canonical_url FROM articles WHERE first_seen_at < {AS_OF} - INTERVAL 48 HOUR)"),
    "f06_frontier": (lambda v: frontier(v.sitemap_urls, v.index_urls, v.articles.where(F.col("first_seen_at") < hours_before(48)), cap=8), FRONTIER),
    "f06_topic_frontiers": (lambda v: topic_frontiers(sites(v.topics, v.sources_topics, v.sources, 8), v.sitemap_urls, v.index_urls, v.articles.where(F.col("first_seen_at") < hours_before(36)), v.robots_rules), TOPIC_FRONTIER),
}
