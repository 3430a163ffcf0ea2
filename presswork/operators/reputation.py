"""Source reputation, failure tracking and discovery (inventory R1-R19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.functions.urls import links
from presswork.operators.extraction import LISTED, NEWS
from presswork.operators.extraction import OUT as OUTBOUND
from presswork.operators.extraction import listing_domains, news_domains, outbound
from presswork.operators.failures import STATE, failure_reason, failure_state
from presswork.operators.reports import hours_before
from presswork.sources.fixtures import AS_OF

#: Domains that are never discovered.
MAINSTREAM = (
    "nytimes.com", "washingtonpost.com", "wsj.com", "ft.com", "cnn.com", "bbc.com", "reuters.com", "apnews.com", "theguardian.com", "bloomberg.com", "economist.com",
    "twitter.com", "x.com", "facebook.com", "youtube.com", "instagram.com", "linkedin.com", "reddit.com", "tiktok.com", "google.com", "wikipedia.org", "amazon.com",
)
#: Weights of the two probe rubrics.
PROBE_A = {"has_sitemap": 30, "lastmod_recent": 20, "has_feed": 15, "jsonld_news": 25, "has_lang": 10}
PROBE_B = {"https": 5, "has_sitemap": 10, "has_feed": 10}


def bump_points(sources: DataFrame, inserted: DataFrame, column: str = "points") -> DataFrame:
    """One point more for each row of (source_id)."""
    more = inserted.groupBy("source_id").agg(F.count("*").alias("more"))
    return sources.join(more, sources.id == more.source_id, "left").select(sources.id, (F.col(column) + F.coalesce("more", F.lit(0))).alias(column))


def decay(points: Column, weeks: int = 1, factor: float = 0.6) -> Column:
    """R2: floor after every week, so weeks are folded one by one."""
    for _ in range(weeks):
        points = F.greatest(F.lit(0), F.floor(points * factor))
    return points


def auto_disable(sources: DataFrame, state: DataFrame, limit: int = 20) -> DataFrame:
    """Sources with too many failures in a row are disabled."""
    n = F.coalesce("consecutive_failures", F.lit(0))
    return sources.join(state, sources.id == state.source_id, "left").select(sources.id, (F.col("enabled") & (n < limit)).alias("enabled"), (F.col("enabled") & (n >= limit)).alias("disabled_now"))


def is_mainstream(domain: Column) -> Column:
    """R10."""
    return F.regexp_replace(F.lower(domain), "^www\\.", "").isin(*MAINSTREAM)


def candidates(feeders: dict[str, DataFrame], sources: DataFrame, n: int = 50) -> DataFrame:
    """Distinct new domains of several feeders, each with the first feeder that has it, at most n."""
    parts = [df.select("domain", F.lit(i).alias("feeder_no"), F.lit(name).alias("feeder")) for i, (name, df) in enumerate(feeders.items())]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    one = rows.groupBy("domain").agg(F.min(F.struct("feeder_no", "feeder")).alias("f")).join(sources.select("domain"), "domain", "left_anti")
    return one.select("domain", "f.feeder_no", "f.feeder").orderBy("feeder_no", "domain").limit(n).select("domain", "feeder")


def mined_links(articles: DataFrame, pages: DataFrame, days: int = 7) -> DataFrame:
    """Domains that pages of recent articles link to, with their number of pages."""
    recent = articles.where(F.col("first_seen_at") >= hours_before(24 * days)).select(F.col("id").alias("page_id"))
    return outbound(pages.join(recent, "page_id", "left_semi")).groupBy("domain").agg(F.count("*").alias("pages"))


def topic_discovery(links: DataFrame, articles: DataFrame, pages: DataFrame, sources: DataFrame, topic_id: int, n: int = 3) -> DataFrame:
    """New domains in the newest articles of a topic, by the article that shows them first; score 5."""
    newest = links.where(F.col("topic_id") == topic_id).orderBy(F.desc("added_at"), F.desc("article_id")).limit(n).select(F.col("article_id").alias("page_id"), "added_at")
    found = outbound(pages.join(newest.select("page_id"), "page_id", "left_semi"), True, ()).where(~is_mainstream(F.col("domain"))).join(sources.select("domain"), "domain", "left_anti")
    return found.join(newest, "page_id").groupBy("domain").agg(F.max_by("page_id", F.struct("added_at", "page_id")).alias("article_id")).select("domain", "article_id", F.lit(5).alias("score"))


def discovery_points(sources: DataFrame, found: DataFrame, articles: DataFrame, candidates: DataFrame) -> DataFrame:
    """A source gets one point more for each new domain, neither a source nor a candidate yet, that its articles link to."""
    new = found.join(sources.select("domain"), "domain", "left_anti").join(candidates.select("domain"), "domain", "left_anti")
    by_source = new.join(articles.select(F.col("id").alias("page_id"), "source_id"), "page_id").select("source_id", "domain").distinct()
    return bump_points(sources, by_source)


def probe_score(weights: dict[str, int]) -> Column:
    """R14, R15."""
    return sum((F.when(F.col(c), w).otherwise(0) for c, w in weights.items()), F.lit(0))


def robots_state(domains: DataFrame, rules: DataFrame) -> DataFrame:
    """Restricted with any disallow rule, open with rules but none, error without a robots row."""
    state = rules.groupBy("domain").agg(F.max(F.when(F.col("kind") == "disallow", "restricted").otherwise("open")).alias("s"))
    return domains.join(state, "domain", "left").select("domain", F.coalesce("s", F.lit("error")).alias("robots_state"))


def promotable(candidates: DataFrame, topics: DataFrame, least: int = 60) -> DataFrame:
    """Candidates for automatic promotion, with the first enabled topic."""
    first = topics.where("enabled").agg(F.min("id").alias("topic_id"))
    return candidates.where(F.col("score") >= least).select("domain", "score").crossJoin(F.broadcast(first))  # one row


def discovery_stats(candidates: DataFrame, probes: DataFrame, least: int = 60) -> DataFrame:
    """Candidates found, those probed, those promoted by their probe's score, and those whose probe failed (no probe row)."""
    tried = probes.select(F.col("domain_id").alias("id")).distinct().withColumn("probed", F.lit(True))
    rows = candidates.join(tried, "id", "left")
    return rows.agg(F.count("*").alias("found"), F.count_if("probed").alias("probed"), F.count_if(F.coalesce("probed", F.lit(False)) & (F.col("score") >= least)).alias("promoted"), F.count_if(F.col("probed").isNull()).alias("errors"))


def page_listings(pages: DataFrame) -> DataFrame:
    """The URL of each page as a listing of its own."""
    return pages.select(F.to_json(F.struct(F.struct(F.array(F.struct(F.struct("url").alias("data"))).alias("children")).alias("data"))).alias("json"))


def search_queries(topics: DataFrame) -> DataFrame:
    """R19."""
    all_ = F.array(F.concat("name", F.lit(" news")), F.concat("name", F.lit(" latest articles")), F.when(F.col("query") != "", F.concat("query", F.lit(" breaking news"))))
    return topics.select("id", F.explode(F.filter(all_, lambda q: q.isNotNull())).alias("q"))


A_SUM = " + ".join(f"CASE WHEN {c} THEN {w} ELSE 0 END" for c, w in PROBE_A.items())



def _out(strip_www: bool) -> str:
    """SQL of the pages and the other hosts they link to, with or without www. and social networks."""
    own, domain = (f"regexp_extract({x}, '(?i)^[a-z]+://([^/:?#]+)', 1)" for x in ("url", "href"))
    own, domain = (f"regexp_replace(lower({x}), '^www\\.', '')" if strip_www else f"lower({x})" for x in (own, domain))
    seen = "" if strip_www else " AND domain NOT LIKE '%facebook%' AND domain NOT LIKE '%twitter%'"
    return f"""SELECT DISTINCT page_id, domain FROM (SELECT page_id, {own} AS own, {domain} AS domain FROM (
        SELECT page_id, url, unnest(regexp_extract_all(html, 'href=["'']([^"'']*)["'']', 1)) AS href FROM tagged_pages) WHERE regexp_matches(href, '(?i)^https?://')) WHERE domain <> '' AND domain <> own{seen}"""


OUT, OUT_PLAIN = _out(False), _out(True)

QUERIES = {
    "r01_bump_points": (lambda v: bump_points(v.sources, v.articles.where(F.col("first_seen_at") >= hours_before(24))), f"SELECT s.id, s.points + count(a.id) AS points FROM sources s LEFT JOIN articles a ON a.source_id = s.id AND a.first_seen_at >= {AS_OF} - INTERVAL 24 HOUR GROUP BY s.id, s.points"),
    "r02_decay": (lambda v: v.sources.select("id", decay(F.col("points"), 3).cast("long").alias("points")), "SELECT id, CAST(floor(floor(floor(points * 0.6) * 0.6) * 0.6) AS BIGINT) AS points FROM sources"),
    "r03_failure_state": (lambda v: failure_state(v.attempts), STATE),
    "r04_reasons": (lambda v: v.attempts.groupBy(failure_reason(F.col("status"), F.col("id") % 37 == 0, F.when(F.col("id") % 41 == 0, F.concat(F.repeat(F.lit("read timed out, "), 8), F.col("source_id").cast("string")))).alias("reason")).agg(F.count("*").alias("n")), "SELECT CASE WHEN id % 37 = 0 THEN 'robots_disallow' WHEN id % 41 = 0 THEN substring(repeat('read timed out, ', 8) || source_id, 1, 100) WHEN status <> 200 THEN 'http_' || CAST(status AS VARCHAR) END AS reason, count(*) AS n FROM attempts GROUP BY 1"),
    "r05_auto_disable": (lambda v: auto_disable(v.sources, failure_state(v.attempts), 4), f"SELECT s.id, s.enabled AND coalesce(consecutive_failures, 0) < 4 AS enabled, s.enabled AND coalesce(consecutive_failures, 0) >= 4 AS disabled_now FROM sources s LEFT JOIN ({STATE}) f ON f.source_id = s.id"),
    "r06_ordered": (lambda v: v.sources.where("enabled").select("domain", "points", "created_at").orderBy(F.desc("points"), F.desc("created_at")), "SELECT domain, points, created_at FROM sources WHERE enabled"),
    "r07_known_domains": (lambda v: v.candidate_domains.join(v.sources.select("domain"), F.regexp_replace(v.candidate_domains.domain, "^www\\.", "") == v.sources.domain, "left_anti").select("domain"), "SELECT c.domain FROM candidate_domains c WHERE regexp_replace(c.domain, '^www\\.', '') NOT IN (SELECT domain FROM sources)"),
    "r08_last_seen": (lambda v: v.articles.groupBy("source_id").agg(F.max("first_seen_at").alias("last_seen_at")), "SELECT source_id, max(first_seen_at) AS last_seen_at FROM articles GROUP BY 1"),
    "r09_discovery_points": (lambda v: discovery_points(v.sources, outbound(v.tagged_pages), v.articles, v.candidate_domains), f"SELECT s.id, s.points + count(DISTINCT o.domain) AS points FROM sources s LEFT JOIN (SELECT a.source_id, o.domain FROM ({OUT}) o JOIN articles a ON a.id = o.page_id WHERE o.domain NOT IN (SELECT domain FROM sources) AND o.domain NOT IN (SELECT domain FROM candidate_domains)) o ON o.source_id = s.id GROUP BY s.id, s.points"),
    "r10_mainstream": (lambda v: v.candidate_domains.where(~is_mainstream(F.col("domain"))).select("domain"), f"SELECT domain FROM candidate_domains WHERE regexp_replace(domain, '^www\\.', '') NOT IN ({', '.join(repr(d) for d in MAINSTREAM)})"),
    "r11_candidates": (lambda v: candidates({"outbound": mined_links(v.articles, v.tagged_pages), "seeds": v.candidate_domains.where("discovered_via = 'search'"), "search": news_domains(v.tagged_pages.select(F.explode(links("html")).alias("url"))), "aggregator": outbound(v.tagged_pages, True, ("canon",)), "listing": listing_domains(page_listings(v.pages))}, v.sources),
        f"""WITH f AS (SELECT domain, 0 AS n, 'outbound' AS feeder FROM ({OUT}) o JOIN articles a ON a.id = o.page_id WHERE first_seen_at >= {AS_OF} - INTERVAL 168 HOUR UNION ALL SELECT domain, 1, 'seeds' FROM candidate_domains WHERE discovered_via = 'search'
            UNION ALL SELECT domain, 2, 'search' FROM ({NEWS}) UNION ALL SELECT domain, 3, 'aggregator' FROM ({OUTBOUND(True, "AND NOT contains(domain, 'canon')")}) UNION ALL SELECT domain, 4, 'listing' FROM ({LISTED}) WHERE NOT contains(domain, 'reddit'))
        SELECT domain, arg_min(feeder, n) AS feeder FROM f WHERE domain NOT IN (SELECT domain FROM sources) GROUP BY 1 ORDER BY min(n), domain LIMIT 50"""),
    "r12_mined_links": (lambda v: mined_links(v.articles, v.tagged_pages), f"SELECT domain, count(*) AS pages FROM ({OUT}) o JOIN articles a ON a.id = o.page_id WHERE first_seen_at >= {AS_OF} - INTERVAL 168 HOUR GROUP BY 1"),
    "r13_topic_discovery": (lambda v: topic_discovery(v.topic_articles, v.articles, v.tagged_pages, v.sources, 1, 30), f"WITH newest AS (SELECT article_id AS page_id, added_at FROM topic_articles WHERE topic_id = 1 ORDER BY added_at DESC, article_id DESC LIMIT 30) SELECT domain, last(page_id ORDER BY added_at, page_id) AS article_id, 5 AS score FROM ({OUT_PLAIN}) o JOIN newest USING (page_id) WHERE regexp_replace(domain, '^www\\.', '') NOT IN ({', '.join(repr(d) for d in MAINSTREAM)}) AND domain NOT IN (SELECT domain FROM sources) GROUP BY 1"),
    "r14_probe_score": (lambda v: v.candidate_probes.select("domain_id", probe_score(PROBE_A).alias("score")), f"SELECT domain_id, {A_SUM} AS score FROM candidate_probes"),
    "r15_probe_score_b": (lambda v: v.candidate_probes.withColumn("https", F.lit(True)).select("domain_id", probe_score(PROBE_B).alias("score")), "SELECT domain_id, 5 + CASE WHEN has_sitemap THEN 10 ELSE 0 END + CASE WHEN has_feed THEN 10 ELSE 0 END AS score FROM candidate_probes"),
    "r16_robots_state": (lambda v: robots_state(v.sources.select("domain"), v.robots_rules), "SELECT s.domain, coalesce(max(CASE WHEN kind = 'disallow' THEN 'restricted' ELSE 'open' END) FILTER (kind IS NOT NULL), 'error') AS robots_state FROM sources s LEFT JOIN robots_rules r ON r.domain = s.domain GROUP BY 1"),
    "r17_promotable": (lambda v: promotable(v.candidate_domains, v.topics), "SELECT domain, score, (SELECT min(id) FROM topics WHERE enabled) AS topic_id FROM candidate_domains WHERE score >= 60"),
    "r18_discovery_stats": (lambda v: discovery_stats(v.candidate_domains, v.candidate_probes), "SELECT count(*) AS found, count(p.domain_id) AS probed, count(*) FILTER (p.domain_id IS NOT NULL AND score >= 60) AS promoted, count(*) FILTER (p.domain_id IS NULL) AS errors FROM candidate_domains c LEFT JOIN candidate_probes p ON p.domain_id = c.id"),
    "r19_search_queries": (lambda v: search_queries(v.topic_requests.withColumnRenamed("slug", "id")), "SELECT slug AS id, name || ' news' AS q FROM topic_requests UNION ALL SELECT slug, name || ' latest articles' FROM topic_requests UNION ALL SELECT slug, query || ' breaking news' FROM topic_requests WHERE query <> ''"),
}
