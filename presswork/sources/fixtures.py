"""Domain tables derived from the driver's tables by one formula for both engines.

Every table is a SQL text, built for Spark or for DuckDB; only the two time functions differ.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: 2024-01-31 00:00:00 UTC, the moment all time-dependent queries are asked for.
AS_OF_EPOCH = 1706659200
AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
#: The types of a source.
DDL_TYPES = ("google_news", "reddit", "custom_crawler", "api")
BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


#: The given tables' schemas: what a typed scan has to find.
SCHEMAS = {
    "region": "r_regionkey int, r_name string", "nation": "n_nationkey int, n_name string, n_regionkey int", "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double", "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string", "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int", "pages": "page_id bigint, url string, html string", "benchmark": "item_id bigint, text string", "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def _ts(spark: bool, epoch: str) -> str:
    return f"timestamp_seconds({epoch})" if spark else f"(TIMESTAMP '1970-01-01 00:00:00' + to_seconds(CAST({epoch} AS BIGINT)))"


def epoch(spark: bool, ts: str) -> str:
    return f"unix_timestamp({ts})" if spark else f"CAST(floor(epoch({ts})) AS BIGINT)"


def in_html(text: str) -> str:
    """SQL of a text inside an element or an attribute."""
    for char, entity in ((38, "amp"), (60, "lt"), (62, "gt"), (34, "quot"), (39, "#39")):
        text = f"replace({text}, chr({char}), '&{entity};')"
    return text


def in_json(text: str) -> str:
    """SQL of a text inside a JSON string (in a script of a page)."""
    text = f"replace(replace({text}, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34))"
    for char, letter in ((10, "n"), (13, "r"), (9, "t")):
        text = f"replace({text}, chr({char}), chr(92) || '{letter}')"
    return text


def tables(spark: bool) -> dict[str, str]:
    """SQL of each derived table, in an order in which each uses earlier ones only."""
    ts = lambda e: _ts(spark, e)
    ev = "CAST(ts AS TIMESTAMP)"
    host = "lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1))"
    return {
        "topics": """SELECT * FROM (VALUES
            (1, 'en', 'English', 'thing tion', 'ther|onth', 'zzzz', 'en', 72, 30, true), (2, 'de', 'Deutsch', 'keit', 'lich|ung', '', 'de', 72, 30, true),
            (3, 'fr', 'Francais', 'eaux', 'ment|elle', 'qqq', 'fr', 72, 30, true), (4, 'es', 'Espanol', 'mente', '', '', 'es', 72, 30, false))
            AS t(id, slug, name, query, includes, excludes, lang, freshness_hours, max_items, enabled)""",
        # keywords of every form; valid and bad say what a compiler would: the patterns up to the first that is none, and whether there is one
        "keyword_topics": """SELECT * FROM (VALUES
            (1, 'Plain', 'thing tion', 'ther|onth', '', 'en', 720, 10, 'thing|tion|ther|onth', false), (2, 'Bad at once', '', 'a(b', '', 'en', 720, 10, '', true),
            (3, 'Bad behind good ones', 'keit', 'zzzz|[oops|lich', '', 'de', 720, 10, 'keit|zzzz', true), (4, 'None', 'of', '', '', 'fr', 720, 10, '', false),
            (5, 'Forms', 'th.n [xyz]{2} an+d', 'and the|or?th|zq[a-z]', '', 'en', 720, 10, 'th.n|[xyz]{2}|an+d|and the|or?th|zq[a-z]', false), (6, 'Bad exclude', 'mente', '', '*', 'es', 720, 10, 'mente', false),
            (7, 'Rare', 'qqqq', 'lement.*eaux', '', 'fr', 720, 10, 'qqqq|lement.*eaux', false), (8, 'Start', '^[0-9]+', '', '', 'en', 72, 10, '^[0-9]+', false))
            AS t(id, name, query, includes, excludes, lang, freshness_hours, max_items, valid, bad)""",
        "topic_requests": """SELECT source || '-' || lang AS slug, source || ' ' || lang AS name, CASE WHEN count(*) % 3 <> 0 THEN source || ' ' || lang WHEN count(*) % 2 = 0 THEN '' END AS query,
            CASE WHEN min(doc_id) % 2 = 0 THEN lang END AS lang, CASE WHEN min(doc_id) % 3 = 0 THEN 24 END AS freshness_hours, CASE WHEN min(doc_id) % 5 = 0 THEN 10 END AS max_items FROM documents GROUP BY source, lang""",
        "fetches": "SELECT doc_id AS id, CASE WHEN doc_id % 23 = 0 THEN 503 WHEN doc_id % 31 = 0 THEN 403 ELSE 200 END AS status FROM documents",
        "articles": f"""SELECT doc_id AS id, 'https://' || source || '.example.com/' || lang || '/' || CAST(doc_id AS VARCHAR(20)) AS canonical_url,
            substring(text, 1, 80) AS title, text AS summary, CAST(substring(source, 4) AS INT) AS source_id, source || '.example.com' AS source_domain,
            {ts(f'{AS_OF_EPOCH} - (doc_id * 7919 % 20160) * 60')} AS published_at, lang,
            {ts(f'least({AS_OF_EPOCH}, {AS_OF_EPOCH} - (doc_id * 7919 % 20160) * 60 + (doc_id * 104729 % 720) * 60)')} AS first_seen_at, doc_id % 11 = 0 AS paywalled_bool
            FROM documents""",
        "sources": f"""SELECT CAST(substring(d.source, 4) AS INT) AS id, d.source AS name, d.source || '.example.com' AS domain, CAST(count(*) AS INT) AS points,
            CAST(substring(d.source, 4) AS INT) % 7 <> 0 AS enabled, max(a.first_seen_at) AS last_seen_at, {ts(f'{AS_OF_EPOCH} - CAST(substring(d.source, 4) AS INT) * 86400')} AS created_at,
            CASE WHEN CAST(substring(d.source, 4) AS INT) % 3 = 0 THEN '{{"articlePattern":"/' || d.source || '/","learned":true,"confidence":0.8,"indexPaths":["/","/' || d.source || '/news","/latest","/archive"]}}'
                 WHEN CAST(substring(d.source, 4) AS INT) % 3 = 1 THEN '{{"articlePattern":"/a/","learned":false}}' END AS api_config
            FROM documents d JOIN articles a ON a.id = d.doc_id GROUP BY d.source""",
        "sources_topics": "SELECT s.id AS source_id, t.id AS topic_id FROM sources s CROSS JOIN topics t WHERE (s.id + t.id) % 3 = 0",
        "topic_articles": "SELECT t.id AS topic_id, a.id AS article_id, a.first_seen_at AS added_at, a.id % 17 = 0 AS hidden_bool FROM articles a JOIN topics t ON t.lang = a.lang",
        # tables with rows that break each of their constraints
        "checked_sources": """SELECT id, CASE WHEN id % 9 = 4 THEN NULL ELSE name END AS name, CASE WHEN id % 8 = 6 THEN NULL ELSE domain END AS domain, CASE id % 6 WHEN 0 THEN 'google_news' WHEN 1 THEN 'reddit' WHEN 2 THEN 'api' WHEN 5 THEN 'rss' ELSE 'custom_crawler' END AS type FROM sources
            UNION ALL SELECT id + CASE WHEN id % 10 = 3 THEN 0 ELSE 1000 END, name, domain, NULL FROM sources WHERE id % 5 = 3""",
        "checked_topics": "SELECT id, slug, name FROM topics UNION ALL SELECT id + 10, slug, NULL FROM topics WHERE id = 2 UNION ALL SELECT id + 20, NULL, name FROM topics WHERE id = 3",
        "checked_articles": """SELECT id, CASE WHEN id % 101 = 7 THEN NULL ELSE canonical_url END AS canonical_url, CASE WHEN id % 53 = 0 THEN NULL ELSE title END AS title, CASE WHEN id % 31 = 0 THEN 999 WHEN id % 37 = 0 THEN NULL ELSE source_id END AS source_id, CASE WHEN id % 71 = 0 THEN NULL ELSE published_at END AS published_at FROM articles
            UNION ALL SELECT id + 1000000, canonical_url, title, source_id, published_at FROM articles WHERE id % 41 = 0""",
        "checked_links": "SELECT topic_id, article_id FROM topic_articles UNION ALL SELECT topic_id, article_id FROM topic_articles WHERE article_id % 43 = 0 UNION ALL SELECT 77, article_id FROM topic_articles WHERE article_id % 47 = 0 UNION ALL SELECT topic_id, -1 - article_id FROM topic_articles WHERE article_id % 59 = 0",
        "checked_site_links": "SELECT source_id, topic_id FROM sources_topics UNION ALL SELECT source_id, topic_id FROM sources_topics WHERE source_id % 4 = 1 UNION ALL SELECT source_id + 500, topic_id + 50 FROM sources_topics WHERE source_id % 7 = 2",
        "crawls": f"""SELECT id, topic_id, started_at, CASE WHEN id % 29 <> 0 THEN finished_at END AS finished_at, CASE WHEN id % 29 <> 0 THEN errors <= kept END AS ok_bool, kept, duplicates, quality, errors FROM (
            SELECT CAST({epoch(spark, 'h')} / 3600 AS BIGINT) * 4 + u AS id, u + 1 AS topic_id, started_at, finished_at, kept, duplicates, quality, errors FROM (
            SELECT CAST(user_id % 4 AS INT) AS u, date_trunc('hour', {ev}) AS h, min({ev}) AS started_at, max({ev}) AS finished_at, count(CASE WHEN event_type = 'click' THEN 1 END) AS kept,
            count(CASE WHEN event_type = 'view' THEN 1 END) AS duplicates, count(CASE WHEN event_type = 'signup' THEN 1 END) AS quality, count(CASE WHEN event_type = 'error' THEN 1 END) AS errors
            FROM events GROUP BY 1, 2) g) n""",
        "attempts": f"SELECT event_id AS id, CAST(user_id % 20 AS INT) AS source_id, {ev} AS ts, CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 404 ELSE 200 END AS status FROM events",
        "crawl_runs": f"SELECT event_id AS id, 'crawl-' || CAST(user_id % 4 AS VARCHAR(20)) AS workflow_name, {ev} AS started_at, props AS metadata FROM events WHERE event_type = 'purchase'",
        "candidate_domains": f"""SELECT p AS id, domain, CASE WHEN p % 2 = 0 THEN 'outbound_links' ELSE 'search' END AS discovered_via,
            CASE WHEN p % 13 = 0 THEN NULL ELSE CAST(CASE WHEN p % 2 = 0 THEN 30 ELSE 0 END + CASE WHEN p % 3 = 0 THEN 20 ELSE 0 END + CASE WHEN p % 5 < 3 THEN 25 ELSE 0 END + CASE WHEN p % 7 < 4 THEN 10 ELSE 0 END AS INT) END AS score,
            {ts(f'{AS_OF_EPOCH} - p % 200 * 3600')} AS last_seen_at, p FROM (SELECT {host} AS domain, min(page_id) AS p FROM pages GROUP BY 1) h""",
        "candidate_probes": "SELECT id AS domain_id, p % 2 = 0 AS has_sitemap, p % 3 = 0 AS lastmod_recent, p % 4 = 0 AS has_feed, p % 5 < 3 AS jsonld_news, p % 7 < 4 AS has_lang, CASE WHEN p % 7 < 4 THEN 'en' END AS lang FROM candidate_domains WHERE p % 6 <> 5",
        "tagged_pages": f"""SELECT doc_id AS page_id, 'https://www.' || source || '.example.com:443/n/' || CAST(doc_id AS VARCHAR(20)) || '?utm_source=x&id=' || CAST(doc_id AS VARCHAR(20)) || '&fbclid=9#top' AS url, source,
            CASE CAST(doc_id % 5 AS INT)
            WHEN 0 THEN '<html lang="' || lang || '-XX"><head><script type="application/ld+json">{{"@type":"NewsArticle","headline":"No ' || CAST(doc_id AS VARCHAR(20)) || ': ' || {in_json('title')} || '","description":"' || {in_json('summary')} || '"' || CASE WHEN doc_id % 4 = 1 THEN '' ELSE ',"datePublished":"2024-01-' || CAST(doc_id % 20 + 10 AS VARCHAR(20)) || 'T08:00:00Z"' END || '}}</script></head><body><p>' || source || '</p></body></html>'
            WHEN 1 THEN '<html><head><meta http-equiv="content-language" content="' || lang || '"><meta property="og:title" content="' || {in_html('title')} || '"><meta name="description" content="' || {in_html('summary')} || '"><meta property="og:image" content="https://img.example.org/' || CAST(doc_id AS VARCHAR(20)) || '.png"><meta property="article:published_time" content="' || CASE WHEN doc_id % 7 = 3 THEN 'soon' ELSE '2024-01-' || CAST(doc_id % 20 + 10 AS VARCHAR(20)) || 'T10:30:00Z' END || '"></head><body><a href="https://www.other' || CAST(doc_id % 9 AS VARCHAR(20)) || '.example.net/x">o</a></body></html>'
            WHEN 2 THEN '<html lang="' || lang || '"><head><title>' || {in_html('title')} || '</title><meta name="publish-date" content="2024-01-' || CAST(doc_id % 20 + 10 AS VARCHAR(20)) || '"></head><body><h1>Big <b>' || {in_html('title')} || '</b></h1><p></p><p>' || {in_html('summary')} || '</p><a href="/2024/01/story-' || CAST(doc_id AS VARCHAR(20)) || '">s</a><a href="/tag/x">t</a><a href="https://facebook.com/p">f</a></body></html>'
            WHEN 3 THEN '<html><head><link rel="canonical" href="https://Canon.example.org/c/' || CAST(doc_id AS VARCHAR(20)) || '?gclid=1"><meta property="og:title" content="' || {in_html('title')} || '"><meta property="og:description" content="' || {in_html('summary')} || '"></head><body class="paywall"><a href="http://news' || CAST(doc_id % 4 AS VARCHAR(20)) || '.example.org/article/1">n</a></body></html>'
            ELSE '<html><body><h1>' || {in_html('title')} || '</h1><p>' || {in_html('summary')} || '</p></body></html>' END AS html FROM (SELECT doc_id, lang, source, substring(text, 1, 80) AS title, text AS summary FROM documents) d""",
        "section_pages": f"""SELECT doc_id AS page_id, 'https://www.' || source || '.example.com/' AS url, '<a href="/' || split_part('news,article,actualites,politique,societe,economy,economie,world,monde,sport,culture,tech,science,2024/01,story,video,opinion,author,World,about', ',', CAST(doc_id % 20 + 1 AS INT)) || '/' || CAST(doc_id AS VARCHAR(20)) || '">' || {in_html('text')} || '</a> <a href="https://elsewhere.example.org/news/1">x</a> <a href="/tag/news/">t</a>' AS html FROM documents""",
        "sitemap_urls": f"""SELECT source_domain AS domain, canonical_url AS url, CASE WHEN id % 19 = 0 THEN NULL ELSE published_at END AS lastmod FROM articles""",
        "index_xml": "SELECT id, '<sitemapindex>' || '<sitemap> <loc>' || canonical_url || '/a.xml</loc></sitemap>' || '<sitemap><loc> ' || canonical_url || '/b.xml </loc><lastmod>x</lastmod></sitemap>' || CASE WHEN id % 2 = 0 THEN '<sitemap><loc>' || canonical_url || '/news.xml</loc></sitemap>' ELSE '' END || '<sitemap><loc>' || canonical_url || '/c.xml</loc></sitemap>' || CASE WHEN id % 3 = 0 THEN '<sitemap><loc>' || canonical_url || '/article-' || lang || '.xml</loc></sitemap>' ELSE '' END || '<sitemap><loc>' || canonical_url || '/d.xml</loc></sitemap></sitemapindex>' AS xml FROM articles",
        "robots_texts": "SELECT domain, 'User-agent: other' || chr(10) || 'Disallow: /' || chr(10) || '# ' || name || chr(10) || 'User-Agent: *' || chr(10) || 'Disallow: /' || name || '/' || chr(10) || CASE WHEN id % 2 = 0 THEN 'Allow: /' || name || '/open' || chr(10) ELSE 'Disallow:' || chr(10) END || CASE WHEN id % 3 = 0 THEN 'Crawl-delay: ' || CAST(id % 5 AS VARCHAR(20)) || chr(10) ELSE '' END || 'Sitemap: https://' || domain || '/s.xml' AS text FROM sources",
        "index_urls": "SELECT source_domain AS domain, CAST(id % 4 AS INT) AS path_no, id AS place, canonical_url || CASE WHEN id % 3 = 0 THEN '?ref=i' ELSE '' END AS url FROM articles",
        "robots_rules": "SELECT domain, CASE WHEN id % 2 = 0 THEN 'disallow' ELSE 'allow' END AS kind, CASE WHEN id % 2 = 0 THEN '/en/1' ELSE '/' END AS path FROM sources WHERE id % 5 <> 4",
    }


def with_tables(sql: str) -> str:
    """DuckDB SQL with the derived tables it uses (and those they use) as CTEs before it."""
    have, need = tables(False), set()

    def visit(text: str) -> None:
        for name in have:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                visit(have[name])

    visit(sql)
    parts = [f"{n} AS ({have[n]})" for n in have if n in need]
    if not parts:
        return sql
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {', '.join(parts)}, {body[15:]}"
    return f"WITH {', '.join(parts)}{', ' + body[5:] if body[:5].upper() == 'WITH ' else ' ' + body}"


class Tables:
    """The driver's and the derived tables of one folder as DataFrames, built when first used."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    @cached_property
    def _sql(self) -> dict[str, str]:
        return tables(True)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = self.scan(name) if name in BASE_TABLES else self.derive(self._sql[name])
        return self._made[name]

    def scan(self, name: str) -> DataFrame:
        """Typed scan: timestamps without a zone become UTC timestamps."""
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return df.select([F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes])

    def derive(self, sql: str) -> DataFrame:
        used = [n for n in (*BASE_TABLES, *self._sql) if re.search(rf"(FROM|JOIN)\s+{n}\b", sql)]
        if not used:
            return self.spark.sql(sql)  # nothing to fill in, so braces stand for themselves
        return self.spark.sql(re.sub(r"\b(FROM|JOIN)\s+(\w+)\b", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in used else m[0], sql.replace("{", "{{").replace("}", "}}")), **{n: getattr(self, n) for n in used})
