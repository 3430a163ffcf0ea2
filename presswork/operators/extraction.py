"""Pages to article fields and links (inventory E1-E27)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswork.functions.urls import HOST, TRACKING, decode_entities, found, host, links, meta, normalise, strip_tracking
from presswork.operators.reports import now
from presswork.sources.fixtures import AS_OF

#: Signs of a paywall, hosts that are no news site, paths that are no article.
PAYWALL = "(?i)paywall|subscriber.{0,20}only|premium.{0,20}content|login.{0,20}to.{0,20}continue|subscribe.{0,20}to.{0,20}read"
NOT_NEWS = ("facebook.com", "twitter.com", "instagram.com", "youtube.com", "linkedin.com", "reddit.com", "duckduckgo.com", "google.com", "bing.com")
NOT_ARTICLE = ("/author/", "/tag/", "/category/", "/page/", "/search", "/login", "/register")
ARTICLE_SECTIONS = ("news", "article", "actualites", "politique", "societe", "economy", "economie", "world", "monde", "sport", "culture", "tech", "science")
ARTICLE_PATH = f"(?i)/({'|'.join(ARTICLE_SECTIONS)})/|/[0-9]{{4}}/[0-9]{{2}}/"


def canonical_url(html: str = "html", url: str = "url") -> Column:
    """The canonical link, else the fetched URL, without tracking parameters."""
    a, b = "(?i)<link[^>]*rel=[\"']canonical[\"'][^>]*href=[\"']([^\"']+)[\"']", "(?i)<link[^>]*href=[\"']([^\"']+)[\"'][^>]*rel=[\"']canonical[\"']"
    return normalise(strip_tracking(F.coalesce(found(html, a), found(html, b), F.col(url))))


def json_ld(html: str = "html") -> Column:
    """The first NewsArticle or Article object over all ld+json scripts, as a struct of its fields."""
    scripts = F.regexp_extract_all(html, F.lit("(?is)<script[^>]*application/ld\\+json[^>]*>(.*?)</script>"), F.lit(1))
    one = "struct<`@type`:string,headline:string,description:string,datePublished:string,image:string>"
    objects = F.flatten(F.transform(scripts, lambda s: F.coalesce(F.when(F.ltrim(s).startswith("["), F.from_json(s, f"array<{one}>")).otherwise(F.array(F.from_json(s, one))), F.array().cast(f"array<{one}>"))))
    return F.get(F.filter(objects, lambda o: o["@type"].isin("NewsArticle", "Article")), F.lit(0))


def published_text(html: str = "html") -> Column:
    """E5: article:published_time, else a publish date or time tag."""
    return F.coalesce(meta(html, "article:published_time"), meta(html, "publish(?:ed)?[-_]?(?:date|time)"))


def language(html: str = "html") -> Column:
    """E6."""
    return F.split_part(F.coalesce(found(html, "(?i)<html[^>]*lang=[\"']([^\"']+)[\"']"), meta(html, "content-language")), F.lit("-"), F.lit(1))


def plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "<[^>]*>", ""))


def extract(pages: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Article fields of (url, html). JSON-LD with a headline wins; else meta tags; where title or
    summary is missing, the first heading and paragraph replace both. No title: the page is dropped. An absent date is
    as_of; one that can't be read is marked date_invalid."""
    ld = F.col("ld")
    rows = pages.withColumn("ld", json_ld()).withColumn("use_ld", F.coalesce(ld["headline"] != "", F.lit(False)))
    title = F.coalesce(meta("html", "og:title"), meta("html", "twitter:title"), found("html", "(?i)<title[^>]*>([^<]*)</title>"))
    summary = F.coalesce(meta("html", "og:description"), meta("html", "description"), meta("html", "twitter:description"))
    image = F.coalesce(meta("html", "og:image"), meta("html", "twitter:image"))
    rows = rows.select(
        "*", F.when(F.col("use_ld"), ld["headline"]).otherwise(title).alias("t"), F.when(F.col("use_ld"), ld["description"]).otherwise(summary).alias("s"), F.when(F.col("use_ld"), ld["image"]).otherwise(image).alias("image_url"),
        F.when(F.col("use_ld"), ld["datePublished"]).otherwise(F.coalesce(published_text(), ld["datePublished"])).alias("date_text"),
        plain(found("html", "(?is)<h1[^>]*>(.*?)</h1>")).alias("h1"), plain(found("html", "(?is)<p[^>]*>([^<].*?)</p>")).alias("p1"),
    )
    fall = (F.col("t").isNull() | F.col("s").isNull()) & F.col("h1").isNotNull() & F.col("p1").isNotNull()
    parsed = F.try_to_timestamp("date_text")
    said = F.struct(F.when(fall, F.col("h1")).otherwise(F.col("t")).alias("title"), F.coalesce(F.when(fall, F.col("p1")).otherwise(F.col("s")), F.lit("")).alias("summary"), "date_text")
    # exploded, not filtered: a filter would move below and build the page and try the patterns again for each use in its condition
    rows = rows.select("page_id", "url", "html", "image_url", F.explode(F.filter(F.array(said), lambda r: r["title"].isNotNull())).alias("said")).select("*", "said.*")
    return rows.select(
        "page_id", canonical_url().alias("canonical_url"), "title", "summary", host("url").alias("source_domain"), language().alias("lang"), "image_url",
        F.coalesce(parsed, F.when(F.col("date_text").isNull(), now(as_of))).alias("published_at"), (F.col("date_text").isNotNull() & parsed.isNull()).alias("date_invalid"), F.col("html").rlike(PAYWALL).alias("paywalled_bool"),
    )


def outbound(pages: DataFrame, strip_www: bool = False, drop: tuple[str, ...] = ("facebook", "twitter")) -> DataFrame:
    """Distinct (page_id, domain) of absolute links to other hosts."""
    rows = pages.select("page_id", host("url", strip_www).alias("own"), F.explode(links("html")).alias("href")).where(F.col("href").rlike("(?i)^https?://"))
    rows = rows.withColumn("domain", host("href", strip_www)).where("domain is not null and domain <> coalesce(own, '')")
    for word in drop:
        rows = rows.where(~F.col("domain").contains(word))
    return rows.select("page_id", "domain").distinct()


def news_domains(urls: DataFrame) -> DataFrame:
    """Distinct hosts of URLs, without search engines and social networks."""
    rows = urls.select(host("url", True).alias("domain")).where("domain is not null")
    for word in NOT_NEWS:
        rows = rows.where(~F.col("domain").contains(word))
    return rows.distinct()


def redirect_target(url: Column) -> Column:
    """The percent-decoded uddg parameter; + stays a plus."""
    return F.try_url_decode(F.replace(found(url, "[?&]uddg=([^&]+)"), F.lit("+"), F.lit("%2B")))


def listing_domains(listings: DataFrame, json: str = "json") -> DataFrame:
    """Hosts in data.children[].data.url of a listing."""
    parsed = F.from_json(json, "data struct<children:array<struct<data:struct<url:string>>>>")
    urls = listings.select(F.explode(parsed["data"]["children"]["data"]["url"]).alias("url")).where(F.col("url").rlike("^https?://"))
    return urls.select(host("url", True).alias("domain")).where(~F.col("domain").contains("reddit")).distinct()


def article_links(pages: DataFrame) -> DataFrame:
    """Links of an index page that look like articles of the same host, resolved against it."""
    origin = F.regexp_extract("url", "^([a-zA-Z]+://[^/?#]+)", 1)
    rows = pages.select("page_id", host("url").alias("own"), origin.alias("origin"), F.posexplode(links("html")).alias("place", "href")).where(~F.col("href").rlike("^(#|javascript:|mailto:|tel:|$)"))
    for path in NOT_ARTICLE:
        rows = rows.where(~F.col("href").contains(path))
    link = F.when(F.col("href").rlike("^https?://"), F.col("href")).when(F.col("href").startswith("/"), F.concat("origin", "href")).otherwise(F.concat("origin", F.lit("/"), "href"))
    rows = rows.withColumn("link", link).where((host("link") == F.col("own")) & F.regexp_extract("link", "^[a-zA-Z]+://[^/?#]+([^?#]*)", 1).rlike(ARTICLE_PATH))
    return rows.groupBy("page_id", "link").agg(F.min("place").cast("long").alias("place"))


def sitemap_entries(xml: DataFrame, column: str = "xml") -> DataFrame:
    """(domain, loc, lastmod) of the url blocks of sitemaps; an invalid date is null."""
    rows = xml.select("domain", F.explode(F.regexp_extract_all(column, F.lit("(?s)<url>(.*?)</url>"), F.lit(1))).alias("block"))
    return rows.select("domain", F.trim(found("block", "(?s)<loc>(.*?)</loc>")).alias("loc"), F.try_to_timestamp(F.trim(found("block", "(?s)<lastmod>(.*?)</lastmod>"))).alias("lastmod")).where("loc is not null")


def is_recent(xml: Column, days: int = 7) -> Column:
    """Whether the first <lastmod> date of a sitemap is at most so many days old; false without one."""
    first = F.try_to_timestamp(F.nullif(F.regexp_extract(xml, "<lastmod>([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), F.lit("")))
    return F.coalesce(F.unix_timestamp(now()) - F.unix_timestamp(first) <= days * 86400, F.lit(False))


def first_locs(xml: Column, n: int = 20) -> Column:
    """The first web addresses of a sitemap."""
    return F.slice(F.regexp_extract_all(xml, F.lit("<loc>(https?://[^<]+)</loc>"), F.lit(1)), 1, n)


def child_sitemaps(xml: str = "xml", n: int = 5) -> Column:
    """The first children of a sitemap index, those with news or article in the name before others."""
    locs = F.array_distinct(F.regexp_extract_all(xml, F.lit("(?s)<sitemap>.*?<loc>\\s*(.*?)\\s*</loc>"), F.lit(1)))
    news = lambda u: u.contains("news") | u.contains("article")
    return F.slice(F.concat(F.filter(locs, news), F.filter(locs, lambda u: ~news(u))), 1, n)


def robots_rules(robots: DataFrame, text: str = "text") -> DataFrame:
    """(domain, kind, path, place) of the rules that hold for all agents."""
    lines = robots.select("domain", F.posexplode(F.split(text, "\r?\n")).alias("place", "line")).withColumn("line", F.trim(F.regexp_replace("line", "#.*$", "")))
    parts = lines.select("domain", "place", F.lower(F.trim(F.split_part("line", F.lit(":"), F.lit(1)))).alias("kind"), F.trim(F.regexp_extract("line", "^[^:]*:(.*)$", 1)).alias("path"))
    # one domain's file is one row of the input, so its window is bounded by it
    agent = F.last(F.when(F.col("kind") == "user-agent", F.col("path")), ignorenulls=True).over(Window.partitionBy("domain").orderBy("place"))
    return parts.withColumn("agent", agent).where((F.col("agent") == "*") & F.col("kind").isin("allow", "disallow", "crawl-delay") & (F.col("path") != "")).select("domain", "kind", "path", "place")


def crawl_delays(robots: DataFrame) -> DataFrame:
    """(domain, seconds): the last readable Crawl-delay for all agents, 1 at least and where there is none, 2 where there is no text."""
    seconds = F.greatest(F.expr("try_cast(regexp_extract(path, '^[0-9]+(?:[.][0-9]+)?', 0) AS DOUBLE)"), F.lit(1.0))
    given = robots_rules(robots).where("kind = 'crawl-delay'").withColumn("seconds", seconds).where("seconds is not null").groupBy("domain").agg(F.max_by("seconds", "place").alias("seconds"))
    return robots.join(given, "domain", "left").select("domain", F.when(F.col("text").isNull(), 2.0).otherwise(F.coalesce("seconds", F.lit(1.0))).alias("seconds"))


def allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Any allow prefix, else no disallow prefix. A prefix join: a URL's path is cut at the lengths that its domain's rules have, and the pieces
    meet the rules by domain and path; no URL is compared with all rules of its domain. Without a rule, a domain or a path all is allowed."""
    kinds = rules.where(F.col("kind").isin("allow", "disallow")).select(F.col("domain").alias("_d"), F.col("path").alias("_p"), "kind").distinct()
    lengths = kinds.groupBy("_d").agg(F.collect_set(F.length("_p")).alias("lengths"))  # as many as a path is long, at most
    path = F.regexp_extract("url", "^[a-zA-Z]+://[^/?#]+([^#]*)", 1)
    cut = urls.select("domain", "url").distinct().withColumn("path", path).join(lengths, F.col("domain") == F.col("_d"))
    starts = cut.select("domain", "url", "path", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n"))
    met = starts.select("domain", "url", F.substr("path", F.lit(1), F.col("n")).alias("start")).join(kinds, (F.col("domain") == F.col("_d")) & (F.col("start") == F.col("_p")))
    said = met.groupBy(F.col("domain").alias("_domain"), F.col("url").alias("_url")).agg(F.max(F.col("kind") == "allow").alias("yes"))
    told = urls.join(said, (F.col("domain") == F.col("_domain")) & (F.col("url") == F.col("_url")), "left")
    return told.withColumn("allowed", F.coalesce("yes", F.lit(True))).drop("yes", "_domain", "_url")


A = "[\"'']"
META = lambda n: f"""coalesce(nullif(regexp_extract(html, '(?i)<meta[^>]*(?:property|name|http-equiv)={A}(?:{n}){A}[^>]*content={A}([^"'']*){A}', 1), ''), nullif(regexp_extract(html, '(?i)<meta[^>]*content={A}([^"'']*){A}[^>]*(?:property|name|http-equiv)={A}(?:{n}){A}', 1), ''))"""
RX = lambda p, c="html": f"nullif(regexp_extract({c}, '{p}', 1), '')"
DHOST = lambda c: f"lower(nullif(regexp_extract({c}, '{HOST}', 1), ''))"
DSTRIP = lambda c: f"""regexp_extract({c}, '^([^?#]*)', 1) || CASE WHEN q = '' THEN '' ELSE '?' || q END || regexp_extract({c}, '(#.*)$', 1)"""
LEFT = lambda c: f"array_to_string(list_filter(string_split(regexp_extract({c}, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: NOT list_contains([{', '.join(repr(t) for t in TRACKING)}], split_part(p, '=', 1))), '&')"
CANON = f"""SELECT page_id, regexp_replace(regexp_replace(lower(regexp_extract(u, '^([a-zA-Z]+://[^/?#]*)', 1)), '^(https://.*):443$', '\\1'), '^(http://.*):80$', '\\1') || regexp_extract(u, '^[a-zA-Z]+://[^/?#]*(.*)$', 1) AS canonical_url
    FROM (SELECT page_id, {DSTRIP('c')} AS u FROM (SELECT *, {LEFT('c')} AS q FROM (SELECT page_id, coalesce({RX(f'(?i)<link[^>]*rel={A}canonical{A}[^>]*href={A}([^"'+"''"+f']+){A}')}, url) AS c FROM tagged_pages)))"""
TITLE = f"coalesce({META('og:title')}, {META('twitter:title')}, {RX('(?i)<title[^>]*>([^<]*)</title>')})"
SUMMARY = f"coalesce({META('og:description')}, {META('description')}, {META('twitter:description')})"
DLANG = f"split_part(coalesce({RX(f'(?i)<html[^>]*lang={A}([^"'+"''"+f']+){A}')}, {META('content-language')}), '-', 1)"
HREFS = f"""regexp_extract_all(html, '(?i)href={A}([^"'']*){A}', 1)"""
OUT = lambda strip, drop: f"""SELECT DISTINCT page_id, domain FROM (SELECT page_id, own, {'regexp_replace(' if strip else ''}{DHOST('href')}{", '^www\\.', '')" if strip else ''} AS domain FROM (SELECT page_id, {'regexp_replace(' if strip else ''}{DHOST('url')}{", '^www\\.', '')" if strip else ''} AS own, unnest({HREFS}) AS href FROM tagged_pages) WHERE regexp_matches(href, '(?i)^https?://')) WHERE domain IS NOT NULL AND domain <> own {drop}"""
PLAIN = lambda p: f"trim(regexp_replace({RX(p)}, '<[^>]*>', '', 'g'))"

NEWS = f"SELECT DISTINCT regexp_replace({DHOST('href')}, '^www\\.', '') AS domain FROM (SELECT unnest({HREFS}) AS href FROM tagged_pages) WHERE {DHOST('href')} IS NOT NULL AND NOT regexp_matches({DHOST('href')}, '{'|'.join(NOT_NEWS)}')"
LISTED = f"SELECT DISTINCT regexp_replace({DHOST('url')}, '^www\\.', '') AS domain FROM pages WHERE regexp_matches(url, '^https?://')"
ROBOTS = """SELECT * FROM (SELECT domain, place, lower(trim(split_part(line, ':', 1))) AS kind, trim(regexp_extract(line, '^[^:]*:(.*)$', 1)) AS path,
    last_value(CASE WHEN lower(trim(split_part(line, ':', 1))) = 'user-agent' THEN trim(regexp_extract(line, '^[^:]*:(.*)$', 1)) END IGNORE NULLS) OVER (PARTITION BY domain ORDER BY place) AS agent
    FROM (SELECT domain, unnest(range(len(lines))) AS place, trim(regexp_replace(unnest(lines), '#.*$', '')) AS line FROM (SELECT domain, string_split(text, chr(10)) AS lines FROM robots_texts))) WHERE agent = '*' AND kind IN ('allow', 'disallow', 'crawl-delay') AND path <> ''"""
LOCS = "regexp_extract_all(xml, '(?s)<sitemap>.*?<loc>\\s*(.*?)\\s*</loc>', 1)"
LISTING_SIZE = 25

LD = lambda k: f"CASE WHEN contains(html, 'ld+json') THEN json_extract_string(regexp_extract(html, '(?s)application/ld.json[^>]*>(.*?)</script>', 1), '$.{k}') END"
EXTRACTED = f"""SELECT page_id, CASE WHEN fall THEN h1 ELSE t END AS title, coalesce(CASE WHEN fall THEN p1 ELSE s END, '') AS summary, dom AS source_domain,
    CASE WHEN said IS NULL THEN {AS_OF} ELSE TRY_CAST(said AS TIMESTAMP) END AS published_at, said IS NOT NULL AND TRY_CAST(said AS TIMESTAMP) IS NULL AS date_invalid
    FROM (SELECT *, (t IS NULL OR s IS NULL) AND h1 IS NOT NULL AND p1 IS NOT NULL AS fall FROM (SELECT page_id, CASE WHEN contains(html, 'ld+json') THEN {LD('headline')} ELSE {TITLE} END AS t,
    CASE WHEN contains(html, 'ld+json') THEN {LD('description')} ELSE {SUMMARY} END AS s, {DHOST('url')} AS dom, {PLAIN('(?is)<h1[^>]*>(.*?)</h1>')} AS h1, {PLAIN('(?is)<p[^>]*>([^<].*?)</p>')} AS p1,
    CASE WHEN contains(html, 'ld+json') THEN {LD('datePublished')} ELSE coalesce({META('article:published_time')}, {META('publish(?:ed)?[-_]?(?:date|time)')}) END AS said FROM tagged_pages)) WHERE t IS NOT NULL OR fall"""

QUERIES = {
    "e01_canonical_url": (lambda v: v.tagged_pages.select("page_id", canonical_url().alias("canonical_url")), CANON),
    "e02_strip_tracking": (lambda v: v.pages.select("page_id", strip_tracking(F.col("url")).alias("u")), f"SELECT page_id, {DSTRIP('url')} AS u FROM (SELECT *, {LEFT('url')} AS q FROM pages)"),
    "e03_json_ld": (lambda v: v.tagged_pages.select("page_id", json_ld()["headline"].alias("headline")).where("headline is not null"), f"SELECT page_id, json_extract_string(regexp_extract(html, '(?s)application/ld.json[^>]*>(.*?)</script>', 1), '$.headline') AS headline FROM tagged_pages WHERE contains(html, 'ld+json')"),
    "e04_meta": (lambda v: v.tagged_pages.select("page_id", F.coalesce(meta("html", "og:title"), meta("html", "twitter:title"), found("html", "(?i)<title[^>]*>([^<]*)</title>")).alias("title"), meta("html", "og:image").alias("image_url")), f"SELECT page_id, {TITLE} AS title, {META('og:image')} AS image_url FROM tagged_pages"),
    "e05_published": (lambda v: v.tagged_pages.select("page_id", published_text().alias("published")), f"SELECT page_id, coalesce({META('article:published_time')}, {META('publish(?:ed)?[-_]?(?:date|time)')}) AS published FROM tagged_pages"),
    "e06_language": (lambda v: v.tagged_pages.select("page_id", language().alias("lang")), f"SELECT page_id, {DLANG} AS lang FROM tagged_pages"),
    "e07_paywall": (lambda v: v.tagged_pages.select("page_id", F.col("html").rlike(PAYWALL).alias("paywalled")), f"SELECT page_id, regexp_matches(html, '{PAYWALL}') AS paywalled FROM tagged_pages"),
    "e08_extract": (lambda v: extract(v.tagged_pages).select("page_id", "title", "summary", "source_domain", "published_at", "date_invalid"), EXTRACTED),
    "e09_excerpt": (lambda v: v.pages.select("page_id", plain(found("html", "(?is)<h1[^>]*>(.*?)</h1>")).alias("h1"), plain(found("html", "(?is)<p[^>]*>([^<].*?)</p>")).alias("p1")), f"SELECT page_id, {PLAIN('(?is)<h1[^>]*>(.*?)</h1>')} AS h1, {PLAIN('(?is)<p[^>]*>([^<].*?)</p>')} AS p1 FROM pages"),
    "e10_host": (lambda v: v.pages.select("page_id", host("url").alias("host"), host("url", True).alias("bare")), f"SELECT page_id, {DHOST('url')} AS host, regexp_replace({DHOST('url')}, '^www\\.', '') AS bare FROM pages"),
    "e11_outbound": (lambda v: outbound(v.tagged_pages), OUT(False, "AND NOT contains(domain, 'facebook') AND NOT contains(domain, 'twitter')")),
    "e12_outbound_bare": (lambda v: outbound(v.tagged_pages, True, ()), OUT(True, "")),
    "e13_news_domains": (lambda v: news_domains(v.tagged_pages.select(F.explode(links("html")).alias("url"))), NEWS),
    "e14_redirects": (lambda v: v.pages.select("page_id", redirect_target(F.concat(F.lit("https://s.example/l/?uddg="), F.url_encode("url"), F.lit("&rut=1"))).alias("target")), "SELECT page_id, url AS target FROM pages"),
    "e15_listing": (lambda v: listing_domains(v.pages.groupBy(F.floor(F.col("page_id") / LISTING_SIZE).alias("g")).agg(F.to_json(F.struct(F.struct(F.collect_list(F.struct(F.struct("url").alias("data"))).alias("children")).alias("data"))).alias("json"))), f"SELECT DISTINCT regexp_replace({DHOST('url')}, '^www\\.', '') AS domain FROM pages"),
    "e16_aggregator": (lambda v: outbound(v.tagged_pages, True, ("canon",)), OUT(True, "AND NOT contains(domain, 'canon')")),
    "e17_article_links": (lambda v: article_links(v.section_pages).select("page_id", "link"), f"SELECT page_id, regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) || href AS link FROM (SELECT page_id, url, unnest(regexp_extract_all(html, 'href=[\"'']([^\"'']*)[\"'']', 1)) AS href FROM section_pages) WHERE href LIKE '/%' AND NOT regexp_matches(href, '{'|'.join(NOT_ARTICLE)}') AND regexp_matches(lower(href), '/({'|'.join(ARTICLE_SECTIONS)})/|/[0-9]{{4}}/[0-9]{{2}}/')"),
    "e18_sitemap": (lambda v: sitemap_entries(v.sitemap_urls.groupBy("domain", F.substring(F.md5("url"), 1, 3)).agg(F.array_join(F.collect_list(F.concat(F.lit("<url><loc> "), "url", F.lit(" </loc>"), F.coalesce(F.concat(F.lit("<lastmod>"), F.date_format("lastmod", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("</lastmod>")), F.lit("")), F.lit("</url>"))), "\n").alias("xml"))), "SELECT domain, url AS loc, lastmod FROM sitemap_urls"),
    "e19_child_sitemaps": (lambda v: v.index_xml.select("id", F.posexplode(child_sitemaps()).alias("place", "loc")), f"SELECT id, unnest(range(len(l))) AS place, unnest(l) AS loc FROM (SELECT id, list_slice(list_concat(list_filter({LOCS}, lambda u: contains(u, 'news') OR contains(u, 'article')), list_filter({LOCS}, lambda u: NOT (contains(u, 'news') OR contains(u, 'article')))), 1, 5) AS l FROM index_xml)"),
    "e20_robots_rules": (lambda v: robots_rules(v.robots_texts), f"SELECT domain, kind, path, place FROM ({ROBOTS})"),
    "e20_crawl_delays": (lambda v: crawl_delays(v.robots_texts), f"SELECT domain, greatest(coalesce(max(TRY_CAST(path AS DOUBLE)) FILTER (kind = 'crawl-delay'), 1), 1) AS seconds FROM robots_texts LEFT JOIN ({ROBOTS}) USING (domain) GROUP BY 1"),
    "e21_allowed": (lambda v: allowed(v.sitemap_urls, v.robots_rules).select("url", "allowed"), """SELECT url, coalesce(bool_or(kind = 'allow' AND starts_with(path_, path)), false) OR NOT coalesce(bool_or(kind = 'disallow' AND starts_with(path_, path)), false) AS allowed
        FROM (SELECT *, regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^#]*)', 1) AS path_ FROM sitemap_urls) u LEFT JOIN robots_rules r ON r.domain = u.domain GROUP BY url"""),
    "e22_article_pattern": (lambda v: v.sitemap_urls.join(v.sources.select("domain", F.get_json_object("api_config", "$.articlePattern").alias("pattern")), "domain").where("pattern is null or url rlike pattern").select("url"), "SELECT url FROM sitemap_urls u JOIN sources s ON s.domain = u.domain WHERE json_extract_string(api_config, '$.articlePattern') IS NULL OR regexp_matches(url, json_extract_string(api_config, '$.articlePattern'))"),
    "e24_entities": (lambda v: v.tagged_pages.select("page_id", decode_entities(F.col("html")).alias("text")), "SELECT page_id, replace(replace(replace(replace(replace(replace(html, '&#x27;', ''''), '&quot;', '\"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&#39;', '''') AS text FROM tagged_pages"),
    "e25_snippet": (lambda v: v.articles.select("id", F.concat(F.substring("summary", 1, 200), F.lit("...")).alias("snippet")), "SELECT id, substring(summary, 1, 200) || '...' AS snippet FROM articles"),
    "e26_probe_features": (lambda v: v.tagged_pages.select("page_id", (F.col("html").contains("ld+json") & F.col("html").contains("NewsArticle")).alias("jsonld_news"), language().isNotNull().alias("has_lang")), f"SELECT page_id, contains(html, 'ld+json') AND contains(html, 'NewsArticle') AS jsonld_news, {DLANG} IS NOT NULL AS has_lang FROM tagged_pages"),
    "e23_first_locs": (lambda v: v.sitemap_urls.select("url", F.explode(first_locs(F.concat(F.lit("<urlset><url><loc>"), "url", F.lit("</loc></url><url><loc>ftp://no</loc></url><loc>"), "url", F.lit("?2</loc>")), 2)).alias("loc")), "SELECT url, url AS loc FROM sitemap_urls UNION ALL SELECT url, url || '?2' FROM sitemap_urls"),
    "e27_recency": (lambda v: v.sitemap_urls.select("url", is_recent(F.concat(F.coalesce(F.concat(F.lit("<url><lastmod>"), F.date_format("lastmod", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("</lastmod></url>")), F.lit("<url></url>")), F.when(F.col("url").endswith("1"), F.lit("")).otherwise(F.lit("<url><lastmod>2024-01-30</lastmod></url>")))).alias("recent")), f"SELECT url, coalesce(CASE WHEN lastmod IS NOT NULL THEN date_trunc('day', lastmod) WHEN NOT url LIKE '%1' THEN TIMESTAMP '2024-01-30 00:00:00' END >= {AS_OF} - INTERVAL 168 HOUR, false) AS recent FROM sitemap_urls"),
}
