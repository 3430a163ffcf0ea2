"""Table maintenance (inventory S1-S27): every function returns the new snapshot of a table, to be written to a new path."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.operators.reports import CONFIG, hours_before, now
from presswork.sources.fixtures import AS_OF, SCHEMAS


def insert_ignore(target: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Incoming rows, the first of each key, with inserted: false if the target has the key."""
    rest = [c for c in incoming.columns if c not in keys]
    first = incoming.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("r")).select(*keys, *[F.col("r")[c].alias(c) for c in rest])
    have = target.select(*keys).distinct().withColumn("_have", F.lit(True))
    return first.join(have, keys, "left").withColumn("inserted", F.col("_have").isNull()).drop("_have")


def upsert(target: DataFrame, incoming: DataFrame, key: str, merge: dict[str, Column]) -> DataFrame:
    """Full outer join on the key; `merge` gives each column from t.column and n.column."""
    return target.alias("t").join(incoming.alias("n"), key, "full_outer").select(key, *[c.alias(k) for k, c in merge.items()])


def newer(column: str) -> Column:
    return F.coalesce(F.col(f"n.{column}"), F.col(f"t.{column}"))


def promote(candidates: DataFrame, sources: DataFrame, sources_topics: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new sources, new links by domain, candidates left) of the chosen (domain, topic_id)."""
    picked = candidates.join(chosen, "domain")
    new = picked.join(sources.select("domain"), "domain", "left_anti").select("domain", F.coalesce("discovered_via", "domain").alias("name"))
    have = sources_topics.join(sources.select(F.col("id").alias("source_id"), "domain"), "source_id").select("domain", "topic_id")
    return new, picked.select("domain", "topic_id").join(have, ["domain", "topic_id"], "left_anti"), candidates.join(chosen.select("domain"), "domain", "left_anti")


def crawl_log(results: DataFrame) -> DataFrame:
    """Rows (crawl_id, at, outcome, fatal) to the log of each crawl: opened at its first row, closed at its last with JSON
    statistics; one with a fatal message is closed as failed, with that message and one error more; one without outcomes is open."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    sums = results.groupBy("crawl_id").agg(
        F.min("at").alias("started_at"), F.max("at").alias("last_at"), F.count("outcome").alias("n"), F.max("fatal").alias("error"),
        n("kept").alias("kept"), n("skippedDuplicates").alias("skippedDuplicates"), n("skippedQuality").alias("skippedQuality"), n("error").alias("errors"),
    )
    failed, closed = F.col("error").isNotNull(), (F.col("n") > 0) | F.col("error").isNotNull()
    stats = F.to_json(F.struct("kept", "skippedDuplicates", "skippedQuality", (F.col("errors") + failed.cast("long")).alias("errors"), "error"))  # a null error is left out
    return sums.select("crawl_id", "started_at", F.when(closed, F.col("last_at")).alias("finished_at"), F.when(closed, ~failed).alias("ok_bool"), F.when(closed, stats).alias("stats_json"))


def new_topics(requests: DataFrame) -> DataFrame:
    """Topics to insert, with the defaults of what a request leaves out or empty."""
    return requests.select(
        "slug", "name", F.nullif("query", F.lit("")).alias("query"), F.coalesce(F.nullif("lang", F.lit("")), F.lit("en")).alias("lang"),
        F.coalesce(F.nullif("freshness_hours", F.lit(0)), F.lit(72)).alias("freshness_hours"), F.coalesce(F.nullif("max_items", F.lit(0)), F.lit(30)).alias("max_items"), F.lit(True).alias("enabled"),
    )


def set_by_key(target: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """The target with a column replaced where the table of new values (one a key) has one."""
    values = new.select(key, F.col(column).alias("_new"))
    return target.join(values, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def set_counts(target: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """How many of the new values found their row, and how many didn't."""
    have = target.select(key, F.lit(True).alias("have"))
    return new.join(have, key, "left").agg(F.count_if("have").alias("updated"), F.count_if(F.col("have").isNull()).alias("not_found"))


def purge_unlinked(articles: DataFrame, links: DataFrame, days: int = 90) -> DataFrame:
    """What is left after unlinked old articles go."""
    linked = links.select(F.col("article_id").alias("id")).distinct().withColumn("linked", F.lit(True))
    return articles.join(linked, "id", "left").where(F.col("linked") | (F.col("first_seen_at") >= hours_before(24 * days)))


def has_term(term: str) -> Column:
    return F.coalesce(F.col("title").ilike(f"%{term}%"), F.lit(False)) | F.coalesce(F.col("summary").ilike(f"%{term}%"), F.lit(False))


def cascade(links: DataFrame, survivors: DataFrame) -> DataFrame:
    """Links of deleted articles go."""
    return links.join(survivors.select(F.col("id").alias("article_id")), "article_id", "left_semi")


def set_null(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Articles of deleted sources lose their source."""
    alive = sources.select(F.col("id").alias("source_id"), F.col("id").alias("kept_source"))
    return articles.join(alive, "source_id", "left").select("id", F.col("kept_source").alias("source_id"))


def repair_stuck(crawls: DataFrame, as_of: Column | None = None, error: str = "Crawl timeout - manually cleaned up") -> DataFrame:
    """Crawls without an end are closed as failed at as_of; their JSON statistics get every count (0 where it lacks), one error more and the error's text."""
    stuck = F.col("finished_at").isNull()
    old = F.from_json(F.coalesce("stats_json", F.lit("{}")), "kept long, skippedDuplicates long, skippedQuality long, errors long")
    count = lambda c: F.coalesce(old[c], F.lit(0))
    new = F.to_json(F.struct(*[count(c).alias(c) for c in ("kept", "skippedDuplicates", "skippedQuality")], (count("errors") + 1).alias("errors"), F.lit(error).alias("error")))
    return crawls.select("id", F.coalesce("finished_at", now(as_of)).alias("finished_at"), F.when(stuck, F.lit(False)).otherwise(F.col("ok_bool")).alias("ok_bool"), F.when(stuck, new).otherwise(F.col("stats_json")).alias("stats_json"))


def violations(df: DataFrame, table: str, keys: list[str], required: list[str], enums: dict[str, list[str]] | None = None) -> DataFrame:
    """(check_name, rows) of broken unique, not-null and enum checks; in one pass and one aggregate for the keys."""
    twice = df.groupBy(*keys).count().where("count > 1").agg(F.lit(f"{table}:unique").alias("check_name"), F.count("*").alias("rows"))
    checks = {f"{table}:{c}:null": F.col(c).isNull() for c in required} | {f"{table}:{c}:enum": ~F.col(c).isin(v) for c, v in (enums or {}).items()}
    one = df.agg(F.array(*[F.struct(F.lit(k).alias("check_name"), F.count_if(c).alias("rows")) for k, c in checks.items()]).alias("a")).select(F.inline("a"))
    return twice.union(one)


def merge_config(config: Column, **new: object) -> Column:
    """Some keys of a JSON config replaced, the others kept."""
    old = F.from_json(config, CONFIG)
    return F.to_json(F.struct(*[(F.lit(new[k]) if k in new else old[k]).alias(k) for k in (f.split()[0] for f in CONFIG.split(", "))]))


def link_domains(domains: DataFrame, sources: DataFrame, sources_topics: DataFrame, topic_id: int) -> DataFrame:
    """Added, already linked and unknown domains of a list."""
    s = sources.select("domain", F.col("id").alias("source_id"))
    have = sources_topics.where(F.col("topic_id") == topic_id).select("source_id").withColumn("have", F.lit(True))
    rows = domains.join(s, "domain", "left").join(have, "source_id", "left")
    return rows.agg(F.count_if(F.col("source_id").isNotNull() & F.col("have").isNull()).alias("added"), F.count_if("have").alias("already"), F.count_if(F.col("source_id").isNull()).alias("not_found"))


def _configs(v):  # noqa: ANN001, ANN202
    rows = v.sources.where("points % 2 = 0").select("domain").union(v.candidate_domains.select("domain"))
    return rows.select("domain", F.to_json(F.struct(F.concat(F.lit("/"), F.split_part("domain", F.lit("."), F.lit(1)), F.lit("/")).alias("articlePattern"), F.lit(True).alias("learned"))).alias("api_config"))


def _with_stats(crawls: DataFrame) -> DataFrame:
    """Crawls with their JSON statistics: none, part of them, or all."""
    some, every = F.to_json(F.struct("kept")), F.to_json(F.struct("kept", F.col("duplicates").alias("skippedDuplicates"), F.col("quality").alias("skippedQuality"), "errors"))
    return crawls.withColumn("stats_json", F.when(F.col("id") % 3 == 1, some).when(F.col("id") % 3 == 2, every))


def _measure(name: str, kind: str, spark: bool) -> str:
    """SQL of a whole number that stands for a value: the number itself (in thousandths), a text's length, a list's length, a moment's microsecond."""
    if kind == "string":
        return f"CAST(length({name}) AS BIGINT)"
    if kind.startswith("array"):
        return f"CAST({'cardinality' if spark else 'len'}({name}) AS BIGINT)"
    if kind == "timestamp":
        return f"unix_micros({name})" if spark else f"epoch_us(CAST({name} AS TIMESTAMP))"
    return f"CAST(round({name} * 1000) AS BIGINT)" if kind == "double" else f"CAST({name} AS BIGINT)"


def scanned(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, type, rows, filled, low, high) of every column of every given table, in one aggregate each. A column that is missing or of
    another type than its schema's is an error."""
    parts = []
    for t, df in tables.items():
        want = [tuple(c.split(" ")) for c in SCHEMAS[t].split(", ")]
        if (have := [(c, k) for c, k in df.dtypes]) != want:
            raise TypeError(f"{t}: {have} in place of {want}")
        cells = [F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("type"), F.count("*").alias("rows"), F.count(c).alias("filled"), F.min(F.expr(_measure(c, k, True))).alias("low"), F.max(F.expr(_measure(c, k, True))).alias("high")) for c, k in want]
        parts.append(df.agg(F.array(*cells).alias("cells")).select(F.lit(t).alias("table_name"), F.inline("cells")))
    return reduce(DataFrame.union, parts)


SCAN_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{k}' AS type, count(*) AS rows, count({c}) AS filled, min({_measure(c, k, False)}) AS low, max({_measure(c, k, False)}) AS high FROM {t}"
    for t, schema in SCHEMAS.items() for c, k in (x.split(" ") for x in schema.split(", "))
)


S_OLD = f"{AS_OF} - INTERVAL 48 HOUR"
HIT = "(lower(title) LIKE '%thing%' OR lower(summary) LIKE '%thing%')"


def _old(v):  # noqa: ANN001, ANN202
    return v.articles.where(F.col("first_seen_at") < hours_before(48))


def _promoted(v, i: int):  # noqa: ANN001, ANN202
    return promote(v.candidate_domains, v.sources, v.sources_topics, v.candidate_domains.where("score >= 60").select("domain", F.lit(1).alias("topic_id")))[i]


QUERIES = {
    "s01_typed_scan": (lambda v: scanned({t: getattr(v, t) for t in SCHEMAS}), SCAN_SQL),
    "s02_pages_scan": (lambda v: v.pages.select("page_id", "url", "html", F.when(F.col("html").isNull(), 404).otherwise(200).alias("status"), F.expr(AS_OF).alias("fetched_at")), f"SELECT page_id, url, html, CASE WHEN html IS NULL THEN 404 ELSE 200 END AS status, {AS_OF} AS fetched_at FROM pages"),
    "s03_insert_articles": (lambda v: insert_ignore(_old(v), v.articles.select("canonical_url", "id"), ["canonical_url"], ["id"]), f"SELECT canonical_url, id, first_seen_at >= {S_OLD} AS inserted FROM articles"),
    "s04_insert_links": (lambda v: insert_ignore(v.topic_articles.where("hidden_bool"), v.topic_articles.select("topic_id", "article_id", "added_at"), ["topic_id", "article_id"], ["added_at"]).where("inserted").select("topic_id", "article_id"), "SELECT topic_id, article_id FROM topic_articles WHERE NOT hidden_bool"),
    "s05_new_sources": (lambda v: insert_ignore(v.sources, v.candidate_domains.select("domain", "last_seen_at"), ["domain"], ["last_seen_at"]), "SELECT domain, last_seen_at, domain NOT IN (SELECT domain FROM sources) AS inserted FROM candidate_domains"),
    "s06_upsert_sources": (lambda v: upsert(v.sources.select("domain", "name", "points"), v.candidate_domains.select("domain", F.col("discovered_via").alias("name")), "domain", {"name": newer("name"), "points": F.coalesce(F.col("t.points"), F.lit(0))}), "SELECT coalesce(s.domain, c.domain) AS domain, coalesce(c.discovered_via, s.name) AS name, coalesce(s.points, 0) AS points FROM sources s FULL JOIN candidate_domains c ON c.domain = s.domain"),
    "s07_topic_defaults": (lambda v: new_topics(v.topic_requests), "SELECT slug, name, nullif(query, '') AS query, coalesce(nullif(lang, ''), 'en') AS lang, coalesce(nullif(freshness_hours, 0), 72) AS freshness_hours, coalesce(nullif(max_items, 0), 30) AS max_items, true AS enabled FROM topic_requests"),
    "s08_crawl_log": (lambda v: crawl_log(v.events.select((F.col("user_id") % 97).alias("crawl_id"), F.col("ts").alias("at"), F.when(F.col("user_id") % 97 % 8 != 7, F.when(F.col("event_type") == "click", "kept").when(F.col("event_type") == "view", "skippedDuplicates").when(F.col("event_type") == "signup", "skippedQuality").when(F.col("event_type") == "error", "error")).alias("outcome"), F.when((F.col("user_id") % 97 % 8 == 3) & (F.col("event_type") == "error"), "fatal").alias("fatal"))),
        """SELECT crawl_id, started_at, CASE WHEN closed THEN last_at END AS finished_at, CASE WHEN closed THEN NOT failed END AS ok_bool, CASE WHEN closed THEN '{"kept":' || kept || ',"skippedDuplicates":' || dup || ',"skippedQuality":' || qual || ',"errors":' || (err + CAST(failed AS INT)) || CASE WHEN failed THEN ',"error":"fatal"' ELSE '' END || '}' END AS stats_json
        FROM (SELECT *, crawl_id % 8 <> 7 AND kept + dup + qual + err > 0 AS closed, crawl_id % 8 = 3 AND err > 0 AS failed FROM (SELECT user_id % 97 AS crawl_id, min(CAST(ts AS TIMESTAMP)) AS started_at, max(CAST(ts AS TIMESTAMP)) AS last_at, count(CASE event_type WHEN 'click' THEN 1 END) AS kept, count(CASE event_type WHEN 'view' THEN 1 END) AS dup,
            count(CASE event_type WHEN 'signup' THEN 1 END) AS qual, count(CASE event_type WHEN 'error' THEN 1 END) AS err FROM events GROUP BY 1))"""),
    "s09_upsert_candidates": (lambda v: upsert(v.candidate_domains.select("domain", "score"), v.candidate_domains.select("domain", (F.lit(70) - F.col("score")).alias("score")).union(v.sources.select("domain", F.lit(5))), "domain", {"score": F.greatest(F.col("t.score"), F.col("n.score"))}), "SELECT domain, greatest(score, 70 - score) AS score FROM candidate_domains UNION ALL SELECT domain, 5 FROM sources"),
    "s10_touch_candidates": (lambda v: upsert(v.candidate_domains.select("domain", "last_seen_at"), v.sources.select("domain", "last_seen_at"), "domain", {"last_seen_at": newer("last_seen_at")}), "SELECT domain, last_seen_at FROM candidate_domains UNION ALL SELECT domain, last_seen_at FROM sources"),
    "s11_promoted_sources": (lambda v: _promoted(v, 0), "SELECT domain, discovered_via AS name FROM candidate_domains WHERE score >= 60 AND domain NOT IN (SELECT domain FROM sources)"),
    "s12_promoted_links": (lambda v: _promoted(v, 1), "SELECT domain, 1 AS topic_id FROM candidate_domains WHERE score >= 60"),
    "s12_promoted_count": (lambda v: _promoted(v, 0).agg(F.count("*").alias("promoted")), "SELECT count(*) AS promoted FROM candidate_domains WHERE score >= 60 AND domain NOT IN (SELECT domain FROM sources)"),
    "s13_manual_promote": (lambda v: v.candidate_domains.where("score >= 40").select(F.col("domain").alias("name"), "domain", F.lit("custom_crawler").alias("type"), F.lit(0).alias("points"), F.lit(True).alias("enabled")), "SELECT domain AS name, domain, 'custom_crawler' AS type, 0 AS points, true AS enabled FROM candidate_domains WHERE score >= 40"),
    "s13_candidates_left": (lambda v: _promoted(v, 2).select("domain"), "SELECT domain FROM candidate_domains WHERE score < 60 OR score IS NULL"),
    "s14_probe_records": (lambda v: v.candidate_probes.select("domain_id", F.to_json(F.struct("has_sitemap", "has_feed")).alias("status_json")), """SELECT domain_id, '{"has_sitemap":' || has_sitemap || ',"has_feed":' || has_feed || '}' AS status_json FROM candidate_probes"""),
    "s15_run_log": (lambda v: v.crawl_runs.select("workflow_name", F.to_json(F.struct(F.get_json_object("metadata", "$.k").cast("long").alias("k"))).alias("metadata")), """SELECT workflow_name, '{"k":' || json_extract_string(metadata, '$.k') || '}' AS metadata FROM crawl_runs"""),
    "s16_purge_unlinked": (lambda v: purge_unlinked(v.articles, v.topic_articles.where("hidden_bool"), 7).select("id"), f"SELECT id FROM articles WHERE id % 17 = 0 OR first_seen_at >= {AS_OF} - INTERVAL 168 HOUR"),
    "s17_purge_term": (lambda v: v.articles.where(has_term("thing")).select("id"), f"SELECT id FROM articles WHERE {HIT}"),
    "s18_cascade": (lambda v: cascade(v.topic_articles, v.articles.where(has_term("thing"))).select("topic_id", "article_id"), f"SELECT topic_id, article_id FROM topic_articles WHERE article_id IN (SELECT id FROM articles WHERE {HIT})"),
    "s18_set_null": (lambda v: set_null(v.articles, v.sources.where("enabled")), "SELECT a.id, s.id AS source_id FROM articles a LEFT JOIN sources s ON s.id = a.source_id AND s.enabled"),
    "s19_backfill": (lambda v: insert_ignore(v.sources_topics, v.sources.select(F.col("id").alias("source_id"), F.lit(1).alias("topic_id"), "domain"), ["source_id", "topic_id"], ["domain"]).where("inserted").select("source_id", "topic_id"), "SELECT id AS source_id, 1 AS topic_id FROM sources WHERE id NOT IN (SELECT source_id FROM sources_topics WHERE topic_id = 1)"),
    "s20_repair_stuck": (lambda v: repair_stuck(_with_stats(v.crawls)), f"""SELECT id, coalesce(finished_at, {AS_OF}) AS finished_at, CASE WHEN finished_at IS NULL THEN false ELSE ok_bool END AS ok_bool,
        CASE WHEN finished_at IS NULL THEN '{{"kept":' || CASE WHEN id % 3 = 0 THEN 0 ELSE kept END || ',"skippedDuplicates":' || CASE WHEN id % 3 < 2 THEN 0 ELSE duplicates END || ',"skippedQuality":' || CASE WHEN id % 3 < 2 THEN 0 ELSE quality END || ',"errors":' || (CASE WHEN id % 3 < 2 THEN 0 ELSE errors END + 1) || ',"error":"Crawl timeout - manually cleaned up"}}'
        WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN '{{"kept":' || kept || '}}' ELSE '{{"kept":' || kept || ',"skippedDuplicates":' || duplicates || ',"skippedQuality":' || quality || ',"errors":' || errors || '}}' END AS stats_json FROM crawls"""),
    "s21_backfill_links": (lambda v: v.articles.where(has_term("thing")).select(F.lit(3).alias("topic_id"), F.col("id").alias("article_id")).join(v.topic_articles, ["topic_id", "article_id"], "left_anti"), f"SELECT 3 AS topic_id, id AS article_id FROM articles WHERE {HIT} AND id NOT IN (SELECT article_id FROM topic_articles WHERE topic_id = 3)"),
    "s22_link_domains": (lambda v: link_domains(v.sources.select("domain").union(v.candidate_domains.select("domain")), v.sources, v.sources_topics, 2), "SELECT (SELECT count(*) FROM sources WHERE id NOT IN (SELECT source_id FROM sources_topics WHERE topic_id = 2)) AS added, (SELECT count(*) FROM sources_topics WHERE topic_id = 2) AS already, (SELECT count(*) FROM candidate_domains) AS not_found"),
    "s23_violations": (lambda v: violations(v.index_urls, "index_urls", ["url"], ["domain", "place"]).union(violations(v.attempts, "attempts", ["source_id", "ts"], ["status"])), "SELECT 'index_urls:unique' AS check_name, count(*) AS rows FROM (SELECT url FROM index_urls GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'attempts:unique', count(*) FROM (SELECT 1 FROM attempts GROUP BY source_id, ts HAVING count(*) > 1) UNION ALL SELECT 'index_urls:domain:null', count(*) FROM index_urls WHERE domain IS NULL UNION ALL SELECT 'index_urls:place:null', count(*) FROM index_urls WHERE place IS NULL UNION ALL SELECT 'attempts:status:null', count(*) FROM attempts WHERE status IS NULL"),
    "s24_replace_config": (lambda v: set_by_key(v.sources.select("domain", F.coalesce("api_config", F.lit('{"learned":false}')).alias("api_config")), _configs(v), "domain", "api_config"), """WITH c AS (SELECT domain, '{"articlePattern":"/' || split_part(domain, '.', 1) || '/","learned":true}' AS api_config FROM (SELECT domain FROM sources WHERE points % 2 = 0 UNION ALL SELECT domain FROM candidate_domains)) SELECT s.domain, coalesce(c.api_config, s.api_config, '{"learned":false}') AS api_config FROM sources s LEFT JOIN c ON c.domain = s.domain"""),
    "s24_replace_counts": (lambda v: set_counts(v.sources, _configs(v), "domain"), "SELECT (SELECT count(*) FROM sources WHERE points % 2 = 0) AS updated, (SELECT count(*) FROM candidate_domains WHERE domain NOT IN (SELECT domain FROM sources)) AS not_found"),
    "s25_merge_config": (lambda v: v.sources.where("api_config is not null").select("domain", F.get_json_object(merge_config(F.col("api_config"), articlePattern="/new/"), "$.articlePattern").alias("pattern"), F.get_json_object(merge_config(F.col("api_config"), articlePattern="/new/"), "$.learned").alias("learned")), "SELECT domain, '/new/' AS pattern, json_extract_string(api_config, '$.learned') AS learned FROM sources WHERE api_config IS NOT NULL"),
    "s26_topic_setting": (lambda v: set_by_key(new_topics(v.topic_requests).select("slug", "max_items"), v.topic_requests.where("lang is not null").select("slug", F.lit(60).alias("max_items")), "slug", "max_items"), "SELECT slug, CASE WHEN lang IS NOT NULL THEN 60 ELSE coalesce(max_items, 30) END AS max_items FROM topic_requests"),
    "s27_insert_counts": (lambda v: insert_ignore(v.sources.where("enabled"), v.sources.select("domain", "id"), ["domain"], ["id"]).agg(F.count_if("inserted").alias("added"), F.count_if(~F.col("inserted")).alias("skipped")), "SELECT count(CASE WHEN NOT enabled THEN 1 END) AS added, count(CASE WHEN enabled THEN 1 END) AS skipped FROM sources"),
}
