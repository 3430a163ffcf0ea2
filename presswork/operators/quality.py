"""Quality gate, topic matching and ranking (inventory Q1-Q14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.functions.text import SPACE_CLASS, any_keyword, blacklist_pattern, has_blacklisted, keywords, listed, once, token_count
from presswork.operators.keyword_index import checked, keyword_hits
from presswork.operators.reports import now
from presswork.operators.topk import places, top_per_group
from presswork.sources.fixtures import AS_OF

REASONS = ("title", "stale", "length", "blacklist", "error", "keywords")


def has_title(title: str = "title", least: int = 10) -> Column:
    """Q2."""
    return F.coalesce(F.length(title) >= least, F.lit(False))


def is_fresh(published: str, hours: Column, as_of: Column | None = None) -> Column:
    """Q3: future dates and missing ones pass."""
    return F.coalesce((F.unix_timestamp(now(as_of)) - F.unix_timestamp(published)) <= hours * 3600, F.lit(True))


def right_length(summary: str = "summary", least: int = 20, most: int = 10000) -> Column:
    """Q1, Q4."""
    return once(token_count(F.coalesce(F.col(summary), F.lit(""))), lambda n: n.between(least, most))


def is_blacklisted(title: str = "title", summary: str = "summary", unicode_boundaries: bool = False) -> Column:
    """Q5."""
    return has_blacklisted(F.lower(F.concat_ws(" ", F.coalesce(F.col(title), F.lit("")), F.coalesce(F.col(summary), F.lit("")))), unicode_boundaries)


def topic_pairs(articles: DataFrame, topics: DataFrame) -> DataFrame:
    """Articles with the topics of their language; topics are a small catalogue, joined on the language where the articles are: no text moves."""
    more = [c for c in ("keys", "broken", "score_broken") if c in topics.columns]
    t = topics.select(F.col("id").alias("topic_id"), F.col("lang"), "query", "includes", "excludes", "freshness_hours", "max_items", *more)
    return articles.join(F.broadcast(t), "lang")


def _judged(articles: DataFrame) -> DataFrame:
    """The articles with what the gate asks of them whatever the topic, so once an article."""
    return articles.withColumns({"_titled": has_title(), "_fits": right_length(), "_blacklisted": is_blacklisted()})


def _before_keywords(as_of: Column | None) -> Column:
    return F.when(~F.col("_titled"), "title").when(~is_fresh("published_at", F.col("freshness_hours"), as_of), "stale").when(~F.col("_fits"), "length").when(F.col("_blacklisted"), "blacklist")


def gate(articles: DataFrame, topics: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Q6, Q7: every article and topic with the first reason to reject it, null if it passes. A keyword that is no pattern makes the pairs that
    reach it an error, not the job."""
    rows = topic_pairs(_judged(articles), checked(topics))
    hit = ((F.size("keys") > 0) | ~F.col("broken")) & any_keyword("keys", F.col("title"), F.col("summary"))
    reason = _before_keywords(as_of).when(hit, None).when(F.col("broken"), "error").otherwise("keywords")
    return rows.withColumn("reason", reason).drop("_titled", "_fits", "_blacklisted")


def gate_many(articles: DataFrame, topics: DataFrame, as_of: Column | None = None) -> DataFrame:
    """gate() for many topics: (id, topic_id, reason), keywords through the inverted index. Articles have one row an id."""
    known = checked(topics)
    rows = topic_pairs(_judged(articles), known).select("id", "topic_id", _before_keywords(as_of).alias("early"), (F.size("keys") == 0).alias("no_keys"), "broken")
    hits = keyword_hits(articles, known).withColumn("hit", F.lit(True))
    missed = F.col("hit").isNull() & (F.col("broken") | ~F.col("no_keys"))
    reason = F.coalesce("early", F.when(missed & F.col("broken"), "error").when(missed, "keywords"))
    return rows.join(hits, ["id", "topic_id"], "left").select("id", "topic_id", reason.alias("reason"))


def topic_score(title: Column, summary: Column) -> Column:
    """Q8: 3 a title hit and 1 a summary hit of a query term, 5 an include, -50 without one, -100 an exclude; 0 at least."""
    text = F.concat(title, F.lit(" "), summary)
    terms = F.filter(F.split(F.lower(F.coalesce("query", F.lit(""))), "\\s+"), lambda t: F.length(t) >= 3)
    hits = F.aggregate(terms, F.lit(0).cast("long"), lambda s, t: s + 3 * F.regexp_count(title, t) + F.regexp_count(summary, t))
    include = F.size(F.filter(listed("includes"), lambda k: F.rlike(text, k)))
    exclude = F.size(F.filter(listed("excludes"), lambda k: F.rlike(text, k)))
    missed = F.when((F.size(listed("includes")) > 0) & (include == 0), 50).otherwise(0)
    return F.greatest(F.lit(0), hits + 5 * include - missed - 100 * exclude).cast("long")


def scored(articles: DataFrame, topics: DataFrame) -> DataFrame:
    """Q8 for every article and topic of its language; null for a topic with a keyword that is no pattern."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    known = checked(topics)
    safe = known.withColumns({c: F.when(~F.col("score_broken"), F.col(c)) for c in ("query", "includes", "excludes")})
    score = F.when(~F.col("score_broken"), topic_score(low("title"), low("summary")))
    return topic_pairs(articles, safe).withColumn("topic_score", score)


def recency(published: str, as_of: Column | None = None) -> Column:
    """Q10."""
    age = (F.unix_timestamp(now(as_of)) - F.unix_timestamp(published)) / 3600.0
    return F.when(age <= 3, 1.0).when(age <= 12, 0.8).when(age <= 48, 0.6).otherwise(0.3)


def source_weights(sources: DataFrame) -> DataFrame:
    """Q11: points from 0 to 1; 0.5 where all are alike. The bounds are one row."""
    bounds = sources.agg(F.min("points").alias("low"), F.max("points").alias("high"))
    weight = F.when(F.col("high") == F.col("low"), 0.5).otherwise(F.try_divide(F.col("points") - F.col("low"), F.col("high") - F.col("low")))
    return sources.crossJoin(F.broadcast(bounds)).select(F.col("id").alias("source_id"), weight.cast("double").alias("weight"))


def order() -> tuple[Column, ...]:
    """Q13: score, then free before paywalled, then earlier; the id makes it total."""
    return F.desc("score"), F.asc("paywalled_bool"), F.asc("published_at"), F.asc("id")


def final_scores(articles: DataFrame, topics: DataFrame, sources: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Q12: final score."""
    rows = scored(articles, topics).join(source_weights(sources), "source_id", "left")
    score = F.round(recency("published_at", as_of) + 0.2 * F.least(F.col("topic_score") / 50.0, F.lit(1.0)) + 0.1 * F.coalesce("weight", F.lit(0.5)), 6)
    return rows.withColumn("score", score)


def ranked(articles: DataFrame, topics: DataFrame, sources: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Q13: (id, topic_id, score, place): every article's place in its topic, from ranges of the whole order."""
    rows = final_scores(articles, topics, sources, as_of).select("id", "topic_id", "score", "paywalled_bool", "published_at")
    return places(rows, "topic_id", order())


def top_items(articles: DataFrame, topics: DataFrame, sources: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Q14: (id, topic_id, score, place) of each topic's first max_items; cut in parts, so no task holds a topic."""
    rows = final_scores(articles, topics, sources, as_of).select("id", "topic_id", "score", "paywalled_bool", "published_at", "max_items")
    return top_per_group(rows, ("topic_id",), F.col("max_items"), order(), ("id",), "place").withColumn("place", F.col("place").cast("long"))


PAIRS = "SELECT a.*, t.id AS topic_id, t.query, t.includes, t.excludes, t.freshness_hours, t.max_items FROM articles a JOIN topics t ON t.lang = a.lang"
GATE = f"""SELECT id, topic_id, CASE WHEN length(title) < 10 THEN 'title' WHEN epoch({AS_OF}) - epoch(published_at) > freshness_hours * 3600 THEN 'stale'
    WHEN len(list_filter(regexp_split_to_array(summary, '{SPACE_CLASS}+'), lambda x: x <> '')) NOT BETWEEN 20 AND 10000 THEN 'length'
    WHEN regexp_matches(lower(title || ' ' || summary), '{blacklist_pattern()}') THEN 'blacklist'
    WHEN NOT (regexp_matches(lower(title), rx) OR regexp_matches(lower(summary), rx)) THEN 'keywords' END AS reason
    FROM (SELECT *, replace(query, ' ', '|') || CASE WHEN includes <> '' THEN '|' || includes ELSE '' END AS rx FROM ({PAIRS}) p) g"""
COUNT = "CAST(coalesce(len(regexp_extract_all(lower({0}), {1})), 0) AS BIGINT)"
SCORE = f"""SELECT *, greatest(0, {' + '.join(f"CASE WHEN split_part(query, ' ', {i}) <> '' THEN 3 * {COUNT.format('title', f"CASE WHEN split_part(query, ' ', {i}) = '' THEN 'zzzzzz' ELSE split_part(query, ' ', {i}) END")} + {COUNT.format('summary', f"CASE WHEN split_part(query, ' ', {i}) = '' THEN 'zzzzzz' ELSE split_part(query, ' ', {i}) END")} ELSE 0 END" for i in (1, 2))}
    + 5 * inc - CASE WHEN includes <> '' AND inc = 0 THEN 50 ELSE 0 END - CASE WHEN excludes <> '' AND contains(txt, excludes) THEN 100 ELSE 0 END) AS topic_score
    FROM (SELECT *, lower(title || ' ' || summary) AS txt, CASE WHEN includes = '' THEN 0 ELSE CAST(contains(lower(title || ' ' || summary), split_part(includes, '|', 1)) AS INT) + CAST(contains(lower(title || ' ' || summary), split_part(includes, '|', 2)) AS INT) END AS inc FROM ({PAIRS}) p) q"""
DECAY = f"CASE WHEN age <= 3 THEN 1.0 WHEN age <= 12 THEN 0.8 WHEN age <= 48 THEN 0.6 ELSE 0.3 END"
WEIGHTS = "SELECT id AS source_id, CASE WHEN max(points) OVER () = min(points) OVER () THEN 0.5 ELSE (points - min(points) OVER ()) / CAST(max(points) OVER () - min(points) OVER () AS DOUBLE) END AS weight FROM sources"
RANKED = f"""SELECT id, topic_id, score, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, paywalled_bool, published_at, id) AS place, max_items FROM (
    SELECT s.*, round(CAST({DECAY} AS DOUBLE) + 0.2 * least(topic_score / 50.0, 1.0) + 0.1 * coalesce(weight, 0.5), 6) AS score
    FROM (SELECT *, epoch({AS_OF} - published_at) / 3600.0 AS age FROM ({SCORE}) z) s LEFT JOIN ({WEIGHTS}) w USING (source_id)) r"""

#: The oracle takes what is valid of the keywords from the table, as its regular expressions can't tell.
KEYED = "SELECT a.*, t.id AS topic_id, t.freshness_hours, t.valid, t.bad FROM articles a JOIN keyword_topics t ON t.lang = a.lang"
HITS = f"SELECT id, topic_id FROM ({KEYED}) WHERE valid <> '' AND (regexp_matches(lower(title), valid) OR regexp_matches(lower(summary), valid))"
GATE_ERRORS = f"""SELECT id, topic_id, CASE WHEN length(title) < 10 THEN 'title' WHEN epoch({AS_OF}) - epoch(published_at) > freshness_hours * 3600 THEN 'stale'
    WHEN len(list_filter(regexp_split_to_array(summary, '{SPACE_CLASS}+'), lambda x: x <> '')) NOT BETWEEN 20 AND 10000 THEN 'length'
    WHEN regexp_matches(lower(title || ' ' || summary), '{blacklist_pattern()}') THEN 'blacklist'
    WHEN valid <> '' AND (regexp_matches(lower(title), valid) OR regexp_matches(lower(summary), valid)) OR valid = '' AND NOT bad THEN NULL WHEN bad THEN 'error' ELSE 'keywords' END AS reason FROM ({KEYED})"""

QUERIES = {
    "q01_token_count": (lambda v: v.articles.select("id", token_count(F.col("summary")).cast("long").alias("tokens")), f"SELECT id, CAST(len(list_filter(regexp_split_to_array(summary, '{SPACE_CLASS}+'), lambda x: x <> '')) AS BIGINT) AS tokens FROM articles"),
    "q02_title": (lambda v: v.articles.select("id", has_title(least=75).alias("ok")), "SELECT id, length(title) >= 75 AS ok FROM articles"),
    "q03_freshness": (lambda v: v.articles.where(is_fresh("published_at", F.lit(72))).select("id"), f"SELECT id FROM articles WHERE published_at >= {AS_OF} - INTERVAL 72 HOUR"),
    "q04_length": (lambda v: v.articles.where(right_length()).select("id"), f"SELECT id FROM articles WHERE len(list_filter(regexp_split_to_array(summary, '{SPACE_CLASS}+'), lambda x: x <> '')) BETWEEN 20 AND 10000"),
    "q05_blacklist": (lambda v: v.articles.withColumn("title", F.when(F.col("id") % 7 == 0, F.concat(F.lit("An Editorial, "), "title")).otherwise(F.col("title"))).where(is_blacklisted()).select("id"), f"SELECT id FROM (SELECT id, lower(CASE WHEN id % 7 = 0 THEN 'An Editorial, ' ELSE '' END || title || ' ' || summary) AS t FROM articles) WHERE regexp_matches(t, '{blacklist_pattern()}')"),
    "q06_keywords": (lambda v: topic_pairs(v.articles, v.topics).withColumn("keys", keywords("query", "includes")).where(any_keyword("keys", F.col("title"), F.col("summary"))).select("id", "topic_id"), f"SELECT id, topic_id FROM (SELECT *, replace(query, ' ', '|') || CASE WHEN includes <> '' THEN '|' || includes ELSE '' END AS rx FROM ({PAIRS}) p) WHERE regexp_matches(lower(title), rx) OR regexp_matches(lower(summary), rx)"),
    "q07_gate": (lambda v: gate(v.articles, v.topics).select("id", "topic_id", "reason"), GATE),
    "q06_keyword_index": (lambda v: keyword_hits(v.articles, checked(v.keyword_topics)), HITS),
    "q07_gate_errors": (lambda v: gate(v.articles, v.keyword_topics).select("id", "topic_id", "reason"), GATE_ERRORS),
    "q07_gate_many": (lambda v: gate_many(v.articles, v.keyword_topics), GATE_ERRORS),
    "q08_score_errors": (lambda v: scored(v.articles, v.keyword_topics.where("id not in (7, 8)")).select("id", "topic_id", F.col("topic_score").isNull().alias("error")), "SELECT a.id, t.id AS topic_id, t.bad OR t.id = 6 AS error FROM articles a JOIN keyword_topics t ON t.lang = a.lang WHERE t.id NOT IN (7, 8)"),
    "q07_gate_counts": (lambda v: gate(v.articles, v.topics).groupBy("topic_id", "reason").agg(F.count("*").alias("articles")), f"SELECT topic_id, reason, count(*) AS articles FROM ({GATE}) GROUP BY 1, 2"),
    "q08_topic_score": (lambda v: scored(v.articles, v.topics).select("id", "topic_id", "topic_score"), f"SELECT id, topic_id, CAST(topic_score AS BIGINT) AS topic_score FROM ({SCORE})"),
    "q09_score_filter": (lambda v: scored(v.articles, v.topics).where("topic_score >= 0.3").select("id", "topic_id"), f"SELECT id, topic_id FROM ({SCORE}) WHERE topic_score >= 0.3"),
    "q10_recency": (lambda v: v.articles.select("id", recency("published_at").alias("recency")), f"SELECT id, CAST({DECAY} AS DOUBLE) AS recency FROM (SELECT id, epoch({AS_OF} - published_at) / 3600.0 AS age FROM articles)"),
    "q11_source_weights": (lambda v: source_weights(v.sources).withColumn("weight", F.round("weight", 9)), f"SELECT source_id, round(weight, 9) AS weight FROM ({WEIGHTS})"),
    "q12_final_score": (lambda v: final_scores(v.articles, v.topics, v.sources).select("id", "topic_id", "score"), f"SELECT id, topic_id, score FROM ({RANKED})"),
    "q13_rank": (lambda v: ranked(v.articles, v.topics, v.sources).select("id", "topic_id", "place"), f"SELECT id, topic_id, place FROM ({RANKED})"),
    "q14_top_items": (lambda v: top_items(v.articles, v.topics, v.sources).select("id", "topic_id", "place", "score"), f"SELECT id, topic_id, place, score FROM ({RANKED}) WHERE place <= max_items"),
}
