"""Gate and score cases, traps, keep-first against a sequential oracle, and streams against batches."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from presswork.functions import text, urls
from presswork.operators import dedupe, extraction, history, keyword_index, main_text, quality, reports, snapshots, topk
from presswork.operators.reports import hours_before
from presswork.plans import registry
from presswork.sources.fixtures import Tables
from presswork.streaming import ingest

SF = "/root/testdata/sf0.001"
LONG = "machine learning models " * 10


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, SF)


@pytest.mark.parametrize(
    ("title", "summary", "age_hours", "reason"),
    [
        ("A fine machine title", LONG, 2, None),
        ("Short", LONG, 2, "title"),
        (None, LONG, 2, "title"),
        ("A fine machine title", LONG, 80, "stale"),
        ("A fine machine title", LONG, -5, None),
        ("A fine machine title", LONG, None, None),
        ("A fine machine title", "too short", 2, "length"),
        ("A fine machine title", None, 2, "length"),
        ("Opinion: a machine title", LONG, 2, "blacklist"),
        ("Opinionated machine title", LONG, 2, None),
        ("Partner  content machine", LONG, 2, "blacklist"),
        ("Une éditorial machine", LONG, 2, None),
        ("A title without the words", "nothing of interest " * 10, 2, "keywords"),
    ],
)
def test_gate(spark, title, summary, age_hours, reason):
    topics = spark.createDataFrame([(1, "en", "machine", "", "", 72, 30)], "id int, lang string, query string, includes string, excludes string, freshness_hours int, max_items int")
    article = spark.createDataFrame([(1, "en", title, summary)], "id long, lang string, title string, summary string")
    age = F.lit(None).cast("timestamp") if age_hours is None else F.timestamp_seconds(F.lit(1706659200 - age_hours * 3600))
    assert quality.gate(article.withColumn("published_at", age), topics).first().reason == reason


def test_accents_with_unicode_boundaries(spark):
    df = spark.createDataFrame([("une éditorial ici", "")], "title string, summary string")
    assert df.select(quality.is_blacklisted(), quality.is_blacklisted(unicode_boundaries=True)).first()[:] == (False, True)


def test_spaces(spark):
    assert spark.createDataFrame([("a b c\u00a0 d",)], "s string").select(text.token_count(F.col("s"))).first()[0] == 4


def test_keywords_that_are_no_patterns(spark):
    rows = [("a(b", False), ("ok", True), ("[", False), ("x{2}", True), ("*a", False), ("(?<n>a)\\k<n>", True), ("", True)]
    got = spark.createDataFrame(rows, "p string, good boolean").select("good", keyword_index.is_pattern(F.col("p")).alias("is")).collect()
    assert all(r.good == r["is"] for r in got)
    topics = spark.createDataFrame([(1, "en", "machine [", "", "", 72, 30), (2, "en", "[ machine", "", "", 72, 30), (3, "en", "", "", "+", 72, 30)], "id int, lang string, query string, includes string, excludes string, freshness_hours int, max_items int")
    topics = topics.withColumn("query", F.when(F.col("id") == 2, "a(b machine").when(F.col("id") == 1, "machine a(b").otherwise(""))
    a = spark.createDataFrame([(1, "en", "A machine title", LONG), (2, "en", "Another fine title", "words of no interest " * 10)], "id long, lang string, title string, summary string").withColumn("published_at", F.lit(None).cast("timestamp"))
    want = {(1, 1): None, (2, 1): "error", (1, 2): "error", (2, 2): "error", (1, 3): None, (2, 3): None}
    assert {(r.id, r.topic_id): r.reason for r in quality.gate(a, topics).collect()} == want
    assert {(r.id, r.topic_id): r.reason for r in quality.gate_many(a, topics).collect()} == want
    assert all(r.topic_score is None for r in quality.scored(a, topics).collect())


def test_feeds_go_by_publication(spark):
    """H1, H3: a link added today doesn't bring an old article back; no date is in no window; a bad keyword costs the articles behind it, not the feed."""
    ago = lambda h: None if h is None else datetime.datetime.fromtimestamp(1706659200 - h * 3600, datetime.timezone.utc)
    rows = [(1, "A machine title", 5), (2, "A machine of old", 60), (3, "No words of it", 5), (4, "A machine without date", None), (5, "machine, hidden", 1), (6, "MACHINE of another source", 47)]
    articles = spark.createDataFrame([(i, f"https://e.org/{i}", t, None, i % 5, "en", ago(h), ago(1)) for i, t, h in rows], "id long, canonical_url string, title string, summary string, source_id int, lang string, published_at timestamp, first_seen_at timestamp")
    links = spark.createDataFrame([(t, i, ago(1), i == 5) for t in (1, 2, 3) for i in range(1, 7)], "topic_id int, article_id long, added_at timestamp, hidden_bool boolean")
    sources = spark.createDataFrame([(1, "One", "one.org")], "id int, name string, domain string")
    topics = spark.createDataFrame([(1, "machine", "", "", 30), (2, "machine a(b", "", "", 30), (3, "", "a(b|machine", "", 30), (4, "machine", "", "", None)], "id int, query string, includes string, excludes string, max_items int")
    feed = lambda *a: sorted(r.article_id for r in reports.topic_feed(links, articles, sources, topics, *a).collect())
    assert feed(1) == [1, 6] and feed(1, "24h") == [1] and feed(1, "7d") == [1, 2, 6] and feed(1, "other") == [1, 6] and feed(1, "all") == [1, 2, 4, 6]
    assert feed(2) == [1, 6] and feed(3) == [] and feed(4) == [] and feed(9) == [] and feed(1, "48h", "de") == []
    home = reports.home_feed(links, articles, sources).collect()
    assert [(r.id, r.source_name) for r in home] == [(5, None), (3, None), (1, "One"), (6, "One")]


def test_pieces_of_patterns(spark):
    cases = [("plain", "plain"), ("ab", None), ("th.nking", "nking"), ("two words", "words"), ("or?th", None), ("an+d", None), ("stop+ing", "stop"), ("^start$", "start"), ("a|bcd", None), ("", None), ("x\\dyyy", None)]
    got = spark.createDataFrame(cases, "p string, want string").select("want", keyword_index.piece(F.col("p")).alias("got")).collect()
    assert [r.got for r in got] == [w for _, w in cases]


def test_urls(spark):
    cases = [("HTTPS://Ex.org:443?utm_source=a&b=1#f", "https://ex.org/?b=1#f"), ("http://a_b.org/x y", "http://a_b.org/x y"), ("not a url", "not a url"), ("https://e.org/?gclid=2", "https://e.org/")]
    got = spark.createDataFrame(cases, "u string, want string").select(urls.normalise(urls.strip_tracking(F.col("u"))).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_extraction_traps(spark):
    pages = [
        (1, "https://www.a.org/x", '<script type="application/ld+json">[{"@type":"Thing"},{"@type":"Article","headline":"H","datePublished":"junk"}]</script><meta property="og:title" content="O">'),
        (2, "https://www.a.org/y", '<meta content="T" property="og:title"><meta name="description" content="D">'),
        (3, "https://a.org/z", "<h1></h1><p>no title</p>"),
    ]
    got = {r.page_id: r for r in extraction.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert set(got) == {1, 2} and got[1].title == "H" and got[1].date_invalid and got[1].summary == ""
    assert got[2].source_domain == "www.a.org" and not got[2].date_invalid and got[2].published_at is not None


def test_robots_and_sitemap_index(spark):
    text_ = "User-agent: bad\nDisallow: /\nUser-agent: *\nDisallow: /x # no\nAllow: /x/y\nCrawl-delay: 2"
    rows = extraction.robots_rules(spark.createDataFrame([("d", text_)], "domain string, text string")).collect()
    assert [(r.kind, r.path) for r in sorted(rows, key=lambda r: r.place)] == [("disallow", "/x"), ("allow", "/x/y"), ("crawl-delay", "2")]
    xml = "".join(f"<sitemap><loc>u{i}{'news' if i == 4 else ''}</loc></sitemap>" for i in range(6))
    assert spark.createDataFrame([(xml,)], "xml string").select(extraction.child_sitemaps()).first()[0] == ["u4news", "u0", "u1", "u2", "u3"]


def test_keep_first_is_sequential(tables):
    sigs = dedupe.signatures(tables.articles).select("id", "sig32")
    kept: list[int] = []
    want = []
    for r in sorted(sigs.collect(), key=lambda r: r.id):
        if all((r.sig32 ^ s).bit_count() > 1 for s in kept):
            kept.append(r.sig32)
            want.append(r.id)
    assert sorted(r.id for r in dedupe.keep_first(sigs).collect()) == want


def test_gate_reasons_cover_the_input(tables):
    assert quality.gate(tables.articles, tables.topics).count() == quality.topic_pairs(tables.articles, tables.topics).count()


def _stream(spark, df, path):
    df.write.mode("overwrite").parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def _run(stream, name, tmp_path, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c_{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def test_streams_match_batches(spark, tables, tmp_path):
    pages = _run(ingest.extracted_articles(_stream(spark, tables.tagged_pages, str(tmp_path / "p"))), "w1", tmp_path)
    assert pages.count() == extraction.extract(tables.tagged_pages).count()
    urls_ = _run(ingest.distinct_urls(_stream(spark, tables.articles.select("canonical_url", "first_seen_at"), str(tmp_path / "a"))), "w2", tmp_path)
    assert urls_.count() == tables.articles.count()
    end = spark.createDataFrame([(4102444800, "end")], "t long, event_type string").select(F.timestamp_seconds("t").alias("ts"), "event_type")
    events = tables.events.select("ts", "event_type").union(end)
    counts = _run(ingest.hourly_counts(_stream(spark, events, str(tmp_path / "e"))), "w5", tmp_path)
    assert counts.agg(F.sum("n")).first()[0] == tables.events.count()
    state = _run(ingest.failure_events(_stream(spark, tables.attempts.coalesce(1), str(tmp_path / "t")), 4), "w7", tmp_path, "update")
    assert all(r.disabled_at is None or r.heard >= 4 for r in state.collect())
    from presswork.operators.reputation import failure_state

    assert {(r.source_id, r.failures) for r in state.collect()} == {(r.source_id, r.consecutive_failures) for r in failure_state(tables.attempts).collect()}


def test_failures_go_on_after_a_restart(spark, tmp_path):
    def attempts(rows):
        return spark.createDataFrame(rows, "id long, source_id int, t long, status int").select("id", "source_id", F.timestamp_seconds("t").alias("ts"), "status")

    parts = [[(1, 1, 10, 500), (2, 1, 20, 404), (3, 2, 10, 200)], [(4, 1, 30, 500), (5, 2, 20, 500)], [(6, 1, 40, 500), (7, 1, 50, 200), (8, 2, 30, 500), (9, 2, 40, 500)]]
    path, check = str(tmp_path / "in"), str(tmp_path / "state")
    out: dict = {}
    for k, rows in enumerate(parts):  # each a run of its own over the same checkpoint
        attempts(rows).coalesce(1).write.mode("append").parquet(path)
        stream = ingest.failure_events(spark.readStream.schema(attempts([]).schema).parquet(path), 3)
        for r in ingest.run_to_end(stream, "update", check).collect():
            out.setdefault(r.source_id, []).append((r.failures, r.disabled_at is not None))
    assert out == {1: [(2, False), (3, True), (0, False)], 2: [(0, False), (1, False), (3, True)]}


def test_near_duplicate_batches(spark, tables, tmp_path):
    run = ingest.near_duplicates(str(tmp_path / "h"), str(tmp_path / "o"))
    recent = tables.articles.where(F.col("first_seen_at") >= hours_before(160))  # older ones are behind the horizon
    run(recent, 0)
    run(recent.withColumn("id", F.col("id") + 1000), 1)
    assert spark.read.parquet(str(tmp_path / "o")).where("id >= 1000").count() == 0
    once = spark.read.parquet(str(tmp_path / "h")).count()
    run(recent, 0)  # a replay changes nothing
    run(recent.limit(0), 2)  # an empty batch neither
    assert spark.read.parquet(str(tmp_path / "h")).count() == once > 0


def _sigs(spark, rows):
    return spark.createDataFrame(rows, "id long, t long, sig32 long").select("id", F.timestamp_seconds("t").alias("first_seen_at"), "sig32")


def test_what_is_near_the_history_takes_nothing_with_it(spark, tmp_path):
    now, path = 1706659200, str(tmp_path / "h")
    assert {r.id for r in history.fold(_sigs(spark, [(1, now, 0)]), path, 0, now).collect()} == {1}
    # A (2) is near H (1), B (3) is near A alone: B stays; its copy (4) goes
    assert {r.id for r in history.fold(_sigs(spark, [(2, now, 1), (3, now, 3), (4, now, 3)]), path, 1, now).collect()} == {3}
    assert {r.id for r in history.fold(_sigs(spark, [(2, now, 1), (3, now, 3), (4, now, 3)]), path, 1, now).collect()} == {3}  # a replay
    later = now + 8 * 86400
    assert {r.id for r in history.fold(_sigs(spark, [(5, later, 0), (6, None, 3)]), path, 2, later).collect()} == {5, 6}
    assert {r.id for r in history.fold(_sigs(spark, [(7, later, 3), (8, later, 1)]), path, 3, later).collect()} == {7}


def test_only_the_days_needed_are_read(spark, tmp_path):
    now, path = 1706659200, str(tmp_path / "h")
    for k in range(20):
        history.remember(_sigs(spark, [(k, now + k * 86400, 1 << k)]), path, k)
    recent = history.recall(spark, path, now + 13 * 86400, 19)
    assert {r.id for r in recent.collect()} == set(range(13, 19))
    days = {f.rsplit("day=", 1)[1].split("/")[0] for f in recent.inputFiles()}
    assert days <= {str(now // 86400 + k) for k in range(13, 20)}
    assert history.recall(spark, str(tmp_path / "none"), 0).collect() == []


def test_places_and_first_rows_of_a_hot_group(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 10 == 0, F.col("id") % 7).when(F.col("id") % 10 == 1, None).otherwise(100).alias("g"), (F.col("id") * 7919 % 50).alias("score"), F.when(F.col("id") % 3 > 0, F.lit(5)).otherwise(F.lit(None)).alias("other"))
    want: dict = {}
    for r in sorted(rows.collect(), key=lambda r: (-r.score, r.id)):
        want.setdefault(r.g, []).append(r.id)
    order = (F.desc("score"), F.asc("id"))
    got = topk.places(rows, "g", order).collect()
    assert len(got) == 3000 and all(want[r.g][r.place - 1] == r.id for r in got)
    cut = topk.top_per_group(rows.withColumn("k", F.when(F.col("g") == 3, 0).when(F.col("g") == 4, None).otherwise(11)), ("g",), F.col("k"), order, ("id",)).collect()
    assert {(r.g, r.rn, r.id) for r in cut} == {(g, i + 1, x) for g, ids in want.items() if g not in (3, 4) for i, x in enumerate(ids[:11])}
    assert topk.places(rows.limit(0), "g", order).collect() == []


def test_crawls_that_run_or_end_before_they_start(spark):
    t = lambda s: None if s is None else 1706600000 + s
    stamp = lambda df, *cs: df.withColumns({c: F.timestamp_seconds(c) for c in cs})
    crawls = stamp(spark.createDataFrame([(1, 1, t(0), t(7200)), (2, 1, t(3600), None), (3, 1, t(9000), t(8000)), (4, 2, t(0), t(10))], "id long, topic_id int, started_at long, finished_at long"), "started_at", "finished_at")
    links = stamp(spark.createDataFrame([(1, 10, t(0)), (1, 11, t(7200)), (1, 12, t(7201)), (1, 13, t(5)), (2, 10, t(11))], "topic_id int, article_id long, added_at long"), "added_at")
    articles = stamp(spark.createDataFrame([(i, 5 if i < 13 else 9, f"T{i}", f"u{i}", t(0)) for i in range(10, 14)], "id long, source_id int, title string, canonical_url string, published_at long"), "published_at")
    sources = spark.createDataFrame([(5, "five", "5.org"), (6, "six", "6.org")], "id int, name string, domain string")
    st = spark.createDataFrame([(5, 1), (6, 1), (5, 2)], "source_id int, topic_id int")
    attempts = stamp(spark.createDataFrame([(1, 6, t(1), 500), (2, 6, t(2), 404)], "id long, source_id int, ts long, status int"), "ts")
    report = reports.crawl_report(crawls, st, sources, links, articles, reports.failure_state(attempts))
    got = {(r.crawl_id, r.source_name): ([a.article_id for a in r.article_list or []], r.consecutive_failures) for r in report.collect()}
    assert got == {(1, "five"): ([11, 10], 0), (1, "six"): ([], 2), (2, "five"): ([12, 11], 0), (2, "six"): ([], 2), (3, "five"): ([], 0), (3, "six"): ([], 2), (4, "five"): ([], 0)}


def test_a_change_rewrites_only_its_days(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "id long, at timestamp, day int"
    rows = spark.range(100).select("id", F.timestamp_seconds(F.col("id") % 10 * 86400).alias("at")).withColumn("day", snapshots.day_of("at"))
    snapshots.write_days(rows.where("id < 95"), path)
    files = lambda: {f for f in snapshots.read_days(spark, path, schema).inputFiles()}
    before = files()
    assert snapshots.insert_ignore(spark, path, schema, rows.union(rows), "id", "at") == 5
    changed = {f.split("day=")[1][0] for f in files() - before}
    assert changed == set("56789") and snapshots.read_days(spark, path, schema).count() == 100
    before = files()
    assert snapshots.insert_ignore(spark, path, schema, rows, "id", "at") == 0 and files() == before
    assert snapshots.delete(spark, path, schema, rows.where("day = 3 or id = 14"), "id") == 11
    assert {f.split("day=")[1][0] for f in before - files()} == {"3", "4"} and not any("day=3/" in f for f in files())
    assert snapshots.delete(spark, path, schema, rows.where("day = 3"), "id") == 0
    assert {r.id for r in snapshots.read_days(spark, path, schema).collect()} == {i for i in range(100) if i % 10 != 3 and i != 14}


def test_main_text_among_navigation(spark):
    body = "This paragraph tells a story, in more than sixteen plain words, so that it counts as content of the page."
    menu = "<ul>" + "".join(f'<li><a href="/{i}">Section {i}</a></li>' for i in range(9)) + "</ul>"
    pages = [
        (1, f"<html><head><title>T</title><script>var x = '<p>{body}</p>'</script></head><body><div>{menu}</div><div><h1>Head</h1><p>First: {body}</p><p>Second: {body}</p></div><footer><p>{body}</p></footer></body></html>"),
        (2, f"<div><p>Never <b>closed</b>{' word' * 20}<p>Also not{' word' * 20} < lone"), (3, None), (4, ""), (5, menu), (6, "plain words without a tag " * 5), (7, f"<div><p><a href='x'>{body}</a></p></div>"), (8, "</div></div><p>" + body + "</nav>"),
    ]
    got = {r.page_id: r for r in main_text.main_texts(spark.createDataFrame(pages, "page_id long, html string")).collect()}
    assert len(got) == 8 and got[1].excerpt == f"First: {body}" and got[1].content_blocks >= 2
    assert got[2].excerpt.startswith("Never closed word") and got[2].content_blocks == 2 and got[6].excerpt.startswith("plain words") and got[8].excerpt == body
    assert all(got[k].excerpt is None and got[k].content_words == 0 for k in (3, 4, 5, 7))


def test_article_links_of_every_section(spark):
    good = ("news", "article", "actualites", "politique", "societe", "economy", "economie", "world", "monde", "sport", "culture", "tech", "science", "2024/01", "World")
    html = "".join(f'<a href="/{x}/1">' for x in (*good, "story", "tag/news", "about"))
    got = extraction.article_links(spark.createDataFrame([(1, "https://a.example.org/", html)], "page_id long, url string, html string"))
    assert {r.link for r in got.collect()} == {f"https://a.example.org/{x}/1" for x in good}


def test_first_date_and_first_locs(spark):
    xml = "<url><loc>https://a/1</loc><lastmod>2024-01-02</lastmod></url><url><loc>ftp://b</loc><lastmod>2024-01-30</lastmod></url>"
    df = spark.createDataFrame([(xml,), (xml.replace("01-02", "01-29"),), ("<url></url>",), (None,)], "xml string")
    got = df.select(extraction.is_recent(F.col("xml")).alias("recent"), extraction.first_locs(F.col("xml")).alias("locs")).collect()
    assert [r.recent for r in got] == [False, True, False, False] and got[0].locs == ["https://a/1"]


def test_token_hash_counts_utf16_units(spark):
    def units(t):
        b = (t or "").encode("utf-16-be")
        return [int.from_bytes(b[i : i + 2], "big") for i in range(0, len(b), 2)]

    def want(t):
        h = 0
        for u in units(t):
            h = (h * 31 + u) & 0xFFFFFFFF
        return h

    rows = spark.createDataFrame([("plain",), ("é€",), ("a\U0001f600b" * 9,), ("",), (None,)], "t string").select("t", dedupe.token_hash(F.col("t")).alias("h")).collect()
    assert all(r.h == want(r.t) for r in rows)


def test_simhash_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, " \t "), (4, "One"), (5, "one one\u00a0ONE"), (6, "a b"), (7, "word " * 70000)]
    got = {r.id: r.sig32 for r in dedupe.simhash(spark.createDataFrame(rows, "id long, t string"), "id", F.col("t")).collect()}
    assert got[1] == got[2] == got[3] == 0 and got[4] == got[5] and len(got) == 7
    assert got[6] == 97 & 98 and got[7] == 3655434  # a bit of half the tokens isn't set


def test_outcomes_of_each_stage(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi"
    other = " ".join(f"machine{i}" for i in range(30))
    rows = [(1, "A machine title", words), (2, "A machine title", words), (3, "short", words), (4, "Seen machine title", other), (5, "Failed machine title", other), (6, "Another machine title", other + " tail")]
    a = spark.createDataFrame(rows, "id long, title string, summary string").select("*", F.lit("en").alias("lang"), F.concat(F.lit("u"), "id").alias("canonical_url"), F.timestamp_seconds(F.lit(1706659200)).alias("published_at"), F.timestamp_seconds(F.lit(1706659200)).alias("first_seen_at"))
    topics = spark.createDataFrame([(1, "en", "machine", "", "", 72, 30)], "id int, lang string, query string, includes string, excludes string, freshness_hours int, max_items int")
    fetches = spark.createDataFrame([(i, 503 if i == 5 else 200) for i in range(1, 7)], "id long, status int")
    got = {r.id: r.outcome for r in dedupe.outcomes(a, fetches, topics, a.where("id = 4"), hours_before(168)).collect()}
    assert got == {1: "kept", 2: "skippedDuplicates", 3: "skippedQuality", 4: "skippedDuplicates", 5: "error", 6: "kept"}


def test_outcomes_of_odd_rows_are_those_of_the_sql(spark, tmp_path):
    text = lambda i: f"Nothing {i % 300} and " + " ".join(f"word{i % 300 * 31 + j * j}" for j in range(30))
    rows = [(i, None if i % 10 == 1 else " \t\u2003" if i % 10 == 2 else "" if i % 10 == 3 else text(i), "en", None if i % 10 == 4 else f"src{i % 5}") for i in range(400)]
    rows += [r for r in rows if r[0] % 10 == 5]  # twice
    rows += [(i, text(i + 7), "de", "src9") for i, *_ in rows if i % 10 == 6]  # one id, two texts and topics
    rows += [(None, text(1), "en", "src1"), (401, text(1), None, "src1")]
    spark.createDataFrame([(*r, None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in registry.queries()["d08_outcomes"](spark, str(tmp_path)).select("id", "topic_id", "outcome").collect()]
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT id, topic_id, outcome FROM ({registry.oracles()['d08_outcomes']})").fetchall()
    assert {r[2] for r in want} == {"kept", "error", "skippedQuality", "skippedDuplicates"} and sorted(got, key=str) == sorted(want, key=str)


def test_gated_late_sliding_and_session_streams(spark, tables, tmp_path):
    pages = tables.tagged_pages
    topics = tables.topics
    got = _run(ingest.extracted_articles(_stream(spark, pages, str(tmp_path / "p")), topics), "w1g", tmp_path)
    assert got.count() == quality.gate(extraction.extract(pages), topics).where("reason is null").count()
    late = _run(ingest.fresh_only(_stream(spark, tables.articles.select("id", "published_at"), str(tmp_path / "f")), 72, None), "w4", tmp_path)
    assert late.count() == tables.articles.where(quality.is_fresh("published_at", F.lit(72))).count()
    end = "timestamp_seconds(4102444800)"
    seen = tables.articles.select("first_seen_at", "published_at").union(spark.sql(f"select {end}, {end}"))
    days = _run(ingest.sliding_latency(_stream(spark, seen, str(tmp_path / "s"))), "w5s", tmp_path)
    assert days.agg(F.sum("n")).first()[0] == 24 * tables.articles.count()
    outs = tables.attempts.select("ts", (F.col("source_id") % 4).alias("topic_id"), F.col("status").cast("string").alias("outcome")).union(spark.sql(f"select {end}, 0, 'end'"))
    hours = _run(ingest.hourly_outcomes(_stream(spark, outs, str(tmp_path / "o"))), "w5t", tmp_path)
    assert hours.agg(F.sum("n")).first()[0] == tables.attempts.count()
    tries = tables.attempts.select("ts", "source_id").union(spark.sql(f"select {end}, 0"))
    sessions = _run(ingest.crawl_sessions(_stream(spark, tries, str(tmp_path / "t"))), "w6", tmp_path)
    assert sessions.agg(F.sum("n")).first()[0] == tables.attempts.count()
