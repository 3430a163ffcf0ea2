"""The inverted index of keywords."""

from presswork.operators import keyword_index


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_keyword_index_joins_the_tokens_that_hold_a_piece_where_the_articles_are(spark):
    topics = spark.createDataFrame([(1, "en", "machine", "learning mod|q.x", ""), (2, "de", "machine", "", "")], "id int, lang string, query string, includes string, excludes string")
    rows = [(1, "en", "Machines", None), (2, "en", "none", "learning models"), (3, "en", None, "a qqx"), (4, "de", "the machine", ""), (5, "fr", "machine", "machine")]
    articles = spark.createDataFrame(rows, "id long, lang string, title string, summary string")
    hits = keyword_index.keyword_hits(articles, keyword_index.checked(topics))
    assert sorted(r[:] for r in hits.collect()) == [(1, 1), (2, 1), (3, 1), (4, 2)]
    assert "substr" not in _plan(hits)  # the vocabulary is done with
