"""Article fields of pages: work a page."""

from presswork.operators import extraction
from presswork.sources import fixtures

SF = "/root/testdata/sf0.001"


def test_a_page_is_built_and_read_once(spark):
    rows = extraction.extract(fixtures.Tables(spark, SF).tagged_pages)
    for df in (rows, rows.where("title <> '' and summary <> '' and not date_invalid")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Big <b>") == 1 and plan.count("<script[^>]*application") == 1
    pages = [(1, "http://a.example/1", "<title>T</title><p>p</p>"), (2, "http://a.example/2", "<p>no title</p>"), (3, "http://a.example/3", None), (4, "http://a.example/4", "<h1>H</h1><p>text</p>")]
    got = {(r.page_id, r.title, r.summary) for r in extraction.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {(1, "T", ""), (4, "H", "text")}
