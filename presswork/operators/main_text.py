"""The main text of a page (inventory E9): blocks of a tag stream, judged by their words and links.

A page is cut into tags and texts; running sums over their order give each text its block, its depth of nesting, and whether it stands in a link or
in navigation. A block is content by the number-of-words rules of Kohlschuetter et al., "Boilerplate Detection using Shallow Text
Features" (2010): its own share of linked words and words, and those of the blocks before and behind it. The excerpt is the first content
block of more than 16 words, else the first at all, at the depth that holds most content words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NO_TEXT = "(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"
TOKEN = "<[^>]*>|[^<]+"
WHITE = "[ \\t\\n\\r\\f]+"
#: Tags that nest, tags that only part blocks, and tags whose content is navigation.
NESTING = ("html", "body", "main", "article", "section", "div", "table", "tr", "td", "ul", "ol", "blockquote", "nav", "header", "footer", "aside", "form")
PARTING = ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "br", "hr", "pre", "dt", "dd", "th", "title", "head")
ASIDE = ("nav", "header", "footer", "aside", "form", "head")


def blocks(pages: DataFrame) -> DataFrame:
    """(page_id, block, text, words, link_words, depth) of the blocks with a word, outside of navigation. Ids are unique. Null and empty pages have none;
    tags that are never closed keep what follows one level deeper, a lone < is dropped."""
    tokens = pages.select("page_id", F.posexplode(F.regexp_extract_all(F.regexp_replace("html", NO_TEXT, " "), F.lit(TOKEN), F.lit(0))).alias("at", "token"))
    name = F.lower(F.regexp_extract("token", "^</?([a-zA-Z][a-zA-Z0-9]*)", 1))
    step = F.when(F.startswith("token", F.lit("</")), -1).when(F.endswith("token", F.lit("/>")), 0).otherwise(1)
    so_far = Window.partitionBy("page_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)  # one page
    level = lambda *names: F.sum(F.when(F.col("name").isin(*names), F.col("step")).otherwise(0)).over(so_far)
    rows = tokens.withColumns({"name": name, "step": step}).select(
        "page_id", "at", "token", F.startswith("token", F.lit("<")).alias("tag"), F.sum(F.col("name").isin(*NESTING, *PARTING).cast("int")).over(so_far).alias("block"), level("a").alias("link"), level(*ASIDE).alias("aside"), level(*NESTING).alias("depth")
    )
    texts = rows.where(~F.col("tag") & (F.col("aside") <= 0)).withColumn("n", F.regexp_count("token", F.lit("[^ \\t\\n\\r\\f]+")))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "token"))), lambda t: t["token"]), "")
    made = texts.groupBy("page_id", "block").agg(F.trim(F.regexp_replace(whole, WHITE, " ")).alias("text"), F.sum("n").alias("words"), F.sum(F.when(F.col("link") > 0, F.col("n")).otherwise(0)).alias("link_words"), F.max("depth").alias("depth"))
    return made.where("words > 0")


def is_content(words: Column, density: Column, before: Column, density_before: Column, behind: Column) -> Column:
    """The number-of-words rules."""
    beside_text = (words > 16) | (behind > 15) | (before > 4)
    beside_links = (words > 40) | (behind > 17)
    return (density <= 1 / 3) & F.when(density_before <= 5 / 9, beside_text).otherwise(beside_links)


def main_texts(pages: DataFrame) -> DataFrame:
    """One row a page: page_id, excerpt, depth, content_words, content_blocks; nulls and zeros where nothing is content."""
    made = blocks(pages).withColumn("density", F.col("link_words") / F.col("words"))
    order = Window.partitionBy("page_id").orderBy("block")
    near = lambda c, n: F.coalesce(F.lag(c, n).over(order), F.lit(0))
    judged = made.withColumn("content", is_content(F.col("words"), F.col("density"), near("words", 1), near("density", 1), near("words", -1))).where("content")
    levels = judged.groupBy("page_id", "depth").agg(F.sum("words").alias("words"), F.count("*").alias("n"), F.min_by("text", F.struct(F.col("words") <= 16, "block")).alias("text"))
    best = levels.groupBy("page_id").agg(F.max_by(F.struct("text", "depth"), F.struct("words", -F.col("depth"))).alias("b"), F.sum("words").alias("words"), F.sum("n").alias("n"))
    found = best.select("page_id", "b.text", "b.depth", "words", "n")
    return pages.select("page_id").join(found, "page_id", "left").select("page_id", F.col("text").alias("excerpt"), F.col("depth").cast("int").alias("depth"), F.coalesce("words", F.lit(0)).alias("content_words"), F.coalesce("n", F.lit(0)).alias("content_blocks"))


def fill_summaries(articles: DataFrame, texts: DataFrame) -> DataFrame:
    """Extracted articles with the excerpt where they have no summary."""
    more = texts.select(F.col("page_id").alias("_p"), "excerpt")
    return articles.join(more, F.col("page_id") == F.col("_p"), "left").withColumn("summary", F.when(F.coalesce("summary", F.lit("")) == "", F.coalesce("excerpt", "summary")).otherwise(F.col("summary"))).drop("_p", "excerpt")


def _oracle(table: str) -> str:
    names = lambda t: ", ".join(map(repr, t))
    level = lambda t: f"sum(CASE WHEN name IN ({names(t)}) THEN step ELSE 0 END) OVER w"
    return f"""WITH t AS (SELECT page_id, unnest(l) AS token, unnest(range(len(l))) AS pos FROM (SELECT page_id, regexp_extract_all(regexp_replace(html, '{NO_TEXT}', ' ', 'g'), '{TOKEN}') AS l FROM {table})),
    m AS (SELECT *, lower(regexp_extract(token, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS name, CASE WHEN token LIKE '</%' THEN -1 WHEN token LIKE '%/>' THEN 0 ELSE 1 END AS step FROM t),
    r AS (SELECT page_id, pos, token, sum(CASE WHEN name IN ({names((*NESTING, *PARTING))}) THEN 1 ELSE 0 END) OVER w AS block, {level(('a',))} AS link, {level(ASIDE)} AS aside, {level(NESTING)} AS depth FROM m WINDOW w AS (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
    b AS (SELECT page_id, block, trim(regexp_replace(string_agg(token, '' ORDER BY pos), '{WHITE}', ' ', 'g')) AS text, sum(n) AS words, sum(CASE WHEN link > 0 THEN n ELSE 0 END) AS linked, max(depth) AS depth
        FROM (SELECT *, len(regexp_extract_all(token, '[^ \\t\\n\\r\\f]+')) AS n FROM r WHERE NOT token LIKE '<%' AND aside <= 0) GROUP BY 1, 2 HAVING sum(n) > 0),
    c AS (SELECT *, linked / words AS d, coalesce(lag(words) OVER v, 0) AS pw, coalesce(lag(linked / words) OVER v, 0) AS pd, coalesce(lead(words) OVER v, 0) AS nw FROM b WINDOW v AS (PARTITION BY page_id ORDER BY block)),
    k AS (SELECT page_id, depth, sum(words) AS words, count(*) AS n, arg_min(text, block + CASE WHEN words > 16 THEN 0 ELSE 1000000000 END) AS text FROM c WHERE d <= 1.0 / 3 AND CASE WHEN pd <= 5.0 / 9 THEN words > 16 OR nw > 15 OR pw > 4 ELSE words > 40 OR nw > 17 END GROUP BY 1, 2)
    SELECT p.page_id, x.text AS excerpt, CAST(x.depth AS INT) AS depth, CAST(coalesce(x.total, 0) AS BIGINT) AS content_words, CAST(coalesce(x.blocks, 0) AS BIGINT) AS content_blocks FROM {table} p
    LEFT JOIN (SELECT *, sum(words) OVER (PARTITION BY page_id) AS total, sum(n) OVER (PARTITION BY page_id) AS blocks, row_number() OVER (PARTITION BY page_id ORDER BY words DESC, depth) AS rn FROM k) x ON x.page_id = p.page_id AND x.rn = 1"""


QUERIES = {
    "e09_main_text": (lambda v: main_texts(v.pages), _oracle("pages")),
    "e09_tagged_main_text": (lambda v: main_texts(v.tagged_pages.select("page_id", "html")), _oracle("tagged_pages")),
}
