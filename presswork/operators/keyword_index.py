"""Keywords of many topics (inventory Q6, Q7): which are patterns at all, and which articles they hit, through an inverted index.

Most keywords contain a plain piece that every match holds. The pieces are looked up in the distinct tokens of the articles, by their first three
characters, and an article meets a keyword only where one of its tokens holds the piece. The tokens that hold one are written down: they are few, so they go
to the articles, whose tokens don't move. Regular expressions run on those alone, and on keywords without a
piece. So the cost follows the hits and the vocabulary, not articles x topics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.functions.shared import stored
from presswork.functions.text import SPACE_CLASS, keywords, listed, pieces

#: Length of the part by which pieces and tokens meet; shorter pieces are no pieces.
GRAM = 3
#: In a keyword with one of these, no part is sure to be in a match; the others part it.
UNSURE = r"[|?*{}()\[\]\\]"
PARTING = rf"[.+^$]|{SPACE_CLASS}"


def is_pattern(pattern: Column) -> Column:
    """Whether Java's own compiler takes a pattern. A call by reflection, for small tables: it can't stand in a lambda."""
    return F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), pattern).isNotNull()


def checked(topics: DataFrame) -> DataFrame:
    """The topics with keys (query terms and includes up to the first that is no pattern), broken (there is one), and score_broken (query terms,
    includes or excludes have one). The gate tries keys in order and fails at a bad one, if none before it hits."""
    every = F.concat(keywords("query", "includes"), listed("excludes"))
    tried = F.size(keywords("query", "includes"))
    rows = topics.select(F.col("id").alias("_t"), tried.alias("tried"), F.posexplode(every).alias("at", "key")).withColumn("good", is_pattern(F.col("key")))
    bad = rows.groupBy("_t").agg(F.min(F.when(~F.col("good"), F.col("at"))).alias("first_bad"))
    all_keys = keywords("query", "includes")
    broken = F.coalesce(F.col("first_bad") < F.size(all_keys), F.lit(False))
    return topics.join(bad, topics.id == bad["_t"], "left").select(
        *[topics[c] for c in topics.columns], F.when(broken, F.slice(all_keys, F.lit(1), F.col("first_bad"))).otherwise(all_keys).alias("keys"), broken.alias("broken"), F.col("first_bad").isNotNull().alias("score_broken")
    )


def piece(pattern: Column) -> Column:
    """The longest plain part that every match of a pattern holds, of GRAM characters or more and without white space; else null."""
    parts = F.transform(F.split(pattern, PARTING), lambda p: F.struct(F.length(p).alias("n"), p.alias("p")))
    longest = F.array_max(parts)
    return F.when(~pattern.rlike(UNSURE) & (longest["n"] >= GRAM), longest["p"])


def keyword_hits(articles: DataFrame, topics: DataFrame) -> DataFrame:
    """Distinct (id, topic_id) of articles and checked() topics of their language with a key in title or summary. Articles have one row an id; null texts are empty."""
    keys = topics.select(F.col("id").alias("topic_id"), "lang", F.explode("keys").alias("key")).withColumn("piece", piece(F.col("key")))
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    texts = articles.select("id", "lang", low("title").alias("title"), low("summary").alias("summary"))
    tokens = texts.select("id", "lang", F.explode(F.array_distinct(pieces(F.concat_ws(" ", "title", "summary")))).alias("token")).where(F.length("token") >= GRAM)
    wanted = keys.where("piece is not null").select("piece", F.substring("piece", 1, GRAM).alias("gram")).distinct()
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("token") - (GRAM - 1)), lambda i: F.substr("token", i, F.lit(GRAM))))
    vocabulary = tokens.select("token").distinct().select("token", F.explode(grams).alias("gram"))
    holding = stored(vocabulary.join(F.broadcast(wanted), "gram").where(F.contains("token", "piece")).select("token", "piece").distinct())
    found = tokens.join(holding, "token").select("id", "lang", "piece").distinct()
    match = lambda df: df.where(F.rlike("title", F.col("key")) | F.rlike("summary", F.col("key")))
    plain = F.col("key") == F.col("piece")  # the token is in one of the two texts, and the piece in it
    met = stored(found.join(F.broadcast(keys.where("piece is not null")), ["piece", "lang"]).select("id", "topic_id", "key", plain.alias("plain")))
    sure = met.where("plain").select("id", "topic_id")
    likely = match(met.where("not plain").join(texts.drop("lang"), "id")).select("id", "topic_id")
    anywhere = match(texts.join(F.broadcast(keys.where("piece is null")), "lang")).select("id", "topic_id")
    return sure.union(likely).union(anywhere).distinct()

