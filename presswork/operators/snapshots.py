"""Snapshots that are written (inventory S3, S16, S18): tables partitioned by day, of which a change rewrites only the days it touches.

Day folders are overwritten as wholes, so a change that runs again, or again in part, ends in the same table; a change that finds nothing to do writes nothing. Days are whole
days since 1970 in UTC; rows without a time have the day -1. The days touched are known to the driver, rows never are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.functions.shared import folders, new_folder, stored
from presswork.operators.reports import hours_before
from presswork.sources.fixtures import AS_OF


def day_of(at: str | Column) -> Column:
    return F.coalesce(F.floor(F.unix_seconds(at) / 86_400), F.lit(-1)).cast("int")


def write_days(rows: DataFrame, path: str) -> None:
    """Rows with a column day, in place of the days they have."""
    rows.write.partitionBy("day").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_days(spark: SparkSession, path: str, schema: str, days: list[int] | None = None) -> DataFrame:
    """A snapshot, or those of its days; only their folders are listed."""
    have = [d for d in folders(spark, path, "day") if days is None or int(d) in days]
    if not have:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*[f"{path}/day={d}" for d in have])


def replace_days(spark: SparkSession, path: str, rows: DataFrame, days: list[int]) -> None:
    """Exactly `rows` as the content of `days`; a day without rows loses its folder."""
    held = stored(rows)  # read before it is overwritten
    write_days(held, path)
    left = {r["day"] for r in held.select("day").distinct().collect()}
    for d in days:
        if d not in left:
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/day={d}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _days(rows: DataFrame) -> list[int]:
    return sorted(r["day"] for r in rows.select("day").distinct().collect())


def insert_ignore(spark: SparkSession, path: str, schema: str, incoming: DataFrame, key: str, order: str) -> int:
    """S3: rows whose key the snapshot doesn't have, the first by `order` of each key; only their days are rewritten. Returns their number.
    Rows without a key are left out."""
    columns = [c for c in incoming.columns if c not in (key, order)]
    first = incoming.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(order, *columns)).alias("r")).select(key, "r.*")
    new = stored(first.join(read_days(spark, path, schema).select(key), key, "left_anti"))
    days = _days(new)
    if days:
        replace_days(spark, path, read_days(spark, path, schema, days).unionByName(new), days)
    return new.count()


def delete(spark: SparkSession, path: str, schema: str, doomed: DataFrame, key: str) -> int:
    """Rows whose key is among `doomed` go; only days that lose a row are rewritten. Returns the number of rows gone."""
    keys = stored(doomed.select(key).distinct())
    hit = stored(read_days(spark, path, schema).select(key, "day").join(keys, key, "left_semi"))
    days = _days(hit)
    if days:
        replace_days(spark, path, read_days(spark, path, schema, days).join(keys, key, "left_anti"), days)
    return hit.count()


def unlinked_before(articles: DataFrame, links: DataFrame, moment: Column) -> DataFrame:
    """Ids of articles first seen before a moment without a link; with days, later ones aren't read."""
    old = articles.where((F.col("day") <= day_of(moment)) & (F.col("first_seen_at") < moment))
    return old.select("id").join(links.select(F.col("article_id").alias("id")), "id", "left_anti")


ARTICLES = "canonical_url string, id long, first_seen_at timestamp, day int"
LINKS = "topic_id int, article_id long, added_at timestamp, day int"


def written(v, runs: int = 2) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
    """Articles and links written, inserted into, purged and cascaded (so often, to the same end), and read back."""
    spark = v.spark
    articles, links = new_folder(spark, "articles"), new_folder(spark, "links")
    every = v.articles.select("canonical_url", "id", "first_seen_at", day_of("first_seen_at").alias("day"))
    write_days(every.where(F.col("first_seen_at") < hours_before(48)), articles)
    # links of visible articles lose theirs where the article is purged: only hidden ones count as linked
    all_links = stored(v.topic_articles.select("topic_id", "article_id", "added_at", "hidden_bool", day_of("added_at").alias("day")))
    write_days(all_links.drop("hidden_bool"), links)
    for _ in range(runs):
        gone = stored(unlinked_before(read_days(spark, articles, ARTICLES).unionByName(every), all_links.where("hidden_bool"), hours_before(168)))
        insert_ignore(spark, articles, ARTICLES, every.join(gone, "id", "left_anti").select(*every.columns), "canonical_url", "id")
        delete(spark, articles, ARTICLES, gone, "id")
        delete(spark, links, LINKS, gone.withColumnRenamed("id", "article_id"), "article_id")
    return read_days(spark, articles, ARTICLES), read_days(spark, links, LINKS)


KEPT = f"(id % 17 = 0 OR first_seen_at >= {AS_OF} - INTERVAL 168 HOUR)"
DAY = "CAST(floor(epoch({0}) / 86400) AS INT) AS day"
QUERIES = {
    "s16_written_purge": (lambda v: written(v)[0].select("id", "day"), f"SELECT id, {DAY.format('first_seen_at')} FROM articles WHERE {KEPT}"),
    "s18_written_cascade": (lambda v: written(v)[1].select("topic_id", "article_id", "day"), f"SELECT topic_id, article_id, {DAY.format('added_at')} FROM topic_articles WHERE article_id IN (SELECT id FROM articles WHERE {KEPT})"),
}
