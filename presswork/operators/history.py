"""Near-duplicates against a stored history (inventory D6, W3): signatures of kept articles, partitioned by day.

A batch is compared with the signatures first seen within the horizon before its own moment. Only the folders of those days are listed
and read, so a batch's cost depends on the horizon, not on the age of the store. Days are whole days since 1970 in UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.functions.shared import folders, new_folder, stored
from presswork.operators import dedupe
from presswork.sources.fixtures import AS_OF, AS_OF_EPOCH

SCHEMA = "id long, first_seen_at timestamp, sig32 long, day int, batch long"
DAY = 86_400
#: The day of rows without a time; they are compared, but no batch looks back at them.
NO_DAY = -1


def remember(rows: DataFrame, path: str, batch: int) -> None:
    """Store the (id, first_seen_at, sig32) that a batch keeps. Each batch has folders of its own, overwritten when it is replayed."""
    day = F.coalesce(F.floor(F.unix_seconds("first_seen_at") / DAY), F.lit(NO_DAY)).cast("int")
    rows.select("id", "first_seen_at", "sig32", day.alias("day"), F.lit(batch).cast("long").alias("batch")).write.partitionBy("day", "batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def recall(spark: SparkSession, path: str, since: int, before_batch: int | None = None) -> DataFrame:
    """Signatures first seen at or after `since` (seconds since 1970), of earlier batches only; folders of other days are neither listed nor read."""
    days = [d for d in folders(spark, path, "day") if int(d) >= since // DAY and int(d) != NO_DAY]
    if not days:
        return spark.createDataFrame([], SCHEMA)
    rows = spark.read.schema(SCHEMA).option("basePath", path).parquet(*[f"{path}/day={d}" for d in days])
    rows = rows.where(F.unix_seconds("first_seen_at") >= since)
    return rows if before_batch is None else rows.where(F.col("batch") < before_batch)


def fold(sigs: DataFrame, path: str, batch: int, as_of: int, days: int = 7) -> DataFrame:
    """(id, first_seen_at, sig32) of a batch that stay, and are remembered: near no signature remembered within `days` before `as_of`, and
    near no earlier row of the batch that stays. What is near the history goes first, so it takes nothing else of the batch with it."""
    since = as_of - days * DAY
    past = recall(sigs.sparkSession, path, since, batch)
    new = stored(sigs.join(dedupe.near_history(sigs, past, F.timestamp_seconds(F.lit(since))), "id", "left_anti").select("id", "first_seen_at", "sig32"))
    kept = stored(new.join(dedupe.keep_first(new), "id", "left_semi"))
    remember(kept, path, batch)
    return kept


#: The query's batches: three days each, the last one with the moment that is asked for.
BATCH_DAYS, BATCHES = 3, 5
START = AS_OF_EPOCH - BATCH_DAYS * BATCHES * DAY


def batch_of(seen: Column) -> Column:
    return F.least(F.lit(BATCHES - 1), F.greatest(F.lit(0), F.floor((F.unix_seconds(seen) - START) / (BATCH_DAYS * DAY)))).cast("int")


def folded(articles: DataFrame) -> DataFrame:
    """(id, batch, kept) of articles that come in batches by the time they were first seen, each folded into one store."""
    spark = articles.sparkSession
    sigs = stored(dedupe.signatures(articles).select("id", "first_seen_at", "sig32", batch_of(F.col("first_seen_at")).alias("batch")))
    path = new_folder(spark, "signatures")
    for k in range(BATCHES):
        fold(sigs.where(F.col("batch") == k).drop("batch"), path, k, START + (k + 1) * BATCH_DAYS * DAY)
    kept = spark.read.schema(SCHEMA).parquet(path).select("id", F.lit(True).alias("kept"))
    return sigs.join(kept, "id", "left").select("id", "batch", F.coalesce("kept", F.lit(False)).alias("kept"))


#: One row after the other, against all that was kept before.
ONE_BY_ONE = f"""WITH RECURSIVE s AS ({dedupe.DUCK_SIG}), o AS MATERIALIZED (SELECT id, sig32, batch, epoch(first_seen_at) AS seen, {START} + (batch + 1) * {BATCH_DAYS * DAY} - {7 * DAY} AS since, row_number() OVER (ORDER BY batch, id) AS n
        FROM (SELECT *, CAST(least({BATCHES - 1}, greatest(0, floor((epoch(first_seen_at) - {START}) / {BATCH_DAYS * DAY}))) AS INT) AS batch FROM s)),
    k AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(sig BIGINT, seen DOUBLE, batch INT)[]) AS had, CAST(NULL AS BIGINT) AS id, CAST(NULL AS INT) AS batch, CAST(NULL AS BOOLEAN) AS kept
        UNION ALL SELECT n, CASE WHEN near THEN had ELSE list_append(had, {{'sig': sig32, 'seen': seen, 'batch': batch}}) END, id, batch, NOT near FROM (
            SELECT o.*, k.had, len(list_filter(k.had, lambda x: bit_count(xor(x.sig, o.sig32)) <= 1 AND (x.batch = o.batch OR x.seen >= o.since))) > 0 AS near FROM k JOIN o ON o.n = k.n + 1) p)
    SELECT id, batch, kept FROM k WHERE id IS NOT NULL"""

QUERIES = {"d06_stored_history": (lambda v: folded(v.articles), ONE_BY_ONE)}
