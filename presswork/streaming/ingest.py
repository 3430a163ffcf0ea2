"""Structured Streaming forms of the ingest path (inventory W1-W7), with the batch operators' semantics."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from presswork.functions.shared import new_folder, stored
from presswork.operators import dedupe, extraction, history, quality


def extracted_articles(pages: DataFrame, topics: DataFrame | None = None) -> DataFrame:
    """A stateless map of a page stream; with topics, each article and topic of its language that passes the gate."""
    articles = extraction.extract(pages)
    return articles if topics is None else quality.gate(articles, topics).where("reason is null").drop("reason", "keys")


def distinct_urls(articles: DataFrame, horizon: str = "7 days") -> DataFrame:
    """The first article of each URL within the horizon; state is dropped behind it."""
    return articles.withWatermark("first_seen_at", horizon).dropDuplicatesWithinWatermark(["canonical_url"])


def near_duplicates(history_path: str, out_path: str, days: int = 7):
    """A foreachBatch function: keeps the articles near none that was stored within the days before the batch's newest, and near no
    earlier one of the batch that is kept; it stores their signatures (history.fold) and ids.

    Each batch has folders of its own, is compared with earlier ones only and overwritten when it is replayed; an empty batch writes nothing.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        sigs = stored(dedupe.signatures(batch))
        newest = sigs.agg(F.count("*"), F.max(F.unix_seconds("first_seen_at"))).first()
        if newest[0]:
            kept = history.fold(sigs, history_path, batch_id, newest[1] or 0, days)
            kept.select("id").write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    return run


def fresh_only(articles: DataFrame, hours: int, as_of) -> DataFrame:  # noqa: ANN001
    """Late articles are rejected on their own time, apart from the state's watermark."""
    return articles.where(quality.is_fresh("published_at", F.lit(hours), as_of))


def hourly_counts(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Tumbling counts by type; a window is emitted when the watermark has closed it."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def hourly_outcomes(outcomes: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Tumbling counts of (topic_id, outcome, ts) by topic."""
    hours = outcomes.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour"), "topic_id", "outcome").agg(F.count("*").alias("n"))
    return hours.select(F.col("window.start").alias("start"), "topic_id", "outcome", "n")


def sliding_latency(articles: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Hours from publication to first sight over the last 24, every hour."""
    latency = (F.unix_timestamp("first_seen_at") - F.unix_timestamp("published_at")) / 3600.0
    days = articles.withWatermark("first_seen_at", delay).groupBy(F.window("first_seen_at", "24 hours", "1 hour")).agg(F.avg(latency).alias("avg_hours"), F.max(latency).alias("max_hours"), F.count("*").alias("n"))
    return days.select(F.col("window.end").alias("until"), "avg_hours", "max_hours", "n")


def crawl_sessions(attempts: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of a source's attempts."""
    return attempts.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "source_id").agg(F.count("*").alias("n")).select("source_id", F.col("session_window.start").alias("start"), "n")


class FailureRun(StatefulProcessor):
    """Failures in a row of one source, kept as a value; with `days_kept` it expires when nothing is heard of the source for so long."""

    def __init__(self, limit: int, days_kept: int | None) -> None:
        self.limit, self.days_kept = limit, days_kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "failures long, disabled boolean", ttlDurationMs=self.days_kept * 86_400_000 if self.days_kept else None)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        batch = pd.concat(list(rows)).sort_values(["ts", "id"])
        before, disabled = self.run.get() if self.run.exists() else (0, False)
        good = np.flatnonzero(batch["status"].to_numpy() == 200)
        failed = batch["status"].to_numpy() != 200
        # a run goes on from the batch before up to the first success; the runs inside the batch lie between successes
        place = np.arange(len(failed))
        last_good = np.maximum.accumulate(np.where(failed, -1, place))
        runs = place - last_good + np.where(last_good < 0, before, 0)
        crossed = np.flatnonzero(failed & (runs >= self.limit))
        after = int(runs[-1]) if failed[-1] else 0
        event = bool(len(crossed)) and not disabled
        self.run.update((after, disabled or event))
        at = batch["ts"].iloc[crossed[0]] if event else None
        yield pd.DataFrame({"source_id": [key[0]], "failures": [after], "disabled_at": pd.Series([at], dtype="datetime64[ns]"), "heard": [len(failed)], "successes": [len(good)]})

    def close(self) -> None:
        pass


FAILURE_SCHEMA = "source_id int, failures long, disabled_at timestamp, heard long, successes long"


def failure_events(attempts: DataFrame, limit: int = 20, days_kept: int | None = None) -> DataFrame:
    """A row for each source of a micro-batch: (source_id, failures in a row after it, disabled_at, heard, successes). disabled_at is set once, where the
    run first reaches `limit`. Attempts of a batch go by time and id. The state is a value in the RocksDB state store; `days_kept` gives it a time to live, for streams that
    don't end (with one, Spark goes on with batches without data, so a bounded run would never stop)."""
    attempts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return attempts.groupBy("source_id").transformWithStateInPandas(FailureRun(limit, days_kept), FAILURE_SCHEMA, "Update", "ProcessingTime" if days_kept else "None")


#: Rows of a micro-batch's file, at least; a batch with fewer is one file.
ROWS_A_FILE = 5_000


def micro_batches(batches: Iterable[DataFrame], files: int | None = None) -> DataFrame:
    """A stream of the given tables, one micro-batch each, from folders that are written one after the other (so many files each; by default as many as the
    batch with the fewest rows fills, so that no task reads a whole batch of a large table)."""
    path = schema = spark = None
    batches = list(batches)
    if files is None:  # each batch has so many rows that no file of it stays away
        files = max(1, min(df.count() for df in batches) // ROWS_A_FILE)
    for k, df in enumerate(batches):
        if path is None:
            spark, schema = df.sparkSession, df.schema
            path = new_folder(spark, "stream")
        df.repartition(files).write.parquet(f"{path}/part={k:05d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(path)


def run_to_end(stream: DataFrame, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """All rows that a bounded stream gives, with `batch`: it runs until its input is used up, each micro-batch overwriting its own folder, so that
    one that runs again adds nothing."""
    spark = stream.sparkSession
    out = new_folder(spark, "stream-out")
    write = lambda df, k: df.write.mode("overwrite").parquet(f"{out}/batch={k}")
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint or new_folder(spark, "stream-state")).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(StructType(list(stream.schema)).add("batch", "long")).parquet(out)
