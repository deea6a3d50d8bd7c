"""Structured Streaming jobs: live progress, verification feed, telemetry windows.

Keyed feeds either live as state of their query (``follow_newest``), which answers without the
feed, or go to Spark's file sink as they are, whose own log makes a delivery count once;
tables are the newest row per key of what lies there, so the order of arrival, repeats and
late rows make no difference. Windows are kept as additive sums per batch. Folders are the
caller's. A feed's files are as many as its triggers; ``fold`` writes the newest rows to a new
folder, from which, with the feed after it, readers go on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.types import StructType

from pagetrace.operators.catalog import newest_per_key, project_progress

PAGE = ["project_id", "asset_id"]
CHANGE = ["changed_at", "change_id"]
REGION = ["asset_id", "region_id"]
VERIFIED = ["created_at", "id"]


def _start(writer: DataStreamWriter, checkpoint: str, once: bool, every: str = "1 minute") -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def _append(stream: DataFrame, path: str, checkpoint: str, once: bool) -> StreamingQuery:
    return _start(stream.writeStream.format("parquet").outputMode("append").option("path", path), checkpoint, once)


def newest(spark: SparkSession, paths: Sequence[str], schema: StructType, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """The newest row of every key over the folders of a feed and of its folds."""
    rows = [spark.read.schema(schema).parquet(path) for path in paths]
    for other in rows[1:]:
        rows[0] = rows[0].unionByName(other)
    return newest_per_key(rows[0], keys, version)


def fold(table: DataFrame, path: str) -> None:
    """A table as it is now, to a folder of its own; the files it was read from stay."""
    table.write.mode("error").parquet(path)


def follow_newest(
    feed: DataFrame, keys: Sequence[str], version: Sequence[str], checkpoint: str, once: bool = False
) -> StreamingQuery:
    """The newest row of every key as keyed state of the query; see ``current_rows``.

    A trigger reads its new files and touches their keys only, however long the feed is; order
    of arrival, repeats and late rows make no difference. Of rows with equal versions any may stay.
    A key that is or holds NULL is a key. State has as many partitions as the session shuffles when
    the query first starts; on a cluster take the RocksDB provider, which keeps it out of the heap.
    """
    row = F.struct(*[c for c in feed.columns if c not in keys])
    kept = feed.groupBy(*keys).agg(F.max_by(row, F.struct(*version)).alias("row"))
    return _start(kept.writeStream.format("noop").outputMode("update"), checkpoint, once)


def current_rows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What ``follow_newest`` holds after its last finished trigger, one row per key; the feed is not read."""
    state = spark.read.format("statestore").load(checkpoint)
    row = state.schema["value"].dataType.names[0]
    return state.select("key.*", F.col("value").getField(row).alias("row")).select("*", "row.*").drop("row")


def follow_status(changes: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """changes(project_id, asset_id, status, ocr_text, changed_at, change_id); see ``current_progress``."""
    return _append(changes, path, checkpoint, once)


def current_progress(spark: SparkSession, paths: Sequence[str], schema: StructType) -> DataFrame:
    return project_progress(newest(spark, paths, schema, PAGE, CHANGE))


def follow_verifications(feed: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Verified texts: feed(id, asset_id, region_id, verified_text, created_at).

    However late or often one arrives, ``newest`` by REGION and VERIFIED is the truth table.
    """
    return _append(feed.where(F.trim("verified_text") != ""), path, checkpoint, once)


def stage_sums() -> dict[str, Column]:
    return {"work_seconds": F.sum("duration_seconds"), "records": F.count(F.lit(1)), "failures": F.count_if(~F.col("success"))}


def call_sums() -> dict[str, Column]:
    return {"calls": F.count(F.lit(1)), "retries": F.count_if(F.col("attempt") > 1), "inference_seconds": F.sum("duration_seconds")}


def follow_windows(
    records: DataFrame, sums: dict[str, Column], path: str, checkpoint: str, width: str = "1 hour", once: bool = False
) -> StreamingQuery:
    """Sums per event-time window and stage of each batch of records(ts, stage, ..).

    Nothing waits for a watermark and no record is too late: it adds to its window in the
    batch it comes with. A batch that is repeated replaces its own folder.
    """

    def handle(rows: DataFrame, batch: int) -> None:
        window = F.window(F.col("ts").cast("timestamp"), width)["start"].alias("window_start")
        parts = rows.groupBy(window, "stage").agg(*[c.alias(n) for n, c in sums.items()])
        parts.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return _start(records.writeStream.outputMode("append").foreachBatch(handle), checkpoint, once)


def windows(spark: SparkSession, path: str, sums: Sequence[str]) -> DataFrame:
    """(window_start, stage, sums): the batches so far added up."""
    return spark.read.parquet(path).groupBy("window_start", "stage").agg(*[F.sum(n).alias(n) for n in sums])
