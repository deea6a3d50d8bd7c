"""Streaming jobs run to the end of the given tables; the answer must equal the batch one."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pagetrace.operators.catalog import project_progress
from pagetrace.session import checkpoint_dir
from pagetrace.sources.lenses import SPARK, table, with_lenses
from pagetrace.streaming import jobs as J

QUERIES = {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return register


def _stream(spark, d, name):
    schema = table(spark, d, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


def _lens_stream(spark, d, lens_name, source):
    text = SPARK[lens_name].replace(f"FROM {source}", f"FROM {{{source}}}")
    return spark.sql(text, **{source: _stream(spark, d, source)})


def _seconds(name):
    """Seconds since 1970 of the wall-clock time, whatever the session's zone."""
    wall = F.col(name).cast("timestamp_ntz")
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("SECOND", start, wall).alias(name)


def _folder(spark):
    return f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


PROGRESS = (
    with_lenses("assets")
    + """, c AS (SELECT project_id, count(*) AS total, count(ocr_text) AS completed,
        count(*) FILTER (WHERE status = 'processing') AS processing, count(*) FILTER (WHERE status = 'failed') AS failed FROM assets GROUP BY 1)
    SELECT *, CASE WHEN processing > 0 THEN 'processing' WHEN failed > 0 THEN 'completed_with_errors'
        WHEN completed = total THEN 'completed' ELSE 'idle' END AS state,
      cast(round_even(cast(completed AS double) / total * 100, 0) AS bigint) AS percent FROM c"""
)
TRUTH = (
    with_lenses("truth")
    + """ SELECT id, asset_id, region_id, verified_text FROM truth
    QUALIFY row_number() OVER (PARTITION BY asset_id, region_id ORDER BY created_at DESC, id DESC) = 1"""
)


def _changes(spark, d):
    """Every page reports ready without text first, then its final state."""
    final = _lens_stream(spark, d, "assets", "orders").select("project_id", "asset_id", "status", "ocr_text", "created_at")
    first = F.struct(F.lit("ready").alias("status"), F.lit(None).cast("string").alias("ocr_text"), F.lit(1).alias("change_id"))
    last = F.struct("status", "ocr_text", F.lit(2).alias("change_id"))
    changes = final.select("project_id", "asset_id", F.col("created_at").alias("changed_at"), F.explode(F.array(first, last)).alias("c"))
    return changes.select("project_id", "asset_id", "changed_at", "c.*")


def _twice(spark, d):
    """Each verification is delivered twice."""
    feed = _lens_stream(spark, d, "truth", "events")
    return feed.withColumn("delivery", F.explode(F.array(F.lit(1), F.lit(2)))).drop("delivery")


@query("stream_project_progress", PROGRESS)
def stream_project_progress(spark, d):
    changes = _changes(spark, d)
    folder = _folder(spark)
    J.follow_status(changes, f"{folder}/table", f"{folder}/checkpoint", once=True).awaitTermination()
    return J.current_progress(spark, [f"{folder}/table"], changes.schema)


@query("stream_verified_truth", TRUTH)
def stream_verified_truth(spark, d):
    twice = _twice(spark, d)
    folder = _folder(spark)
    J.follow_verifications(twice, f"{folder}/table", f"{folder}/checkpoint", once=True).awaitTermination()
    return J.newest(spark, [f"{folder}/table"], twice.schema, J.REGION, J.VERIFIED).drop("created_at")


@query("stream_progress_state", PROGRESS)
def stream_progress_state(spark, d):
    """Progress from the state of the query, without a table of the feed."""
    checkpoint = _folder(spark)
    J.follow_newest(_changes(spark, d), J.PAGE, J.CHANGE, checkpoint, once=True).awaitTermination()
    return project_progress(J.current_rows(spark, checkpoint))


@query("stream_truth_state", TRUTH)
def stream_truth_state(spark, d):
    checkpoint = _folder(spark)
    J.follow_newest(_twice(spark, d), J.REGION, J.VERIFIED, checkpoint, once=True).awaitTermination()
    return J.current_rows(spark, checkpoint).drop("created_at")


@query(
    "stream_stage_windows",
    with_lenses("stages")
    + """ SELECT epoch(date_trunc('hour', ts))::bigint AS window_start, stage, round(sum(duration_seconds), 6) AS work_seconds, count(*) AS records,
      count(*) FILTER (WHERE NOT success) AS failures FROM stages GROUP BY 1, 2""",
)
def stream_stage_windows(spark, d):
    return _windows(spark, _lens_stream(spark, d, "stages", "events"), J.stage_sums()).select(
        _seconds("window_start"), "stage", F.round("work_seconds", 6).alias("work_seconds"), "records", "failures"
    )


@query(
    "stream_call_windows",
    with_lenses("calls")
    + """ SELECT epoch(date_trunc('hour', ts))::bigint AS window_start, stage, count(*) AS calls, count(*) FILTER (WHERE attempt > 1) AS retries,
      round(sum(duration_seconds), 6) AS inference_seconds FROM calls GROUP BY 1, 2""",
)
def stream_call_windows(spark, d):
    return _windows(spark, _lens_stream(spark, d, "calls", "events"), J.call_sums()).select(
        _seconds("window_start"), "stage", "calls", "retries", F.round("inference_seconds", 6).alias("inference_seconds")
    )


def _windows(spark, records, sums):
    folder = _folder(spark)
    J.follow_windows(records, sums, f"{folder}/sums", f"{folder}/checkpoint", once=True).awaitTermination()
    return J.windows(spark, f"{folder}/sums", list(sums))
