"""Run reports and recall audits."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pagetrace.operators import recall as R
from pagetrace.operators import telemetry as M
from pagetrace.session import checkpoint_dir
from pagetrace.sources.lenses import lens, table, with_lenses
from pagetrace.sources.stores import write_report

QUERIES = {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return register


WRAPPERS = "('page_total', 'reliability_total')"
PAGE_TOTALS = """, flags AS (SELECT run_id, bool_or(stage = 'page_total') AS wrapped FROM stages GROUP BY 1),
  page_sums AS (SELECT run_id, asset_id, sum(duration_seconds) AS all_s,
      coalesce(sum(duration_seconds) FILTER (WHERE stage = 'page_total'), 0) AS total_s,
      min(ord) AS first_all, min(ord) FILTER (WHERE stage = 'page_total') AS first_total
    FROM stages GROUP BY 1, 2),
  page_totals AS (SELECT run_id, asset_id, CASE WHEN wrapped THEN total_s ELSE all_s END AS total_seconds,
      wrapped AND first_total IS NULL AS late,
      CASE WHEN wrapped THEN coalesce(first_total, first_all) ELSE first_all END AS first_ord
    FROM page_sums JOIN flags USING (run_id))"""


def _stages(spark, d):
    return lens(spark, d, "stages")


def _calls(spark, d):
    return lens(spark, d, "calls")


@query(
    "stage_work_seconds",
    with_lenses("stages")
    + f""" SELECT run_id, stage, round(sum(duration_seconds), 6) AS work_seconds, min(ord) AS first_ord
    FROM stages WHERE stage NOT IN {WRAPPERS} GROUP BY 1, 2""",
)
def stage_work_seconds(spark, d):
    return M.stage_work(_stages(spark, d))


@query(
    "page_total_seconds",
    with_lenses("stages")
    + PAGE_TOTALS
    + " SELECT run_id, asset_id, round(total_seconds, 6) AS total_seconds, late, first_ord FROM page_totals",
)
def page_total_seconds(spark, d):
    return M.page_totals(_stages(spark, d)).withColumn("total_seconds", F.round("total_seconds", 6))


@query(
    "page_stage_seconds",
    with_lenses("stages")
    + """ SELECT run_id, asset_id, stage, round(sum(duration_seconds), 6) AS stage_seconds
    FROM stages WHERE stage <> 'page_total' GROUP BY 1, 2, 3""",
)
def page_stage_seconds(spark, d):
    return M.page_stage_seconds(_stages(spark, d))


@query(
    "page_time_statistics",
    with_lenses("stages")
    + PAGE_TOTALS
    + """, listed AS (SELECT run_id, list(total_seconds ORDER BY total_seconds) AS v, count(*) AS n,
        avg(total_seconds) AS mean FROM page_totals GROUP BY 1)
    SELECT run_id, n AS total_assets, round(mean, 6) AS average_page_seconds,
      round((v[(n + 1) // 2] + v[n // 2 + 1]) / 2, 6) AS median_page_seconds,
      round(v[cast(floor((n - 1) * cast(0.95 AS double) + 0.5) AS bigint) + 1], 6) AS p95_page_seconds FROM listed""",
)
def page_time_statistics(spark, d):
    return M.page_statistics(_stages(spark, d))


@query(
    "slowest_stage_and_page",
    with_lenses("stages")
    + PAGE_TOTALS
    + f""", work AS (SELECT run_id, stage, sum(duration_seconds) AS s, min(ord) AS o FROM stages
        WHERE stage NOT IN {WRAPPERS} GROUP BY 1, 2)
    SELECT run_id, slowest_stage, slowest_page FROM
      (SELECT run_id, arg_max(stage, row(s, -o)) AS slowest_stage FROM work GROUP BY 1)
      JOIN (SELECT run_id, arg_max(asset_id, row(total_seconds, NOT late, -first_ord)) AS slowest_page
            FROM page_totals GROUP BY 1) USING (run_id)""",
)
def slowest_stage_and_page(spark, d):
    return M.slowest(_stages(spark, d))


@query(
    "page_outcome_counts",
    with_lenses("stages")
    + """, p AS (SELECT run_id, asset_id, bool_or(success) AS ok, bool_or(NOT success) AS bad FROM stages GROUP BY 1, 2)
    SELECT run_id, count(*) FILTER (WHERE ok) - count(*) FILTER (WHERE bad) AS completed_assets,
      count(*) FILTER (WHERE bad) AS failed_assets FROM p GROUP BY 1""",
)
def page_outcome_counts(spark, d):
    return M.page_outcomes(_stages(spark, d))


@query(
    "page_call_budget",
    with_lenses("calls")
    + """ SELECT run_id, asset_id, """
    + ", ".join(f"count(*) FILTER (WHERE stage = '{s}') AS {n}" for s, n in M.PAGE_CALLS.items())
    + f" FROM calls WHERE stage IN {tuple(M.PAGE_CALLS)} GROUP BY 1, 2",
)
def page_call_budget(spark, d):
    return M.page_call_budget(_calls(spark, d))


@query(
    "project_call_budget",
    with_lenses("calls")
    + """ SELECT run_id,
      count(*) FILTER (WHERE stage = 'story_analyzer' AND attempt = 1) AS story_analyzer_full_calls,
      count(*) FILTER (WHERE stage = 'story_analyzer_repair') AS story_analyzer_repair_calls,
      count(*) FILTER (WHERE stage = 'story_analyzer' AND attempt > 1) AS story_analyzer_full_retry_calls,
      count(*) FILTER (WHERE stage = 'coverage_recovery') AS coverage_recovery_calls,
      count(*) FILTER (WHERE stage = 'coverage_recovery_repair') AS coverage_recovery_repair_calls,
      count(*) FILTER (WHERE stage = 'coverage_recovery_continuation') AS coverage_recovery_continuation_calls
    FROM calls GROUP BY 1""",
)
def project_call_budget(spark, d):
    return M.project_call_budget(_calls(spark, d))


@query(
    "project_stage_timings",
    with_lenses("stages")
    + f""" SELECT run_id, stage, round(sum(duration_seconds), 6) AS seconds FROM stages
    WHERE stage IN {tuple(M.PROJECT_STAGES)} GROUP BY 1, 2""",
)
def project_stage_timings(spark, d):
    return M.project_timings(_stages(spark, d))


@query(
    "model_call_totals",
    with_lenses("calls")
    + """ SELECT run_id, count(*) AS total_model_calls, round(sum(duration_seconds), 6) AS total_model_inference_seconds,
      count(*) FILTER (WHERE attempt > 1) AS retry_count FROM calls GROUP BY 1""",
)
def model_call_totals(spark, d):
    return M.call_totals(_calls(spark, d))


@query(
    "model_calls_by_stage",
    with_lenses("calls") + " SELECT run_id, stage, count(*) AS calls FROM calls GROUP BY 1, 2",
)
def model_calls_by_stage(spark, d):
    return M.calls_by_stage(_calls(spark, d))


@query(
    "first_failing_stage",
    with_lenses("stages")
    + """ SELECT run_id, arg_min(stage, ord) FILTER (WHERE NOT success) AS failure_stage FROM stages GROUP BY 1""",
)
def first_failing_stage(spark, d):
    return M.first_failure(_stages(spark, d))


@query(
    "run_stability_table",
    with_lenses("stages", "calls")
    + """, runs AS (SELECT run_id, count(DISTINCT asset_id) AS region_count,
        count(*) FILTER (WHERE NOT success) AS missing_count FROM stages GROUP BY 1),
      kinds AS (SELECT run_id, count(*) FILTER (WHERE stage = 'vision_layout') AS layout_calls,
        count(*) FILTER (WHERE stage = 'reading_order') AS reading_order_fallback_calls,
        count(*) FILTER (WHERE stage = 'vision_recovery') AS vision_recovery_calls FROM calls GROUP BY 1)
    SELECT *, layout_calls > 0 AND reading_order_fallback_calls = 0 AS layout_supplied_valid_order
    FROM runs JOIN kinds USING (run_id)""",
)
def run_stability_table(spark, d):
    runs = _stages(spark, d).groupBy("run_id").agg(
        F.countDistinct("asset_id").alias("region_count"), F.count_if(~F.col("success")).alias("missing_count")
    )
    return M.stability(runs, _calls(spark, d))


AUDIT = r"""WITH b AS (SELECT item_id, concat(' ', trim(regexp_replace(text, '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS words FROM benchmark),
  d AS (SELECT doc_id, concat(' ', trim(regexp_replace(text, '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS words FROM documents),
  hits AS (SELECT b.item_id AS audit_id, d.doc_id AS region_id FROM b JOIN d ON trim(b.words) <> '' AND contains(d.words, b.words)),
  expected AS (SELECT concat('f', cast(b.item_id % 10 AS varchar)) AS filename, b.item_id AS audit_id, h.region_id,
      CASE WHEN h.region_id IS NULL THEN 'OCR_MISSING' WHEN b.item_id % 4 = 0 THEN 'DETECTED_PARTIAL' ELSE 'DETECTED' END AS classification,
      CASE WHEN b.item_id % 3 = 0 THEN 'GARBLED' ELSE 'COMPLETE' END AS text_quality
    FROM benchmark b LEFT JOIN hits h ON h.audit_id = b.item_id),
  per_region AS (SELECT filename, audit_id, count(region_id) AS hits, max(classification) AS c, max(text_quality) AS q
    FROM expected GROUP BY 1, 2),
  usage AS (SELECT filename, count(*) AS detected_pipeline_regions, count(*) FILTER (WHERE n > 1) AS merge_errors
    FROM (SELECT filename, region_id, count(*) AS n FROM expected WHERE region_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
  counts AS (SELECT filename, count(*) AS expected_dialogue_regions,
      count(*) FILTER (WHERE hits > 0) AS detected_expected_regions,
      count(*) FILTER (WHERE c = 'OCR_MISSING') AS ocr_missing,
      count(*) FILTER (WHERE c = 'OCR_PRESENT_REGION_MISSING') AS vision_grouping_missing,
      count(*) FILTER (WHERE c = 'DETECTED_PARTIAL') AS partial_dialogues,
      count(*) FILTER (WHERE c = 'DROPPED_LATER') AS dropped_later,
      count(*) FILTER (WHERE hits > 0 AND q = 'COMPLETE') AS complete_text,
      count(*) FILTER (WHERE hits > 0 AND q = 'GARBLED') AS garbled_text,
      count(*) FILTER (WHERE hits > 1) AS split_errors FROM per_region GROUP BY 1),
  pages_ AS (SELECT c.*, coalesce(u.detected_pipeline_regions, 0) AS detected_pipeline_regions,
      coalesce(u.merge_errors, 0) AS merge_errors FROM counts c LEFT JOIN usage u USING (filename)) """


def _audit_regions(spark, d):
    """Expected passages of the benchmark and the documents that hold them.

    A document holds a passage if its words, in order and whole, occur in the document's. They
    meet on the passage's longest word; pairs of ids come before the texts are joined.
    """
    items = table(spark, d, "benchmark").select("item_id", _spaced("text").alias("passage"))
    documents = table(spark, d, "documents").select("doc_id", _spaced("text").alias("words"))
    longest = F.array_max(F.transform(F.split(F.trim("passage"), " "), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    keyed = items.select("item_id", longest.alias("word")).where("word <> ''")
    spread = documents.select("doc_id", F.explode(F.array_distinct(F.split(F.trim("words"), " "))).alias("word"))
    pairs = spread.join(keyed, "word").select("doc_id", "item_id")
    hits = (
        pairs.join(items, "item_id")
        .join(documents, "doc_id")
        .where(F.contains("words", F.col("passage")))
        .select("item_id", F.col("doc_id").alias("detected_region_id"))
    )
    return (
        items.select("item_id")
        .join(hits, "item_id", "left")
        .select(
            F.concat(F.lit("f"), F.col("item_id") % 10).alias("filename"),
            F.col("item_id").alias("audit_id"),
            F.lit(True).alias("required"),
            F.when(F.col("detected_region_id").isNull(), "OCR_MISSING")
            .when(F.col("item_id") % 4 == 0, "DETECTED_PARTIAL")
            .otherwise("DETECTED")
            .alias("classification"),
            F.when(F.col("item_id") % 3 == 0, "GARBLED").otherwise("COMPLETE").alias("text_quality"),
            "detected_region_id",
        )
    )


def _spaced(column):
    """The words of a text between single spaces, one at either end."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(column, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


@query(
    "page_recall_audit",
    AUDIT
    + """ SELECT *, coalesce(cast(detected_expected_regions AS double) / nullif(expected_dialogue_regions, 0), 1.0) AS bubble_recall,
      coalesce(cast(expected_dialogue_regions - detected_expected_regions AS double) / nullif(expected_dialogue_regions, 0), 0.0) AS missing_dialogue_rate,
      coalesce(cast(complete_text AS double) / nullif(detected_expected_regions, 0), 0.0) AS text_completeness FROM pages_""",
)
def page_recall_audit(spark, d):
    return R.page_audit(_audit_regions(spark, d))


@query(
    "recall_report_file",
    AUDIT + " SELECT filename, expected_dialogue_regions, detected_expected_regions, ocr_missing, split_errors, merge_errors FROM pages_",
)
def recall_report_file(spark, d):
    """The audit written as a JSON report, replaced, and read back."""
    report = R.page_audit(_audit_regions(spark, d)).select(
        "filename", "expected_dialogue_regions", "detected_expected_regions", "ocr_missing", "split_errors", "merge_errors"
    )
    path = f"{checkpoint_dir(spark)}/report-{uuid.uuid4().hex}"
    write_report(report.limit(0), path)
    write_report(report, path)
    return spark.read.schema(report.schema).json(path)


@query(
    "recall_snapshot_audit",
    AUDIT + " SELECT filename, expected_dialogue_regions, detected_expected_regions, ocr_missing, partial_dialogues, split_errors, merge_errors FROM pages_",
)
def recall_snapshot_audit(spark, d):
    """Audit snapshots, a JSON document a page with its expected regions, written, read back and audited."""
    found = _audit_regions(spark, d)
    regions = found.groupBy("filename", "audit_id", "required", "classification", "text_quality").agg(
        F.collect_list("detected_region_id").alias("detected_region_ids")
    )
    parts = ("audit_id", "required", "classification", "text_quality", "detected_region_ids")
    # A snapshot lists a page's regions; it is one value of the file.
    pages = regions.groupBy("filename").agg(F.collect_list(F.struct(*parts)).alias("expected_regions"))
    path = f"{checkpoint_dir(spark)}/snapshot-{uuid.uuid4().hex}"
    documents = pages.select(F.array(F.struct("filename", "expected_regions")).alias("pages"))
    documents.write.option("maxRecordsPerFile", 1).json(path)
    _, rows = R.read_snapshot(spark, path)
    return R.page_audit(rows).select(
        "filename", "expected_dialogue_regions", "detected_expected_regions", "ocr_missing", "partial_dialogues", "split_errors", "merge_errors"
    )


@query(
    "dataset_recall_audit",
    AUDIT
    + ", total AS (SELECT "
    + ", ".join(f"cast(sum({c}) AS bigint) AS {c}" for c in R.SUMMED)
    + """ FROM pages_) SELECT *, cast(detected_expected_regions AS double) / expected_dialogue_regions AS bubble_recall,
      cast(expected_dialogue_regions - detected_expected_regions AS double) / expected_dialogue_regions AS missing_dialogue_rate,
      coalesce(cast(complete_text AS double) / nullif(detected_expected_regions, 0), 0.0) AS text_completeness FROM total""",
)
def dataset_recall_audit(spark, d):
    return R.dataset_audit(R.page_audit(_audit_regions(spark, d)))
