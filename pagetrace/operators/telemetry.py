"""Run reports over stage and model-call telemetry.

Columns: stages(run_id, ord, asset_id, filename?, stage, duration_seconds, success),
calls(run_id, ord, asset_id, stage, attempt, duration_seconds). Every report is
per run; ``run_id`` may be any key column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrace.operators.numbering import number_rows

# Fixed values -------------------------------------------------------------
WRAPPER_STAGES = ["page_total", "reliability_total"]
PAGE_CALLS = {
    "vision_layout": "layout_calls",
    "vision_recovery": "vision_recovery_calls",
    "reading_order": "reading_order_calls",
    "dialogue_correction": "dialogue_correction_calls",
    "dialogue_recovery": "dialogue_recovery_calls",
}
PROJECT_STAGES = [
    "story_input_builder", "story_analyzer", "story_analyzer_repair",
    "story_grounding", "coverage_calculation", "coverage_recovery",
    "coverage_recovery_repair", "coverage_recovery_continuation",
    "reliability_total",
]
# --------------------------------------------------------------------------


def stage_work(stages: DataFrame) -> DataFrame:
    return (
        stages.where(~F.col("stage").isin(WRAPPER_STAGES))
        .groupBy("run_id", "stage")
        .agg(
            F.round(F.sum("duration_seconds"), 6).alias("work_seconds"),
            F.min("ord").alias("first_ord"),
        )
    )


def page_totals(stages: DataFrame) -> DataFrame:
    """Seconds per page: its page_total records if the run has any, else all its records.

    A page without page_total in a run that has them still appears, with 0.
    """
    on_page = stages.where(F.col("asset_id").isNotNull())
    is_total = F.col("stage") == "page_total"
    flags = stages.groupBy("run_id").agg(F.bool_or(is_total).alias("_wrapped"))
    pages = on_page.groupBy("run_id", "asset_id").agg(
        F.sum(F.when(is_total, F.col("duration_seconds"))).alias("_total"),
        F.sum("duration_seconds").alias("_all"),
        F.min(F.when(is_total, F.col("ord"))).alias("_first_total"),
        F.min("ord").alias("_first"),
    )
    wrapped = F.col("_wrapped")
    return pages.join(flags, "run_id").select(
        "run_id",
        "asset_id",
        F.when(wrapped, F.coalesce("_total", F.lit(0.0))).otherwise(F.col("_all")).alias("total_seconds"),
        # Pages found through page_total come first, in record order.
        (wrapped & F.col("_first_total").isNull()).alias("late"),
        F.when(wrapped, F.coalesce("_first_total", "_first")).otherwise(F.col("_first")).alias("first_ord"),
    )


def page_stage_seconds(stages: DataFrame) -> DataFrame:
    kept = stages.where(F.col("asset_id").isNotNull() & (F.col("stage") != "page_total"))
    return kept.groupBy("run_id", "asset_id", "stage").agg(
        F.round(F.sum("duration_seconds"), 6).alias("stage_seconds")
    )


def nearest_ranks(values: DataFrame, keys: list[str], value: str, tie: list[str], ranks: dict) -> DataFrame:
    """Exact order statistics: one column per entry of ``ranks`` (name → f(count) → position).

    Positions come from the distributed numbering, never from one sorted array.
    """
    numbered = number_rows(values, keys, [F.col(value), *[F.col(t) for t in tie]])
    counts = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    located = numbered.join(counts, keys)
    picks = [
        F.max(F.when(F.col("position") == rank(F.col("_n")), F.col(value))).alias(name)
        for name, rank in ranks.items()
    ]
    return located.groupBy(*keys).agg(*picks)


def page_statistics(stages: DataFrame) -> DataFrame:
    """Mean, median and nearest-rank 95th percentile of the page totals, per run."""
    pages = page_totals(stages)
    means = pages.groupBy("run_id").agg(
        F.round(F.avg("total_seconds"), 6).alias("average_page_seconds"),
        F.count(F.lit(1)).alias("total_assets"),
    )
    ranked = nearest_ranks(
        pages,
        ["run_id"],
        "total_seconds",
        ["asset_id"],
        {
            "_low": lambda n: F.floor((n + 1) / 2),
            "_high": lambda n: F.floor(n / 2) + 1,
            "_p95": lambda n: F.floor((n - 1) * 0.95 + 0.5) + 1,
        },
    )
    return means.join(ranked, "run_id").select(
        "run_id",
        "total_assets",
        "average_page_seconds",
        F.round((F.col("_low") + F.col("_high")) / 2, 6).alias("median_page_seconds"),
        F.round("_p95", 6).alias("p95_page_seconds"),
    )


def slowest(stages: DataFrame) -> DataFrame:
    """Slowest stage and page per run; the first one seen wins a tie."""
    # Stage totals are compared unrounded, as they were summed.
    work = (
        stages.where(~F.col("stage").isin(WRAPPER_STAGES))
        .groupBy("run_id", "stage")
        .agg(F.sum("duration_seconds").alias("_work"), F.min("ord").alias("first_ord"))
    )
    by_stage = work.groupBy("run_id").agg(
        F.max_by("stage", F.struct("_work", -F.col("first_ord"))).alias("slowest_stage")
    )
    rank = F.struct(F.col("total_seconds"), ~F.col("late"), -F.col("first_ord"))
    by_page = page_totals(stages).groupBy("run_id").agg(
        F.max_by("asset_id", rank).alias("slowest_page")
    )
    return by_stage.join(by_page, "run_id", "full_outer")


def page_outcomes(stages: DataFrame) -> DataFrame:
    """Pages with a failure, and pages with a success minus those (kept literally)."""
    pages = (
        stages.where(F.col("asset_id").isNotNull())
        .groupBy("run_id", "asset_id")
        .agg(F.bool_or("success").alias("_ok"), F.bool_or(~F.col("success")).alias("_failed"))
    )
    return pages.groupBy("run_id").agg(
        (F.count_if("_ok") - F.count_if("_failed")).alias("completed_assets"),
        F.count_if("_failed").alias("failed_assets"),
    )


def page_call_budget(calls: DataFrame) -> DataFrame:
    counted = calls.where(F.col("asset_id").isNotNull() & F.col("stage").isin(list(PAGE_CALLS)))
    return counted.groupBy("run_id", "asset_id").agg(
        *[F.count_if(F.col("stage") == stage).alias(name) for stage, name in PAGE_CALLS.items()]
    )


def project_call_budget(calls: DataFrame) -> DataFrame:
    stage, first = F.col("stage"), F.col("attempt") == 1
    return calls.groupBy("run_id").agg(
        F.count_if((stage == "story_analyzer") & first).alias("story_analyzer_full_calls"),
        F.count_if(stage == "story_analyzer_repair").alias("story_analyzer_repair_calls"),
        F.count_if((stage == "story_analyzer") & (F.col("attempt") > 1)).alias("story_analyzer_full_retry_calls"),
        F.count_if(stage == "coverage_recovery").alias("coverage_recovery_calls"),
        F.count_if(stage == "coverage_recovery_repair").alias("coverage_recovery_repair_calls"),
        F.count_if(stage == "coverage_recovery_continuation").alias("coverage_recovery_continuation_calls"),
    )


def project_timings(stages: DataFrame) -> DataFrame:
    kept = stages.where(F.col("stage").isin(PROJECT_STAGES))
    return kept.groupBy("run_id", "stage").agg(
        F.round(F.sum("duration_seconds"), 6).alias("seconds")
    )


def call_totals(calls: DataFrame) -> DataFrame:
    return calls.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total_model_calls"),
        F.round(F.sum("duration_seconds"), 6).alias("total_model_inference_seconds"),
        F.count_if(F.col("attempt") > 1).alias("retry_count"),
    )


def calls_by_stage(calls: DataFrame) -> DataFrame:
    named = calls.withColumn("stage", F.coalesce("stage", F.lit("unknown")))
    return named.groupBy("run_id", "stage").agg(F.count(F.lit(1)).alias("calls"))


def first_failure(stages: DataFrame, reported: DataFrame | None = None) -> DataFrame:
    """The first failing stage of a run overrides the stage the run reported."""
    failed = stages.where(~F.col("success")).groupBy("run_id").agg(
        F.min_by("stage", "ord").alias("_failed")
    )
    base = reported if reported is not None else stages.select("run_id").distinct().withColumn(
        "failure_stage", F.lit(None).cast("string")
    )
    return base.join(failed, "run_id", "left").select(
        "run_id", F.coalesce("_failed", "failure_stage").alias("failure_stage")
    )


def stability(runs: DataFrame, calls: DataFrame) -> DataFrame:
    """Repeated-run table: calls by kind beside each run's region and missing counts.

    runs(run_id, region_count, missing_count).
    """
    kinds = calls.groupBy("run_id").agg(
        F.count_if(F.col("stage") == "vision_layout").alias("layout_calls"),
        F.count_if(F.col("stage") == "reading_order").alias("reading_order_fallback_calls"),
        F.count_if(F.col("stage") == "vision_recovery").alias("vision_recovery_calls"),
    )
    zero = F.lit(0).cast("long")
    joined = runs.join(kinds, "run_id", "left")
    names = ["layout_calls", "reading_order_fallback_calls", "vision_recovery_calls"]
    filled = joined.select(*runs.columns, *[F.coalesce(n, zero).alias(n) for n in names])
    return filled.withColumn(
        "layout_supplied_valid_order",
        (F.col("layout_calls") > 0) & (F.col("reading_order_fallback_calls") == 0),
    )
