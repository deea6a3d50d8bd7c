"""Recall audit of expected regions against detected ones.

regions(filename, audit_id, required, classification, text_quality, detected_region_id)
holds one row per expected region and detection, with NULL where nothing was
detected; pages(filename, reading_order, important_ocr_blocks,
assigned_important_ocr_blocks, ignored_meaningful_blocks).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column, empty: float) -> Column:
    return F.coalesce(part.cast("double") / F.nullif(whole, F.lit(0)).cast("double"), F.lit(empty))


def read_snapshot(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """Pages and region rows of an audit snapshot (one JSON document)."""
    pages = (
        spark.read.json(path, multiLine=True)
        .select(F.explode("pages").alias("page"))
        .select("page.*")
    )
    regions = pages.select("filename", F.explode("expected_regions").alias("r")).select(
        "filename",
        "r.audit_id",
        F.coalesce(_optional(pages, "r", "required"), F.lit(True)).alias("required"),
        "r.classification",
        _optional(pages, "r", "text_quality", "string").alias("text_quality"),
        F.explode_outer("r.detected_region_ids").alias("detected_region_id"),
    )
    return pages.drop("expected_regions"), regions


def _optional(pages: DataFrame, parent: str, field: str, kind: str = "boolean") -> Column:
    present = field in pages.schema["expected_regions"].dataType.elementType.names
    return F.col(f"{parent}.{field}") if present else F.lit(None).cast(kind)


def page_audit(regions: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    expected = regions.where(F.coalesce("required", F.lit(True)))
    per_region = expected.groupBy("filename", "audit_id").agg(
        F.count("detected_region_id").alias("_hits"),
        F.max("classification").alias("_class"),
        F.max("text_quality").alias("_quality"),
    )
    found = F.col("_hits") > 0
    counts = per_region.groupBy("filename").agg(
        F.count(F.lit(1)).alias("expected_dialogue_regions"),
        F.count_if(found).alias("detected_expected_regions"),
        F.count_if(F.col("_class") == "OCR_MISSING").alias("ocr_missing"),
        F.count_if(F.col("_class") == "OCR_PRESENT_REGION_MISSING").alias("vision_grouping_missing"),
        F.count_if(F.col("_class") == "DETECTED_PARTIAL").alias("partial_dialogues"),
        F.count_if(F.col("_class") == "DROPPED_LATER").alias("dropped_later"),
        F.count_if(found & (F.col("_quality") == "COMPLETE")).alias("complete_text"),
        F.count_if(found & (F.col("_quality") == "GARBLED")).alias("garbled_text"),
        F.count_if(F.col("_hits") > 1).alias("split_errors"),
    )
    usage = (
        expected.where(F.col("detected_region_id").isNotNull())
        .groupBy("filename", "detected_region_id")
        .agg(F.count(F.lit(1)).alias("_used"))
        .groupBy("filename")
        .agg(
            F.count(F.lit(1)).alias("detected_pipeline_regions"),
            F.count_if(F.col("_used") > 1).alias("merge_errors"),
        )
    )
    joined = counts.join(usage, "filename", "full_outer" if pages is None else "left")
    if pages is not None:
        # A page without expected regions still reports, with the zero-count defaults.
        joined = pages.join(joined, "filename", "left")
    measures = [c for c in joined.columns if c in counts.columns + usage.columns and c != "filename"]
    joined = joined.fillna(0, subset=measures)
    expected_n, detected_n = F.col("expected_dialogue_regions"), F.col("detected_expected_regions")
    return joined.withColumns(
        {
            "bubble_recall": ratio(detected_n, expected_n, 1.0),
            "missing_dialogue_rate": ratio(expected_n - detected_n, expected_n, 0.0),
            "text_completeness": ratio(F.col("complete_text"), detected_n, 0.0),
        }
    )


SUMMED = [
    "expected_dialogue_regions", "detected_expected_regions", "ocr_missing",
    "vision_grouping_missing", "partial_dialogues", "dropped_later",
    "complete_text", "garbled_text", "merge_errors", "split_errors",
]


def dataset_audit(page_reports: DataFrame) -> DataFrame:
    """Micro-averaged: counts are summed over the pages before any division."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMMED]
    if "important_ocr_blocks" in page_reports.columns:
        sums += [
            F.coalesce(F.sum(c), F.lit(0)).alias(c)
            for c in ("important_ocr_blocks", "assigned_important_ocr_blocks", "ignored_meaningful_blocks")
        ]
        sums.append(F.count_if(F.col("reading_order") != "CORRECT").alias("reading_order_errors"))
    total = page_reports.agg(*sums)
    expected, detected = F.col("expected_dialogue_regions"), F.col("detected_expected_regions")
    ratios = {
        "bubble_recall": ratio(detected, expected, 1.0),
        "missing_dialogue_rate": ratio(expected - detected, expected, 0.0),
        "text_completeness": ratio(F.col("complete_text"), detected, 0.0),
    }
    if "important_ocr_blocks" in page_reports.columns:
        ratios["ocr_block_coverage"] = ratio(
            F.col("assigned_important_ocr_blocks"), F.col("important_ocr_blocks"), 1.0
        )
    return total.withColumns(ratios)
