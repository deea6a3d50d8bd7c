"""Audits over stored state: verified regions, input safety, invariants, run comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REGION = ["asset_id", "region_id"]

# Fixed values -------------------------------------------------------------
AUDIT_ONLY_KEYS = ["audit_id", "oracle_source", "expected_text", "transcription"]
AUTHORITATIVE = ["auto_accepted", "auto_recovered", "verified"]
SNAPSHOT_FIELDS = [
    "ord", "region_id", "raw_text", "clean_text", "ocr_confidence", "confidence", "needs_review",
    "reason_code", "correction_score", "risky_text_change", "decision", "recovered_text",
    "recovery_confidence", "recovery_reason_code",
]
# --------------------------------------------------------------------------


def verified_regions(dialogues: DataFrame, truth: DataFrame) -> DataFrame:
    """Human-verified dialogues and whether a truth row exists and agrees."""
    human = (F.col("decision") == "verified") | F.coalesce("human_verified", F.lit(False))
    known = truth.select(*REGION, F.col("verified_text").alias("_t"), F.lit(True).alias("_known"))
    joined = dialogues.where(human).join(known, REGION, "left")
    return joined.select(
        *REGION,
        "verified_text",
        F.coalesce("_known", F.lit(False)).alias("ground_truth_exists"),
        (F.coalesce("_known", F.lit(False)) & F.col("_t").eqNullSafe(F.col("verified_text"))).alias("ground_truth_matches"),
    )


def state_snapshot(dialogues: DataFrame) -> DataFrame:
    """The text and decision every dialogue stands for, to compare before and after a run."""
    text = F.coalesce(
        F.nullif("verified_text", F.lit("")), F.nullif("recovered_text", F.lit("")), F.col("clean_text")
    )
    return dialogues.select(*REGION, "decision", text.alias("text"))


def recovered_provenance(regions: DataFrame) -> DataFrame:
    """Regions that carry traces of a recovery."""
    traced = F.col("provenance").isNotNull() | F.coalesce("recovered", F.lit(False)) | F.col("recovery_confidence").isNotNull()
    return regions.where(traced).select(
        *REGION, F.coalesce("provenance", F.lit("recovery_metadata_preserved")).alias("provenance")
    )


def forbidden_key(json_text: Column, keys: list[str] = AUDIT_ONLY_KEYS) -> Column:
    """Whether any object in the JSON, at any depth, has one of the keys (any case).

    A key is a string followed by a colon; strings are consumed whole, escapes
    included, so text that merely mentions a key does not count.
    """
    names = F.transform(
        F.regexp_extract_all(json_text, F.lit(r'"((?:[^"\\]|\\.)*+)"(\s*:)?'), F.lit(0)),
        lambda m: F.when(m.rlike(r":$"), F.lower(F.regexp_extract(m, r'^"((?:[^"\\]|\\.)*+)"', 1))),
    )
    return F.coalesce(F.arrays_overlap(F.array_compact(names), F.array(*[F.lit(k) for k in keys])), F.lit(False))


def input_safety_issues(
    evidence: DataFrame, truth: DataFrame, pages_json: DataFrame | None = None
) -> DataFrame:
    """(project_id, asset_id, region_id, issue) of story-input rows that should not be there."""
    place = ["project_id", *REGION]
    repeats = evidence.groupBy(*place).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    again = repeats.withColumn("_i", F.explode(F.sequence(F.lit(2), F.col("_n").cast("int"))))
    known = truth.select(*REGION, F.col("verified_text").alias("_t"))
    checked = evidence.join(known, REGION, "left")
    tests = F.array_compact(
        F.array(
            F.when(F.col("decision").eqNullSafe(F.lit("needs_review")), F.lit("review_gated_region")),
            F.when(~F.coalesce(F.col("decision").isin(AUTHORITATIVE), F.lit(False)), F.lit("non_authoritative_decision")),
            F.when(
                F.col("text_source").eqNullSafe(F.lit("verified")) & ~F.coalesce(F.col("_t") == F.col("final_text"), F.lit(False)),
                F.lit("verified_text_without_truth"),
            ),
        )
    )
    issues = again.select(*place, F.lit("duplicate_region").alias("issue")).unionByName(
        checked.select(*place, F.explode(tests).alias("issue"))
    )
    if pages_json is None:
        return issues
    spoiled = pages_json.where(forbidden_key(F.col("json"))).select(
        "project_id", "asset_id", F.lit(None).cast(evidence.schema["region_id"].dataType).alias("region_id"),
        F.lit("audit_only_key").alias("issue"),
    )
    return issues.unionByName(spoiled)


def input_safety(
    summary: DataFrame, evidence: DataFrame, issues: DataFrame, review_queue: DataFrame
) -> DataFrame:
    """PASS or FAIL per project with its counts; summary(project_id, status)."""
    rows = evidence.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("represented_regions"), F.count_if(F.col("text_source") == "verified").alias("_verified")
    )
    found = issues.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("issue_count"),
        F.count_if(F.col("issue") == "verified_text_without_truth").alias("_unbacked"),
        F.bool_or(F.col("issue") == "audit_only_key").alias("_audit"),
    )
    waiting = review_queue.groupBy("project_id").agg(F.count(F.lit(1)).alias("review_queue_count"))
    joined = summary.select("project_id", "status")
    for part in (rows, found, waiting):
        joined = joined.join(part, "project_id", "left")
    joined = joined.fillna(0)
    clean = (F.col("issue_count") == 0) & (F.col("review_queue_count") == 0) & (F.col("status") == "ready")
    return joined.select(
        "project_id",
        F.when(clean, "PASS").otherwise("FAIL").alias("audit_status"),
        "issue_count",
        "review_queue_count",
        "represented_regions",
        (F.col("_verified") - F.col("_unbacked")).alias("ground_truth_backed_dialogues"),
        F.coalesce("_audit", F.lit(False)).alias("audit_only_contamination"),
    )


def invariants(dialogues: DataFrame) -> DataFrame:
    """Rows against distinct region references, per project."""
    return dialogues.groupBy("project_id").agg(
        F.count("region_id").alias("represented_regions"),
        F.count_distinct("asset_id", "region_id").alias("unique_region_references"),
    )


def event_totals(events: DataFrame, coverage: DataFrame) -> DataFrame:
    """Story totals and usability from events(.., story_role, script_ready, unsupported_claims)."""
    main = F.col("story_role") == "main_story"
    counts = events.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(main).alias("main_story_events"),
        F.count_if(F.col("story_role") == "supporting_context").alias("supporting_context_events"),
        F.count_if(main & F.col("script_ready")).alias("script_ready_main_story_events"),
        F.sum("unsupported_claims").cast("long").alias("unsupported_claims"),
    )
    joined = coverage.select("project_id", F.col("unresolved_regions").alias("unresolved_evidence")).join(counts, "project_id", "left")
    filled = joined.fillna(0)
    return filled.withColumn(
        "usable", (F.col("unresolved_evidence") == 0) & (F.col("script_ready_main_story_events") > 0)
    )


def preservation(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Whether a table survived a run: unchanged rows, and no key stored twice."""
    from pagetrace.operators.catalog import row_changes

    twice = after.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    parts = {
        "changed_rows": row_changes(before, after),
        "repeated_keys": twice,
        "before_count": before,
        "after_count": after,
    }
    tagged = None
    for name, rows in parts.items():
        one = rows.select(F.lit(name).alias("_part"))
        tagged = one if tagged is None else tagged.unionByName(one)
    totals = tagged.agg(*[F.count_if(F.col("_part") == name).alias(name) for name in parts])
    return totals.withColumn("unchanged", F.col("changed_rows") == 0)


def snapshot(stage: str, dialogues: DataFrame) -> DataFrame:
    """The comparison fields of one stage; fields a stage has not produced yet are NULL."""
    have = {c: dialogues.schema[c].dataType for c in dialogues.columns}
    fields = [F.col(f) if f in have else F.lit(None).cast("string").alias(f) for f in SNAPSHOT_FIELDS if f != "region_id"]
    return dialogues.select(F.lit(stage).alias("stage"), *REGION, *fields)


def merge_experiments(trusted: DataFrame, isolated: DataFrame, order: DataFrame) -> DataFrame:
    """Isolated results for the regions they hold, trusted ones for the rest, in raw order."""
    kept = trusted.join(isolated.select(*REGION), REGION, "left_anti").unionByName(isolated, allowMissingColumns=True)
    return kept.drop("ord").join(order.select(*REGION, "ord"), REGION)


def compare_runs(left: DataFrame, right: DataFrame, fields: list[str]) -> DataFrame:
    """(asset_id, region_id, field) where two runs differ, missing rows included as ``row``."""
    a = left.select(*REGION, F.struct(*fields).alias("_a"))
    b = right.select(*REGION, F.struct(*fields).alias("_b"))
    joined = a.join(b, REGION, "full_outer")
    absent = F.col("_a").isNull() | F.col("_b").isNull()
    differing = F.array_compact(
        F.array(*[F.when(~F.col(f"_a.{f}").eqNullSafe(F.col(f"_b.{f}")), F.lit(f)) for f in fields])
    )
    found = F.when(absent, F.array(F.lit("row"))).otherwise(differing)
    return joined.select(*REGION, F.explode(found).alias("field"))
