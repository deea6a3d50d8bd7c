"""Dialogue text: assembly, screening, correction, recovery, verification.

Model tables (one row per item, no nested page arrays):
blocks(asset_id, block_id, text, confidence), region_blocks(asset_id, region_id,
pos, block_id), regions(asset_id, region_id, type, region_source, needs_review),
reading_order(asset_id, pos, region_id), dialogues(asset_id, region_id, ord,
raw_text, ...), corrections and recoveries keyed by (asset_id, region_id) with
``pos`` for the order inside a response, truth(asset_id, region_id, verified_text).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetrace.functions import text as T
from pagetrace.functions.json import kind, number_field, strict_json, text_field
from pagetrace.functions.numeric import round_exact

REGION = ["asset_id", "region_id"]

# Fixed values -------------------------------------------------------------
UNRESOLVED = "unresolved_visual_candidate"
RECOVERED_SOURCES = ["local_ocr_recovery", "vision_ocr_recovery"]
REVIEW_THRESHOLD = 0.90
RECOVERY_THRESHOLD = 0.90
VISUAL_REVIEW_CODE = "recovered_visual_text_requires_review"
VISUAL_REVIEW_REASON = "Recovered OCR-empty visual text requires human review."
FAST_PATH_REASON = "Deterministic high-confidence unchanged OCR fast path."
# --------------------------------------------------------------------------


def page_text(blocks: DataFrame) -> DataFrame:
    """Non-blank block texts of a page joined by newlines, in block order."""
    kept = blocks.where(T.non_blank(F.col("text")).isNotNull())
    return kept.groupBy("asset_id").agg(_joined("block_id", F.col("text"), "\n").alias("ocr_text"))


def _joined(order: str, value: Column, separator: str) -> Column:
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("t"))))
    return F.array_join(F.transform(parts, lambda x: x["t"]), separator)


def region_evidence(region_blocks: DataFrame, blocks: DataFrame) -> DataFrame:
    """Text and confidence of every region; unknown block ids fall out of the join."""
    cited = region_blocks.join(blocks, ["asset_id", "block_id"])
    return cited.groupBy(*REGION).agg(
        _joined("pos", T.non_blank(F.col("text")), " ").alias("raw_text"),
        F.avg("confidence").alias("ocr_average"),
        F.min("confidence").alias("ocr_minimum"),
        F.count(F.lit(1)).alias("valid_blocks"),
    )


def build_dialogues(
    blocks: DataFrame, regions: DataFrame, region_blocks: DataFrame, reading_order: DataFrame
) -> DataFrame:
    """Dialogues in reading order; a position naming an unknown region stays unused."""
    evidence = region_evidence(region_blocks, blocks)
    placed = reading_order.select("asset_id", "region_id", (F.col("pos") + 1).alias("ord"))
    known = regions.select(*REGION, F.coalesce("type", F.lit("speech_bubble")).alias("type"))
    return (
        placed.join(known, REGION)
        .join(evidence, REGION, "left")
        .select(
            *REGION,
            "ord",
            "type",
            F.coalesce("raw_text", F.lit("")).alias("raw_text"),
            F.coalesce("ocr_average", F.lit(0.0)).alias("ocr_average"),
            "ocr_minimum",
            F.coalesce("valid_blocks", F.lit(0)).alias("valid_blocks"),
        )
    )


def newest_truth(truth: DataFrame) -> DataFrame:
    """Non-blank verified text, one row per region (the feed is already keyed when stored)."""
    text = T.non_blank(F.col("verified_text")).alias("truth_text")
    return truth.select(*REGION, text).where("truth_text IS NOT NULL")


def screen(dialogues: DataFrame, truth: DataFrame) -> DataFrame:
    """Mark each dialogue ground_truth, fast_path or uncertain; accepted rows get their text."""
    joined = dialogues.join(newest_truth(truth), REGION, "left")
    verified = F.col("truth_text").isNotNull()
    fast = T.passes_fast_path(F.col("raw_text"), F.col("ocr_minimum"))
    accepted = verified | fast
    return joined.select(
        *dialogues.columns,
        F.when(verified, "ground_truth").when(fast, "fast_path").otherwise("uncertain").alias("correction_path"),
        F.when(verified, F.col("truth_text")).when(fast, F.col("raw_text")).alias("clean_text"),
        F.when(verified, F.lit(1.0)).when(fast, F.col("ocr_minimum")).alias("confidence"),
        F.when(accepted, F.lit(False)).alias("needs_review"),
        F.when(fast & ~verified, F.lit(FAST_PATH_REASON)).alias("reason"),
        F.col("truth_text").alias("verified_text"),
        verified.alias("human_verified"),
    )


def decode_compact(
    originals: DataFrame, responses: DataFrame, keys: Sequence[str] = ("asset_id",)
) -> DataFrame:
    """Typed corrections of a batch, or the safe review rows when its response is not usable.

    One bad item (unknown or repeated region, unlisted code, wrong JSON kind,
    confidence outside 0..1, missing text) or an omitted region rejects the whole
    batch. Kinds are read from the variant because typed parsing cannot tell a
    boolean or a string from a missing number.
    """
    keys = list(keys)
    parsed = responses.select(*keys, strict_json(T.unfenced(F.col("raw_json"))).alias("_v"))
    items = F.try_variant_get("_v", "$.items", "variant")
    usable = kind(F.col("_v")).startswith("OBJECT") & kind(items).startswith("ARRAY")
    flagged = parsed.select(*keys, usable.alias("_usable"), F.when(usable, items).alias("_items"))
    exploded = flagged.select(
        *keys, F.posexplode(F.try_variant_get("_items", "$", "array<variant>")).alias("pos", "_raw")
    )
    # A list entry that is not an object reads as missing everything.
    exploded = exploded.withColumn("_item", F.when(kind(F.col("_raw")).startswith("OBJECT"), F.col("_raw")))
    item = F.col("_item")
    whole = kind(F.try_variant_get(item, "$.region_id", "variant")) == "BIGINT"
    read = exploded.select(
        *keys,
        "pos",
        F.when(whole, F.try_variant_get(item, "$.region_id", "long")).alias("region_id"),
        text_field(item, "action").alias("action"),
        text_field(item, "decision").alias("decision"),
        text_field(item, "reason_code").alias("reason_code"),
        text_field(item, "clean_text").alias("changed_text"),
        number_field(item, "confidence").alias("confidence"),
    )
    sound = (
        F.col("region_id").isNotNull()
        & F.coalesce(F.col("action").isin("unchanged", "changed"), F.lit(False))
        & F.coalesce(F.col("decision").isin("accept", "review"), F.lit(False))
        & F.coalesce(F.col("reason_code").isin(T.REASON_CODES), F.lit(False))
        & F.coalesce(F.col("confidence").between(0, 1), F.lit(False))
    )
    per_region = (
        read.withColumn("_sound", sound)
        .groupBy(*keys, "region_id")
        .agg(
            (F.bool_and("_sound") & (F.count(F.lit(1)) == 1)).alias("_sound"),
            F.min_by(
                F.struct("action", "decision", "reason_code", "changed_text", "confidence"), "pos"
            ).alias("_c"),
        )
    )
    known = originals.select(*keys, "region_id", "raw_text").withColumn("_known", F.lit(True))
    matched = known.join(per_region, [*keys, "region_id"], "full_outer")
    new_text = T.non_blank(
        F.when(F.col("_c.action") == "unchanged", F.col("raw_text")).otherwise(F.col("_c.changed_text"))
    )
    fits = F.coalesce(F.col("_sound") & F.col("_known") & new_text.isNotNull(), F.lit(False))
    matched = matched.withColumn("_fits", fits).withColumn("_text", new_text)
    verdict = (
        matched.groupBy(*keys)
        .agg(F.bool_and("_fits").alias("_fits"))
        .join(flagged.select(*keys, "_usable"), keys, "left")
        .select(*keys, (F.col("_fits") & F.coalesce("_usable", F.lit(False))).alias("accepted"))
    )
    good = F.col("accepted")
    review = (F.col("_c.decision") == "review") | F.col("_c.reason_code").isin(T.REVIEW_REASON_CODES)
    return (
        matched.where("_known")
        .join(verdict, keys)
        .select(
            *keys,
            "region_id",
            F.when(good, F.col("_text")).otherwise(F.col("raw_text")).alias("clean_text"),
            F.when(good, F.col("_c.confidence")).otherwise(F.lit(0.0)).alias("confidence"),
            F.when(good, review).otherwise(F.lit(True)).alias("needs_review"),
            F.when(good, F.col("_c.reason_code")).otherwise(F.lit("needs_review")).alias("reason_code"),
            good.alias("response_accepted"),
        )
    )


def reattach(originals: DataFrame, candidates: DataFrame) -> DataFrame:
    """Corrections with ord and raw_text taken from the originals, whatever they say."""
    fixed = ["ord", "raw_text"]
    rest = [c for c in candidates.columns if c not in fixed]
    return originals.select(*REGION, *fixed).join(candidates.select(*rest), REGION)


def correction_issues(originals: DataFrame, corrected: DataFrame) -> DataFrame:
    """One row per (asset_id, region_id, issue); the last of repeated rows is compared."""
    per_region = corrected.groupBy(*REGION).agg(
        F.count(F.lit(1)).alias("_n"),
        F.max_by(F.struct("ord", "raw_text", "clean_text", "confidence"), "pos").alias("_c"),
    )
    known = originals.select(*REGION, F.struct("ord", "raw_text").alias("_o"))
    both = known.join(per_region, REGION, "full_outer")
    original, new = F.col("_o"), F.col("_c")
    paired = original.isNotNull() & new.isNotNull()
    tests = {
        "missing": original.isNotNull() & new.isNull(),
        "invalid": original.isNull(),
        "duplicate": F.col("_n") > 1,
        "order_mismatch": paired & ~new["ord"].eqNullSafe(original["ord"]),
        "raw_text_mismatch": paired & ~new["raw_text"].eqNullSafe(original["raw_text"]),
        "empty_clean_text": paired & T.non_blank(new["clean_text"]).isNull(),
        "invalid_confidence": paired & ~F.coalesce(new["confidence"].between(0.0, 1.0), F.lit(False)),
    }
    found = F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()])
    return both.select(*REGION, F.explode(F.array_compact(found)).alias("issue"))


def correction_verdicts(originals: DataFrame, corrected: DataFrame) -> DataFrame:
    """Per page: counts and whether its corrections can be used."""
    issues = correction_issues(originals, corrected).groupBy("asset_id").agg(F.count(F.lit(1)).alias("_i"))
    left = originals.groupBy("asset_id").agg(F.count(F.lit(1)).alias("total_original"))
    right = corrected.groupBy("asset_id").agg(F.count(F.lit(1)).alias("total_corrected"))
    joined = left.join(right, "asset_id", "full_outer").join(issues, "asset_id", "left")
    filled = joined.fillna(0, subset=["total_original", "total_corrected", "_i"])
    return filled.select(
        "asset_id",
        "total_original",
        "total_corrected",
        F.col("_i").alias("issue_count"),
        ((F.col("_i") == 0) & (F.col("total_original") == F.col("total_corrected"))).alias("is_valid"),
    )


def safety(corrected: DataFrame, threshold: float = REVIEW_THRESHOLD) -> DataFrame:
    """Rows that need review: flagged by the model or below the threshold."""
    flagged = F.coalesce("needs_review", F.lit(False)) | (
        F.coalesce("confidence", F.lit(0.0)) < threshold
    )
    return corrected.where(flagged)


def page_safety(corrected: DataFrame, threshold: float = REVIEW_THRESHOLD) -> DataFrame:
    flagged = F.coalesce("needs_review", F.lit(False)) | (
        F.coalesce("confidence", F.lit(0.0)) < threshold
    )
    return corrected.groupBy("asset_id").agg(
        F.count_if(flagged).alias("review_count"), (F.count_if(flagged) == 0).alias("safe")
    )


def score(
    corrected: DataFrame, similarity: Callable[[Column, Column], Column] = T.similarity_levenshtein
) -> DataFrame:
    """Blend OCR, similarity and model confidence; review compares the unrounded score.

    A caller's measure gets the texts of unequal rows only; of others it sees NULLs.
    """
    flagged = F.coalesce("needs_review", F.lit(False))
    raw, clean = F.col("raw_text"), F.col("clean_text")
    same = F.coalesce(F.lower(raw) == F.lower(clean), F.lit(False))
    measure = F.when(same, F.lit(1.0)).otherwise(similarity(F.when(~same, raw), F.when(~same, clean)))
    measured = corrected.withColumn("_similarity", measure)
    blend = (
        F.col("ocr_average") * 0.45
        + F.col("_similarity") * 0.35
        + F.coalesce("confidence", F.lit(0.0)) * 0.20
        - F.when(flagged, 0.15).otherwise(0.0)
    )
    scored = measured.withColumn("_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), blend)))
    return scored.withColumns(
        {
            "ocr_confidence": round_exact(F.col("ocr_average"), 3),
            "text_similarity": round_exact(F.col("_similarity"), 3),
            "correction_score": round_exact(F.col("_score"), 3),
            "needs_review": flagged | (F.col("_score") < 0.75),
        }
    ).drop("_similarity", "_score")


def decide(scored: DataFrame) -> DataFrame:
    risky = T.risky_change(F.col("raw_text"), F.col("clean_text"))
    row = {
        name: F.col(name)
        for name in ("raw_text", "clean_text", "reason_code", "text_similarity", "ocr_confidence", "confidence")
    }
    tiny = T.tiny_typo(row)
    rated = scored.withColumn("risky_text_change", risky).withColumn("_tiny", tiny)
    calm = ~F.col("needs_review") & ~F.col("risky_text_change")
    good = (F.col("correction_score") >= 0.90) | (
        (F.col("correction_score") >= 0.75) & (F.col("ocr_confidence") >= 0.65)
    )
    return rated.withColumns(
        {
            "decision": F.when(F.col("_tiny") | (calm & good), "auto_accepted").otherwise("needs_recovery"),
            "calibration_rule": F.when(F.col("_tiny"), F.lit("tiny_ocr_typo")),
        }
    ).drop("_tiny")


def recover(decided: DataFrame, recoveries: DataFrame) -> DataFrame:
    """Second-pass texts for needs_recovery rows; a repeated answer counts as none."""
    answers = recoveries.groupBy(*REGION).agg(
        F.count(F.lit(1)).alias("_n"),
        F.first(
            F.struct(
                "recovered_text",
                F.col("confidence").alias("confidence"),
                F.col("reason_code").alias("reason_code"),
                "still_uncertain",
            )
        ).alias("_answer"),
    )
    single = answers.where("_n = 1").select(*REGION, "_answer")
    joined = decided.join(single, REGION, "left")
    waiting = F.col("decision") == "needs_recovery"
    answer = F.col("_answer")
    given = answer.isNotNull()
    row = {
        name: F.col(name)
        for name in ("clean_text", "reason_code", "text_similarity", "ocr_confidence", "confidence")
    }
    certainty = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(answer["confidence"], F.lit(0.0))))
    agreed = T.recovery_agrees(
        row,
        {name: answer[name] for name in ("recovered_text", "reason_code", "confidence")},
    )
    uncertain = ~given | (F.coalesce(answer["still_uncertain"], F.lit(True)) & ~agreed)
    effective = F.coalesce(T.non_blank(answer["recovered_text"]), F.col("clean_text"))
    code = F.coalesce(answer["reason_code"], F.lit("needs_review"))
    names = [c for c in decided.columns if c not in ("clean_text", "decision")]
    return joined.select(
        *names,
        F.when(waiting, F.col("clean_text")).alias("initial_clean_text"),
        F.when(waiting, effective).otherwise(F.col("clean_text")).alias("clean_text"),
        F.when(waiting, effective).alias("recovered_text"),
        F.when(waiting, certainty).alias("recovery_confidence"),
        F.when(waiting, code).alias("recovery_reason_code"),
        F.when(waiting, agreed).alias("agreement_evidence"),
        F.when(~waiting, F.col("decision"))
        .when((certainty >= RECOVERY_THRESHOLD) & ~uncertain, "auto_recovered")
        .otherwise("needs_review")
        .alias("decision"),
    )


def apply_truth(dialogues: DataFrame, truth: DataFrame) -> DataFrame:
    """Human-verified text replaces whatever the passes produced."""
    joined = dialogues.join(newest_truth(truth), REGION, "left")
    verified = F.col("truth_text").isNotNull()
    replaced = {
        "pre_verification_text": F.when(verified, F.col("clean_text")),
        "clean_text": F.coalesce("truth_text", "clean_text"),
        "verified_text": F.col("truth_text"),
        "human_verified": verified,
        "needs_review": F.col("needs_review") & ~verified,
        "decision": F.when(verified, "verified").otherwise(F.col("decision")),
    }
    return joined.withColumns(replaced).drop("truth_text")


def gate_recovered_regions(dialogues: DataFrame, regions: DataFrame) -> DataFrame:
    """Recovered regions flagged for review send their unverified dialogues to review."""
    flagged = (
        regions.where(F.col("needs_review") & F.col("region_source").isin(RECOVERED_SOURCES))
        .select(*REGION)
        .distinct()
        .withColumn("_gate", F.lit(True))
    )
    verified = (F.col("decision") == "verified") | F.coalesce("human_verified", F.lit(False))
    gate = F.coalesce("_gate", F.lit(False)) & ~verified
    joined = dialogues.join(flagged, REGION, "left")
    return joined.withColumns(
        {
            "needs_review": F.col("needs_review") | gate,
            "decision": F.when(gate, "needs_review").otherwise(F.col("decision")),
            "reason_code": F.when(gate, VISUAL_REVIEW_CODE).otherwise(F.col("reason_code")),
            "reason": F.when(gate, VISUAL_REVIEW_REASON).otherwise(F.col("reason")),
        }
    ).drop("_gate")


def evidence_batches(dialogues: DataFrame, regions: DataFrame) -> DataFrame:
    """``batch`` = recovered for dialogues of recovered regions, else trusted."""
    recovered = (
        regions.where(F.col("region_source").isin(RECOVERED_SOURCES))
        .select(*REGION)
        .distinct()
        .withColumn("_r", F.lit(True))
    )
    joined = dialogues.join(recovered, REGION, "left")
    batch = F.when(F.col("_r"), "recovered").otherwise("trusted").alias("batch")
    return joined.select(*dialogues.columns, batch)


def lost_or_invented(dialogues: DataFrame, results: DataFrame) -> DataFrame:
    """Region ids that differ between the input and the recombined output; empty when sound."""
    left = dialogues.select(*REGION).withColumn("_in", F.lit(1))
    right = results.select(*REGION).withColumn("_out", F.lit(1))
    joined = left.join(right, REGION, "full_outer").where("_in IS NULL OR _out IS NULL")
    return joined.select(*REGION, F.when(F.col("_out").isNull(), "lost").otherwise("invented").alias("problem"))


def dialogue_status(dialogues: DataFrame) -> DataFrame:
    waiting = F.bool_or(F.col("decision") == "needs_review")
    return dialogues.groupBy("asset_id").agg(
        F.when(waiting, "needs_review").otherwise("completed").alias("dialogue_status")
    )


def region_boxes(region_blocks: DataFrame, boxes: DataFrame) -> DataFrame:
    """Bounding box and centre of each region; regions without a known box drop out."""
    cited = region_blocks.join(boxes, ["asset_id", "block_id"])
    return (
        cited.groupBy(*REGION)
        .agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
        .withColumns(
            {"center_x": (F.col("x0") + F.col("x1")) / 2, "center_y": (F.col("y0") + F.col("y1")) / 2}
        )
    )


def review_queue(
    dialogues: DataFrame, assets: DataFrame, region_blocks: DataFrame, boxes: DataFrame
) -> DataFrame:
    """Dialogues waiting for review with their page, box and reasons, in page order."""
    waiting = dialogues.where(F.col("decision") == "needs_review")
    boxed = region_boxes(region_blocks, boxes).drop("center_x", "center_y")
    code = F.when(F.col("reason_code") == VISUAL_REVIEW_CODE, F.col("reason_code")).otherwise(
        F.coalesce("recovery_reason_code", "reason_code", F.lit("needs_review"))
    )
    return (
        waiting.join(assets.select("asset_id", "project_id", "filename", "page_order"), "asset_id")
        .join(boxed, REGION, "left")
        .select(
            "project_id", "asset_id", "filename", "page_order", "region_id", "raw_text", "clean_text",
            "recovered_text", "correction_score", "recovery_confidence", "confidence",
            F.coalesce("recovery_reason_code", "reason", F.lit("")).alias("reason"),
            code.alias("review_reason_code"),
            "x0", "y0", "x1", "y1",
        )
        .orderBy("project_id", "page_order", "region_id")
    )


def evidence_lookup(
    requested: DataFrame, regions: DataFrame, region_blocks: DataFrame, boxes: DataFrame
) -> DataFrame:
    """Box and role of requested (asset_id, region_id) keys; unknown or boxless → not found."""
    boxed = region_boxes(region_blocks, boxes)
    roles = regions.select(*REGION, F.coalesce("type", F.lit("unknown")).alias("text_role"))
    joined = requested.join(roles, REGION, "left").join(boxed, REGION, "left")
    found = F.col("text_role").isNotNull() & F.col("x0").isNotNull()
    return joined.withColumn("found", found)


def verify_dialogues(
    dialogues: DataFrame, stored_truth: DataFrame, feed: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Apply a batch of verifications(asset_id, region_id, verified_text, version).

    Returns the dialogues, the truth table, the page states and the rejected feed
    rows (blank text or unknown region). The newest of repeated verifications wins.
    """
    from pagetrace.operators.catalog import newest_per_key

    known = dialogues.select(*REGION).distinct().withColumn("_known", F.lit(True))
    checked = feed.withColumn("verified_text", T.non_blank(F.col("verified_text"))).join(known, REGION, "left")
    reason = F.when(F.col("verified_text").isNull(), "empty_text").when(F.col("_known").isNull(), "unknown_region")
    judged = checked.withColumn("reason", reason).drop("_known")
    rejected = judged.where("reason IS NOT NULL")
    accepted = newest_per_key(judged.where("reason IS NULL").drop("reason"), REGION, ["version"])
    updated = apply_truth(dialogues.drop("verified_text", "human_verified"), accepted)
    kept = dialogues.select(*REGION, F.col("verified_text").alias("_v"), F.col("human_verified").alias("_h"))
    updated = (
        updated.join(kept, REGION)
        .withColumn("verified_text", F.coalesce("verified_text", "_v"))
        .withColumn("human_verified", F.col("human_verified") | F.coalesce("_h", F.lit(False)))
        .drop("_v", "_h")
    )
    new_truth = accepted.join(
        dialogues.select(*REGION, "raw_text", "recovered_text", "clean_text", "correction_score", "recovery_confidence"),
        REGION,
    ).select(
        *REGION,
        "raw_text",
        F.coalesce(F.nullif("recovered_text", F.lit("")), "clean_text").alias("ai_text"),
        "verified_text",
        "correction_score",
        "recovery_confidence",
    )
    truth = stored_truth.join(new_truth.select(*REGION), REGION, "left_anti").unionByName(new_truth)
    return updated, truth, dialogue_status(updated), rejected


def rank_attempts(attempts: DataFrame, threshold: float = REVIEW_THRESHOLD, candidates: DataFrame | None = None) -> DataFrame:
    """Resolve each candidate box by the first usable non-blank attempt.

    attempts(asset_id, candidate_id, rank, source, text, confidence, usable,
    needs_review); issues of the earlier attempts are kept, in rank order. With
    candidates(asset_id, candidate_id, x0, y0, x1, y1), a box with a side missing or
    without an area is never resolved, whatever was read in it or if nothing was.
    """
    ranked = _ranked(attempts, threshold)
    if candidates is None:
        return ranked
    sound = F.coalesce((F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1")), F.lit(False))
    bad = candidates.where(~sound).select("asset_id", "candidate_id").distinct()
    refused = bad.select(
        "asset_id", "candidate_id", F.lit(False).alias("resolved"), F.lit(UNRESOLVED).alias("region_source"), F.lit(None).cast("string").alias("text"),
        F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("boolean").alias("needs_review"), F.array(F.lit("invalid_candidate_bbox")).alias("issues"),
    )
    return ranked.join(bad, ["asset_id", "candidate_id"], "left_anti").unionByName(refused)


def _ranked(attempts: DataFrame, threshold: float) -> DataFrame:
    text = T.non_blank(F.col("text"))
    usable = F.coalesce("usable", F.lit(True))
    wins = text.isNotNull() & usable
    issue = F.when(text.isNull(), F.concat("source", F.lit("_empty"))).when(
        ~usable, F.concat("source", F.lit("_unusable"))
    )
    certainty = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0))))
    best = attempts.groupBy("asset_id", "candidate_id").agg(
        F.min_by(
            F.struct(
                F.col("source").alias("source"), text.alias("text"), certainty.alias("confidence"),
                F.coalesce("needs_review", F.lit(False)).alias("needs_review"), "rank",
            ),
            F.when(wins, F.col("rank")),
        ).alias("_best"),
        # One candidate has one entry per resolver, so this list stays tiny.
        F.array_sort(F.collect_list(F.struct("rank", issue.alias("issue")))).alias("_log"),
    )
    chosen = F.col("_best")
    earlier = F.filter(
        F.col("_log"),
        lambda x: x["issue"].isNotNull() & (chosen.isNull() | (x["rank"] < chosen["rank"])),
    )
    issues = F.transform(earlier, lambda x: x["issue"])
    return best.select(
        "asset_id",
        "candidate_id",
        chosen.isNotNull().alias("resolved"),
        F.coalesce(chosen["source"], F.lit(UNRESOLVED)).alias("region_source"),
        chosen["text"].alias("text"),
        chosen["confidence"].alias("confidence"),
        (chosen["needs_review"] | (chosen["confidence"] < threshold)).alias("needs_review"),
        F.when(chosen.isNull() & (F.size(issues) == 0), F.array(F.lit("no_recovery_result")))
        .otherwise(issues)
        .alias("issues"),
    )


def resolve_with(
    candidates: DataFrame, resolver: Callable, source: str, rank: int
) -> DataFrame:
    """Run a user's resolver over (asset_id, candidate_id, x0, y0, x1, y1, content).

    ``resolver`` takes a pandas frame of those columns and returns text,
    confidence, usable and needs_review aligned with it; Spark streams Arrow batches.
    """
    schema = (
        ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in candidates.schema if f.name in ("asset_id", "candidate_id"))
        + ", rank int, source string, text string, confidence double, usable boolean, needs_review boolean"
    )

    def run(batches):
        for frame in batches:
            answer = resolver(frame)
            out = frame[["asset_id", "candidate_id"]].copy()
            out["rank"], out["source"] = rank, source
            for name in ("text", "confidence", "usable", "needs_review"):
                out[name] = answer[name].to_numpy()
            yield out

    return candidates.mapInPandas(run, schema)
