"""Page dataflows: from blocks and layout to settled dialogues."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetrace.functions import text as T
from pagetrace.operators import dialogue as D


def settle_dialogues(
    dialogues: DataFrame,
    corrections: DataFrame,
    recoveries: DataFrame,
    truth: DataFrame,
    regions: DataFrame,
    similarity: Callable[[Column, Column], Column] = T.similarity_levenshtein,
) -> DataFrame:
    """Screen, correct, score, decide, recover, overlay truth, gate review.

    ``corrections(asset_id, region_id, clean_text, confidence, needs_review,
    reason_code)`` holds the decoded model answers; ``decode_compact`` makes them
    per (asset, batch), so a bad answer about recovered regions cannot touch the
    trusted ones. Every step is row- or region-local after that.
    """
    screened = D.screen(dialogues, truth)
    answers = corrections.select(
        *D.REGION,
        F.col("clean_text").alias("_text"),
        F.col("confidence").alias("_confidence"),
        F.col("needs_review").alias("_review"),
        F.col("reason_code").alias("_code"),
    )
    joined = screened.join(answers, D.REGION, "left")
    open_row = F.col("correction_path") == "uncertain"
    corrected = joined.select(
        *[c for c in screened.columns if c not in ("clean_text", "confidence", "needs_review", "reason", "correction_path")],
        F.when(open_row, F.coalesce("_text", "raw_text")).otherwise(F.col("clean_text")).alias("clean_text"),
        F.when(open_row, F.coalesce("_confidence", F.lit(0.0))).otherwise(F.col("confidence")).alias("confidence"),
        F.when(open_row, F.coalesce("_review", F.lit(True))).otherwise(F.col("needs_review")).alias("needs_review"),
        F.when(open_row, F.coalesce("_code", F.lit("needs_review"))).alias("reason_code"),
        F.when(open_row, F.coalesce("_code", F.lit("needs_review"))).otherwise(F.col("reason")).alias("reason"),
        F.when(open_row, "model").otherwise(F.col("correction_path")).alias("correction_path"),
    )
    decided = D.decide(D.score(corrected, similarity))
    recovered = D.recover(decided, recoveries)
    overlaid = D.apply_truth(recovered, truth)
    return D.gate_recovered_regions(overlaid, regions)


def layout_quality(
    pages: DataFrame, blocks: DataFrame, boxes: DataFrame, regions: DataFrame, region_blocks: DataFrame,
    order: DataFrame, candidates: DataFrame, attempts: DataFrame,
) -> dict[str, DataFrame]:
    """Check assignments, split merged regions, add recovered text regions in reading order.

    candidates(asset_id, candidate_id, x0, y0, x1, y1, core_x0.., confidence) come
    from ``text_candidates``; attempts(asset_id, candidate_id, rank, ..) from the
    resolvers. Only pages with a sound assignment are changed. What comes back can go
    on to ``build_dialogues`` and ``settle_dialogues``: ``regions`` keep their columns through
    a split and tell of a recovered one its candidate, confidence and review flag;
    ``blocks`` holds the recovered texts as blocks of their own with their boxes.
    """
    from pagetrace.operators import layout as L
    from pagetrace.operators.numbering import number_rows
    from pagetrace.session import cut

    validity = L.page_validity(L.assignment(blocks, region_blocks))
    sound = cut(validity.where("is_valid").select("asset_id"))

    def of_sound(rows: DataFrame) -> DataFrame:
        return rows.join(sound, "asset_id", "left_semi")

    split = L.split_regions(of_sound(regions), of_sound(region_blocks), boxes, of_sound(order))
    free = L.uncovered_candidates(of_sound(candidates), boxes, "core_")
    kept = L.distinct_candidates(free).drop("confidence")
    named = kept.join(free.groupBy("asset_id", *L.SIDES).agg(F.min("candidate_id").alias("candidate_id")), ["asset_id", *L.SIDES])
    found = D.rank_attempts(attempts, candidates=candidates).where("resolved").join(named, ["asset_id", "candidate_id"])
    numbered = number_rows(
        found, ["asset_id"], [F.col("y0"), F.col("x0"), F.col("candidate_id")], into="seq", bucket=F.floor(F.col("y0") / 256)
    )
    last_region = split["regions"].groupBy("asset_id").agg(F.max("region_id").alias("_region"))
    last_block = blocks.groupBy("asset_id").agg(F.max("block_id").alias("_block"))
    added = cut(
        numbered.join(last_region, "asset_id", "left")
        .join(last_block, "asset_id", "left")
        .withColumn("region_id", F.coalesce("_region", F.lit(0)) + F.col("seq"))
        .withColumn("block_id", F.coalesce("_block", F.lit(-1)) + F.col("seq"))
        .drop("_region", "_block")
    )
    centres = D.region_boxes(split["region_blocks"], boxes).select("asset_id", "region_id", "center_x", "center_y")
    placed = L.insert_by_position(split["reading_order"], centres, added.select("asset_id", "seq", "region_id", *L.SIDES))
    new_regions = added.select(
        "asset_id", "region_id", F.lit("speech_bubble").alias("type"), "region_source", "candidate_id",
        F.col("confidence").alias("recovery_confidence"), "needs_review",
    )
    all_regions = split["regions"].drop("cluster").unionByName(new_regions, allowMissingColumns=True)
    new_blocks = added.select("asset_id", "block_id", "text", "confidence", *L.SIDES, F.col("region_source").alias("source"), "needs_review", "candidate_id")
    last_place = F.lit(0).cast("long").alias("pos")
    return {
        "validity": validity,
        "no_dialogue": L.no_dialogue_pages(pages, blocks, regions, order),
        "regions": all_regions,
        "recovered": added,
        "blocks": blocks.unionByName(new_blocks, allowMissingColumns=True),
        "region_blocks": split["region_blocks"].withColumn("pos", F.col("block_id").cast("long")).unionByName(
            added.select("asset_id", "region_id", "block_id", last_place)
        ),
        "split_sources": split["split_sources"],
        "reading_order": placed,
        "order_check": L.valid_reading_order(all_regions, placed),
    }


def placed_quality(
    pages: DataFrame, placed: DataFrame, candidates: DataFrame, attempts: DataFrame, large: DataFrame | None
) -> dict[str, DataFrame]:
    """``layout_quality`` of pages whose blocks are all cited and bring their boxes: regions, reading_order, order_check, no_dialogue.

    placed(asset_id, region_id, block_id, x0, y0, x1, y1, confidence); the regions are those cited, region n at place n - 1
    of the reading order. ``large`` names the pages of too many rows for a list, None for none; they go the way of
    ``layout_quality``, the others as lists in one Arrow stage. Inputs dealt by page over one number of tasks are not dealt again.
    """
    from pagetrace.operators import layout as L

    def listed(rows: DataFrame, name: str, *fields: str) -> DataFrame:
        return rows.groupBy("asset_id").agg(F.collect_list(F.struct(*fields)).alias(name))

    def quality(placed: DataFrame, candidates: DataFrame, attempts: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
        whole = listed(placed, "cited", "region_id", "block_id", *L.SIDES, "confidence")
        blocks = F.transform("cited", lambda c: c["block_id"])
        sound = F.col("asset_id").isNotNull() & F.forall(blocks, lambda b: b.isNotNull()) & (F.size(F.array_distinct(blocks)) == F.size(blocks))
        found = listed(candidates, "candidates", "candidate_id", *L.SIDES, *[f"core_{s}" for s in L.SIDES], "confidence")
        read = listed(D.rank_attempts(attempts).where("resolved"), "read", "candidate_id", "region_source", "confidence", "needs_review")
        once = F.array_distinct(F.transform("cited", lambda c: F.struct(c["block_id"].alias("id"), c["confidence"].alias("sure"))))
        unsure = F.filter(once, lambda b: F.coalesce(b["sure"], F.lit(0.0)) < L.LOW_CONFIDENCE)
        shares = whole.select("asset_id", (F.size(unsure) / F.size(once)).alias("_share"))
        return L.repair_small(whole.where(sound).join(found, "asset_id", "left").join(read, "asset_id", "left")), shares

    if large is None:
        out, shares = quality(placed, candidates, attempts)
    else:
        out, shares = quality(*[rows.join(large, "asset_id", "left_anti") for rows in (placed, candidates, attempts)])
        hot, *others = [rows.join(large, "asset_id", "left_semi") for rows in (placed, candidates, attempts)]
        cited = hot.select("asset_id", "region_id", "block_id")
        regions = cited.select("asset_id", "region_id").distinct()
        order = regions.select("asset_id", (F.col("region_id") - 1).alias("pos"), "region_id")
        blocks = hot.select("asset_id", "block_id", F.lit(None).cast("string").alias("text"), *L.SIDES, "confidence").dropDuplicates(["asset_id", "block_id"])
        rest = layout_quality(large, blocks, blocks, regions, cited, order, *others)
        out = {name: rows.unionByName(rest[name]) for name, rows in out.items()}
        low = F.avg((F.coalesce("confidence", F.lit(0.0)) < L.LOW_CONFIDENCE).cast("double"))
        shares = shares.unionByName(blocks.groupBy("asset_id").agg(low.alias("_share")))
    share = F.coalesce("_share", F.lit(1.0))
    known = pages.select("asset_id").join(shares, "asset_id", "left")
    out["no_dialogue"] = known.select(
        "asset_id", share.alias("low_confidence_share"), (F.col("_share").isNull() & (share >= L.NO_DIALOGUE_SHARE)).alias("no_dialogue")
    )
    return out
