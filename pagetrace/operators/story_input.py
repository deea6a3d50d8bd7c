"""From stored pages with JSON columns to authoritative evidence rows.

Input: assets(project_id, asset_id, page_order, status, vision_status,
dialogue_status, dialogues, vision_regions); the last two are JSON text. Output
stays flat: one row per project, page, dialogue and issue.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType

from pagetrace.functions import text as T
from pagetrace.functions.json import json_list, kind, positive_int, text_field, true_field
from pagetrace.session import cut

# Fixed values -------------------------------------------------------------
CONTRACT_VERSION = "story_input.v1"
SUPPORTED_DECISIONS = ["auto_accepted", "auto_recovered", "verified"]
# --------------------------------------------------------------------------


@F.arrow_udf(ArrayType(StringType()))
def _types_by_region(listed: pa.Array, refs: pa.Array) -> pa.Array:
    """For every reference of a page the type listed for its region; pages of a batch are searched at once."""

    def flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        rows = lists.flatten()
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        return rows, sizes, np.repeat(np.arange(len(lists)), sizes)

    rows, _, page = flat(listed)
    kinds = rows.field("type")
    valid = np.flatnonzero(np.asarray(rows.field("region_id").is_valid()) & np.asarray(kinds.is_valid()))
    wanted, sizes, own = flat(refs)
    ids, sought = (x.field("region_id").fill_null(0).to_numpy(zero_copy_only=False) for x in (rows, wanted))
    # Ids are above zero; the number of an id stands for it, so that page and id make one key.
    names, number = np.unique(np.concatenate([ids[valid], sought]), return_inverse=True)
    known, asked = page[valid] * len(names) + number[: len(valid)], own * len(names) + number[len(valid):]
    order = np.argsort(known, kind="stable")
    # The last one of a repeated id.
    last = np.searchsorted(known[order], asked, "right") - 1
    hit = (last >= 0) & (sought > 0)
    hit[hit] = known[order[last[hit]]] == asked[hit]
    index = np.zeros(len(asked), dtype=np.int64)
    index[hit] = valid[order[last[hit]]]
    found = kinds.take(pa.array(index, mask=~hit))
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, found)


def region_types(regions: Column, refs: Column) -> Column:
    """Types of the regions that ``refs`` name, from the page's own JSON list ``regions``; the last valid entry of a repeated id wins.

    Both lists lie in the page's row, so they meet there and no table of all regions is joined.
    """
    listed = F.transform(
        json_list(regions),
        lambda r: F.named_struct(F.lit("region_id"), positive_int(r, "id"), F.lit("type"), text_field(r, "type")),
    )
    return _types_by_region(listed, refs)


@F.arrow_udf(ArrayType(BooleanType()))
def _repeats_in_order(regions: pa.Array, orders: pa.Array) -> pa.Array:
    """Linear in a page's entries; NULL lists, those of pages without a repeat, stay NULL."""

    def flags(own: list, places: list) -> list[bool]:
        seen, taken, out = set(), set(), []
        for region, place in zip(own, places, strict=True):
            usable = region is not None and place is not None
            repeat = usable and (region in seen or place in taken)
            if usable and not repeat:
                seen.add(region)
                taken.add(place)
            out.append(repeat)
        return out

    rows = zip(regions.to_pylist(), orders.to_pylist(), strict=True)
    return pa.array([None if own is None else flags(own, places) for own, places in rows], pa.list_(pa.bool_()))


def _repeat_flags(rows: Column) -> Column:
    """Which references repeat an earlier accepted one (region or order).

    Only accepted rows count as seen, so entries are taken in order; pages without
    any repeat are told apart before and send nothing to Python.
    """
    valid = F.filter(rows, lambda r: r["region_id"].isNotNull() & r["ord"].isNotNull())
    clean = (F.size(F.array_distinct(F.transform(valid, lambda r: r["region_id"]))) == F.size(valid)) & (
        F.size(F.array_distinct(F.transform(valid, lambda r: r["ord"]))) == F.size(valid)
    )
    regions = F.when(~clean, F.transform(rows, lambda r: r["region_id"]))
    orders = F.when(~clean, F.transform(rows, lambda r: r["ord"]))
    return F.coalesce(_repeats_in_order(regions, orders), F.transform(rows, lambda r: F.lit(False)))


def decode_pages(pages: DataFrame) -> DataFrame:
    """One typed row per dialogue entry; an unusable list leaves one row flagged so.

    The list is parsed once below the explode; fields are read from each entry above it.
    """
    parsed = pages.withColumn("_items", json_list(F.col("dialogues")))
    objects = F.forall("_items", lambda i: kind(i).startswith("OBJECT"))
    checked = parsed.withColumn("_usable", F.coalesce((F.size("_items") > 0) & objects, F.lit(False)))
    refs = F.transform(
        "_items",
        lambda i: F.named_struct(
            F.lit("region_id"), positive_int(i, "region_id"), F.lit("ord"), positive_int(i, "order")
        ),
    )
    refs = checked.withColumn("_refs", refs)
    flagged = refs.withColumn("_repeats", _repeat_flags(F.col("_refs")))
    flagged = flagged.withColumn("_types", region_types(F.col("vision_regions"), F.col("_refs")))
    entries = F.when(F.col("_usable"), F.arrays_zip("_items", "_repeats", "_types"))
    exploded = flagged.withColumn("_entries", entries).select(
        "project_id", "asset_id", "page_order", "_usable", F.posexplode_outer("_entries").alias("idx", "_e")
    )
    item = F.col("_e._items")
    return exploded.select(
        "project_id", "asset_id", "page_order", "idx",
        (~F.col("_usable")).alias("unusable"),
        F.col("_e._repeats").alias("repeated"),
        positive_int(item, "region_id").alias("region_id"),
        positive_int(item, "order").alias("ord"),
        text_field(item, "decision").alias("decision"),
        text_field(item, "verified_text").alias("verified_text"),
        true_field(item, "human_verified").alias("human_verified"),
        text_field(item, "recovered_text").alias("recovered_text"),
        text_field(item, "clean_text").alias("clean_text"),
        F.col("_e._types").alias("region_type"),
    )


def page_states(assets: DataFrame) -> DataFrame:
    """Pages with the code that stops them (NULL when usable) and the repeated-order flag."""
    live = assets.where("status <> 'excluded'")
    first = live.groupBy("project_id", "page_order").agg(
        F.min(F.col("asset_id").cast("string")).alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    joined = assets.join(first.where("_n > 1"), ["project_id", "page_order"], "left")
    code = (
        F.when(F.col("status") == "excluded", "asset_excluded")
        .when(~F.col("status").eqNullSafe(F.lit("ready")), "asset_not_ready")
        .when(F.col("vision_status") == "no_dialogue", F.lit(None))
        .when(~F.col("vision_status").eqNullSafe(F.lit("completed")), "vision_not_ready")
        .when(F.col("dialogue_status") == "needs_review", "dialogue_review_required")
        .when(~F.col("dialogue_status").eqNullSafe(F.lit("completed")), "dialogue_not_ready")
    )
    repeated = (F.col("status") != "excluded") & (F.col("asset_id").cast("string") != F.col("_first"))
    return joined.select(
        *assets.columns, code.alias("stop_code"), F.coalesce(repeated, F.lit(False)).alias("repeated_order")
    )


def dialogue_rows(pages: DataFrame) -> DataFrame:
    """One row per dialogue of the pages that reach decoding, with its own code."""
    reached = pages.where("stop_code IS NULL AND vision_status = 'completed'")
    typed = decode_pages(reached)
    row = {n: F.col(n) for n in ("decision", "human_verified", "verified_text", "recovered_text", "clean_text")}
    final = typed.withColumn("_final", T.authoritative_text(row)).withColumn("final_text", F.col("_final.text"))
    final = final.withColumn("_note", T.note_position(F.col("final_text")))
    text = F.col("final_text")
    code = (
        F.when(F.col("unusable"), "invalid_dialogues")
        .when(F.col("region_id").isNull() | F.col("ord").isNull(), "invalid_dialogue_reference")
        .when(F.col("repeated"), "duplicate_dialogue_reference")
        .when(~F.coalesce(F.col("decision").isin(SUPPORTED_DECISIONS), F.lit(False)), "unsupported_dialogue_decision")
        .when(text.isNull(), "missing_authoritative_text")
    )
    return final.select(
        "project_id", "asset_id", "page_order", "idx", "region_id", "ord", "decision",
        "final_text", F.col("_final.source").alias("text_source"),
        T.evidence_text(text, F.col("_note")).alias("evidence_text"),
        T.excluded_text(text, F.col("_note")).alias("excluded_text"),
        T.text_role(text, F.col("region_type"), F.col("_note")).alias("text_role"),
        code.alias("code"),
    )


def build_story_input(projects: DataFrame, assets: DataFrame) -> dict[str, DataFrame]:
    """projects(status, summary counts), pages, evidence and issues.

    One blocking issue blocks its whole project: it keeps its issues but yields no
    pages and no evidence. Excluded pages only warn.
    """
    pages = page_states(assets)
    # Issues, evidence and counts all read the decoded rows: the JSON is parsed once.
    dialogues = cut(dialogue_rows(pages))
    place = ["project_id", "asset_id", "page_order"]
    none = F.lit(None).cast("long").alias("region_id")
    with_region = F.col("code").isin("unsupported_dialogue_decision", "missing_authoritative_text")
    issues = (
        pages.where("stop_code IS NOT NULL").select(*place, none, F.col("stop_code").alias("code"))
        .unionByName(pages.where("repeated_order").select(*place, none, F.lit("duplicate_page_order").alias("code")))
        .unionByName(
            dialogues.where("code IS NOT NULL").select(
                *place, F.when(with_region, F.col("region_id")).alias("region_id"), "code"
            )
        )
        .withColumn("severity", F.when(F.col("code") == "asset_excluded", "warning").otherwise("error"))
    )
    blocked = issues.where("severity = 'error'").select("project_id").distinct()
    kept = pages.where("stop_code IS NULL").select(
        *place, F.when(F.col("vision_status") == "no_dialogue", "no_dialogue").otherwise("dialogue").alias("page_type")
    ).join(blocked, "project_id", "left_anti")
    evidence = dialogues.where("code IS NULL").drop("code", "idx").join(blocked, "project_id", "left_anti")

    totals = assets.groupBy("project_id").agg(F.count(F.lit(1)).alias("total_assets"))
    page_counts = kept.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("source_pages"),
        F.count_if(F.col("page_type") == "dialogue").alias("dialogue_pages"),
        F.count_if(F.col("page_type") == "no_dialogue").alias("no_dialogue_pages"),
    )
    dialogue_counts = evidence.groupBy("project_id").agg(F.count(F.lit(1)).alias("dialogue_count"))
    counts = ["total_assets", "source_pages", "dialogue_pages", "no_dialogue_pages", "dialogue_count"]
    summary = (
        projects.select("project_id").distinct()
        .join(totals, "project_id", "left")
        .join(blocked.withColumn("_blocked", F.lit(True)), "project_id", "left")
        .join(page_counts, "project_id", "left")
        .join(dialogue_counts, "project_id", "left")
        .fillna(0, subset=counts)
        .select(
            "project_id",
            F.when(F.col("total_assets") == 0, "empty").when(F.col("_blocked"), "blocked").otherwise("ready").alias("status"),
            *counts,
        )
    )
    empty = summary.where("status = 'empty'").select(
        "project_id",
        F.lit(None).cast(assets.schema["asset_id"].dataType).alias("asset_id"),
        F.lit(None).cast(assets.schema["page_order"].dataType).alias("page_order"),
        none,
        F.lit("project_has_no_assets").alias("code"),
        F.lit("error").alias("severity"),
    )
    return {"projects": summary, "pages": kept, "evidence": evidence, "issues": issues.unionByName(empty)}


def unknown_projects(requested: DataFrame, projects: DataFrame) -> DataFrame:
    """Requested ids without a project, as blocked rows."""
    missing = requested.select("project_id").distinct().join(projects, "project_id", "left_anti")
    return missing.select("project_id", F.lit("blocked").alias("status"), F.lit("project_not_found").alias("code"))


def sorted_issues(issues: DataFrame) -> DataFrame:
    """Issue order: page, asset, region, with missing values first; by code where these are equal, so that no order is open."""
    return issues.orderBy(
        "project_id",
        F.coalesce("page_order", F.lit(0)),
        F.coalesce(F.col("asset_id").cast("string"), F.lit("")),
        F.coalesce("region_id", F.lit(0)),
        "code",
    )


def source_revision(summary: DataFrame, pages: DataFrame, evidence: DataFrame) -> DataFrame:
    """Content revision per project: equal content in any row order gives an equal hash.

    Rows are hashed one by one and summed, so no project is gathered in one place.
    """
    from pagetrace.functions.hashing import canonical_json, set_digest

    def digest(rows: DataFrame, fields: list[str], name: str) -> DataFrame:
        hashed = rows.select("project_id", F.sha2(canonical_json(**{f: F.col(f) for f in fields}), 256).alias("_h"))
        a, b, c = set_digest(F.col("_h"))
        return hashed.groupBy("project_id").agg(
            F.concat_ws("-", a.cast("string"), b.cast("string"), c.cast("string")).alias(name)
        )

    page_part = digest(pages, ["asset_id", "page_order", "page_type"], "_pages")
    fields = ["asset_id", "page_order", "region_id", "ord", "final_text", "evidence_text", "excluded_text", "text_role", "text_source", "decision"]
    text_part = digest(evidence, fields, "_evidence")
    joined = summary.join(page_part, "project_id", "left").join(text_part, "project_id", "left")
    body = canonical_json(
        contract_version=F.lit(CONTRACT_VERSION), project_id=F.col("project_id"), status=F.col("status"),
        pages=F.coalesce("_pages", F.lit("")), evidence=F.coalesce("_evidence", F.lit("")),
    )
    return joined.select("project_id", F.sha2(body, 256).alias("source_revision"))
