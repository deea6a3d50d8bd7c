"""Human review laid over grounded stories, with content fingerprints.

Tables: stories(project_id, status, source_revision, review_source_revision,
approval_source_revision, approval_story_fingerprint, approved), revisions
(project_id, current_revision), events(project_id, event_id, event_ord, summary,
story_role, script_ready, unsupported_claims), claims(project_id, event_id,
claim_ord, text), event_regions(project_id, event_id, asset_id, page_order,
region_id), open_regions(project_id, asset_id, page_order, region_id,
evidence_text), edits(project_id, event_id, text), resolutions(project_id,
asset_id, page_order, region_id, action, text, event_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetrace.functions import text as T
from pagetrace.functions.hashing import canonical_json, set_digest, short_id
from pagetrace.operators.numbering import number_rows

EVENT = ["project_id", "event_id"]
PLACE = ["project_id", "asset_id", "region_id"]

# Fixed values -------------------------------------------------------------
MAX_STORY_TEXT = 2000
ACTIONS = ["added_to_story", "non_story_relevant"]
NO_PLACE = 10**9
# --------------------------------------------------------------------------


def result_status(projects: DataFrame, coverage: DataFrame, events: DataFrame) -> DataFrame:
    """ready when nothing is unresolved and a main event can be used, else partial."""
    main = events.groupBy("project_id").agg(
        F.bool_or((F.col("story_role") == "main_story") & F.col("script_ready")).alias("_main")
    )
    joined = projects.select("project_id").join(coverage.select("project_id", "unresolved_regions"), "project_id", "left").join(main, "project_id", "left")
    ready = (F.col("unresolved_regions") == 0) & F.coalesce("_main", F.lit(False))
    return joined.select("project_id", F.when(ready, "ready").otherwise("partial").alias("status"))


def serialized_status(stories: DataFrame, revisions: DataFrame) -> DataFrame:
    """Stored status, replaced by stale where the sources changed since."""
    joined = stories.join(revisions, "project_id", "left")
    stale = ~F.col("source_revision").eqNullSafe(F.col("current_revision"))
    return joined.select(
        "project_id",
        F.when(stale, "stale").otherwise(F.col("status")).alias("status"),
        F.col("status").alias("story_status"),
        stale.alias("stale"),
    )


def store_results(stored: DataFrame, results: DataFrame) -> DataFrame:
    """Keyed upsert of results(project_id, status, source_revision); an earlier approval is voided."""
    fresh = results.join(stored.select("project_id", "approval_story_fingerprint"), "project_id", "left").withColumn(
        "approval_story_fingerprint",
        F.when(
            F.coalesce("approval_story_fingerprint", F.lit("")) != "",
            F.concat(F.lit("invalidated:"), "approval_story_fingerprint"),
        ),
    )
    return stored.join(results.select("project_id"), "project_id", "left_anti").unionByName(fresh, allowMissingColumns=True)


def freshness(stories: DataFrame, revisions: DataFrame) -> DataFrame:
    """Stories with stale, review_stale and applicable flags."""
    joined = stories.join(revisions, "project_id")
    stale = ~F.col("source_revision").eqNullSafe(F.col("current_revision"))
    review_stale = F.coalesce(F.col("review_source_revision") != F.col("current_revision"), F.lit(False))
    return joined.withColumns({"stale": stale, "review_stale": review_stale, "applicable": ~stale & ~review_stale})


def final_events(
    state: DataFrame, events: DataFrame, event_regions: DataFrame, edits: DataFrame, resolutions: DataFrame
) -> DataFrame:
    """Usable events with edits applied and added events, in source order.

    ``state`` comes from ``freshness``; overlays of a project that is not
    applicable are ignored. Position follows the first cited (page, region).
    """
    live = state.where("applicable").select("project_id")
    edited = edits.join(live, "project_id", "left_semi").select(*EVENT, F.col("text").alias("_edit"))
    safe = events.join(state.select("project_id"), "project_id", "left_semi").where(
        F.coalesce("script_ready", F.lit(False)) & (F.coalesce("unsupported_claims", F.lit(0)) == 0)
    )
    first = event_regions.groupBy(*EVENT).agg(F.min(F.struct("page_order", "region_id")).alias("_at"))
    ai = safe.join(edited, EVENT, "left").join(first, EVENT, "left").select(
        *EVENT,
        F.coalesce("_edit", "summary").alias("summary"),
        F.when(F.col("_edit").isNotNull(), F.col("summary")).alias("ai_original_summary"),
        F.coalesce("story_role", F.lit("main_story")).alias("story_role"),
        F.when(F.col("_edit").isNotNull(), "human_edited").otherwise("ai_grounded").alias("provenance"),
        F.coalesce("_at.page_order", F.lit(NO_PLACE)).cast("long").alias("_page"),
        F.coalesce("_at.region_id", "event_ord").cast("long").alias("_region"),
        F.lit(0).alias("_kind"),
        F.col("event_ord").cast("long").alias("_ord"),
    )
    none = F.lit(None).cast("string")
    added = resolutions.where("action = 'added_to_story'").join(live, "project_id", "left_semi").select(
        *EVENT, F.col("text").alias("summary"), none.alias("ai_original_summary"), F.lit("main_story").alias("story_role"),
        F.lit("human_added").alias("provenance"), F.col("page_order").cast("long").alias("_page"),
        F.col("region_id").cast("long").alias("_region"), F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("_ord"),
    )
    numbered = number_rows(
        ai.unionByName(added), ["project_id"],
        [F.col(c) for c in ("_page", "_region", "_kind", "_ord", "event_id")],
        into="position",
    )
    return numbered.drop("_page", "_region", "_kind", "_ord")


def remaining_regions(state: DataFrame, open_regions: DataFrame, resolutions: DataFrame) -> DataFrame:
    live = state.where("applicable").select("project_id")
    settled = resolutions.join(live, "project_id", "left_semi").select(*PLACE).distinct()
    known = open_regions.join(state.select("project_id"), "project_id", "left_semi")
    return known.join(settled, PLACE, "left_anti")


def final_fingerprints(
    state: DataFrame, ordered: DataFrame, claims: DataFrame, event_regions: DataFrame, resolutions: DataFrame
) -> DataFrame:
    """(project_id, final_story_fingerprint): order, ids, texts, provenance and sources count.

    Built from per-event hashes that carry their position, summed per project, so
    the story is never gathered into one value.
    """
    added = resolutions.where("action = 'added_to_story'").select(*EVENT, "asset_id", "page_order", "region_id")
    cited = event_regions.select(*EVENT, "asset_id", "page_order", "region_id").unionByName(added).distinct()
    row = F.sha2(canonical_json(**{c: F.col(c) for c in ("asset_id", "page_order", "region_id")}), 256)
    a, b, c = set_digest(F.col("_h"))
    sources = cited.select(*EVENT, row.alias("_h")).groupBy(*EVENT).agg(
        F.concat_ws("-", a.cast("string"), b.cast("string"), c.cast("string")).alias("_sources")
    )
    said = claims.groupBy(*EVENT).agg(F.array_sort(F.collect_list(F.struct("claim_ord", "text"))).alias("_claims"))
    text = F.coalesce(
        F.nullif("summary", F.lit("")), F.array_join(F.transform("_claims", lambda x: x["text"]), " "), F.lit("")
    )
    joined = ordered.join(sources, EVENT, "left").join(said, EVENT, "left")
    hashed = joined.select(
        "project_id",
        F.sha2(
            canonical_json(
                position=F.col("position"), id=F.col("event_id"), text=text,
                provenance=F.col("provenance"), sources=F.coalesce("_sources", F.lit("")),
            ),
            256,
        ).alias("_h"),
    )
    body = hashed.groupBy("project_id").agg(
        F.concat_ws("-", a.cast("string"), b.cast("string"), c.cast("string")).alias("_events")
    )
    whole = canonical_json(
        source_revision=F.col("current_revision"), events=F.coalesce("_events", F.lit(""))
    )
    return state.select("project_id", "current_revision").join(body, "project_id", "left").select(
        "project_id", F.sha2(whole, 256).alias("final_story_fingerprint")
    )


def review_states(
    state: DataFrame, open_regions: DataFrame, resolutions: DataFrame, edits: DataFrame, fingerprints: DataFrame
) -> DataFrame:
    """Per project: review status, counts, readiness and approval."""
    live = state.where("applicable").select("project_id")
    total = open_regions.groupBy("project_id").agg(F.count_distinct("asset_id", "region_id").alias("unresolved_total"))
    left = remaining_regions(state, open_regions, resolutions).groupBy("project_id").agg(
        F.count(F.lit(1)).alias("unresolved_remaining"), F.count_distinct("asset_id", "region_id").alias("_left_keys")
    )
    edited = edits.join(live, "project_id", "left_semi").select("project_id").distinct().withColumn("_edited", F.lit(True))
    counts = ["unresolved_total", "unresolved_remaining", "_left_keys"]
    joined = (
        state.join(total, "project_id", "left")
        .join(left, "project_id", "left")
        .join(edited, "project_id", "left")
        .join(fingerprints, "project_id")
        .fillna(0, subset=counts)
    )
    resolved = F.col("unresolved_total") - F.col("_left_keys")
    complete = F.col("applicable") & (F.col("unresolved_remaining") == 0) & (
        F.col("review_source_revision").isNotNull() | (F.col("unresolved_total") == 0)
    )
    fresh = ~F.col("stale") & ~F.col("review_stale")
    ready = ((F.col("status") == "ready") & ~F.col("stale")) | complete
    approved = (
        ready & fresh
        & F.coalesce(F.col("approval_source_revision") == F.col("current_revision"), F.lit(False))
        & F.coalesce(F.col("approval_story_fingerprint") == F.col("final_story_fingerprint"), F.lit(False))
    )
    present = F.col("approved") & (F.coalesce("approval_story_fingerprint", F.lit("")) != "")
    return joined.select(
        "project_id",
        F.when(~fresh, "stale")
        .when(complete, "reviewed")
        .when((resolved > 0) | F.coalesce("_edited", F.lit(False)), "in_progress")
        .otherwise("none")
        .alias("review_status"),
        (~fresh).alias("stale"),
        resolved.alias("resolved_by_human"),
        "unresolved_total",
        "unresolved_remaining",
        complete.alias("review_complete"),
        (ready & fresh).alias("final_story_ready"),
        approved.alias("story_approved"),
        (F.coalesce(present, F.lit(False)) & ~approved).alias("approval_invalidated"),
        "final_story_fingerprint",
    )


def compose_review(
    stories: DataFrame, revisions: DataFrame, events: DataFrame, claims: DataFrame, event_regions: DataFrame,
    open_regions: DataFrame, edits: DataFrame, resolutions: DataFrame,
) -> dict[str, DataFrame]:
    state = freshness(stories, revisions)
    ordered = final_events(state, events, event_regions, edits, resolutions)
    prints = final_fingerprints(state, ordered, claims, event_regions, resolutions)
    return {
        "events": ordered,
        "remaining": remaining_regions(state, open_regions, resolutions),
        "states": review_states(state, open_regions, resolutions, edits, prints),
    }


def _text_problem(text: Column, longest: int) -> Column:
    value = T.strip(F.coalesce(text, F.lit("")))
    return F.when(value == "", "empty_text").when(F.length(value) > longest, "text_too_long")


def _revision_problem(requested: Column) -> Column:
    current = F.col("current_revision")
    wrong = ~requested.eqNullSafe(current) | ~F.col("source_revision").eqNullSafe(current)
    older = F.coalesce(F.col("review_source_revision") != current, F.lit(False))
    return F.when(wrong, "sources_changed").when(older, "older_review")


def apply_edits(
    requests: DataFrame, stories: DataFrame, revisions: DataFrame, events: DataFrame, resolutions: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(judged requests, resolutions with new texts) of requests(project_id, seq, event_id, text, revision).

    Accepted rows have no ``reject``; ``target`` says whether the edit goes to an
    added event or to an analysed one. Of repeated edits the highest seq counts.
    """
    state = stories.join(revisions, "project_id").select(
        "project_id", "current_revision", "source_revision", "review_source_revision"
    )
    human = resolutions.where("action = 'added_to_story'").select(*EVENT).withColumn("_human", F.lit(True))
    safe = events.where(
        F.coalesce("script_ready", F.lit(False)) & (F.coalesce("unsupported_claims", F.lit(0)) == 0)
    ).select(*EVENT, F.lit(True).alias("_safe"))
    joined = requests.join(state, "project_id", "left").join(human, EVENT, "left").join(safe, EVENT, "left")
    reject = F.coalesce(
        _revision_problem(F.col("revision")),
        F.when(F.col("_human").isNull() & F.col("_safe").isNull(), F.lit("event_not_found")),
        _text_problem(F.col("text"), MAX_STORY_TEXT),
    )
    judged = joined.select(
        *requests.columns, reject.alias("reject"), F.when(F.col("_human"), "resolution").otherwise("event").alias("target")
    )
    newest = judged.where("reject IS NULL AND target = 'resolution'").groupBy(*EVENT).agg(
        F.max_by(T.strip(F.col("text")), F.col("seq")).alias("_text")
    )
    updated = resolutions.join(newest, EVENT, "left").withColumn("text", F.coalesce("_text", "text")).drop("_text")
    return judged, updated.select(*resolutions.columns)


def apply_resolutions(
    requests: DataFrame, stories: DataFrame, revisions: DataFrame, open_regions: DataFrame, stored: DataFrame
) -> DataFrame:
    """Judge requests(project_id, seq, asset_id, region_id, action, text, revision).

    One resolution per region: a stored one, or the first sound request of the
    batch, rejects the others. Accepted added events get a derived id.
    """
    state = stories.join(revisions, "project_id").select(
        "project_id", "current_revision", "source_revision", "review_source_revision"
    )
    known = open_regions.groupBy(*PLACE).agg(
        F.first("page_order").alias("page_order"), F.first("evidence_text").alias("evidence_text")
    )
    done = stored.select(*PLACE).distinct().withColumn("_done", F.lit(True))
    joined = requests.join(known, PLACE, "left").join(state, "project_id", "left").join(done, PLACE, "left")
    added = F.col("action") == "added_to_story"
    reject = F.coalesce(
        F.when(F.col("page_order").isNull(), F.lit("evidence_not_found")),
        _revision_problem(F.col("revision")),
        F.when(F.col("_done"), F.lit("already_reviewed")),
        F.when(added, _text_problem(F.col("text"), MAX_STORY_TEXT)).when(
            ~F.coalesce(F.col("action").isin(ACTIONS), F.lit(False)), "unsupported_action"
        ),
    )
    judged = joined.withColumn("reject", reject)
    first = judged.where("reject IS NULL").groupBy(*PLACE).agg(F.min("seq").alias("_first"))
    settled = judged.join(first, PLACE, "left").withColumn(
        "reject", F.when(F.col("reject").isNull() & (F.col("seq") > F.col("_first")), "already_reviewed").otherwise(F.col("reject"))
    )
    identity = short_id("human-event-", "|", 16, F.col("project_id"), F.col("current_revision"), F.col("asset_id"), F.col("region_id"))
    taken = F.col("reject").isNull() & added
    return settled.select(
        "project_id", "seq", "asset_id", "region_id", "page_order", "evidence_text", "action",
        F.when(taken, T.strip(F.col("text"))).alias("text"),
        F.when(taken, identity).alias("event_id"),
        "reject",
    )


def approve_stories(stories: DataFrame, states: DataFrame, requested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stories with approvals, rejected requests): only complete, current, ready reviews pass."""
    judged = requested.select("project_id").distinct().join(states, "project_id", "left")
    fine = F.coalesce(
        F.col("story_approved")
        | (~F.col("stale") & F.col("final_story_ready") & F.col("review_complete") & (F.col("unresolved_remaining") == 0)),
        F.lit(False),
    )
    passed = judged.where(fine).select("project_id", F.col("final_story_fingerprint").alias("_print"))
    updated = stories.join(passed, "project_id", "left").withColumns(
        {
            "approved": F.col("approved") | F.col("_print").isNotNull(),
            "approval_source_revision": F.when(F.col("_print").isNotNull(), F.col("source_revision")).otherwise(F.col("approval_source_revision")),
            "approval_story_fingerprint": F.coalesce("_print", "approval_story_fingerprint"),
        }
    ).drop("_print")
    return updated, judged.where(~fine).select("project_id", F.lit("not_ready_for_approval").alias("reject"))
