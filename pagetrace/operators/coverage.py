"""Which evidence a story covers, and what happens to the regions it leaves out.

Works on evidence(project_id, asset_id, page_order, region_id, ord,
evidence_text, text_role) and the grounded regions and claims of
``operators.grounding``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagetrace.functions import text as T
from pagetrace.functions.numeric import round_exact
from pagetrace.operators import grounding as G
from pagetrace.operators.numbering import number_rows
from pagetrace.session import cut

REFERENCE = ["asset_id", "page_order", "region_id"]
KEY = ["project_id", *REFERENCE]
#: Claims of a project up to which a token is rare; signatures that meet in a task, and at once inside it.
HOT = 64
TILE = 4096
STEP = 256

# Fixed values -------------------------------------------------------------
NON_STORY_CODES = [
    "standalone_label", "repeated_information", "non_story_ui", "greeting_or_filler",
    "sfx_or_annotation", "redundant_context", "no_factual_story_content",
]
UI_WORDS = ["system", "achievement", "unlocked", "level", "hp", "mp"]
BACKEND_FIELDS = ["asset_id", "page_order", "region_id", "event_id", "source", "sources"]
EQUIVALENT_OVERLAP = 0.8
SEMANTIC_REJECTIONS = [
    "incompatible_non_story_reason_code", "unsafe_fixed_slot_event", "fixed_slot_claim_not_anchored_to_evidence",
]
# --------------------------------------------------------------------------


def valid_reference(asset: str = "asset_id", page: str = "page_order", region: str = "region_id") -> Column:
    return F.col(asset).isNotNull() & F.col(page).isNotNull() & F.col(region).isNotNull()


def covered_regions(evidence: DataFrame, grounded: DataFrame, non_story: DataFrame | None = None) -> DataFrame:
    """Evidence with ``category``, ``covered`` and ``marked`` (set aside as not story)."""
    cited = grounded.select(*KEY).distinct().withColumn("_cited", F.lit(True))
    joined = evidence.join(cited, KEY, "left")
    category = T.role_category(F.col("text_role"))
    marked = (category == "primary") & T.name_only(F.col("evidence_text"))
    if non_story is not None:
        asides = non_story.where(valid_reference()).select(*KEY).distinct().withColumn("_aside", F.lit(True))
        joined = joined.join(asides, KEY, "left")
        marked = marked | F.coalesce("_aside", F.lit(False))
    return joined.select(
        *evidence.columns,
        category.alias("category"),
        F.coalesce("_cited", F.lit(False)).alias("covered"),
        marked.alias("marked"),
    )


def uncovered_important(regions: DataFrame) -> DataFrame:
    return regions.where((F.col("category") == "primary") & ~F.col("covered") & ~F.col("marked"))


def coverage_report(regions: DataFrame) -> DataFrame:
    """Counts per project; the score is resolved over important regions, 1.0 without any."""
    eligible = F.col("category") != "excluded"
    primary = F.col("category") == "primary"
    covered, marked = F.col("covered"), F.col("marked")
    counts = regions.groupBy("project_id").agg(
        F.count_if(eligible).alias("eligible_regions"),
        F.count_if(primary).alias("important_regions"),
        F.count_if(eligible & covered & ~marked).alias("covered_regions"),
        F.count_if(eligible & marked).alias("non_story_relevant_regions"),
        F.count_if(primary & ~covered & ~marked).alias("unresolved_regions"),
        F.count_if((F.col("category") == "context") & ~covered).alias("optional_context_regions"),
        F.count_if(primary & (covered | marked)).alias("_resolved"),
    )
    important = F.nullif("important_regions", F.lit(0)).cast("double")
    rate = F.coalesce(F.col("_resolved").cast("double") / important, F.lit(1.0))
    return (
        counts.withColumn("_rate", rate)
        .withColumn("coverage_score", round_exact(F.col("_rate"), 4))
        .drop("_resolved", "_rate")
    )


def nearby_context(evidence: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows at most one order step from a target on the same page; no pairs are formed."""
    orders = evidence.select(*KEY, "ord")
    placed = targets.select(*KEY).join(orders, KEY, "left").withColumn("_o", F.coalesce("ord", "region_id"))
    around = placed.select(
        "project_id", "asset_id", "page_order", F.explode(F.array(F.col("_o") - 1, F.col("_o"), F.col("_o") + 1)).alias("ord")
    ).distinct()
    return evidence.join(around, ["project_id", "asset_id", "page_order", "ord"], "left_semi")


def closest_claims(regions: DataFrame, claims: DataFrame, key: Sequence[str], hot: int = HOT) -> DataFrame:
    """For every region the first claim with the greatest share of the region's tokens.

    regions(project_id, key.., tokens), claims(project_id, claim_ord, text, tokens);
    returns (key.., closest_text, overlap), NULL and 0.0 without a shared token.

    Equal token sets are compared once. A pair that shares a rare token (held by at
    most ``hot`` claims) is found by joining the rare tokens, so a region meets at most
    ``hot`` claims a token. Frequent tokens, numbered within their project, are bits of a
    signature: pairs that share only those are looked for among the distinct signatures,
    in tiles, where a region leaves as soon as no signature left can hold more of its
    tokens. Pairs carry ids and numbers; the text is joined to the winners.
    """
    key = list(key)
    ordered = F.array_sort(F.array_distinct("tokens")).alias("tokens")
    sets = regions.select("project_id", ordered).where(F.size("tokens") > 0).distinct()
    sets = cut(sets.withColumn("set_id", F.sha2(F.array_join("tokens", " "), 256)))
    bags = cut(claims.select("project_id", "claim_ord", ordered).where(F.size("tokens") > 0).groupBy("project_id", "tokens").agg(F.min("claim_ord").alias("ord")))
    held = bags.select("project_id", "ord", F.explode("tokens").alias("token"))
    frequency = held.groupBy("project_id", "token").agg(F.count(F.lit(1)).alias("df"))
    # Only frequent tokens are numbered: at most one for each ``hot`` postings of a project.
    number = (F.row_number().over(W.partitionBy("project_id").orderBy("token")) - 1).alias("number")
    warm = frequency.where(F.col("df") > hot).select("project_id", "token", number)
    known = cut(frequency.select("project_id", "token").join(warm, ["project_id", "token"], "left"))
    wanted = sets.select("project_id", "set_id", F.explode("tokens").alias("token")).join(known, ["project_id", "token"])
    held = held.join(known, ["project_id", "token"])
    numbers = F.array_sort(F.collect_list("number"))
    warm_sets = wanted.where("number IS NOT NULL").groupBy("project_id", "set_id").agg(numbers.alias("own"))
    warm_bags = held.where("number IS NOT NULL").groupBy("project_id", "ord").agg(numbers.alias("other"))

    rare = wanted.where("number IS NULL").select("project_id", "token", "set_id")
    pairs = rare.join(held.where("number IS NULL").select("project_id", "token", "ord"), ["project_id", "token"])
    pairs = pairs.groupBy("project_id", "set_id", "ord").agg(F.count(F.lit(1)).alias("rare"))
    pairs = pairs.join(warm_sets, ["project_id", "set_id"], "left").join(warm_bags, ["project_id", "ord"], "left")
    both = F.coalesce(F.size(F.array_intersect("own", "other")), F.lit(0))
    found = pairs.select("project_id", "set_id", "ord", (F.col("rare") + both).alias("shared"))

    signatures = warm_bags.groupBy("project_id", "other").agg(F.min("ord").alias("ord"))
    asked = warm_sets.select("project_id", "own").distinct()
    by_signature = _most_bits(asked, signatures).join(warm_sets, ["project_id", "own"])
    found = found.unionByName(by_signature.select("project_id", "set_id", "ord", "shared"))
    best = found.groupBy("project_id", "set_id").agg(F.max(F.struct("shared", (-F.col("ord")).alias("first"))).alias("best"))
    texts = claims.groupBy("project_id", F.col("claim_ord").alias("ord")).agg(F.min("text").alias("closest_text"))
    best = best.select("project_id", "set_id", "best.shared", (-F.col("best.first")).alias("ord")).join(texts, ["project_id", "ord"])
    own = F.array_sort(F.array_distinct("tokens"))
    joined = regions.withColumn("set_id", F.sha2(F.array_join(own, " "), 256)).withColumn("_n", F.size(own)).join(best, ["project_id", "set_id"], "left")
    return joined.select(*key, "closest_text", F.coalesce(F.col("shared") / F.col("_n"), F.lit(0.0)).alias("overlap"))


def _most_bits(asked: DataFrame, signatures: DataFrame, tile: int = TILE) -> DataFrame:
    """(project_id, own, ord, shared): for each set of numbers the first of the signatures that hold most of them, if any.

    asked(project_id, own), signatures(project_id, other, ord). Both sides of a project are dealt to tiles.
    """
    tiles = asked.groupBy("project_id").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("rows")).join(
        signatures.groupBy("project_id").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("columns")), "project_id"
    )
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(tiles, "project_id").withColumn("r", F.pmod(F.xxhash64("own"), F.col("rows")).cast("int")).withColumn("c", upto("columns"))
    right = signatures.join(tiles, "project_id").withColumn("c", F.pmod(F.xxhash64("other"), F.col("columns")).cast("int")).withColumn("r", upto("rows"))
    met = left.select("project_id", "r", "c", F.col("own").alias("numbers"), F.lit(None).cast(signatures.schema["ord"].dataType).alias("ord")).unionByName(
        right.select("project_id", "r", "c", F.col("other").alias("numbers"), "ord")
    )
    kinds = {f.name: f.dataType.simpleString() for f in met.schema}
    schema = f"project_id {kinds['project_id']}, own array<int>, ord {kinds['ord']}, shared int"

    def bits(lists: pa.ListArray, width: int) -> np.ndarray:
        sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
        words = np.zeros((len(lists), width), np.uint64)
        np.bitwise_or.at(words, (np.repeat(np.arange(len(lists)), sizes), flat // 64), np.uint64(1) << (flat % 64).astype(np.uint64))
        return words

    def search(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        asks = pc.is_null(group.column("ord"))
        here, there = group.filter(asks), group.filter(pc.invert(asks)).sort_by("ord")
        lists = [t.column("numbers").combine_chunks() for t in (here, there)]
        width = max((int(x.flatten().to_numpy().max(initial=-1)) for x in lists), default=-1) // 64 + 1
        own, other = (bits(x, width) for x in lists)
        best, at = np.zeros(len(own), np.int32), np.zeros(len(own), np.int64)
        # In the order of claims, so that a later one has to hold more.
        for start in range(0, len(other), STEP):
            part = other[start : start + STEP]
            most = np.bitwise_count(own & np.bitwise_or.reduce(part, axis=0)).sum(1)
            open_ = np.flatnonzero(most > best)
            for rows in np.array_split(open_, max(1, len(open_) // STEP)):
                shared = sum(np.bitwise_count(own[rows, w, None] & part[None, :, w]).astype(np.int32) for w in range(width))
                first = shared.argmax(axis=1) if len(rows) else np.zeros(0, np.int64)
                shared = shared[np.arange(len(rows)), first] if len(rows) else np.zeros(0, np.int32)
                more = shared > best[rows]
                best[rows[more]], at[rows[more]] = shared[more], start + first[more]
        found = np.flatnonzero(best)
        taken = here.take(pa.array(found))
        return pa.table({
            "project_id": taken.column("project_id"), "own": taken.column("numbers").cast(pa.list_(pa.int32())),
            "ord": there.column("ord").take(pa.array(at[found])), "shared": pa.array(best[found], pa.int32()),
        })

    return met.groupBy("project_id", "r", "c").applyInArrow(search, schema)


def with_overlap(regions: DataFrame, claims: DataFrame, key: Sequence[str] = tuple(KEY)) -> DataFrame:
    """Regions with ``closest_text`` and ``overlap`` by semantic tokens of evidence and claims."""
    tokens = regions.select(*key, T.semantic_tokens(F.col("evidence_text")).alias("tokens"))
    said = claims.select("project_id", "claim_ord", "text", T.semantic_tokens(F.col("text")).alias("tokens"))
    return regions.join(closest_claims(tokens, said, key), list(key))


def reason_compatible(reason: Column, text: Column, role: Column, overlap: Column) -> Column:
    """Whether a non-story reason fits its region's text, role and overlap with the story."""
    tokens = T.semantic_tokens(text)
    count = F.size(tokens)
    label = (count.between(1, 4)) & (F.length(T.strip(text)) <= 40) & ~text.rlike("[.!?;:]")
    ui = (role == "game_ui") | F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in UI_WORDS]))
    fits = (
        F.when(reason == "standalone_label", label)
        .when(reason == "sfx_or_annotation", role.isin("sfx", "translator_note"))
        .when(reason == "non_story_ui", ui)
        .when(reason == "repeated_information", overlap >= 0.6)
        .when(reason == "redundant_context", overlap >= 0.5)
        .when(reason == "greeting_or_filler", count.between(1, 5))
        .when(reason == "no_factual_story_content", count.between(1, 2) & ~text.rlike(r"\p{Nd}"))
    )
    return F.coalesce(fits, F.lit(False))


def recovery_slots(uncovered: DataFrame, claims: DataFrame) -> DataFrame:
    """Numbered slots for the uncovered regions, with their ids and closest claim.

    uncovered needs ``ord``; claims(project_id, claim_ord, text) are the grounded ones.
    """
    numbered = number_rows(
        uncovered, ["project_id"],
        [F.col("page_order"), F.col("asset_id"), F.col("ord"), F.col("region_id")],
        into="slot",
    )
    suffix = F.substring(F.sha2(F.col("asset_id").cast("string"), 256), 1, 8)
    event = F.concat(F.lit("coverage_recovery_p"), "page_order", F.lit("_r"), "region_id", F.lit("_"), suffix)
    named = numbered.withColumns({"slot_id": F.concat(F.lit("slot_"), "slot"), "event_id": event})
    near = with_overlap(named, claims)
    return near.select(
        *KEY, "slot", "slot_id", "event_id", "evidence_text", "text_role",
        F.col("closest_text").alias("closest_grounded_claim"),
        "overlap",
        round_exact(F.col("overlap"), 4).alias("normalized_token_overlap"),
        (F.col("overlap") >= EQUIVALENT_OVERLAP).alias("equivalent_grounded_proposition"),
    )


def slot_collisions(slots: DataFrame, events: DataFrame) -> DataFrame:
    return slots.join(events.select("project_id", "event_id"), ["project_id", "event_id"], "left_semi")


def validate_slot_outputs(
    outputs: DataFrame, slots: DataFrame, existing_events: DataFrame, world: dict[str, DataFrame]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(one verdict per returned slot, issues, accepted claims) of fixed-slot answers.

    outputs(project_id, pos, slot_id, decision, reason_code, supplied_fields, claims)
    with claims an array of texts (NULL for a missing list). New events are checked
    by the claim rules against the whole project's evidence in ``world``.
    """
    known = slots.select("project_id", "slot_id").withColumn("_known", F.lit(True))
    counted = outputs.groupBy("project_id", "slot_id").agg(F.count(F.lit(1)).alias("_n"))
    shape = F.col("slot_id").isNotNull()
    ids = counted.where(shape).join(known, ["project_id", "slot_id"], "left")
    none = F.lit(None).cast("string")
    issues = (
        ids.where("_known IS NULL").select("project_id", "slot_id", F.lit("unknown_recovery_slot").alias("code"))
        .unionByName(ids.where("_n > 1").select("project_id", "slot_id", F.lit("duplicate_recovery_slot").alias("code")))
        .unionByName(outputs.where("slot_id IS NULL").select("project_id", none.alias("slot_id"), F.lit("invalid_recovery_slot_output").alias("code")))
    )
    single = outputs.join(ids.where("_n = 1").select("project_id", "slot_id"), ["project_id", "slot_id"], "left_semi").join(
        slots, ["project_id", "slot_id"]
    )
    texts = F.col("claims")
    written = F.coalesce(
        (F.size(texts) > 0) & F.forall(texts, lambda t: F.coalesce(T.non_blank(t).isNotNull(), F.lit(False))), F.lit(False)
    )
    own = T.semantic_tokens(F.col("evidence_text"))
    anchored = F.forall(texts, lambda t: F.coalesce(F.arrays_overlap(T.semantic_tokens(t), own), F.lit(False)))
    taken = existing_events.select("project_id", "event_id").distinct().withColumn("_taken", F.lit(True))
    fields = F.coalesce("supplied_fields", F.array().cast("array<string>"))
    early = (
        F.when(F.arrays_overlap(fields, F.array(*[F.lit(f) for f in BACKEND_FIELDS])), "model_supplied_backend_owned_field")
        .when((F.col("decision") == "non_story_relevant") & ~F.coalesce(F.col("reason_code").isin(NON_STORY_CODES), F.lit(False)), "invalid_non_story_reason_code")
        .when(
            (F.col("decision") == "non_story_relevant")
            & ~reason_compatible(F.col("reason_code"), F.col("evidence_text"), F.col("text_role"), F.col("overlap")),
            "incompatible_non_story_reason_code",
        )
        .when(F.col("decision") == "non_story_relevant", F.lit(None))
        .when(~F.col("decision").eqNullSafe(F.lit("new_event")), "invalid_fixed_slot_decision")
        .when(~written, "invalid_fixed_slot_claims")
        .when(F.col("_taken"), "coverage_recovery_event_id_collision")
        .when(~anchored, "fixed_slot_claim_not_anchored_to_evidence")
    )
    judged = cut(single.join(taken, ["project_id", "event_id"], "left").withColumn("_early", early))
    fresh = judged.where("_early IS NULL AND decision = 'new_event'")
    new_claims = fresh.select(
        "project_id", "event_id", "slot_id", *REFERENCE, F.posexplode("claims").alias("_i", "_t")
    ).select(
        "project_id", "event_id", "slot_id", *REFERENCE,
        (F.col("_i") + 1).alias("claim_ord"),
        F.concat("event_id", F.lit("_claim_"), F.col("_i") + 1).alias("claim_id"),
        T.strip(F.col("_t")).alias("text"), F.lit("fact").alias("claim_type"), none.alias("subject"),
    )
    cited = new_claims.select("project_id", "event_id", "claim_id", F.lit(1).alias("source_ord"), *REFERENCE)
    no_people = world["characters"].where(F.lit(False))
    verdicts = G.judge_claims(new_claims.drop("slot_id", *REFERENCE), cited, world["evidence"], no_people)
    unsafe = verdicts.where("reason IS NOT NULL").select("project_id", "event_id").distinct().withColumn("_unsafe", F.lit(True))
    settled = judged.join(unsafe, ["project_id", "event_id"], "left").withColumn(
        "code", F.coalesce("_early", F.when(F.col("_unsafe"), "unsafe_fixed_slot_event"))
    )
    # Of new events of one batch with the same id, those behind the first that is accepted collide with it.
    place = F.struct(F.length("slot_id").alias("n"), F.col("slot_id").alias("slot"))
    reached = F.col("decision").eqNullSafe(F.lit("new_event")) & (
        F.col("code").isNull() | F.col("code").isin("fixed_slot_claim_not_anchored_to_evidence", "unsafe_fixed_slot_event")
    )
    accepted = settled.where(F.col("code").isNull() & (F.col("decision") == "new_event"))
    accepted = accepted.groupBy("project_id", "event_id").agg(F.min(place).alias("_first"))
    late = reached & (F.col("_first") < place)
    settled = settled.join(accepted, ["project_id", "event_id"], "left").withColumn(
        "code", F.when(late, "coverage_recovery_event_id_collision").otherwise(F.col("code"))
    )
    structural = F.col("code").isNull() | F.col("code").isin(*SEMANTIC_REJECTIONS, "coverage_recovery_event_id_collision")
    verdict = settled.select(
        *KEY, "slot_id", "event_id", "decision", "reason_code", "code",
        structural.alias("structurally_valid"), F.col("code").isNull().alias("valid"),
    )
    issues = issues.unionByName(verdict.where("code IS NOT NULL").select("project_id", "slot_id", "code"))
    accepted = verdicts.join(verdict.where("valid").select("project_id", "event_id"), ["project_id", "event_id"], "left_semi")
    return verdict, issues, accepted


def slot_metrics(slots: DataFrame, outputs: DataFrame, verdict: DataFrame, issues: DataFrame) -> DataFrame:
    requested = slots.groupBy("project_id").agg(F.count(F.lit(1)).alias("requested_slots"))
    known = outputs.join(slots.select("project_id", "slot_id"), ["project_id", "slot_id"], "left_semi")
    returned = known.groupBy("project_id").agg(F.count_distinct("slot_id").alias("returned_known_slots"))
    valid = verdict.groupBy("project_id").agg(
        F.count_if("structurally_valid").alias("structurally_valid_slots"), F.count_if("valid").alias("valid_slots")
    )
    twice = known.groupBy("project_id", "slot_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    duplicates = twice.groupBy("project_id").agg(F.count(F.lit(1)).alias("duplicate_slots"))
    problems = issues.groupBy("project_id").agg(
        F.count_if(F.col("code") == "unknown_recovery_slot").alias("unknown_slots"),
        F.count_if(F.col("code").isin(SEMANTIC_REJECTIONS)).alias("semantic_rejections"),
    )
    joined = requested
    for part in (returned, valid, duplicates, problems):
        joined = joined.join(part, "project_id", "left")
    joined = joined.fillna(0)
    total = F.col("requested_slots")
    rated = joined.withColumns(
        {
            "missing_slots": total - F.col("structurally_valid_slots"),
            "unresolved_slots": total - F.col("valid_slots"),
            "_s": F.col("structurally_valid_slots").cast("double") / total,
            "_d": F.col("valid_slots").cast("double") / total,
        }
    )
    return rated.withColumns(
        {"structural_completeness": round_exact(F.col("_s"), 4), "decision_completeness": round_exact(F.col("_d"), 4)}
    ).drop("_s", "_d")


def validate_decisions(
    decisions: DataFrame, uncovered: DataFrame, existing_events: DataFrame, sources: DataFrame, ready_events: DataFrame
) -> DataFrame:
    """Verdict of every recovery decision (``code`` NULL when accepted).

    decisions(project_id, pos, asset_id, page_order, region_id, disposition,
    reason_code, event_id); uncovered carries evidence_text, text_role and overlap;
    sources(project_id, event_id, asset_id, page_order, region_id) are the proposed
    events' citations, ready_events(project_id, event_id) those that passed
    structure and grounding checks.
    """
    allowed = uncovered.select(*KEY, "evidence_text", "text_role", "overlap").withColumn("_allowed", F.lit(True))
    repeats = decisions.where(valid_reference()).groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("_n"), F.min("pos").alias("_first")
    )
    cites = sources.select(*KEY, "event_id").distinct().withColumn("_cites", F.lit(True))
    taken = existing_events.select("project_id", "event_id").distinct().withColumn("_taken", F.lit(True))
    ready = ready_events.select("project_id", "event_id").distinct().withColumn("_ready", F.lit(True))
    joined = (
        decisions.join(allowed, KEY, "left")
        .join(repeats, KEY, "left")
        .join(cites, [*KEY, "event_id"], "left")
        .join(taken, ["project_id", "event_id"], "left")
        .join(ready, ["project_id", "event_id"], "left")
    )
    aside, event = F.col("disposition") == "non_story_relevant", F.col("disposition") == "new_event"
    code = (
        F.when(~valid_reference(), "invalid_region_reference")
        .when(F.col("_allowed").isNull(), "unknown_region")
        .when((F.col("_n") > 1) & (F.col("pos") == F.col("_first")), "duplicate_region_decision")
        .when(F.col("_n") > 1, "repeated_duplicate")
        .when(aside & T.non_blank(F.col("reason_code")).isNull(), "missing_non_story_reason_code")
        .when(aside & ~F.col("reason_code").isin(NON_STORY_CODES), "unknown_non_story_reason_code")
        .when(
            aside & ~reason_compatible(F.col("reason_code"), F.col("evidence_text"), F.col("text_role"), F.col("overlap")),
            "incompatible_non_story_reason_code",
        )
        .when(event & F.col("event_id").isNull(), "missing_recovery_event")
        .when(event & F.col("_cites").isNull(), "recovery_event_does_not_cover_region")
        .when(event & F.col("_taken"), "recovery_event_id_conflict")
        .when(event & F.col("_ready").isNull(), "unsafe_recovery_event")
        .when(~F.coalesce(aside | event, F.lit(False)), "unknown_recovery_disposition")
    )
    return joined.select(*decisions.columns, code.alias("code"))


def unresolved(uncovered: DataFrame, verdicts: DataFrame) -> DataFrame:
    return uncovered.join(verdicts.where("code IS NULL").select(*KEY), KEY, "left_anti")


def repairable_reasons(decisions: DataFrame, open_regions: DataFrame) -> DataFrame:
    """Open non-story decisions that give a free-text reason but no code."""
    wanted = (
        valid_reference()
        & (F.col("disposition") == "non_story_relevant")
        & T.non_blank(F.col("reason")).isNotNull()
        & (F.coalesce("reason_code", F.lit("")) == "")
    )
    return decisions.where(wanted).join(open_regions.select(*KEY), KEY, "left_semi")


def apply_repairs(
    issues: DataFrame, open_regions: DataFrame, resolved: DataFrame, new_issues: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(issues, open regions) after repaired decisions: their keys are no longer open and
    their missing-reason issues go. ``resolved`` holds the keys of repaired decisions and of
    every region the repaired events cite."""
    keys = resolved.select(*KEY).distinct().withColumn("_fixed", F.lit(True))
    marked = issues.join(keys, KEY, "left")
    kept = marked.where(
        ~((F.col("code") == "missing_non_story_reason_code") & F.coalesce("_fixed", F.lit(False)))
    ).drop("_fixed")
    return kept.unionByName(new_issues), open_regions.join(keys, KEY, "left_anti")


def merge_events(existing: DataFrame, recovered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all events, collisions); a collision must be empty before the union is used."""
    collisions = recovered.join(existing.select("project_id", "event_id"), ["project_id", "event_id"], "left_semi")
    repeated = recovered.groupBy("project_id", "event_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    ids = collisions.select("project_id", "event_id").unionByName(repeated.select("project_id", "event_id")).distinct()
    return existing.unionByName(recovered, allowMissingColumns=True), ids


def extend_progression(existing: DataFrame, added: DataFrame) -> DataFrame:
    """Append event ids not yet listed, keeping each one's first place."""
    last = existing.groupBy("project_id").agg(F.max("pos").alias("_last"))
    fresh = (
        added.groupBy("project_id", "event_id").agg(F.min("pos").alias("pos"))
        .join(existing.select("project_id", "event_id"), ["project_id", "event_id"], "left_anti")
        .join(last, "project_id", "left")
    )
    placed = fresh.select("project_id", (F.coalesce("_last", F.lit(-1)) + 1 + F.col("pos")).alias("pos"), "event_id")
    return existing.select("project_id", "pos", "event_id").unionByName(placed)


def merge_continuation(
    initial_events: DataFrame, continuation_events: DataFrame, continuation_sources: DataFrame,
    open_regions: DataFrame, decided: DataFrame,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, conflict issues, open regions) after a second answer.

    Events whose id the first answer used are rejected, and the regions they cite
    stay open even when the second answer decided them.
    """
    ids = ["project_id", "event_id"]
    known = initial_events.select(*ids)
    accepted = continuation_events.join(known, ids, "left_anti")
    rejected = continuation_events.join(known, ids, "left_semi")
    issues = rejected.select(*ids, F.lit("recovery_event_id_conflict").alias("code"))
    disputed = continuation_sources.join(rejected.select(*ids), ids, "left_semi").select(*KEY).distinct()
    settled = decided.select(*KEY).join(disputed, KEY, "left_anti")
    return (
        initial_events.unionByName(accepted),
        issues,
        open_regions.join(settled, KEY, "left_anti"),
    )
