"""Story dataflows: input to grounded events, coverage, recovery, review and script."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrace.operators import coverage as V
from pagetrace.operators import grounding as G
from pagetrace.session import cut


def ground_story(world: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Ground every project's analysis.

    ``world`` holds pages, evidence, events, claims, claim_sources, characters,
    character_sources and progression. Valid citations and claim verdicts feed
    several results each, so both are materialised once.
    """
    valid, source_issues = G.validate_sources(
        world["claims"], world["claim_sources"], world["pages"], world["evidence"], G.CLAIM
    )
    valid = cut(valid)
    judged = cut(G.judge_claims(world["claims"], valid, world["evidence"], world["characters"]))
    events = G.ground_events(world["events"], judged)
    out = {
        "valid_sources": valid,
        "claims": judged,
        "events": events,
        "claim_source_issues": source_issues,
        "covered_regions": G.grounded_regions(valid, judged),
        "event_sources": G.merged_sources(valid, judged),
    }
    if "character_sources" in world:
        named, character_issues = G.validate_sources(
            world["characters"], world["character_sources"], world["pages"], world["evidence"], G.CHARACTER
        )
        people, supporting = G.ground_characters(world["characters"], named, world["evidence"])
        out.update(characters=people, character_sources=supporting, character_source_issues=character_issues)
        out["summary"] = G.grounding_summary(
            world["evidence"].select("project_id").distinct(), people, events
        )
    if "progression" in world:
        out["progression"] = G.check_progression(world["progression"], events)
    return out


def grounded_claims(world: dict[str, DataFrame], grounded: dict[str, DataFrame]) -> DataFrame:
    """(project_id, claim_ord, text) of the grounded claims in story order."""
    good = grounded["claims"].where("reason IS NULL")
    ordered = good.join(world["events"].select(*G.EVENT, "event_ord"), G.EVENT)
    # A million claims of one event keep their place before the next event's.
    place = F.col("event_ord") * 10**6 + F.col("claim_ord")
    return ordered.select("project_id", place.alias("claim_ord"), "text")


def cover_and_recover(
    world: dict[str, DataFrame],
    grounded: dict[str, DataFrame],
    slot_outputs: DataFrame | None = None,
    non_story: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Coverage before and after one round of fixed-slot answers (an input table)."""
    regions = V.covered_regions(world["evidence"], grounded["covered_regions"], non_story)
    open_regions = cut(V.uncovered_important(regions))
    slots = cut(V.recovery_slots(open_regions, grounded_claims(world, grounded)))
    out = {"regions": regions, "coverage_before": V.coverage_report(regions), "slots": slots}
    if slot_outputs is None:
        out["coverage"] = out["coverage_before"]
        return out
    verdict, issues, accepted = V.validate_slot_outputs(slot_outputs, slots, world["events"], world)
    verdict = cut(verdict)
    asides = verdict.where("valid AND decision = 'non_story_relevant'").select(*V.KEY)
    if non_story is not None:
        asides = asides.unionByName(non_story.select(*V.KEY))
    new_regions = verdict.where("valid AND decision = 'new_event'").select("project_id", "event_id", *V.REFERENCE)
    after = V.covered_regions(world["evidence"], grounded["covered_regions"].unionByName(new_regions), asides)
    out.update(
        verdicts=verdict,
        issues=issues,
        accepted_claims=accepted,
        metrics=V.slot_metrics(slots, slot_outputs, verdict, issues),
        coverage=V.coverage_report(after),
    )
    return out


def plan_scripts(
    events: DataFrame, claims: DataFrame, progression: DataFrame,
    selections: DataFrame | None = None, styles: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Flat units, their totals, beats and rendered segments; model selections are an optional input table.

    Units are one row per told claim; a beat's text is joined only if beats, segments or issues are read.
    """
    from pagetrace.operators import script as P

    safe = P.safe_events(events, claims)
    units = cut(P.beat_units(safe, claims, progression))
    told = P.beats(units)
    chosen = None if selections is None else P.checked_selections(P.beat_names(units), selections, styles)
    segments = P.render(told, chosen)
    return {
        "problems": P.script_problems(events.select("project_id").distinct(), safe),
        "units": units,
        "beats": told,
        "segments": segments,
        "issues": P.script_issues(segments, safe, claims),
        "totals": P.beat_totals(units, chosen),
    }
