"""Report dataflows: run performance, recall, story audit."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pagetrace.operators import audit as A
from pagetrace.operators import recall as R
from pagetrace.operators import telemetry as M


def performance_report(stages: DataFrame, calls: DataFrame) -> dict[str, DataFrame]:
    """Every part of a run report, for all runs at once."""
    return {
        "stage_work": M.stage_work(stages),
        "page_totals": M.page_totals(stages),
        "page_stages": M.page_stage_seconds(stages),
        "page_statistics": M.page_statistics(stages),
        "slowest": M.slowest(stages),
        "outcomes": M.page_outcomes(stages),
        "project_timings": M.project_timings(stages),
        "page_calls": M.page_call_budget(calls),
        "project_calls": M.project_call_budget(calls),
        "call_totals": M.call_totals(calls),
        "calls_by_stage": M.calls_by_stage(calls),
        "failure": M.first_failure(stages),
    }


def recall_audit(regions: DataFrame, pages: DataFrame | None = None) -> dict[str, DataFrame]:
    reports = R.page_audit(regions, pages)
    return {"pages": reports, "aggregate": R.dataset_audit(reports)}


def story_audit(
    summary: DataFrame, evidence: DataFrame, dialogues: DataFrame, truth_before: DataFrame, truth_after: DataFrame,
    events: DataFrame, coverage: DataFrame,
) -> dict[str, DataFrame]:
    """Safety, invariants, totals and preservation of a story run."""
    issues = A.input_safety_issues(evidence, truth_after)
    waiting = dialogues.where("decision = 'needs_review'")
    return {
        "verified_regions": A.verified_regions(dialogues, truth_after),
        "safety_issues": issues,
        "safety": A.input_safety(summary, evidence, issues, waiting),
        "invariants": A.invariants(dialogues),
        "event_totals": A.event_totals(events, coverage),
        "preservation": A.preservation(truth_before, truth_after, ["asset_id", "region_id"]),
    }
