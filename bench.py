"""Time the headline queries: prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pagetrace.session import local_session  # noqa: E402
from pagetrace.suite.registry import registered  # noqa: E402

HEADLINE = [
    "fast_path_share_by_source",
    "project_progress",
    "natural_page_renumber",
    "newest_truth_per_region",
    "page_time_statistics",
    "page_total_seconds",
    "dataset_recall_audit",
    "dialogues_in_reading_order",
    "dialogue_screening",
    "compact_correction_decode",
    "correction_decisions",
    "region_bounding_boxes",
    "block_assignment",
    "neighbour_block_clusters",
    "split_merged_regions",
    "suppressed_duplicate_boxes",
    "uncovered_candidates",
    "story_input_evidence",
    "claim_verdicts",
    "closest_claim_per_region",
    "coverage_report",
    "review_queue",
    "final_story_events",
    "script_beats",
    "story_input_safety",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), name="pagetrace-bench")
    known = registered()
    # One untimed query pays for class loading and code generation.
    known["project_progress"][0](spark, folder).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        if name not in known:
            continue
        start = time.perf_counter()
        known[name][0](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    line = {
        "metric": "headline_total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
