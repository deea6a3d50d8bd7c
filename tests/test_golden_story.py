"""Known story cases: sources, claims, coverage, review, script."""

import random

import pytest
from pyspark.sql import functions as F

from pagetrace.functions import text as T
from pagetrace.operators import coverage as V
from pagetrace.operators import grounding as G
from pagetrace.operators import review as R
from pagetrace.operators import script as P
from pagetrace.plans.story import plan_scripts

EVIDENCE = "project_id string, asset_id string, page_order int, region_id int, ord int, evidence_text string, text_role string"
SOURCE = "project_id string, event_id string, claim_id string, source_ord int, asset_id string, page_order int, region_ids array<int>"
CLAIM = "project_id string, event_id string, claim_ord int, claim_id string, text string, claim_type string, subject string"
EVENT = "project_id string, event_id string, event_ord int, summary string, story_role string, script_ready boolean, unsupported_claims int"


def _evidence(spark, texts, role="dialogue"):
    return spark.createDataFrame([("p", "asset-1", 1, i, i, t, role) for i, t in texts.items()], EVIDENCE)


def _judge(spark, texts, claims, people=(), sources=None):
    evidence = _evidence(spark, texts)
    pages = evidence.select("project_id", "asset_id", "page_order").distinct()
    rows = [("p", "e", i, f"c{i}", *c) for i, c in enumerate(claims)]
    listed = sources or [("p", "e", f"c{i}", 1, "asset-1", 1, [1]) for i in range(len(claims))]
    frame = spark.createDataFrame(rows, CLAIM)
    valid, issues = G.validate_sources(frame, spark.createDataFrame(listed, SOURCE), pages, evidence, G.CLAIM)
    names = spark.createDataFrame([("p", i, f"n{i}", n) for i, n in enumerate(people)], "project_id string, char_ord int, character_id string, name string")
    return {r.claim_id: r for r in G.judge_claims(frame, valid, evidence, names).collect()}, sorted(r.code for r in issues.collect()), valid


def test_source_issues(spark):
    sources = [
        ("p", "e", "c0", 1, "asset-1", 2, [1]), ("p", "e", "c0", 2, "asset-1", 1, [9]), ("p", "e", "c0", 3, "asset-9", 1, [1]),
        ("p", "e", "c0", 4, "asset-1", 1, [2, 1, 1]), ("p", "e", "c0", 5, "asset-1", 1, [1, 2]), ("p", "e", "c0", 6, "asset-1", 1, []),
    ]
    _, issues, valid = _judge(spark, {1: "a text", 2: "b text"}, [("a", "fact", None), ("b", "fact", None)], sources=sources)
    assert issues == sorted(["wrong_page_order", "invalid_region_reference", "invalid_asset_reference",
                             "duplicate_region_reference", "duplicate_source_reference", "invalid_source_shape", "missing_source_references"])
    assert sorted((r.source_ord, r.region_id) for r in valid.collect()) == [(4, 1), (4, 2)]


def test_one_foreign_name_is_taken_out(spark):
    verdicts, _, _ = _judge(
        spark, {1: "They open the door."},
        [("Rin opens the door.", "fact", None), ("Rin and Kazu open it.", "fact", None), ("RIN’s door opens", "fact", None),
         ("Rin opens because so", "causal_relation", None)],
        people=["Rin", "Kazu"],
    )
    assert (verdicts["c0"].text, verdicts["c0"].reason, verdicts["c0"].removed_attribution) == ("A character opens the door.", None, "Rin")
    assert verdicts["c1"].code == "unsupported_named_attribution"
    assert verdicts["c2"].text == "A character door opens"
    assert verdicts["c3"].code == "unsupported_causal_inference"


def test_accents_fold_but_stroked_d_stays(spark):
    row = spark.range(1).select(T.normalize_name(F.lit(" Nguyễn  Đức ")).alias("a"), T.normalize_name_arrow(F.lit(" Nguyễn  Đức ")).alias("b")).first()
    assert row.a == row.b == "NGUYEN ĐUC"


def test_names_are_word_bounded(spark):
    def holds(text, name):
        return spark.range(1).select(T.contains_name(T.normalize_name(F.lit(text)), T.normalize_name(F.lit(name))).alias("v")).first().v

    assert holds("Chào RÍN!", "rin") and not holds("Bring", "rin") and holds("a.b (x)", "a.b")


def test_progression(spark):
    events = spark.createDataFrame(
        [("p", "e1", 1, "s", "main_story", True, 0), ("p", "e2", 2, "s", "main_story", False, 1), ("p", "e3", 3, "s", "supporting_context", True, 0)], EVENT)
    listed = spark.createDataFrame([("p", i, e) for i, e in enumerate(["e2", " e1 ", "e3", "e1", "ghost", " "])], "project_id string, pos int, event_id string")
    got = {r.pos: r.code for r in G.check_progression(listed, events).collect()}
    assert got == {0: "unsupported_progression_event", 1: None, 2: "contextual_progression_event", 3: "duplicate_progression_event",
                   4: "nonexistent_progression_event", 5: "invalid_progression_event_id"}


def test_coverage_counts(spark):
    rows = [("p", "a", 1, 1, 1, "Hello there friend", "dialogue"), ("p", "a", 1, 2, 2, "A fact", "narration"), ("p", "a", 1, 3, 3, "RIN", "dialogue"),
            ("p", "a", 1, 4, 4, "LEVEL UP", "game_ui"), ("p", "a", 1, 5, 5, "BOOM", "sfx")]
    evidence = spark.createDataFrame(rows, EVIDENCE)
    grounded = spark.createDataFrame([("p", "e", "a", 1, 2)], "project_id string, event_id string, asset_id string, page_order int, region_id int")
    first = V.coverage_report(V.covered_regions(evidence, grounded)).first()
    assert (first.eligible_regions, first.important_regions, first.covered_regions, first.non_story_relevant_regions,
            first.unresolved_regions, first.optional_context_regions, first.coverage_score) == (4, 3, 1, 1, 1, 1, 0.6667)
    aside = spark.createDataFrame([("p", "a", 1, 1)], "project_id string, asset_id string, page_order int, region_id int")
    second = V.coverage_report(V.covered_regions(evidence, grounded, aside)).first()
    assert (second.unresolved_regions, second.coverage_score) == (0, 1.0)


@pytest.mark.parametrize(
    "reason,text,overlap,expected",
    [("standalone_label", "LET US BE HAPPY TOGETHER!", 0.0, False), ("standalone_label", "KAZU-SAN", 0.0, True),
     ("repeated_information", "A fact", 1.0, True), ("repeated_information", "something else", 0.2, False), ("made_up", "x", 1.0, False)],
)
def test_reason_compatibility(spark, reason, text, overlap, expected):
    fits = V.reason_compatible(F.lit(reason), F.lit(text), F.lit("dialogue"), F.lit(overlap))
    assert spark.range(1).select(fits.alias("v")).first().v is expected


@pytest.mark.parametrize(("hot", "tile", "step"), [(0, 4096, 256), (0, 7, 3), (2, 10, 256), (256, 4096, 256)])
def test_closest_claims_equal_brute_force(spark, hot, tile, step, monkeypatch):
    monkeypatch.setattr(V, "STEP", step)
    monkeypatch.setattr(V._most_bits, "__defaults__", (tile,))
    rng = random.Random(5)
    words = ["the", "of"] * 6 + [f"w{i}" for i in range(25)]
    regions = {i: sorted(set(rng.choices(words, k=rng.randrange(0, 7)))) for i in range(60)}
    regions[60] = regions[1]
    claims = {i: sorted(set(rng.choices(words, k=rng.randrange(0, 9)))) for i in range(50)}
    want = {}
    for key, own in regions.items():
        best, text = 0, None
        for order, bag in claims.items():
            shared = len(set(own) & set(bag))
            if shared > best:
                best, text = shared, f"claim {order}"
        want[key] = (text, best / len(own) if own else 0.0)
    left = spark.createDataFrame([("p", k, v) for k, v in regions.items()], "project_id string, region_id int, tokens array<string>")
    right = spark.createDataFrame([("p", k, f"claim {k}", v) for k, v in claims.items()], "project_id string, claim_ord int, text string, tokens array<string>")
    got = {r.region_id: (r.closest_text, r.overlap) for r in V.closest_claims(left, right, ["project_id", "region_id"], hot=hot).collect()}
    assert got == want


def test_closest_claims_among_common_words(spark):
    """Ten thousand regions and claims of few words in one project: signatures, and no pair of rows."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(150)]
    regions = [("p", i, rng.sample(words, 6)) for i in range(10_000)]
    claims = [("p", i, f"claim {i}", rng.sample(words, 9)) for i in range(10_000)]
    left = spark.createDataFrame(regions, "project_id string, region_id int, tokens array<string>")
    right = spark.createDataFrame(claims, "project_id string, claim_ord int, text string, tokens array<string>")
    got = {r.region_id: (r.closest_text, r.overlap) for r in V.closest_claims(left, right, ["project_id", "region_id"]).collect()}
    assert len(got) == 10_000
    for _, i, own in regions[:40]:
        shared = [len(set(own) & set(bag)) for _, _, _, bag in claims]
        assert got[i] == (f"claim {shared.index(max(shared))}", max(shared) / 6)


def _story(spark):
    events = spark.createDataFrame(
        [("p", "event-1", 1, "one", "main_story", True, 0), ("p", "event-2", 2, "two", "main_story", True, 0), ("p", "event-3", 3, "three", "main_story", False, 1)], EVENT)
    claims = spark.createDataFrame([("p", "event-1", 1, "claim-1", "First fact", "fact", None), ("p", "event-2", 1, "claim-2", 'Second "fact"', "fact", None)], CLAIM)
    places = "project_id string, event_id string, asset_id string, page_order int, region_id int"
    regions = spark.createDataFrame([("p", "event-1", "a", 1, 2), ("p", "event-2", "a", 1, 1)], places)
    stories = spark.createDataFrame(
        [("p", "partial", "r1", None, None, None, False)],
        "project_id string, status string, source_revision string, review_source_revision string, approval_source_revision string, approval_story_fingerprint string, approved boolean")
    revisions = spark.createDataFrame([("p", "r1")], "project_id string, current_revision string")
    open_regions = spark.createDataFrame([("p", "a", 1, 4, "lost"), ("p", "a", 1, 5, "too")], "project_id string, asset_id string, page_order int, region_id int, evidence_text string")
    return events, claims, regions, stories, revisions, open_regions


EDIT = "project_id string, event_id string, text string"
RESOLUTION = "project_id string, asset_id string, page_order int, region_id int, action string, text string, event_id string"


def test_review_overlays_and_approval(spark):
    events, claims, regions, stories, revisions, open_regions = _story(spark)
    reviewed = stories.withColumn("review_source_revision", F.lit("r1"))
    edits = spark.createDataFrame([("p", "event-1", "edited one")], EDIT)
    one = spark.createDataFrame([("p", "a", 1, 4, "added_to_story", "added", "human-1")], RESOLUTION)
    composed = R.compose_review(reviewed, revisions, events, claims, regions, open_regions, edits, one)
    listed = [(r.event_id, r.provenance, r.summary) for r in composed["events"].orderBy("position").collect()]
    assert listed == [("event-2", "ai_grounded", "two"), ("event-1", "human_edited", "edited one"), ("human-1", "human_added", "added")]
    state = composed["states"].first()
    assert (state.review_status, state.unresolved_remaining, state.final_story_ready) == ("in_progress", 1, False)

    both = one.unionByName(spark.createDataFrame([("p", "a", 1, 5, "non_story_relevant", None, None)], RESOLUTION))
    done = R.compose_review(reviewed, revisions, events, claims, regions, open_regions, edits, both)["states"]
    assert done.first().review_status == "reviewed"
    approved, rejected = R.approve_stories(reviewed, done, reviewed)
    assert rejected.count() == 0
    again = R.compose_review(approved, revisions, events, claims, regions, open_regions, edits, both)["states"].first()
    assert again.story_approved and not again.approval_invalidated
    other = spark.createDataFrame([("p", "event-1", "edited twice")], EDIT)
    moved = R.compose_review(approved, revisions, events, claims, regions, open_regions, other, both)["states"].first()
    assert not moved.story_approved and moved.approval_invalidated
    stale = R.compose_review(approved, revisions.withColumn("current_revision", F.lit("r2")), events, claims, regions, open_regions, edits, both)
    assert stale["states"].first().review_status == "stale"
    assert {r.provenance for r in stale["events"].collect()} == {"ai_grounded"}


def test_resolution_requests(spark):
    _, _, _, stories, revisions, open_regions = _story(spark)
    none = spark.createDataFrame([], RESOLUTION)
    requests = spark.createDataFrame(
        [("p", 1, "a", 4, "added_to_story", " told ", "r1"), ("p", 2, "a", 4, "non_story_relevant", None, "r1"), ("p", 3, "a", 9, "added_to_story", "x", "r1"),
         ("p", 4, "a", 5, "added_to_story", "x", "r0")],
        "project_id string, seq int, asset_id string, region_id int, action string, text string, revision string")
    got = {r.seq: r.reject for r in R.apply_resolutions(requests, stories, revisions, open_regions, none).collect()}
    assert got == {1: None, 2: "already_reviewed", 3: "evidence_not_found", 4: "sources_changed"}


def test_beats_follow_progression(spark):
    events, claims, *_ = _story(spark)
    context = spark.createDataFrame([("p", "ctx", 9, "c", "supporting_context", True, 0)], EVENT)
    more = spark.createDataFrame([("p", "ctx", 1, "ctx-1", "Context", "fact", None)], CLAIM)
    progression = spark.createDataFrame([("p", 0, "event-2"), ("p", 1, "event-1")], "project_id string, pos int, event_id string")
    out = plan_scripts(events.unionByName(context), claims.unionByName(more), progression)
    told = {r.beat: (r.claim_ids, r.fact_text) for r in out["beats"].collect()}
    assert told[1] == (["claim-2"], "Second fact")
    assert told[2] == (["claim-1", "ctx-1"], "First fact Context")
    assert told[3] == told[4] == told[5] == (["claim-1"], "First fact")
    texts = {r.pos: r.text for r in out["segments"].collect()}
    assert texts[1] == "Mở đầu, Second fact"
    assert out["issues"].count() == 0 and out["problems"].count() == 0


def test_six_claims_all_placed(spark):
    events = spark.createDataFrame([("p", "e", 1, "s", "main_story", True, 0)], EVENT)
    claims = spark.createDataFrame([("p", "e", i, f"c{i}", f"fact {i}", "fact", None) for i in range(1, 7)], CLAIM)
    none = spark.createDataFrame([], "project_id string, pos int, event_id string")
    told = {r.beat: r.claim_ids for r in P.beats(P.beat_units(events, claims, none)).collect()}
    assert told == {1: ["c1"], 2: ["c2"], 3: ["c3"], 4: ["c4"], 5: ["c5", "c6"]}


def test_hot_project_beats_are_joined_from_pieces(spark):
    """One project holds nearly all claims; pieces, ids and totals equal a plain loop over the units."""
    n = 3 * P.PIECE + 17
    events = spark.createDataFrame(
        [("p", f"e{i}", i, "s", "main_story", True, 0) for i in range(1, 60)] + [("q", "e1", 1, "s", "main_story", True, 0)], EVENT)
    rows = [("p", f"e{1 + i % 59}", i, f"c{i % 2000}", f"fact  {i} 'x'" if i % 7 else '"', "fact", None) for i in range(n)]
    claims = spark.createDataFrame(rows + [("q", "e1", 1, "c1", "alone", "fact", None)], CLAIM)
    none = spark.createDataFrame([], "project_id string, pos int, event_id string")
    out = plan_scripts(events, claims, none)
    units = sorted(map(tuple, out["units"].collect()))
    told = {}
    for project, beat, _, event, claim, text in units:
        ids, cited, texts = told.setdefault((project, beat), ([], [], []))
        ids += [event] * (event not in ids)
        cited += [claim] * (claim not in cited)
        texts.append(text)
    got = {(r.project_id, r.beat): (r.source_event_ids, r.claim_ids, r.fact_text) for r in out["beats"].collect()}
    assert got == {k: (e, c, " ".join(t)) for k, (e, c, t) in told.items()}
    assert len(got["p", 5][1]) == 2000
    flat = sorted(map(tuple, out["totals"].select("project_id", "segment_count", "word_count", "source_event_count", "estimated_duration_seconds").collect()))
    whole = P.script_totals(out["segments"]).select("project_id", "segment_count", "word_count", "source_event_count", "estimated_duration_seconds")
    assert flat == sorted(map(tuple, whole.collect()))
    assert "collect_list" not in out["totals"]._jdf.queryExecution().optimizedPlan().toString()


def test_blank_text_has_no_words(spark):
    row = spark.range(1).select(T.word_count(F.lit("  ")).alias("a"), T.word_count(F.lit(" a\n b ")).alias("b")).first()
    assert (row.a, row.b) == (0, 2)
