"""Known page cases: screening, corrections, recovery, layout."""

import pytest
from pyspark.sql import functions as F

from pagetrace.functions import text as T
from pagetrace.operators import dialogue as D
from pagetrace.operators import layout as L
from pagetrace.operators.catalog import natural_key, without_projects
from pagetrace.plans.page import settle_dialogues

DIALOGUE = "asset_id int, region_id int, ord int, raw_text string, ocr_average double, ocr_minimum double"


def value(spark, expression):
    return spark.range(1).select(expression.alias("v")).first().v


def test_screening_paths(spark):
    rows = spark.createDataFrame(
        [(1, 1, 1, "XIN CHÀO", 0.99, 0.99), (1, 2, 2, "XIN CHÀO", 0.5, 0.5), (1, 3, 3, "TÔ1", 0.99, 0.99),
         (1, 4, 4, "MỜ", 0.1, 0.1), (1, 5, 5, 'A "B', 0.99, 0.99), (1, 6, 6, "OK", None, None)],
        DIALOGUE,
    )
    truth = spark.createDataFrame([(1, 4, " ĐÚNG "), (1, 2, "  ")], "asset_id int, region_id int, verified_text string")
    got = {r.region_id: (r.correction_path, r.clean_text, r.confidence) for r in D.screen(rows, truth).collect()}
    assert got[1] == ("fast_path", "XIN CHÀO", 0.99)
    assert got[4] == ("ground_truth", "ĐÚNG", 1.0)
    assert {got[i][0] for i in (2, 3, 5, 6)} == {"uncertain"}


def test_correction_issues(spark):
    original = spark.createDataFrame([(1, 7, 1, "A")], "asset_id int, region_id int, ord int, raw_text string")

    def issues(*rows):
        schema = "asset_id int, region_id int, pos int, ord int, raw_text string, clean_text string, confidence double"
        found = D.correction_issues(original, spark.createDataFrame(rows, schema))
        return sorted((r.region_id, r.issue) for r in found.collect())

    assert issues((1, 7, 0, 1, "A", "A", 0.9)) == []
    assert issues((1, 7, 0, 1, "B", "A", 0.9)) == [(7, "raw_text_mismatch")]
    assert issues((1, 7, 0, 1, "A", "A", 0.9), (1, 7, 1, 1, "A", "A", 0.9)) == [(7, "duplicate")]
    assert issues((1, 7, 0, 1, "A", "A", 1.5)) == [(7, "invalid_confidence")]
    assert issues((1, 7, 0, 2, "A", " ", 0.5), (1, 9, 1, 2, "A", "A", 0.5)) == [
        (7, "empty_clean_text"), (7, "order_mismatch"), (9, "invalid")]


def test_risky_and_tiny_changes(spark):
    assert value(spark, T.risky_change(F.lit("NGUYỆN YẾU"), F.lit("NGUYỆN YÊU"))) is True
    assert value(spark, T.risky_change(F.lit("a b"), F.lit("A B"))) is False
    long = " ".join(["w"] * 13)
    assert value(spark, T.risky_change(F.lit(long), F.lit("x" + long[1:]))) is False
    row = {"raw_text": F.lit('CÔ GÁl TÊN LÀ "RIN"'), "clean_text": F.lit('CÔ GÁI TÊN LÀ "RIN"'), "reason_code": F.lit("ocr_typo"),
           "text_similarity": F.lit(0.97), "ocr_confidence": F.lit(0.70), "confidence": F.lit(0.98)}
    assert value(spark, T.tiny_typo(row)) is True
    assert value(spark, T.tiny_typo({**row, "clean_text": F.lit('CÔ GÁI TÊN LÀ "RAN"')})) is False


@pytest.mark.parametrize(
    "reason,text,confidence,similarity,ocr,expected",
    [("ocr_typo", "A", 0.96, 0.95, 0.7, True), ("ocr_typo", "B", 0.96, 0.95, 0.7, False),
     ("proper_name_uncertain", "A", 0.99, 0.99, 0.9, False), ("fragmented_ocr", "A", 0.98, 0.97, 0.79, False),
     ("fragmented_ocr", "A", 0.98, 0.97, 0.80, True)],
)
def test_recovery_agreement(spark, reason, text, confidence, similarity, ocr, expected):
    row = {"clean_text": F.lit("A"), "reason_code": F.lit(reason), "text_similarity": F.lit(similarity),
           "ocr_confidence": F.lit(ocr), "confidence": F.lit(confidence)}
    answer = {"recovered_text": F.lit(text), "reason_code": F.lit("ocr_typo"), "confidence": F.lit(confidence)}
    assert value(spark, T.recovery_agrees(row, answer)) is expected


def _settle(spark, dialogues, corrections, recoveries, truth=(), regions=()):
    return {
        r.region_id: r
        for r in settle_dialogues(
            spark.createDataFrame(dialogues, DIALOGUE),
            spark.createDataFrame(corrections, "asset_id int, region_id int, clean_text string, confidence double, needs_review boolean, reason_code string"),
            spark.createDataFrame(recoveries, "asset_id int, region_id int, recovered_text string, confidence double, reason_code string, still_uncertain boolean"),
            spark.createDataFrame(list(truth), "asset_id int, region_id int, verified_text string"),
            spark.createDataFrame(list(regions), "asset_id int, region_id int, region_source string, needs_review boolean"),
        ).collect()
    }


def test_settled_page(spark):
    got = _settle(
        spark,
        [(1, 1, 1, "XIN CHÀO", 0.99, 0.99), (1, 2, 2, "NGUYỆN YẾU", 0.6, 0.6), (1, 3, 3, "rewrite me", 0.9, 0.9),
         (1, 4, 4, "twice", 0.5, 0.5), (1, 8, 5, "HÃY", 0.99, 0.99)],
        [(1, 2, "NGUYỆN YÊU", 0.9, False, "ocr_typo"), (1, 3, "other words", 0.9, False, "ocr_typo"), (1, 4, "twice!", 0.9, False, "ocr_typo")],
        [(1, 3, "found text", 0.95, "ocr_typo", False), (1, 4, "a", 0.99, "ocr_typo", False), (1, 4, "b", 0.99, "ocr_typo", False)],
        truth=[(1, 2, "NGUYỆN YÊU")],
        regions=[(1, 8, "vision_ocr_recovery", True), (1, 1, "original_layout", True)],
    )
    assert (got[1].decision, got[1].correction_path, got[1].correction_score) == ("auto_accepted", "fast_path", round(0.99 * 0.45 + 0.35 + 0.99 * 0.2, 3))
    assert (got[2].decision, got[2].clean_text, got[2].needs_review, got[2].human_verified) == ("verified", "NGUYỆN YÊU", False, True)
    assert (got[3].decision, got[3].clean_text, got[3].recovery_confidence) == ("auto_recovered", "found text", 0.95)
    # A repeated answer counts as none.
    assert (got[4].decision, got[4].clean_text, got[4].recovery_confidence) == ("needs_review", "twice!", 0.0)
    assert (got[8].decision, got[8].reason_code) == ("needs_review", D.VISUAL_REVIEW_CODE)


def test_one_uncertain_row_does_not_change_its_siblings(spark):
    rows = [(1, i, i, f"text number {i}", 0.95, 0.95) for i in range(1, 5)]
    alone = _settle(spark, rows[:1], [], [])
    together = _settle(spark, [*rows, (1, 9, 9, "?", 0.1, 0.1)], [], [])
    assert alone[1] == together[1]


@pytest.mark.parametrize(
    "raw,accepted",
    [('```json\n{"items":[{"region_id":1,"action":"unchanged","confidence":0.9,"decision":"accept","reason_code":"unchanged"}]}\n```', True),
     ('{"items":[{"region_id":1,"action":"unchanged","confidence":true,"decision":"accept","reason_code":"unchanged"}]}', False),
     ('{"items":[{"region_id":"1","action":"unchanged","confidence":1,"decision":"accept","reason_code":"unchanged"}]}', False),
     ('{"items":[{"region_id":1,"action":"changed","confidence":1,"decision":"accept","reason_code":"unchanged"}]}', False),
     ('{"items":[{"region_id":1,"action":"unchanged","confidence":1,"decision":"accept","reason_code":"unchanged"}, 3]}', False),
     ('{"items":[]}', False), ('[1]', False), ('{"items":[{"region_id":1', False)],
)
def test_compact_decode(spark, raw, accepted):
    originals = spark.createDataFrame([(1, 1, "A")], "asset_id int, region_id long, raw_text string")
    responses = spark.createDataFrame([(1, raw)], "asset_id int, raw_json string")
    row = D.decode_compact(originals, responses).first()
    assert row.response_accepted is accepted
    assert (row.clean_text, row.needs_review) == ("A", not accepted)


def test_attempts(spark):
    schema = "asset_id int, candidate_id string, rank int, source string, text string, confidence double, usable boolean, needs_review boolean"
    rows = spark.createDataFrame(
        [(1, "a", 1, "local_ocr_recovery", "Hãy", 0.95, None, None),
         (1, "b", 1, "local_ocr_recovery", " ", 0.0, None, None), (1, "b", 2, "vision_ocr_recovery", "Hãy", 0.62, True, None),
         (1, "c", 1, "local_ocr_recovery", "", 0.0, None, None), (1, "c", 2, "vision_ocr_recovery", None, 0.0, None, None)], schema)
    got = {r.candidate_id: (r.resolved, r.region_source, r.needs_review, r.issues) for r in D.rank_attempts(rows).collect()}
    assert got["a"] == (True, "local_ocr_recovery", False, [])
    assert got["b"] == (True, "vision_ocr_recovery", True, ["local_ocr_recovery_empty"])
    assert got["c"] == (False, "unresolved_visual_candidate", None, ["local_ocr_recovery_empty", "vision_ocr_recovery_empty"])


def test_boxes_without_an_area_are_never_resolved(spark):
    schema = "asset_id int, candidate_id string, rank int, source string, text string, confidence double, usable boolean, needs_review boolean"
    rows = spark.createDataFrame([(1, c, 1, "local_ocr_recovery", "Hãy", 0.95, None, None) for c in "abc"], schema)
    boxes = [(1, "a", 0, 0, 5, 5), (1, "b", 5, 0, 5, 9), (1, "c", 0, None, 5, 9), (1, "d", 4, 4, 1, 9), (1, "e", 0, 0, 1, 1)]
    boxes = spark.createDataFrame(boxes, "asset_id int, candidate_id string, x0 int, y0 int, x1 int, y1 int")
    got = {r.candidate_id: (r.resolved, r.region_source, r.text, r.issues) for r in D.rank_attempts(rows, candidates=boxes).collect()}
    refused = (False, "unresolved_visual_candidate", None, ["invalid_candidate_bbox"])
    assert got == {"a": (True, "local_ocr_recovery", "Hãy", []), "b": refused, "c": refused, "d": refused}


def test_a_split_keeps_what_is_known_of_a_region(spark):
    boxes = {0: (0, 0, 40, 20), 1: (400, 0, 450, 20), 2: (0, 0, 40, 20), 3: (500, 0, 540, 20)}
    cited = spark.createDataFrame([(1, 4, 0), (1, 4, 1), (2, 7, 2)], "asset_id int, region_id int, block_id int")
    regions = spark.createDataFrame(
        [(1, 4, "narration", 0.5, True, "vision"), (2, 7, "sfx", 0.7, None, "local_ocr_recovery"), (2, 8, "sfx", None, None, None)],
        "asset_id int, region_id int, type string, confidence double, needs_review boolean, region_source string")
    order = regions.select("asset_id", F.col("region_id").alias("pos"), "region_id")
    placed = spark.createDataFrame([(1, i, *boxes[i]) for i in (0, 1)] + [(2, i, *boxes[i]) for i in (2, 3)], _boxes(spark, boxes).schema)
    out = L.split_regions(regions, cited, placed, order)
    got = sorted((r.asset_id, r.region_id, r.type, r.confidence, r.needs_review, r.region_source) for r in out["regions"].collect())
    assert got == [
        (1, 4, "narration", 0.5, True, "geometry_split"), (1, 5, "narration", 0.5, True, "geometry_split"),
        (2, 7, "sfx", 0.7, None, "local_ocr_recovery"), (2, 8, "sfx", None, None, "original_layout"),
    ]


def _boxes(spark, boxes):
    return spark.createDataFrame([(1, i, *b) for i, b in boxes.items()], "asset_id int, block_id int, x0 int, y0 int, x1 int, y1 int")


def _split(spark, boxes, regions):
    cited = spark.createDataFrame([(1, r, b) for r, bs in regions.items() for b in bs], "asset_id int, region_id int, block_id int")
    known = cited.select("asset_id", "region_id").distinct()
    order = known.select("asset_id", F.col("region_id").alias("pos"), "region_id")
    out = L.split_regions(known, cited, _boxes(spark, boxes), order)
    blocks = sorted((r.region_id, r.block_id) for r in out["region_blocks"].collect())
    return blocks, {r.region_id: r.region_source for r in out["regions"].collect()}, sorted((r.pos, r.region_id) for r in out["reading_order"].collect()), sorted(
        (r.region_id, r.from_region_id) for r in out["split_sources"].collect())


def test_split_one_region(spark):
    boxes = {0: (0, 0, 40, 20), 1: (5, 25, 45, 45), 2: (400, 0, 450, 20)}
    blocks, sources, order, origin = _split(spark, boxes, {4: [0, 1, 2]})
    assert blocks == [(4, 0), (4, 1), (5, 2)]
    assert order == [(0, 4), (1, 5)] and set(sources.values()) == {"geometry_split"} and origin == [(4, 4), (5, 4)]


def test_split_regroups_across_regions(spark):
    boxes = {0: (0, 0, 40, 20), 1: (400, 0, 450, 20), 2: (5, 25, 45, 45)}
    blocks, _, _, origin = _split(spark, boxes, {1: [0], 2: [1, 2]})
    assert blocks == [(1, 0), (1, 2), (2, 1)]
    assert (1, 1) in origin and (1, 2) in origin


def test_split_leaves_pages_with_missing_boxes(spark):
    blocks, sources, _, origin = _split(spark, {0: (0, 0, 40, 20), 1: (400, 0, 450, 20)}, {1: [0, 1, 2]})
    assert blocks == [(1, 0), (1, 1), (1, 2)] and sources == {1: "original_layout"} and origin == []


def test_partition_check(spark):
    before = spark.createDataFrame([(1, 0), (1, 1)], "asset_id int, block_id int")

    def check(*rows):
        return L.partition_preserved(before, spark.createDataFrame(rows, "asset_id int, cluster int, block_id int")).first().valid_split

    assert check((1, 0, 0), (1, 1, 1)) is True
    assert check((1, 0, 0), (1, 1, 0)) is False
    assert check((1, 0, 0)) is False


def test_suppression(spark):
    rows = spark.createDataFrame(
        [(1, 0, 0, 20, 20, 0.9), (1, 1, 1, 21, 21, 0.8), (1, 0, 0, 20, 20, 0.5), (1, 100, 0, 120, 20, 0.1)],
        "asset_id int, x0 int, y0 int, x1 int, y1 int, confidence double")
    got = sorted((r.x0, r.confidence) for r in L.distinct_candidates(rows).collect())
    assert got == [(0, 0.9), (100, 0.1)]


def test_recovered_region_goes_before_its_right_neighbour(spark):
    order = spark.createDataFrame([(1, 0, 1)], "asset_id int, pos int, region_id int")
    centres = spark.createDataFrame([(1, 1, 115.0, 110.0)], "asset_id int, region_id int, center_x double, center_y double")
    new = spark.createDataFrame([(1, 1, 2, 20, 100, 60, 120)], "asset_id int, seq int, region_id int, x0 int, y0 int, x1 int, y1 int")
    got = sorted((r.pos, r.region_id) for r in L.insert_by_position(order, centres, new).collect())
    assert got == [(0, 2), (1, 1)]


def test_region_box(spark):
    cited = spark.createDataFrame([(1, 8, 1)], "asset_id int, region_id int, block_id int")
    row = D.region_boxes(cited, _boxes(spark, {1: (20, 30, 50, 60), 2: (0, 0, 9, 9)})).first()
    assert (row.x0, row.y0, row.x1, row.y1, row.center_x) == (20, 30, 50, 60, 35.0)


def test_authoritative_text(spark):
    base = {"decision": F.lit("auto_recovered"), "human_verified": F.lit(False), "verified_text": F.lit("V"),
            "recovered_text": F.lit(" R "), "clean_text": F.lit("C")}

    def pick(**changes):
        row = value(spark, T.authoritative_text({**base, **changes}))
        return row.text, row.source

    none = F.lit(None).cast("string")
    assert pick() == ("R", "recovered")
    assert pick(decision=F.lit("verified")) == ("V", "verified")
    assert pick(human_verified=F.lit(True), verified_text=F.lit("  ")) == (None, None)
    assert pick(recovered_text=F.lit("")) == ("C", "clean")
    assert pick(recovered_text=none, clean_text=none) == (None, None)


def test_verification_is_idempotent(spark):
    none = None
    dialogues = spark.createDataFrame(
        [(1, 2, "raw 2", "clean 2", False, "auto_accepted", none, none, none, 0.9, none),
         (1, 3, "raw 3", "clean 3", True, "needs_review", none, none, "rec 3", 0.5, 0.4)],
        "asset_id int, region_id int, raw_text string, clean_text string, needs_review boolean, decision string, verified_text string, human_verified boolean, recovered_text string, correction_score double, recovery_confidence double")
    stored = spark.createDataFrame([], "asset_id int, region_id int, raw_text string, ai_text string, verified_text string, correction_score double, recovery_confidence double")
    feed = spark.createDataFrame([(1, 3, "first", 1), (1, 3, " last ", 2), (1, 2, " ", 3), (1, 9, "x", 4)], "asset_id int, region_id int, verified_text string, version int")
    updated, truth, status, rejected = D.verify_dialogues(dialogues, stored, feed)
    again, truth2, _, _ = D.verify_dialogues(updated.select(dialogues.columns), truth, feed)
    assert [(r.region_id, r.verified_text, r.ai_text) for r in truth.collect()] == [(3, "last", "rec 3")]
    assert truth2.count() == 1
    rows = {r.region_id: r for r in updated.collect()}
    assert (rows[3].decision, rows[3].clean_text, rows[3].needs_review) == ("verified", "last", False)
    assert (rows[2].decision, rows[2].clean_text) == ("auto_accepted", "clean 2")
    assert status.first().dialogue_status == "completed"
    assert sorted(r.reason for r in rejected.collect()) == ["empty_text", "unknown_region"]


def test_project_delete(spark):
    tables = {
        "projects": spark.createDataFrame([("a",), ("b",)], "project_id string"),
        "assets": spark.createDataFrame([("a", 1), ("b", 2)], "project_id string, asset_id int"),
        "ground_truth": spark.createDataFrame([(1, 1), (2, 1)], "asset_id int, region_id int"),
    }
    kept = without_projects(spark.createDataFrame([("a",)], "project_id string"), tables)
    assert [r.project_id for r in kept["projects"].collect()] == ["b"]
    assert [r.asset_id for r in kept["assets"].collect()] == [2]
    assert [r.asset_id for r in kept["ground_truth"].collect()] == [2]


def test_natural_order(spark):
    names = ["p10.jpg", "P1.png", "p2a.jpg", "p2.jpg", "p007.webp"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").orderBy(natural_key(F.col("n"))).collect()
    assert [r.n for r in rows] == ["P1.png", "p2.jpg", "p2a.jpg", "p007.webp", "p10.jpg"]
