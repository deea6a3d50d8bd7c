"""Small rules that no registered query isolates."""

import pytest
from pyspark.sql import functions as F

from pagetrace.functions import text as T
from pagetrace.functions.boxes import corners_box
from pagetrace.operators import coverage as V
from pagetrace.operators import grounding as G
from pagetrace.operators import layout as L
from pagetrace.operators import story_input as S
from pagetrace.operators.catalog import extension


def one(spark, expression):
    return spark.range(1).select(expression.alias("v")).first().v


def test_box_of_corners(spark):
    rows = spark.createDataFrame([(1, [[1, 5], [9, 2], [4, 8], [3, 3]]), (2, [[1, 2], [3]]), (3, []), (4, None)], "id int, box array<array<int>>")
    got = {r.id: r.b and tuple(r.b) for r in rows.select("id", corners_box(F.col("box")).alias("b")).collect()}
    assert got == {1: (1, 2, 9, 8), 2: None, 3: None, 4: None}


@pytest.mark.parametrize("name,expected", [("a.JPG", ".jpg"), ("b.tar.png", ".png"), ("noext", ""), (".hidden", ""), ("dir.x/file", "")])
def test_extension(spark, name, expected):
    assert one(spark, extension(F.lit(name))) == expected


@pytest.mark.parametrize(
    "text,evidence,excluded",
    [("Đi thôi *TRANS NOTE: x", "Đi thôi", "*TRANS NOTE: x"), (" plain ", "plain", None), ("trans  note: all", "", "trans  note: all"),
     ("transport notes", "transport notes", None)],
)
def test_translator_notes(spark, text, evidence, excluded):
    assert one(spark, T.evidence_text(F.lit(text))) == evidence
    assert one(spark, T.excluded_text(F.lit(text))) == excluded


@pytest.mark.parametrize(
    "text,kind,role",
    [("hi", " Speech_Bubble ", "dialogue"), ("hi", None, "other"), ("You unlocked it", "dialogue", "game_ui"), ("*trans note: x", "dialogue", "translator_note"),
     ("bang", "sfx", "sfx"), ("x", "note", "other")],
)
def test_text_roles(spark, text, kind, role):
    assert one(spark, T.text_role(F.lit(text), F.lit(kind).cast("string"))) == role


@pytest.mark.parametrize("text,found", [("VI SAO", True), ("VIET", False), ("RESULT IN", True), ("ĐVI", False), ("IT CAUSES", True), ("BECAUSES", False)])
def test_causality(spark, text, found):
    assert one(spark, T.states_causality(T.normalize_name(F.lit(text)))) is found


@pytest.mark.parametrize("raw,plain", [("```json\n{}\n```", "{}"), ("```\n{}", "{}"), (" {} ", "{}"), ("```", "")])
def test_fences(spark, raw, plain):
    assert one(spark, T.unfenced(F.lit(raw))) == plain


def test_index_and_structure_gates(spark):
    pages = spark.createDataFrame([("p", "a", 1), ("p", "a", 2)], "project_id string, asset_id string, page_order int")
    evidence = spark.createDataFrame([("p", "b", 1), ("p", "b", 1), ("p", "b", 2)], "project_id string, asset_id string, region_id int")
    got = {(r.asset_id, r.region_id, r.problem) for r in G.source_index_problems(pages, evidence).collect()}
    assert got == {("a", None, "duplicate_asset"), ("b", 1, "duplicate_region")}
    issues = spark.createDataFrame([("q", "x")], "project_id string, code string")
    projects = spark.createDataFrame([("p",), ("q",)], "project_id string")
    assert [r.project_id for r in G.well_formed_projects(projects, issues).collect()] == ["p"]
    assert [r.code for r in S.unknown_projects(spark.createDataFrame([("z",), ("p",)], "project_id string"), projects).collect()] == ["project_not_found"]


def test_slot_collisions(spark):
    slots = spark.createDataFrame([("p", "e1"), ("p", "e2")], "project_id string, event_id string")
    assert [r.event_id for r in V.slot_collisions(slots, slots.where("event_id = 'e2'")).collect()] == ["e2"]


def test_repeated_references_count_once_accepted(spark):
    """A rejected repeat does not block later rows: only accepted references count as seen."""
    import json

    rows = [
        {"region_id": 1, "order": 1, "decision": "auto_accepted", "clean_text": "a"},
        {"region_id": 1, "order": 2, "decision": "auto_accepted", "clean_text": "b"},
        {"region_id": 2, "order": 2, "decision": "auto_accepted", "clean_text": "c"},
        {"region_id": 3, "order": 1, "decision": "auto_accepted", "clean_text": "d"},
    ]
    assets = spark.createDataFrame(
        [("p", "a", 1, "ready", "completed", "completed", json.dumps(rows), "[]")],
        "project_id string, asset_id string, page_order int, status string, vision_status string, dialogue_status string, dialogues string, vision_regions string")
    out = S.build_story_input(assets.select("project_id"), assets)
    assert sorted(r.code for r in out["issues"].collect()) == ["duplicate_dialogue_reference"] * 2
    assert out["projects"].first().status == "blocked" and out["evidence"].count() == 0


def test_repeats_in_a_long_page_take_linear_work():
    """Every reference occurs twice; the second of each repeats the first, and rejected ones do not count."""
    import time

    import pyarrow as pa

    n = 100_000
    regions = [i // 2 for i in range(n)] + [None]
    orders = [i for i in range(n)] + [1]
    start = time.perf_counter()
    flags = S._repeats_in_order.func(pa.array([regions, None, [1, 1, 2, 3]]), pa.array([orders, None, [1, 2, 2, 1]])).to_pylist()
    assert time.perf_counter() - start < 5
    assert flags == [[i % 2 == 1 for i in range(n)] + [False], None, [False, True, False, True]]


def test_blocked_project_does_not_block_another(spark):
    import json

    def asset(project, asset_id, order, status="ready", text="x"):
        rows = [{"region_id": 1, "order": 1, "decision": "auto_accepted", "clean_text": text}]
        return (project, asset_id, order, status, "completed", "completed", json.dumps(rows), '[{"id":1,"type":"narration"}]')

    assets = spark.createDataFrame(
        [asset("p", "a", 1), asset("p", "b", 1), asset("q", "c", 1), asset("q", "d", 2, status="excluded"), asset("r", "e", 1, status="failed")],
        "project_id string, asset_id string, page_order int, status string, vision_status string, dialogue_status string, dialogues string, vision_regions string")
    out = S.build_story_input(assets.select("project_id").distinct(), assets)
    assert {r.project_id: r.status for r in out["projects"].collect()} == {"p": "blocked", "q": "ready", "r": "blocked"}
    assert [(r.asset_id, r.text_role, r.text_source) for r in out["evidence"].collect()] == [("c", "narration", "clean")]
    assert sorted((r.project_id, r.code, r.severity) for r in out["issues"].collect()) == [
        ("p", "duplicate_page_order", "error"), ("q", "asset_excluded", "warning"), ("r", "asset_not_ready", "error")]


def test_stroke_gate(spark):
    schema = "asset_id int, page_width int, page_height int, x int, y int, w int, h int, grouped_area int, component_count int, dark_density double, ring_density double"
    good = (1, 900, 1280, 100, 200, 40, 20, 500, 6, 0.15, 0.01)
    rows = [good, (2, *good[1:8], 8, *good[9:]), (3, *good[1:9], 0.3, 0.01), (4, *good[1:10], 0.05), (5, 900, 1280, 100, 200, 90, 20, 500, 6, 0.15, 0.01)]
    got = L.text_candidates(spark.createDataFrame(rows, schema)).collect()
    assert [(r.asset_id, r.x0, r.y0, r.x1, r.y1, r.confidence) for r in got] == [(1, 88, 188, 152, 232, round(min(0.9, 0.72 + 0.12 + 0.04 * (1 - 0.25)), 3))]


def test_decomposed_and_other_scripts_equal_the_unicode_rules(spark):
    import re
    import unicodedata as u

    from pagetrace.functions import text as T

    words = ["à nhà trường đẹp quá", "Việt Nam ậ ế ữ ợ", "ﬁn ﬂow ſt", "Ώ ά й ё", "ｆｕｌｌ ２３", "ệ ệ", "कि हिन्दी", "ก็ที่", "x́y", "\u0301start", "𝐁𝐨𝐥𝐝 ²", "ǆ ŉa ĳs", "a⃝ b"]
    rows = sorted({form for w in words for form in (w, *(u.normalize(f, w) for f in ("NFC", "NFD", "NFKC", "NFKD")))})

    def name(value):
        return " ".join("".join(c for c in u.normalize("NFKD", value) if not u.combining(c)).upper().split())

    def tokens(value):
        return {t for t in re.findall(r"[^\W_]+", u.normalize("NFKC", value).casefold()) if len(t) > 1}

    frame = spark.createDataFrame([(r,) for r in rows], "t string")
    for r in frame.select("t", T.normalize_name(F.col("t")).alias("n"), T.semantic_tokens(F.col("t")).alias("s")).collect():
        assert (r.n, set(r.s)) == (name(r.t), tokens(r.t)), r.t


def test_issues_of_one_place_have_an_order(spark):
    codes = ["duplicate_page_order", "asset_not_ready", "invalid_dialogue_reference", "duplicate_dialogue_reference"]
    schema = "project_id string, asset_id int, page_order int, region_id int, code string, severity string"
    for listed in (codes, codes[::-1]):
        rows = spark.createDataFrame([("p", 1, 1, None, c, "error") for c in listed], schema).coalesce(1)
        assert [r.code for r in S.sorted_issues(rows).collect()] == sorted(codes)
