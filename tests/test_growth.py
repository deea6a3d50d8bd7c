"""Steps whose cost must follow the rows: what travels with them and how often they are evaluated."""

import random
import time
import unicodedata

import duckdb
from pyspark.sql import functions as F

from pagetrace.functions import text as T
from pagetrace.operators import grounding as G
from pagetrace.operators import layout as L
from pagetrace.operators import story_input as S
from pagetrace.operators.components import PAGE_BOUND, box_components
from pagetrace.operators.numbering import number_rows, number_short_keys
from pagetrace.plans.page import layout_quality, placed_quality
from pagetrace.sources.lenses import lens
from pagetrace.suite.registry import registered
from tests.oracle import ROOT, compare


def queries():
    return {name: fn for name, (fn, _) in registered().items()}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_anchors_travel_without_texts(spark):
    claims = spark.createDataFrame(
        [(1, "e", "a", "ANNA MET BOB", ["BOB"]), (1, "e", "b", "NOBODY", None), (2, "e", "a", "ANNA", ["ANNA"])],
        "project_id int, event_id string, claim_id string, _norm string, source_texts array<string>",
    )
    names = spark.createDataFrame([(1, "ANNA", "Anna", "ANNA"), (1, "BOB", "Bob", "BOB"), (2, "ANNA", "Anna", "ANNA")], "project_id int, normalized string, name string, anchor string")
    found = G._foreign_names(claims, names)
    assert [tuple(r) for r in found.collect()] == [(1, "e", "a", "ANNA", "Anna")]
    assert not [line for line in plan(found).splitlines() if "Generate" in line and "source_texts" in line.split("), [")[-1]]


def test_classes_of_many_ranges_stand_behind_a_cheap_test(spark):
    assert T._combining().startswith("(?!")
    codes = [c for c in range(1, 0x1FBFF) if not 0xD800 <= c <= 0xDFFF]
    frame = spark.createDataFrame([(c, chr(c)) for c in codes], "code int, c string")
    hit = {r.code for r in frame.where(F.col("c").rlike(T._combining())).collect()}
    assert hit == {c for c in codes if c >= 0x300 and unicodedata.combining(chr(c))}
    spelled = {ord(c) for c, _ in T._compatible()[2]}
    hit = {r.code for r in frame.where(F.col("c").rlike(T._seldom(sorted(spelled)))).collect()}
    assert hit == spelled


def test_small_pages_close_in_batches(spark):
    rows = [("p", "b", 0, 0, 10, 10), ("p", "a", 0, 20, 10, 30), ("p", "c", 500, 500, 510, 510), (None, "a", 0, 0, 9, 9), ("q", "z", None, 0, None, 9)]
    found = box_components(spark.createDataFrame(rows, "asset_id string, block_id string, x0 int, y0 int, x1 int, y1 int"))
    assert "MapInArrow" in plan(found)
    assert {tuple(r) for r in found.collect()} == {("p", "b", "a"), ("p", "a", "a"), ("p", "c", "c"), (None, "a", "a"), ("q", "z", "z")}


def test_edit_distance_goes_by_words_where_it_may(spark):
    rng = random.Random(3)
    rows = [("", ""), (None, "a"), ("a", None), ("abc", ""), ("Đi ngay", "đi ngày"), ("a b ", "a b"), ("ab c", "b ac"), ("x  y", "x y z"), ("you out", "yo ot")]
    for size, changes in [(20, 3), (400, 12), (400, 60), (700, 400), (300, 2000)]:
        text = [rng.choice("abcđê ") for _ in range(size)]
        other = list(text)
        for _ in range(changes):
            other.insert(rng.randrange(len(other) + 1), rng.choice("xyz"))
        rows += [("".join(text), "".join(other)), ("".join(other), "".join(text)), ("".join(text), "".join(other[::-1]))]
    frame = spark.createDataFrame(rows, "a string, b string")
    a, b = F.lower("a"), F.lower("b")
    assert frame.where(~T.edit_distance(a, b).eqNullSafe(F.levenshtein(a, b))).count() == 0
    # Not literals, which would be folded with all their branches.
    long = spark.range(6000, 6001).selectExpr("repeat('you found our house ', cast(id AS int)) AS a", "repeat('yo fond or hose ', cast(id AS int)) AS b")
    began = time.time()
    assert long.select(T.edit_distance(F.col("a"), F.col("b"))).first()[0] == 24000
    assert time.time() - began < 15


def test_boxes_are_dealt_before_they_are_grouped(spark):
    text = plan(lens(spark, f"{ROOT}/sf0.001", "boxes"))
    above, below = text.split("Exchange", 1)
    assert "Aggregate" in above and "Aggregate" not in below and "Exchange" not in below


def test_small_pages_settle_in_one_stage(spark):
    nan, one = float("nan"), (0, 0, 100, 100)
    rows = [
        (1, *one, 0.5), (1, *one, None), (1, 0, 0, 100, 90, 0.9), (1, 500, 500, 600, 600, 0.1),
        (2, *one, None), (2, 0, 0, 100, 99, 0.9), (2, 5, 5, 5, 5, 0.2), (2, 5, 5, 5, 5, 0.3), (2, 7, 7, 7, 7, 0.3),
        (3, *one, nan), (3, *one, 0.4), (3, 0, 0, 100, 98, 0.1), (4, None, 0, 9, 9, 0.4), (4, None, 0, 9, 9, 0.6), (4, 0, 0, 9, 9, 0.5),
        (5, *one, 0.5), (5, 1, 0, 101, 100, 0.5), (5, 40, 0, 140, 100, 0.5), (5, 41, 0, 141, 100, 0.5),
    ]
    frame = spark.createDataFrame(rows, "asset_id int, x0 int, y0 int, x1 int, y1 int, confidence double")
    found = L.distinct_candidates(frame)
    assert "MapInArrow" in plan(found)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, L.distinct_candidates(frame, bound=0).collect()))
    nameless = frame.withColumn("asset_id", F.lit(None).cast("int")).where("x0 = 0 AND confidence = 0.9")
    assert [tuple(r) for r in L.distinct_candidates(nameless).collect()] == [(None, 0, 0, 100, 90, 0.9)]


def test_split_check_joins_nothing(spark):
    before = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 2), (None, 1), (None, 2), (4, 1), (5, 1), (5, 2)], "asset_id int, block_id int")
    rows = [(1, 1, 1), (1, 2, 2), (2, 7, 1), (2, 7, 2), (3, 1, 1), (3, 2, 2), (3, 3, 2), (None, 1, 1), (None, 2, 2), (5, 1, 1), (5, None, 2), (6, 1, 1)]
    found = L.partition_preserved(before, spark.createDataFrame(rows, "asset_id int, cluster int, block_id int"))
    assert "Join" not in plan(found)
    assert {tuple(r) for r in found.collect()} == {(1, True), (2, False), (3, False), (None, False), (4, False), (5, False), (6, False)}


def test_insertion_of_small_pages_needs_no_joins(spark):
    rng = random.Random(8)
    order, centres, new = [], [], []
    for page in range(40):
        name = None if page == 0 else f"p{page}"
        for i in range(rng.randrange(0, 9)):
            order.append((name, 2 * i + 3, f"r{i}"))
            for _ in range(rng.choice([0, 1, 1, 1, 2])):
                centres.append((name, f"r{i}", rng.randrange(0, 600) / 2, rng.randrange(0, 600) / 2))
        centres.append((name, "unknown", 300.0, 300.0))
        for seq in range(rng.randrange(0, 6)):
            x, y = rng.randrange(0, 250), rng.choice([None, *range(0, 250, 10)])
            new.append((name, seq * 5, f"n{seq}", x, y, x + 30, None if y is None else y + rng.randrange(10, 90)))
    inputs = [
        spark.createDataFrame(order, "asset_id string, pos int, region_id string"),
        spark.createDataFrame(centres, "asset_id string, region_id string, center_x double, center_y double"),
        spark.createDataFrame(new, "asset_id string, seq int, region_id string, x0 int, y0 int, x1 int, y1 int"),
    ]
    found = L.insert_by_position(*inputs)
    assert "MapInArrow" in plan(found) and "Join" not in plan(found)
    named = found.where("asset_id IS NOT NULL")
    assert sorted(map(tuple, named.collect())) == sorted(map(tuple, L.insert_by_position(*[f.where("asset_id IS NOT NULL") for f in inputs], bound=0).collect()))
    assert found.where("asset_id IS NULL").count() == sum(r[0] is None for r in order + new)


def test_numbering_shares_one_shuffle_with_its_join(spark):
    rows = spark.range(100).selectExpr("id % 3 AS k", "id AS o")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        text = plan(number_rows(rows, ["k"], [F.col("o")], bucket=F.floor(F.col("o") / 8)))
        assert text.count("Exchange hashpartitioning") == 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = sorted(map(tuple, number_rows(rows, ["k"], [F.col("o")], bucket=F.floor(F.col("o") / 8)).collect()))
    for bound in (5, 2**16):
        assert sorted(map(tuple, number_short_keys(rows, ["k"], [F.col("o")], bucket=F.floor(F.col("o") / 8), bound=bound).collect())) == want


def test_region_types_meet_dialogues_in_the_page(spark):
    def lines(*ids):
        return "[" + ",".join(f'{{"region_id":{i},"order":{n},"decision":"auto_accepted","clean_text":"t"}}' for n, i in enumerate(ids, 1)) + "]"

    big = 2**62
    listed = f'[{{"id":2,"type":"sfx"}},{{"id":2,"type":"thought"}},{{"id":2,"type":7}},{{"id":"3","type":"sfx"}},{{"id":-4,"type":"sfx"}},{{"id":{big},"type":"note"}},5]'
    rows = [
        ("a", 1, lines(2, 3, big, 0, 9), listed), ("a", 2, lines(2, 1), '[{"id":1,"type":"narration"}]'), ("a", 3, lines(1), "{broken"),
        ("a", 4, lines(1), None), ("a", 5, "[1]", listed), ("a", 6, None, listed), ("a", None, lines(1), '[{"id":1,"type":"sfx"}]'), ("a", 8, lines(2), "[]"),
    ]
    pages = spark.createDataFrame(rows, "project_id string, asset_id int, dialogues string, vision_regions string").selectExpr(
        "project_id", "asset_id", "1 AS page_order", "'ready' AS status", "'completed' AS vision_status", "'completed' AS dialogue_status", "dialogues", "vision_regions"
    )
    found = S.decode_pages(pages)
    assert {(r.asset_id, r.idx): r.region_type for r in found.collect()} == {
        (1, 0): "thought", (1, 1): None, (1, 2): "note", (1, 3): None, (1, 4): None, (2, 0): None, (2, 1): "narration",
        (3, 0): None, (4, 0): None, (5, None): None, (6, None): None, (None, 0): "sfx", (8, 0): None,
    }
    assert "Join" not in plan(S.dialogue_rows(pages.withColumn("stop_code", F.lit(None).cast("string"))))


def _random_layout(spark):
    """Pages with missing, repeated and half boxes, blocks cited twice or not at all, regions listed twice or without a block."""
    rng = random.Random(11)
    regions, cited, boxes, order = [], [], [], []
    for page in range(60):
        name = None if page == 0 else f"p{page}"
        for block in range(rng.randrange(0, 12)):
            x, y = rng.randrange(0, 260), rng.randrange(0, 260)
            if rng.random() < 0.99:
                boxes += [(name, block, x, y if rng.random() < 0.99 else None, x + 30, y + 20)] * rng.choice([1] * 60 + [2])
            cited.append((name, rng.choice([1, 2, 5]), block))
            if rng.random() < 0.01:
                cited.append((name, 5, block))
        for region in (1, 2, 5, 9):
            regions += [(name, region, rng.choice(["sfx", None]), f"{name}-{region}-{i}", rng.choice(["vision", None])) for i in range(rng.choice([1] * 8 + [0, 2]))]
            order.append((name, region + 3, region))
    return [
        spark.createDataFrame(regions, "asset_id string, region_id int, type string, label string, region_source string"),
        spark.createDataFrame(cited, "asset_id string, region_id int, block_id long"),
        spark.createDataFrame(boxes, "asset_id string, block_id long, x0 int, y0 int, x1 int, y1 int"),
        spark.createDataFrame(order, "asset_id string, pos int, region_id int"),
    ]


def _same_split(found, wanted):
    for name, rows in wanted.items():
        assert found[name].columns == rows.columns and found[name].dtypes == rows.dtypes
        assert sorted(found[name].collect(), key=repr) == sorted(rows.collect(), key=repr), name


def test_split_of_small_pages_needs_one_shuffle_and_no_steps(spark):
    layout = _random_layout(spark)
    found = L.split_regions(*layout)
    wanted = L.split_regions(*layout, bound=0)
    _same_split(found, wanted)
    assert found["split_sources"].count() > 20 and found["regions"].where("region_source = 'vision'").count() > 0
    text = plan(queries()["split_region_sources"](spark, f"{ROOT}/sf0.001"))
    assert text.count("Exchange ") == 1 and "MapInArrow" in text and "Join" not in text


def _folder_with_a_large_page(tmp_path):
    """Lines of sf0.001 of which some hundred lie on one page."""
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT * REPLACE (CASE WHEN l_orderkey < 60 THEN 7 ELSE l_orderkey END AS l_orderkey)
        FROM '{ROOT}/sf0.001/lineitem.parquet') TO '{tmp_path}/lineitem.parquet'""")
    con.execute(f"CREATE VIEW lineitem AS FROM '{tmp_path}/lineitem.parquet'")
    assert con.execute("SELECT count(*) FROM lineitem WHERE l_orderkey = 7").fetchone()[0] > 2 * PAGE_BOUND
    return con


def test_a_large_page_is_split_beside_small_ones(spark, tmp_path):
    con = _folder_with_a_large_page(tmp_path)
    assert compare(spark, con, str(tmp_path), *registered()["split_merged_regions"])[0] is None
    text = plan(queries()["split_merged_regions"](spark, f"{ROOT}/sf0.001"))
    assert text.count("Exchange ") == 1 and "Join" not in text


def test_reading_order_of_split_pages_is_read_in_one_shuffle(spark, tmp_path):
    con = _folder_with_a_large_page(tmp_path)
    assert compare(spark, con, str(tmp_path), *registered()["split_reading_order"])[0] is None
    text = plan(queries()["split_reading_order"](spark, f"{ROOT}/sf0.001"))
    assert text.count("Exchange ") == 1 and "Join" not in text


def _random_placed(spark):
    """Citations with their boxes, candidates and readings: overlaps, equal and empty boxes, missing sides, a block cited twice."""
    rng = random.Random(5)
    placed, candidates, attempts = [], [], []

    def box(gap):
        x, y, w, h = rng.randrange(0, 260, 10), rng.randrange(0, 260, 10), rng.choice([30, 60]), rng.choice([20, 40])
        sides = [x, y, x + w, y + h]
        return [None if rng.random() < gap else s for s in sides]

    for page in range(80):
        name = None if page == 0 else f"p{page}"
        blocks = [(name, rng.choice([1, 2, 5]), block * 7, *box(0.003), rng.choice([0.1, 0.9, None])) for block in range(rng.randrange(0, 9))]
        placed += blocks + ([(name, 2, *blocks[0][2:])] if blocks and page % 13 == 5 else [])
        for i in range(rng.randrange(0, 7)):
            sides = box(0.01)
            if rng.random() < 0.05:
                sides[2] = sides[0]
            core = sides if rng.random() < 0.7 else box(0)
            for twin in range(rng.choice([1, 1, 1, 2])):
                candidates.append((name, f"c{i}-{twin}", *sides, *core, rng.choice([0.5, 0.7, 0.7, None])))
                for rank in range(rng.choice([0, 1, 1, 2])):
                    attempts.append((name, f"c{i}-{twin}", rank, f"s{rank}", rng.choice(["Hãy", " ", "đi"]), rng.choice([0.3, 0.95, None]), rng.choice([True, None, False]), rng.choice([True, False, None])))
    sides = "x0 int, y0 int, x1 int, y1 int"
    cores = ", ".join("core_" + s for s in sides.split(", "))
    return (
        spark.createDataFrame([(f"p{i}",) for i in range(1, 85)], "asset_id string"),
        spark.createDataFrame(placed, f"asset_id string, region_id int, block_id long, {sides}, confidence double"),
        spark.createDataFrame(candidates, f"asset_id string, candidate_id string, {sides}, {cores}, confidence double"),
        spark.createDataFrame(attempts, "asset_id string, candidate_id string, rank int, source string, text string, confidence double, usable boolean, needs_review boolean"),
    )


def test_quality_of_small_pages_equals_the_general_way(spark):
    pages, placed, candidates, attempts = _random_placed(spark)
    cited = placed.select("asset_id", "region_id", "block_id")
    blocks = placed.drop("region_id").dropDuplicates(["asset_id", "block_id"]).withColumn("text", F.lit("t"))
    regions = cited.select("asset_id", "region_id").distinct()
    order = regions.select("asset_id", (F.col("region_id") - 1).alias("pos"), "region_id")
    wanted = layout_quality(pages, blocks, blocks, regions, cited, order, candidates, attempts)
    wanted = {name: sorted(wanted[name].collect(), key=repr) for name in ("regions", "reading_order", "order_check", "no_dialogue")}
    sources = [r.region_source for r in wanted["regions"]]
    assert min(sources.count(s) for s in ("original_layout", "geometry_split", "s0")) > 10 and {r.valid_order for r in wanted["order_check"]} == {True}
    hot = placed.select("asset_id").distinct().where("substr(asset_id, 2) % 7 = 3")
    for large in (None, hot):
        found = placed_quality(pages, placed, candidates, attempts, large)
        for name, rows in wanted.items():
            assert found[name].columns == (list(rows[0].__fields__))
            assert sorted(found[name].collect(), key=repr) == rows, name


def test_layout_quality_deals_each_table_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        text = plan(queries()["layout_quality_summary"](spark, f"{ROOT}/sf0.001"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Of rows: lines for boxes, candidates and attempts of two results, boxes and pages of the third. The others hold totals.
    assert text.count("REPARTITION_BY_NUM") == 8 and text.count("ENSURE_REQUIREMENTS") == 3


def test_documents_without_a_source_are_a_project(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT * REPLACE (CASE WHEN doc_id % 3 > 0 THEN source END AS source) FROM '{ROOT}/sf0.001/documents.parquet')
        TO '{tmp_path}/documents.parquet'""")
    con.execute(f"COPY (FROM '{ROOT}/sf0.001/region.parquet') TO '{tmp_path}/region.parquet'")
    for name in ("documents", "region"):
        con.execute(f"CREATE VIEW {name} AS FROM '{tmp_path}/{name}.parquet'")
    assert compare(spark, con, str(tmp_path), *registered()["story_input_issues"])[0] is None
