"""Operators that spread one large group, against brute force on the whole group."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagetrace.functions.json import strict_json
from pagetrace.functions.numeric import round_exact
from pagetrace.operators import layout as L
from pagetrace.operators.components import box_components
from pagetrace.operators.numbering import number_rows, with_neighbours
from pagetrace.operators.telemetry import page_statistics
from tests.test_components import expected, near_boxes


def test_page_with_most_of_the_rows(spark):
    rng = random.Random(3)
    boxes = []
    for block in range(1500):
        x, y = rng.randrange(0, 6000), rng.randrange(0, 6000)
        boxes.append((block, (x, y, x + rng.randrange(5, 70), y + rng.randrange(8, 30))))
    pages = {0: boxes, 1: boxes[:5], 2: boxes[5:9]}
    rows = [(p, b, *box) for p, items in pages.items() for b, box in items]
    frame = spark.createDataFrame(rows, "asset_id int, block_id int, x0 int, y0 int, x1 int, y1 int")
    got = {(r.asset_id, r.block_id, r.component) for r in box_components(frame).collect()}
    assert got == expected(pages, near_boxes)


@pytest.mark.parametrize("width", [None, 7])
def test_numbering(spark, width):
    bucket = None if width is None else F.floor(F.col("o") / width)
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else f"k{i % 5}", rng.randrange(100), i) for i in range(600)]
    frame = spark.createDataFrame(rows, "k string, o int, id int")
    got = number_rows(frame, ["k"], [F.col("o"), F.col("id")], bucket=bucket)
    want = frame.withColumn("position", F.row_number().over(W.partitionBy("k").orderBy("o", "id")).cast("long"))
    assert sorted(map(tuple, got.select("k", "o", "id", "position").collect())) == sorted(map(tuple, want.collect()))


def test_neighbours_across_buckets(spark):
    rows = [("a", o) for o in (1, 2, 9, 10, 55, 56, 57)] + [("b", 3)]
    frame = spark.createDataFrame(rows, "k string, o int")
    got = with_neighbours(frame, ["k"], "o", ["o"], span=5)
    seen = {(r.k, r.o): (r.previous and r.previous.o, r.next and r.next.o) for r in got.collect()}
    assert seen[("a", 9)] == (2, 10) and seen[("a", 55)] == (10, 56) and seen[("a", 1)] == (None, 2)
    assert seen[("b", 3)] == (None, None)


def _iou(a, b):
    w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / union if union > 0 else 0.0


@pytest.mark.parametrize("bound", [64, 0])
def test_suppression_equals_greedy(spark, bound):
    rng = random.Random(9)
    rows = []
    for page in range(4):
        for _ in range(80):
            x, y = rng.randrange(0, 300), rng.randrange(0, 300)
            rows.append((page, x, y, x + rng.randrange(20, 80), y + rng.randrange(20, 80), rng.randrange(10) / 10))
    want = set()
    for page in range(4):
        kept = []
        for row in sorted((r for r in rows if r[0] == page), key=lambda r: (-r[5], r[1:5])):
            if all(_iou(row[1:5], k[1:5]) < 0.35 for k in kept):
                kept.append(row)
        want |= {(r[0], *r[1:6]) for r in kept}
    frame = spark.createDataFrame(rows, "asset_id int, x0 int, y0 int, x1 int, y1 int, confidence double")
    assert {tuple(r) for r in L.distinct_candidates(frame, bound=bound).collect()} == want


def _before(box, centre):
    cx, cy = (box[0] + box[2]) / 2, (box[1] + box[3]) / 2
    same = abs(cy - centre[1]) <= max(40, (box[3] - box[1]) * 1.5)
    return cy < centre[1] - 40 or (same and cx < centre[0])


def test_insertion_equals_one_by_one(spark):
    rng = random.Random(4)
    order, centres, new, want = [], [], [], {}
    for page in range(6):
        listed = []
        for i in range(rng.randrange(0, 25)):
            centre = (rng.randrange(0, 1000) / 2, rng.randrange(0, 2000) / 2)
            order.append((page, i, i + 1))
            if rng.random() < 0.9:
                centres.append((page, i + 1, *centre))
                listed.append((i + 1, centre))
            else:
                listed.append((i + 1, None))
        for seq in range(5):
            x, y = rng.randrange(0, 450), rng.randrange(0, 950)
            box = (x, y, x + rng.randrange(10, 60), y + rng.randrange(10, 90))
            new.append((page, seq, 100 + seq, *box))
            at = next((j for j, (_, c) in enumerate(listed) if c and _before(box, c)), len(listed))
            listed.insert(at, (100 + seq, ((box[0] + box[2]) / 2, (box[1] + box[3]) / 2)))
        want[page] = [region for region, _ in listed]
    got = L.insert_by_position(
        spark.createDataFrame(order, "asset_id int, pos int, region_id int"),
        spark.createDataFrame(centres, "asset_id int, region_id int, center_x double, center_y double"),
        spark.createDataFrame(new, "asset_id int, seq int, region_id int, x0 int, y0 int, x1 int, y1 int"),
    ).collect()
    for page in want:
        assert [r.region_id for r in sorted((r for r in got if r.asset_id == page), key=lambda r: r.pos)] == want[page]


def test_exact_page_statistics(spark):
    rng = random.Random(2)
    rows = [(1, i, i % 41, "ocr", round(rng.random() * 9, 3), True) for i in range(300)]
    frame = spark.createDataFrame(rows, "run_id int, ord int, asset_id int, stage string, duration_seconds double, success boolean")
    totals = sorted(sum(r[4] for r in rows if r[2] == page) for page in range(41))
    row = page_statistics(frame).first()
    assert row.median_page_seconds == pytest.approx(totals[20], abs=1e-6)
    assert row.p95_page_seconds == pytest.approx(totals[int(40 * 0.95 + 0.5)], abs=1e-6)


def test_rounding_follows_the_binary_value(spark):
    values = [2.675, 0.0625, 1.005, 0.5, 2.5, 0.125] + [random.Random(6).random() for _ in range(50)]
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (1, 3, 4):
        got = frame.select("x", round_exact(F.col("x"), digits).alias("r")).collect()
        assert all(row.r == round(row.x, digits) for row in got)


@pytest.mark.parametrize(
    "text,valid", [('[1]', True), ('[1]]', False), ('{"a":1} x', False), ('1,"b":2', False), ('', False), ('null', True)]
)
def test_strict_json(spark, text, valid):
    frame = spark.createDataFrame([(text,)], "t string")
    assert (frame.select(F.to_json(strict_json(F.col("t"))).alias("v")).first().v is not None) is valid


def test_rows_without_key_or_order_are_numbered_too(spark):
    rows = [(None, 3, 0), (None, None, 1), ("a", None, 2), ("a", 1, 3), ("a", 9, 4), ("a", None, 5)]
    frame = spark.createDataFrame(rows, "k string, o int, id int")
    for bucket in (None, F.floor(F.col("o") / 4)):
        got = {r.id: r.position for r in number_rows(frame, ["k"], [F.col("o"), F.col("id")], bucket=bucket).collect()}
        assert got == {1: 1, 0: 2, 2: 1, 5: 2, 3: 3, 4: 4}
    near = {r.id: (r.previous and r.previous.id, r.next and r.next.id) for r in with_neighbours(frame, ["k"], "o", ["id"], span=4).collect()}
    assert len(near) == 6 and near[4] == (3, None) and near[1] == (None, 0) and near[0] == (1, None)
