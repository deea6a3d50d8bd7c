"""Components against brute force, on both the array way and the large-page way."""

import random

import numpy as np
import pytest

from pagetrace.operators.components import box_components, centre_components

# The written definition, in fixed values: boxes belong together if they overlap sideways by a
# fifth of the narrower one (a width counts as 1 at least) with at most 36 between them from top
# to bottom, or touch in height with at most 45 between them sideways; centres within 120.
SHARE, BELOW, ASIDE, REACH = 0.2, 36, 45, 120


def _intervals(low, high):
    """For every pair of intervals: signed overlap (negative: the space between) and the shorter length."""
    shared = np.minimum.outer(high, high) - np.maximum.outer(low, low)
    return shared, np.minimum.outer(high - low, high - low)


def near_boxes(boxes):
    """Boolean matrix over an array of (x0, y0, x1, y1)."""
    across, narrower = _intervals(boxes[:, 0], boxes[:, 2])
    down, _ = _intervals(boxes[:, 1], boxes[:, 3])
    stacked = (across >= SHARE * np.maximum(narrower, 1)) & (-down <= BELOW)
    return stacked | ((down >= 0) & (-across <= ASIDE))


def near_centres(boxes):
    doubled = boxes[:, :2] + boxes[:, 2:]
    apart = ((doubled[:, None] - doubled[None]) ** 2).sum(-1)
    return apart <= (2 * REACH) ** 2


def expected(pages, near):
    """(page, block, least block of its group), by squaring the reachability matrix until it stays."""
    found = set()
    for page, boxes in pages.items():
        ids = np.array([b for b, _ in boxes])
        reached = near(np.array([c for _, c in boxes])) | np.eye(len(boxes), dtype=bool)
        while True:
            further = (reached.astype(int) @ reached.astype(int)) > 0
            if (further == reached).all():
                break
            reached = further
        found |= {(page, int(i), int(ids[row].min())) for i, row in zip(ids, reached, strict=True)}
    return found


def test_groups_made_by_hand(spark):
    """A chain of stacked boxes, a touching pair on one line, one box just out of reach, equal boxes."""
    boxes = [
        (1, (0, 0, 100, 20)), (2, (0, 56, 100, 76)), (3, (0, 112, 100, 132)),  # 36 apart each
        (4, (0, 169, 100, 189)),  # 37 below
        (5, (500, 0, 560, 20)), (6, (605, 20, 660, 40)),  # touching in height, 45 aside
        (7, (706, 20, 760, 40)),  # 46 aside
        (8, (900, 900, 900, 900)), (9, (900, 900, 900, 900)),
    ]
    frame = spark.createDataFrame([(0, b, *c) for b, c in boxes], "asset_id int, block_id int, x0 int, y0 int, x1 int, y1 int")
    for bound in (64, 0):
        got = {r.block_id: r.component for r in box_components(frame, bound=bound).collect()}
        assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7, 8: 8, 9: 8}


def _pages(seed):
    rng = random.Random(seed)
    pages = {}
    for page, (count, width) in enumerate([(1, 400), (12, 900), (60, 2500), (90, 1500), (40, 300)]):
        boxes = []
        for block in range(count):
            x, y = rng.randrange(0, width), rng.randrange(0, width)
            w = rng.choice([0, 5, 20, 60, 300])
            boxes.append((block, (x, y, x + w, y + rng.choice([0, 10, 25, 80]))))
        boxes.append((count, boxes[0][1]))
        pages[page] = boxes
    return pages


@pytest.mark.parametrize("operator,near", [(box_components, near_boxes), (centre_components, near_centres)])
@pytest.mark.parametrize("bound", [64, 0])
def test_components_match_brute_force(spark, operator, near, bound):
    pages = _pages(7)
    rows = [(p, b, *box) for p, boxes in pages.items() for b, box in boxes]
    boxes = spark.createDataFrame(rows, "asset_id int, block_id int, x0 int, y0 int, x1 int, y1 int")
    got = {(r.asset_id, r.block_id, r.component) for r in operator(boxes, bound=bound).collect()}
    assert got == expected(pages, near)


def test_few_links_take_one_task(spark):
    from pagetrace.llm.graph import components

    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 95)], "a int, b int").repartition(4)
    want = {(i, 0) for i in range(41)} | {(i, 90) for i in (90, 95, 100)}
    few, many = components(links), components(links, small=0)
    assert {tuple(r) for r in few.collect()} == {tuple(r) for r in many.collect()} == want
    assert few.rdd.getNumPartitions() == 1
