"""Connected components inside pages.

Pages up to ``PAGE_BOUND`` boxes are closed as arrays, a batch of pages at once. Larger pages never form an array or a pair list per page: their boxes are
first merged exactly, joined by place, and closed by distributed label spreading.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetrace.functions.boxes import beside, box_of, linked_boxes, stacked
from pagetrace.session import cut

PAGE_BOUND = 64
#: Whether the members of pairs are linked, from the fields of the first and of the second ones.
Linked = Callable[[dict[str, np.ndarray], dict[str, np.ndarray]], np.ndarray]


def large_keys(rows: DataFrame, keys: Sequence[str], bound: int) -> DataFrame | None:
    """Keys with more than ``bound`` rows, materialised; None when there are none (the usual case)."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    large = cut(sizes.where(F.col("_n") > bound).select(*keys))
    return None if large.isEmpty() else large


def spread_labels(nodes: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, node) with ``component`` = least node reachable over ``edges(keys, a, b)``.

    Every round takes the least label among the neighbours (a combinable
    aggregate, so hubs are reduced map-side) and then jumps to the label's own
    label, which shortens chains; it stops when nothing changes.
    """
    keys = list(keys)
    both = edges.select(*keys, "a", "b").union(
        edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))
    )
    both = cut(both.where(F.col("a") != F.col("b")).distinct())
    labels = cut(nodes.select(*keys, "node", F.col("node").alias("component")).distinct())
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), [*keys, "b"])
            .groupBy(*keys, F.col("a").alias("node"))
            .agg(F.min("component").alias("_near"))
        )
        hooked = labels.join(near, [*keys, "node"], "left").select(
            *keys,
            "node",
            F.col("component").alias("_old"),
            F.least("component", F.coalesce("_near", "component")).alias("_label"),
        )
        hooked = cut(hooked)
        target = hooked.select(*keys, F.col("node").alias("_label"), F.col("_label").alias("_jump"))
        labels = cut(
            hooked.join(target, [*keys, "_label"], "left").select(
                *keys,
                "node",
                F.least("_label", F.coalesce("_jump", "_label")).alias("component"),
                (F.least("_label", F.coalesce("_jump", "_label")) < F.col("_old")).alias("_moved"),
            )
        )
        moved = not labels.where("_moved").isEmpty()
        labels = labels.drop("_moved")
        if not moved:
            return labels


def least_linked(a: np.ndarray, b: np.ndarray, count: int) -> np.ndarray:
    """For every position below ``count`` the least position reachable over the pairs (a, b)."""
    label = np.arange(count)
    while True:
        near = label.copy()
        np.minimum.at(near, a, label[b])
        np.minimum.at(near, b, label[a])
        near = near[near]
        if (near == label).all():
            return label
        label = near


def _close_pages(batches: Iterable[pa.RecordBatch], keys: Sequence[str], fields: Sequence[str], linked: Linked) -> Iterator[pa.RecordBatch]:
    """Every page is a list of members in the order of their nodes, so the first of a group is its least."""
    for batch in batches:
        column = batch.column(len(keys))
        members = column.flatten()
        sizes = np.diff(column.offsets.to_numpy())
        page = np.repeat(np.arange(len(sizes)), sizes)
        values = {f: members.field(f).to_numpy(zero_copy_only=False) for f in fields}
        pairs = [np.zeros((2, 0), dtype=np.int64)]
        for step in range(1, int(sizes.max(initial=0))):
            low = np.flatnonzero(page[:-step] == page[step:])
            both = low + step
            met = linked({f: v[low] for f, v in values.items()}, {f: v[both] for f, v in values.items()})
            pairs.append(np.stack([low[met], both[met]]))
        a, b = np.concatenate(pairs, axis=1)
        node = members.field("node")
        head = pa.array(least_linked(a, b, len(page)))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i).take(pa.array(page)) for i in range(len(keys))), node, node.take(head)], [*keys, "node", "component"]
        )


def _small_pages(rows: DataFrame, keys: Sequence[str], linked: Linked) -> DataFrame:
    """Pages met as arrays; all pairs of a batch of pages are compared at once, by their distance in the array."""
    fields = [c for c in rows.columns if c not in [*keys, "node"]]
    pages = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("node", *fields))).alias("_members"))
    kind = rows.schema["node"]
    schema = T.StructType([*(rows.schema[k] for k in keys), kind, T.StructField("component", kind.dataType)])
    return pages.mapInArrow(lambda batches: _close_pages(batches, keys, fields, linked), schema)


def _by_page_size(
    rows: DataFrame,
    keys: Sequence[str],
    linked: Linked,
    large: Callable[[DataFrame, Sequence[str]], DataFrame],
    bound: int,
) -> DataFrame:
    hot = large_keys(rows, keys, bound)
    if hot is None:
        return _small_pages(rows, keys, linked)
    small = _small_pages(rows.join(hot, list(keys), "left_anti"), keys, linked)
    return small.unionByName(large(rows.join(hot, list(keys), "left_semi"), keys))


def _islands(
    boxes: DataFrame, keys: Sequence[str], fixed: tuple[str, str], low: str, high: str, reach: int
) -> tuple[DataFrame, DataFrame]:
    """Merge boxes with equal ``fixed`` sides whose other sides are at most ``reach`` apart.

    Such boxes are neighbours, and another box is a neighbour of some member
    exactly when it is one of the merged box, so nothing is lost.
    """
    side = W.partitionBy(*keys, *fixed).orderBy(low, high)
    so_far = F.max(high).over(side.rowsBetween(W.unboundedPreceding, -1))
    started = boxes.withColumn(
        "_new", (F.col(low) - F.coalesce(so_far, F.lit(-(10**9))) > reach).cast("int")
    ).withColumn("_island", F.sum("_new").over(side.rowsBetween(W.unboundedPreceding, 0)))
    merged = started.groupBy(*keys, *fixed, "_island").agg(
        F.min(low).alias(low), F.max(high).alias(high), F.min("node").alias("node")
    )
    return merged, started


def _near_pairs(
    merged: DataFrame,
    keys: Sequence[str],
    test: Callable,
    cells: tuple[int, int],
    reach: tuple[int, int],
) -> DataFrame:
    """Pairs of merged boxes passing ``test``, met through the grid cells they reach.

    A pair is emitted only in the first cell both reach, so it appears once.
    """
    def first(axis: int) -> Column:
        return F.floor(F.col(("x0", "y0")[axis]) / cells[axis])

    def last(axis: int) -> Column:
        return F.floor((F.col(("x1", "y1")[axis]) + reach[axis]) / cells[axis])

    placed = (
        merged.select(*keys, "node", "x0", "y0", "x1", "y1", first(0).alias("fx"), first(1).alias("fy"),
                      last(0).alias("lx"), last(1).alias("ly"))
        .withColumn("cx", F.explode(F.sequence("fx", "lx")))
        .withColumn("cy", F.explode(F.sequence("fy", "ly")))
        .drop("lx", "ly")
    )
    other = placed.select(
        *keys, "cx", "cy", *[F.col(c).alias(f"r_{c}") for c in ("node", "x0", "y0", "x1", "y1", "fx", "fy")]
    )
    return (
        placed.join(other, [*keys, "cx", "cy"])
        .where(
            (F.col("node") < F.col("r_node"))
            & (F.col("cx") == F.greatest("fx", "r_fx"))
            & (F.col("cy") == F.greatest("fy", "r_fy"))
            & test(box_of(), box_of("r_"))
        )
        .select(*keys, F.col("node").alias("a"), F.col("r_node").alias("b"))
    )


def _large_box_pages(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Neighbour components of pages of any size.

    Equal boxes collapse to one. Boxes sharing both x sides merge along y and
    boxes sharing both y sides merge along x; the merged boxes are then compared.
    Their number depends on the page's pixel size, not on its number of rows.
    """
    keys = list(keys)
    sides = ["x0", "y0", "x1", "y1"]
    distinct = cut(rows.groupBy(*keys, *sides).agg(F.min("node").alias("node")))
    columns, in_columns = _islands(distinct, keys, ("x0", "x1"), "y0", "y1", 36)
    lines, in_lines = _islands(distinct, keys, ("y0", "y1"), "x0", "x1", 45)

    def membership(members: DataFrame, merged: DataFrame, fixed: list[str]) -> DataFrame:
        heads = merged.select(*keys, *fixed, "_island", F.col("node").alias("b"))
        return members.select(*keys, *fixed, "_island", F.col("node").alias("a")).join(
            heads, [*keys, *fixed, "_island"]
        ).select(*keys, "a", "b")

    # A box of zero width shares no column with its equals, so it takes no part here.
    wide = F.col("x1") > F.col("x0")
    edges = (
        membership(in_columns.where(wide), columns.where(wide), ["x0", "x1"])
        .union(membership(in_lines, lines, ["y0", "y1"]))
        .union(_near_pairs(columns, keys, stacked, (64, 128), (0, 36)))
        .union(_near_pairs(lines, keys, beside, (256, 32), (45, 0)))
    )
    labels = spread_labels(distinct, edges, keys)
    return (
        rows.join(
            distinct.join(labels, [*keys, "node"]).select(*keys, *sides, "component"), [*keys, *sides]
        )
        .select(*keys, "node", "component")
    )


def box_components(
    boxes: DataFrame, keys: Sequence[str] = ("asset_id",), bound: int = PAGE_BOUND
) -> DataFrame:
    """(keys, block_id, component) grouping neighbouring boxes; component = least block id."""
    rows = boxes.select(*keys, F.col("block_id").alias("node"), "x0", "y0", "x1", "y1")
    done = _by_page_size(rows, keys, linked_boxes, _large_box_pages, bound)
    return done.withColumnRenamed("node", "block_id")


# Sums of four integer corners are exact; 120 px is 480 in these units. Points of
# one 339-unit cell are at most 478.1 apart, so a cell is always one group.
_REACH = 480
_CELL = 339


def _large_point_pages(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Single-linkage components of pages of any size through a grid.

    A cell is connected by itself. Two cells are linked when their closest
    points are; along a row (or column) only the outermost points of a cell can
    be closest to another cell, so a cell contributes a bounded number of points.
    """
    keys = list(keys)
    celled = rows.withColumn("cx", F.floor(F.col("sx") / _CELL)).withColumn(
        "cy", F.floor(F.col("sy") / _CELL)
    )
    cell = [*keys, "cx", "cy"]
    heads = cut(celled.groupBy(*cell).agg(F.min("node").alias("head")))
    per_row = celled.groupBy(*cell, "sy").agg(F.min("sx").alias("lo"), F.max("sx").alias("hi"))
    per_column = celled.groupBy(*cell, "sx").agg(F.min("sy").alias("lo"), F.max("sy").alias("hi"))
    outline = (
        per_row.select(*cell, F.explode(F.array("lo", "hi")).alias("sx"), "sy")
        .union(per_column.select(*cell, "sx", F.explode(F.array("lo", "hi")).alias("sy")))
        .distinct()
    )
    around = F.explode(F.sequence(F.lit(-2), F.lit(2)))
    reach = (
        outline.withColumn("_dx", around)
        .withColumn("_dy", around)
        .where("_dx > 0 OR (_dx = 0 AND _dy > 0)")
        .select(
            *keys,
            F.col("cx").alias("ax"),
            F.col("cy").alias("ay"),
            (F.col("cx") + F.col("_dx")).alias("cx"),
            (F.col("cy") + F.col("_dy")).alias("cy"),
            F.col("sx").alias("px"),
            F.col("sy").alias("py"),
        )
    )
    dx, dy = F.col("px") - F.col("sx"), F.col("py") - F.col("sy")
    linked = (
        reach.join(outline, cell)
        .where(dx * dx + dy * dy <= _REACH * _REACH)
        .select(*keys, "ax", "ay", "cx", "cy")
        .distinct()
    )
    first = heads.select(*keys, F.col("cx").alias("ax"), F.col("cy").alias("ay"), F.col("head").alias("a"))
    edges = (
        linked.join(first, [*keys, "ax", "ay"])
        .join(heads, cell)
        .select(*keys, "a", F.col("head").alias("b"))
    )
    labels = spread_labels(heads.withColumnRenamed("head", "node"), edges, keys)
    named = heads.join(labels.withColumnRenamed("node", "head"), [*keys, "head"]).select(*cell, "component")
    return celled.join(named, cell).select(*keys, "node", "component")


def centre_components(
    boxes: DataFrame, keys: Sequence[str] = ("asset_id",), bound: int = PAGE_BOUND
) -> DataFrame:
    """(keys, block_id, component) for blocks whose centres chain within 120 px."""
    rows = boxes.select(
        *keys,
        F.col("block_id").alias("node"),
        (2 * (F.col("x0") + F.col("x1"))).cast("long").alias("sx"),
        (2 * (F.col("y0") + F.col("y1"))).cast("long").alias("sy"),
    )

    def linked(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> np.ndarray:
        dx, dy = a["sx"] - b["sx"], a["sy"] - b["sy"]
        return dx * dx + dy * dy <= _REACH * _REACH

    done = _by_page_size(rows, keys, linked, _large_point_pages, bound)
    return done.withColumnRenamed("node", "block_id")
