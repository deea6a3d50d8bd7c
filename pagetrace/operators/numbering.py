"""Positions within a key that no single task has to sort alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagetrace.operators.components import large_keys
from pagetrace.session import cut


def join_by(rows: DataFrame, other: DataFrame, names: Sequence[str]) -> DataFrame:
    """Inner join on equal names, where NULL equals NULL; ``other`` adds its remaining columns."""
    right = other.select(*[F.col(n).alias(f"_on_{i}") for i, n in enumerate(names)], *[c for c in other.columns if c not in names])
    same = [F.col(n).eqNullSafe(F.col(f"_on_{i}")) for i, n in enumerate(names)]
    return rows.join(right, same).drop(*[f"_on_{i}" for i in range(len(names))])


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    into: str = "position",
    bucket: Column | None = None,
) -> DataFrame:
    """Add 1-based positions per ``keys`` following ``order`` (a total order).

    NULL keys are a key and NULL orders have a bucket of their own, so every row comes
    out. Rows of one key are spread over buckets that are monotone in the order;
    each bucket is numbered on its own and shifted by the rows before it. With a
    ``bucket`` expression nothing is materialised; it suits an integer order
    column with few rows per value. Without one the buckets are the ranges of a
    range partitioning, even for any distribution, fixed by a checkpoint so that
    both passes see the same ranges even when a task is retried.
    """
    keys = list(keys)
    if bucket is None:
        spread = df.repartitionByRange(*[F.col(k) for k in keys], *order)
        rows = cut(spread.withColumn("_bucket", F.spark_partition_id()))
    else:
        rows = df.withColumn("_bucket", bucket)
    # Equal structs hold NULLs at the same places; as one column the join and the window share a shuffle.
    rows = rows.withColumn("_at", F.struct(*keys, "_bucket")).drop("_bucket")
    sizes = rows.groupBy("_at").agg(F.count(F.lit(1)).alias("_size"))
    before = W.partitionBy(*[F.col("_at")[k] for k in keys]).orderBy(F.col("_at")["_bucket"]).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_at", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inside = W.partitionBy("_at").orderBy(*order)
    return (
        rows.join(offsets, "_at")
        .withColumn(into, (F.col("_offset") + F.row_number().over(inside)).cast("long"))
        .drop("_at", "_offset")
    )


def number_short_keys(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    into: str = "position",
    bucket: Column | None = None,
    bound: int = 2**16,
) -> DataFrame:
    """``number_rows`` where most keys are short: those up to ``bound`` rows are numbered in one window each.

    The keys are counted at once, so ``df`` should be cheap to read again.
    """

    def short(rows: DataFrame) -> DataFrame:
        return rows.withColumn(into, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long"))

    hot = large_keys(df, keys, bound)
    if hot is None:
        return short(df)
    long = number_rows(df.join(hot, list(keys), "left_semi"), keys, order, into, bucket)
    return short(df.join(hot, list(keys), "left_anti")).unionByName(long)


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    fields: Sequence[str],
    span: int = 4096,
) -> DataFrame:
    """Previous and next row's ``fields`` per key, by an integer order column.

    The window runs inside ``span``-wide order buckets; the rows at a bucket's
    edge take their neighbour from the summary of the adjacent non-empty bucket. Rows
    without an order come first, NULL keys are a key.
    """
    keys = list(keys)
    row = F.struct(*[F.col(f) for f in fields])
    rows = df.withColumn("_bucket", F.floor(F.col(order) / F.lit(span)))
    edges = rows.groupBy(*keys, "_bucket").agg(
        F.coalesce(F.min_by(row, F.col(order)), F.first(row)).alias("_first"),
        F.coalesce(F.max_by(row, F.col(order)), F.first(row)).alias("_last"),
    )
    across = W.partitionBy(*keys).orderBy("_bucket")
    edges = edges.select(
        *keys,
        "_bucket",
        F.lag("_last").over(across).alias("_before"),
        F.lead("_first").over(across).alias("_after"),
    )
    inside = W.partitionBy(*keys, "_bucket").orderBy(order)
    joined = join_by(rows, edges, [*keys, "_bucket"])
    return joined.select(
        *df.columns,
        F.coalesce(F.lag(row).over(inside), F.col("_before")).alias("previous"),
        F.coalesce(F.lead(row).over(inside), F.col("_after")).alias("next"),
    )
