"""Exact top-k by inner product with vector-approximation files.

Rows are cut into blocks; in each, every component is quantised to one of 256 cells of its
dimension's range, one byte. For a query the cells alone give a bound from above on every
score in the block; exact vectors are then read in the order of their bounds, best first, until
the k-th best exact score beats every bound left. So a block gives its exact k best, ties to the
smaller id, and the k best of all blocks' are the answer. The work is queries times rows; every
query block meets every row block once, and no task holds more than one of each.

Components are floor(1024 * x) as 64-bit integers. Scores are added in 64 bits where they surely fit and
exactly elsewhere; a component of 2^61 or more, or a score outside 64 bits, is an error. Null vectors, and those with null or non-finite components, take no part, nor do rows
without id. Scores of vectors of different lengths count the shorter as filled up with zeros.
Repeated ids are candidates each; a query id that repeats gives each row its own ranks only once:
its first vector (the smallest) is the query. Equal vectors are compared once and stand for their k + 1
smallest ids. An empty table gives no row. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagetrace.llm.common import ArrowBatches, stored, table

SCALE = 1024
#: Components stay below this, so that differences of two fit 64 bits.
LARGEST = 2**61
#: Parts that the rows of one query block are dealt to where they are joined.
SALT = 16
K = 10
CELLS = 256
#: Rows and queries that meet in one task.
ROWS = 8192
QUERIES_AT_ONCE = 1024


def whole_numbers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): components floor(scale * x) of the vectors that take part."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    taken = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)
    large = lambda x: F.abs(x.cast("double") * scale) >= float(LARGEST)
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    error = F.raise_error(F.lit(f"a component times {scale} is not below 2^61")).cast("array<bigint>")
    return taken.select("vec_id", F.when(F.exists("embedding", large), error).otherwise(whole).alias("v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros."""
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    if len(lengths) and (lengths == dims).all():
        return flat[offsets[0] : offsets[-1]].reshape(-1, dims)
    found = np.zeros((len(lengths), dims), np.int64)
    for i, (a, n) in enumerate(zip(offsets[:-1], lengths, strict=True)):
        found[i, :n] = flat[a : a + n]
    return found


class Block:
    """A vector-approximation file of one block: cells of each component, and the exact vectors."""

    def __init__(self, exact: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> None:
        self.exact, self.ids, self.keys = exact, ids, keys
        self.low = exact.min(axis=0).astype(np.int64) if len(exact) else np.zeros(exact.shape[1], np.int64)
        span = (exact.max(axis=0).astype(np.int64) - self.low) if len(exact) else self.low
        self.width = span // CELLS + 1
        self.cells = ((exact - self.low) // self.width).astype(np.uint8)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """From above, for each query and row: at positive components a cell's upper end counts, at negative its lower."""
        middle = self.cells.astype(np.float64) * self.width + self.low
        # Lower end for all, plus what the upper ends may add where the query is positive.
        scores = queries.astype(np.float64) @ middle.T
        slack = np.maximum(queries, 0).astype(np.float64) @ (self.width - 1).astype(np.float64)
        found = scores + slack[:, None]
        # Whole numbers stay exact below 2 ** 53; beyond it rounding is allowed for.
        most = np.abs(queries).astype(np.float64).sum(axis=1) * max(1.0, float(np.abs(middle).max(initial=0)))
        return found + np.where(most < 2.0**53, 0.0, most * 2.0**-44)[:, None]


def _exact_scores(rows: np.ndarray, query: np.ndarray) -> list[int]:
    scores = [sum(a * b for a, b in zip(row, query.tolist(), strict=True)) for row in rows.tolist()]
    if any(not -(2**63) <= s < 2**63 for s in scores):
        raise OverflowError("a score does not fit 64 bits")
    return scores


def block_best(block: Block, queries: np.ndarray, query_ids: np.ndarray, k: int, step: int = 64) -> list[tuple[int, int, int]]:
    """(query number, vec_id, score): the exact k best of the block for each query, fewer if there are fewer."""
    found = []
    bounds = block.bounds(queries)
    largest = float(np.abs(block.exact).max(initial=0))
    for q, query in enumerate(queries.astype(np.int64)):
        fits = largest * float(np.abs(query).astype(np.float64).sum()) < 2.0**62
        bound = bounds[q]
        # A class holds up to k + 1 ids, so k classes, or one more if the query's own is among them, are enough.
        first = np.argpartition(-bound, step)[:step] if len(bound) > step else np.arange(len(bound))
        order, best = first[np.argsort(-bound[first], kind="stable")], []
        read, at, rest = 0, 0, None
        while True:
            part = order[at : at + step]
            scores = (block.exact[part].astype(np.int64) @ query).tolist() if fits else _exact_scores(block.exact[part], query)
            for row, score in zip(part.tolist(), scores, strict=True):
                best += [(-score, i) for i in block.keys[row] if i != query_ids[q]]
            best = sorted(best)[:k]
            read += len(part)
            at += len(part)
            if read >= len(bound):
                break
            if rest is None:
                rest = np.setdiff1d(np.arange(len(bound)), first, assume_unique=True)
                # Only rows whose bound can still matter are ordered.
                rest = rest[bound[rest] >= -best[-1][0]] if len(best) == k else rest
                order, at = rest[np.argsort(-bound[rest], kind="stable")], 0
            if at >= len(order) or len(best) == k and bound[order[at]] < -best[-1][0]:
                break
        found += [(q, i, -s) for s, i in best]
    return found


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score) of queries and vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    # Equal vectors once, with the ids that can be among k after the query's own is left out.
    whole = whole_numbers(vectors, scale)
    ranked = whole.withColumn("r", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    classes = stored(ranked.groupBy("v").agg(F.collect_list("vec_id").alias("ids")), "va-rows")
    asked = stored(whole_numbers(queries, scale).groupBy("vec_id").agg(F.min("v").alias("v")), "va-queries")
    counts = asked.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    dims = max([0, *(n or 0 for n in (classes.agg(F.max(F.size("v"))).first()[0], counts[1]))])
    blocks = max(1, -(-counts[0] // QUERIES_AT_ONCE))
    grouped = asked.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("b")).agg(F.collect_list(F.struct("vec_id", "v")).alias("asked"))

    def gather(given: ArrowBatches) -> ArrowBatches:
        """The batches of a partition as rows of a block each."""
        for batch in given:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows = pa.StructArray.from_arrays([part.column("v"), part.column("ids")], ["v", "ids"])
                whole = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
                yield pa.RecordBatch.from_arrays([whole], ["rows"])

    kind = "array<struct<v:array<bigint>,ids:array<bigint>>>"
    # Small tables still spread over the cores; blocks follow partitions.
    packed = classes.repartition(F.xxhash64("v")).mapInArrow(gather, f"rows {kind}")
    # Where the queries are too many to be broadcast, the rows that meet one query block are dealt to several tasks.
    every = packed.withColumn("s", F.pmod(F.monotonically_increasing_id(), F.lit(SALT)).cast("int"))
    every = every.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    grouped = grouped.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    met = every.join(grouped, ["b", "s"]).select("rows", "asked")

    def search(given: ArrowBatches) -> ArrowBatches:
        for batch in given:
            for number in range(batch.num_rows):
                rows, asked = batch.column(0)[number].values, batch.column(1)[number].values
                ids = rows.field("ids")
                block = Block(_matrix(rows.field("v"), dims), np.zeros(0), ids.to_pylist())
                own = asked.field("vec_id").to_numpy(zero_copy_only=False)
                found = block_best(block, _matrix(asked.field("v"), dims), own, k)
                if found:
                    q, vec, score = (np.array(c, np.int64) for c in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(vec), pa.array(score)], ["query_id", "vec_id", "score"])

    best = met.mapInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_vector_search(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(1024 * x::DOUBLE) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
flat AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM v),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, SUM(q.x * c.x)::BIGINT AS score FROM flat q JOIN flat c ON q.d = c.d AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0 GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""

QUERIES = {"op10_vector_search": (op10_vector_search, SQL)}
