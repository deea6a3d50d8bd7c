"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Every source gets a target in words. A document's expected copies are target over source
size. Its whole copies are certain; the rest of the target is filled by an order sample:
documents are ranked by random odds divided by inclusion odds and taken in that order while
they fit. The sample's fixed size is in words, so the sizes of documents, which differ by
orders of magnitude, cannot move a source off its target; one last document, that whose size
comes nearest to the gap left, closes it. ``weight`` makes inclusion odds differ by document.

The random number of a row is a hash of its id and the seed, so reruns agree. Rows tied in it
are ordered by a hash of the text; rows equal in that too are interchangeable. Null texts have
no word, null sources are one source, the last; null ids hash as the word ``null``. Sources
without words are taken zero times. An empty table gives no row. Extra columns are ignored.

No task sorts a source: order keys are summed by bucket before the shuffle, and only the bucket
in which the sample ends is sorted. What is decided per source is one small row, joined to the
documents; Spark broadcasts it where its size allows and splits the hot source where not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagetrace.llm.common import WORD, stored, table

BUCKETS = 65536
#: No document is taken more often than this.
MOST = 3
SEED = 7


def words_in(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def random_of(key: Column, seed: int) -> Column:
    """A number in (0, 1) from the first 52 bits of a hash of seed and key."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    digits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint")
    return (digits + F.lit(0.5)) / F.lit(float(2**52))


def source_targets(sizes: DataFrame, cycle: int = 3, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources by code point, null last, weigh 1, 2, .., ``cycle``, repeating. Sharing an excess
    again until no target is above ``most`` times its size ends at one level: each target is
    the smaller of weight times level and its bound, and the level fills the total. Bounds are
    met in the order of bound over weight, so the level follows from running sums.
    """
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = sizes.withColumn("w", (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % cycle + 1)
    ranked = ranked.withColumn("most", most * F.col("source_size")).withColumn("at", F.col("most").cast("double") / F.col("w"))
    by_bound = W.orderBy("at", F.col("source").asc_nulls_last())
    levels = (
        ranked.withColumn("k", F.row_number().over(by_bound))
        .withColumn("bound", F.coalesce(F.sum("most").over(by_bound.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("free", F.sum("w").over(by_bound.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(whole))
        .withColumn("own", (F.col("total") - F.col("bound")).cast("double") / F.col("free"))
        .withColumn("fits", F.when(F.col("own") <= F.col("at"), F.col("k")))
        .withColumn("level", F.min_by("own", "fits").over(whole))
    )
    return levels.select("source", "source_size", F.least(F.col("w") * F.col("level"), F.col("most").cast("double")).alias("target"))


def _by_source(rows: DataFrame, plan: DataFrame) -> DataFrame:
    other = plan.withColumnRenamed("source", "_source")
    return rows.join(other, rows["source"].eqNullSafe(other["_source"])).drop("_source")


def _ordered(rows: DataFrame) -> DataFrame:
    """Adds whole copies, the order key in (0, 1) (null where nothing is sampled) and its bucket."""
    part = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("whole", F.floor(part)).withColumn("share", part - F.floor(part))
    odds = F.col("share") / (1 - F.col("share")) * F.col("weight")
    ratio = F.when(F.col("share") > 0, F.col("u") / (1 - F.col("u")) / odds)
    rows = rows.withColumn("key", ratio / (1 + ratio)).drop("share")
    return rows.withColumn("bucket", F.floor(F.col("key") * BUCKETS).cast("int"))


def copies(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """``rows`` (source, size, u, weight, tie, row, ..) with source_size, target and copies; rows is a stored table."""
    place = F.struct("key", "tie", "row")
    skinny = _ordered(_by_source(rows.select("source", "size", "u", "weight", "tie", "row"), targets))
    skinny = skinny.where("bucket IS NOT NULL").withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    sums = skinny.groupBy("source", "bucket").agg(F.sum("size").alias("n"), F.first("rest").alias("rest"))
    before = F.sum("n").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    ends = sums.withColumn("before", F.coalesce(before, F.lit(0))).where("before <= rest").groupBy("source")
    ends = ends.agg(F.max_by("before", "bucket").alias("before"), F.max("bucket").alias("last"))
    # The first document, in order, that no longer fits, and the gap before it.
    own = W.partitionBy("source").orderBy("key", "tie", "row").rowsBetween(W.unboundedPreceding, -1)
    inside = _by_source(skinny, ends).where("bucket = last")
    inside = inside.withColumn("at", F.col("before") + F.coalesce(F.sum("size").over(own), F.lit(0)))
    cuts = inside.where("at + size > rest").groupBy("source").agg(
        F.min(place).alias("cut"), F.min_by(F.col("rest") - F.col("at"), place).alias("gap")
    )
    cuts = stored(cuts, "mix-cuts")
    # Of the documents behind the cut, the one that closes the gap best, if any comes nearer.
    behind = _by_source(skinny, cuts).where((place >= F.col("cut")) & (F.abs(F.col("size") - F.col("gap")) < F.col("gap")))
    closing = behind.groupBy("source").agg(F.min_by("row", F.struct(F.abs(F.col("size") - F.col("gap")), "key", "tie", "row")).alias("closing"))
    joined = targets.withColumnRenamed("source", "s")
    for found in (cuts.select(F.col("source").alias("t"), "cut"), closing.select(F.col("source").alias("t"), "closing")):
        joined = joined.join(found, F.col("s").eqNullSafe(F.col("t")), "left").drop("t")
    plan = stored(joined.withColumnRenamed("s", "source"), "mix-plan")
    full = _ordered(_by_source(rows, plan))
    taken = F.coalesce((place < F.col("cut")) | (F.col("row") == F.col("closing")), F.col("key").isNotNull() & F.col("cut").isNotNull() & (place < F.col("cut")), F.lit(False))
    return full.withColumn("copies", F.col("whole") + taken.cast("bigint")).drop("cut", "closing", "whole", "key", "bucket")


def mix(
    docs: DataFrame, carry: list[str], seed: int = SEED, cycle: int = 3, most: int = MOST, key: str = "doc_id", weight: Column | None = None
) -> DataFrame:
    """``carry`` columns of docs with _size, _source_size, _target and _copies."""
    rows = stored(
        docs.select(
            F.struct(*carry).alias("carried"),
            F.col("source").alias("source"),
            words_in(F.col("text")).alias("size"),
            random_of(F.col(key), seed).alias("u"),
            (F.lit(1.0) if weight is None else weight).alias("weight"),
            F.xxhash64("text").alias("tie"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "mix-rows",
    )
    targets = stored(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), cycle, most), "mix-targets")
    done = copies(rows, targets)
    return done.select(
        *(F.col(f"carried.`{c}`").alias(c) for c in carry),
        *(F.col(c).alias(f"_{c}") for c in ("size", "source_size", "target", "copies")),
    )


def op6_mix_sources(spark, sf_dir):
    mixed = mix(table(spark, sf_dir, "documents"), ["doc_id"])
    return mixed.select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_copies") * F.col("_size")).alias("taken"),
    )


SQL = r"""
WITH docs AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    (CAST('0x' || substr(md5('7:' || COALESCE(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents),
sizes AS (SELECT source, SUM(size)::BIGINT AS source_size FROM docs GROUP BY source),
ranked AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS w, 3 * source_size AS most FROM sizes),
bounds AS (SELECT *, row_number() OVER o AS k, most::DOUBLE / w AS reach,
    COALESCE(SUM(most) OVER (ORDER BY most::DOUBLE / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bound,
    SUM(w) OVER (ORDER BY most::DOUBLE / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free,
    SUM(source_size) OVER () AS total
  FROM ranked WINDOW o AS (ORDER BY most::DOUBLE / w, source ASC NULLS LAST)),
own AS (SELECT *, (total - bound)::DOUBLE / free::DOUBLE AS own FROM bounds),
level AS (SELECT own AS level FROM own WHERE own <= reach ORDER BY k LIMIT 1),
targets AS (SELECT source, source_size, LEAST(w * level, most::DOUBLE) AS target FROM own, level),
parts AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS part
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
shares AS (SELECT *, floor(part)::BIGINT AS whole, part - floor(part) AS share FROM parts),
ratios AS (SELECT *, CASE WHEN share > 0 THEN u / (1 - u) / (share / (1 - share) * 1.0::DOUBLE) END AS ratio FROM shares),
keyed AS (SELECT *, ratio / (1 + ratio) AS key, target - whole * source_size AS rest FROM ratios),
placed AS (SELECT *, COALESCE(SUM(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto
  FROM keyed WHERE key IS NOT NULL),
cuts AS (SELECT source, MIN(key) AS cut, arg_min(rest - upto, key) AS gap FROM placed WHERE upto + size > rest GROUP BY source),
closing AS (SELECT p.source, arg_min(doc_id, (abs(size - gap), key)) AS closing FROM placed p JOIN cuts c ON p.source IS NOT DISTINCT FROM c.source
  WHERE key >= cut AND abs(size - gap) < gap GROUP BY p.source)
SELECT k.doc_id, k.size::BIGINT AS size, k.source_size, k.target,
  ((whole + COALESCE(CAST(key < cut OR k.doc_id = closing AS INT), CAST(key < cut AS INT), 0)) * k.size)::BIGINT AS taken
FROM keyed k LEFT JOIN cuts c ON k.source IS NOT DISTINCT FROM c.source LEFT JOIN closing l ON k.source IS NOT DISTINCT FROM l.source
"""

QUERIES = {"op6_mix_sources": (op6_mix_sources, SQL)}
