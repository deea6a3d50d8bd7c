r"""Importance resampling towards a target distribution: scored features, a bisected cutoff, ranks by range.

Features are runs of one to ``ORDERS`` consecutive words (letters and digits, A-Z lower-cased),
hashed into buckets by crc32. Bucket counts of all documents and of the target's texts give each
bucket an integer gain, an array of fixed length; a document's weight is the floored mean of its
features' gains. A random number drawn from its id (Gumbel noise) makes the highest scores a
sample by weight without replacement.

Scores are written once. The cutoff is found by bisecting numbers: each job counts the rows at
or below several thresholds exactly, first of the score, then of doc_id among rows of that score,
and, for rows equal in both, of a hash of the text and of the row's number. Drawn rows are
partitioned by ranges of the same keys, sorted there and numbered by the counts of the partitions
before. No row is collected; no window spans all rows.

Null and wordless texts have no features and weight 0. Null ids draw their number as the word
``null`` and come last among ties. Rows are documents of their own, also where ids repeat; equal rows
are interchangeable. An empty target counts as no features. An empty table gives no row. Extra
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetrace.llm.common import ArrowBatches, stored, table
from pagetrace.llm.words import word_lists

BUCKETS = 10_000
ORDERS = 2
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
#: Thresholds counted in one job: five halvings.
AT_ONCE = 31


def feature_buckets(text: str | None, buckets: int = BUCKETS, orders: int = ORDERS) -> Iterator[tuple[int, np.ndarray]]:
    """(number of new words, buckets of the features that end in them), piece by piece of a text."""
    before: list[bytes] = []
    for new in word_lists(text):
        words = before + new
        known, found = len(before), []
        spaced = [b" " + w for w in words]
        sums = list(map(crc32, words))
        for order in range(1, orders + 1):
            # A run of k words goes on from the checksum of its first k - 1.
            sums = sums if order == 1 else list(map(crc32, spaced[order - 1 :], sums))
            found.append(np.array(sums[max(0, known - order + 1) :], np.uint32))
        yield len(new), np.concatenate(found) % buckets
        before = words[len(words) - orders + 1 :] if orders > 1 else []


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS, orders: int = ORDERS) -> np.ndarray:
    """Features of all texts of ``rows`` by bucket; tasks send sums, the driver gets one number a bucket."""

    def count(given: ArrowBatches) -> ArrowBatches:
        total = np.zeros(buckets, np.int64)
        for batch in given:
            for text in batch.column(0):
                for _, found in feature_buckets(text.as_py(), buckets, orders):
                    total += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["bucket", "n"])

    sums = rows.select("text").mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = np.zeros(buckets, np.int64)
    for row in sums.collect():
        found[row["bucket"]] = row["n"]
    return found


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of smoothed target share over smoothed source share, by bucket."""
    size, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    ratio = ((target + 1.0) * (s_all + size)) / ((source + 1.0) * (t_all + size))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, orders: int = ORDERS) -> DataFrame:
    """(doc_id, tie, n_words, n_features, weight) of every row."""
    buckets = len(gain)

    def weigh(given: ArrowBatches) -> ArrowBatches:
        for batch in given:
            found = np.zeros((3, batch.num_rows), np.int64)
            for i, text in enumerate(batch.column("text")):
                n_words = n = total = 0
                for new, own in feature_buckets(text.as_py(), buckets, orders):
                    n_words, n, total = n_words + new, n + len(own), total + int(gain[own].sum())
                found[:, i] = n_words, n, total // n if n else 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tie"), *(pa.array(x) for x in found)], ["doc_id", "tie", "n_words", "n_features", "weight"]
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    return rows.mapInArrow(weigh, "doc_id bigint, tie bigint, n_words bigint, n_features bigint, weight bigint")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln u)), u in (0, 1) from the first 32 bits of a hash of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    number = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("bigint")
    u = (number + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(-1000 * F.ln(-F.ln(u)))


def cutoff(rows: DataFrame, keys: list[str], wanted: int, at_once: int = AT_ONCE) -> list[int] | None:
    """The first values of ``keys`` (numbers, none null, ascending) up to which exactly ``wanted`` rows come.

    None if no row is wanted; fewer values than keys if all rows of the last value are wanted.
    """
    if wanted <= 0:
        return None
    found: list[int] = []
    for key in keys:
        column = F.col(key)
        low, high, total = rows.agg(F.min(key), F.max(key), F.count(F.lit(1))).first()
        if wanted >= total:
            return [*found, high]
        below, upto = 0, total  # rows under low, rows up to high
        while low < high:
            steps = min(at_once, high - low)
            marks = [low + (high - low) * i // (steps + 1) for i in range(1, steps + 1)]
            marks = sorted({m for m in marks if m < high} | {low + (high - low) // 2})
            counts = rows.agg(*(F.count_if(column <= m).alias(f"c{i}") for i, m in enumerate(marks))).first()
            for mark, count in zip(marks, counts, strict=True):
                if count >= wanted:
                    high, upto = mark, count
                    break
                low, below = mark + 1, count
        found.append(high)
        if upto == wanted:
            return found
        rows, wanted = rows.where(column == high), wanted - below
    return found


def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with _rank, 1, 2, .. in the order of ``keys``."""
    placed = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "resample-ranges")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit(2**33 - 1))
    # One number a partition.
    sizes = sorted(tuple(r) for r in placed.groupBy(part.alias("part")).count().collect())
    starts = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    offsets = [(p, start) for (p, _), start in zip(sizes, starts, strict=False)]
    offsets = rows.sparkSession.createDataFrame(offsets, "_part bigint, _start bigint")
    joined = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return joined.withColumn("_rank", F.col("_start") + place + 1).drop("_at", "_part", "_start")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank is null where it is not drawn."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    scored = weighted(docs, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    rows = stored(scored.withColumn("row", F.monotonically_increasing_id()), "resample-scores")
    keys = {
        "_score": -F.col("score"), "_no_id": F.col("doc_id").isNull().cast("bigint"), "_id": F.coalesce("doc_id", F.lit(0).cast("bigint")),
        "_tie": F.col("tie"), "_row": F.col("row"),
    }
    long_enough = rows.where(F.col("n_words") >= least_words).select("doc_id", "n_features", "weight", "score", *(c.alias(k) for k, c in keys.items()))
    wanted = percent * long_enough.count() // 100
    cut = cutoff(long_enough, list(keys), wanted)
    own = F.struct(*(c.alias(k) for k, c in list(keys.items())[: len(cut or [])]))
    drawn = (F.col("n_words") >= least_words) & (own <= F.struct(*(F.lit(v).cast("bigint").alias(k) for k, v in zip(keys, cut, strict=False)))) if cut else F.lit(False)
    columns = ["doc_id", "n_features", "weight", "score"]
    rest = rows.where(~drawn).select(*columns, F.lit(None).cast("bigint").alias("rank"))
    if not cut:
        return rest
    chosen = ranked(rows.where(drawn).select(*columns, *(c.alias(k) for k, c in keys.items())), list(keys))
    return rest.unionByName(chosen.select(*columns, F.col("_rank").alias("rank")))


def op12_importance_resampling(spark, sf_dir):
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: crc32 of every distinct feature is taken byte by byte, all features together.
SQL = r"""
WITH RECURSIVE
bits AS (SELECT i, 0 AS k, i::BIGINT AS c FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS crcs FROM bits WHERE k = 8),
texts AS (
  SELECT row_number() OVER () AS r, true AS own, doc_id, text FROM documents
  UNION ALL SELECT row_number() OVER (), false, NULL, text FROM benchmark),
worded AS (SELECT r, own, doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts),
placed AS (SELECT r, own, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM worded),
paired AS (SELECT r, own, w, LEAD(w) OVER (PARTITION BY own, r ORDER BY i) AS w2 FROM placed),
features AS (SELECT r, own, w AS f FROM paired UNION ALL SELECT r, own, w || ' ' || w2 FROM paired WHERE w2 IS NOT NULL),
crcs AS (
  SELECT f, hex(encode(f)) AS h, 1 AS p, 4294967295::BIGINT AS c FROM (SELECT DISTINCT f FROM features)
  UNION ALL
  SELECT f, h, p + 2, xor(c >> 8, crcs[(xor(c & 255, CAST('0x' || substr(h, p, 2) AS BIGINT)) + 1)::BIGINT]) FROM crcs, crc_table WHERE p < length(h)),
buckets AS (SELECT f, xor(c, 4294967295) % 10000 AS b FROM crcs WHERE p > length(h)),
counts AS (SELECT b, COUNT(*) FILTER (WHERE own) AS s, COUNT(*) FILTER (WHERE NOT own) AS t FROM features JOIN buckets USING (f) GROUP BY b),
sums AS (SELECT COALESCE(SUM(s), 0)::DOUBLE AS s_all, COALESCE(SUM(t), 0)::DOUBLE AS t_all FROM counts),
gains AS (SELECT b, floor(1000 * ln(((t + 1)::DOUBLE * (s_all + 10000)) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS g FROM counts, sums),
totals AS (SELECT r, COUNT(*) AS n, SUM(g)::BIGINT AS g FROM features JOIN buckets USING (f) JOIN gains USING (b) WHERE own GROUP BY r),
weighed AS (
  SELECT w.r, doc_id, len(ws) AS n_words, COALESCE(n, 0) AS n_features,
    COALESCE((g - ((g % n) + n) % n) // n, 0) AS weight,
    (CAST('0x' || substr(sha256('7:' || COALESCE(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE AS u
  FROM worded w LEFT JOIN totals t ON w.r = t.r WHERE own),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln(u)))::BIGINT AS score FROM weighed),
ranks AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, COUNT(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranks USING (r)
"""

QUERIES = {"op12_importance_resampling": (op12_importance_resampling, SQL)}
