"""A training corpus from documents: quality, near-duplicates, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir), docs with the columns of ``documents``, and works on all
that its predecessor kept; all but the last return the same columns. Stages with Python lower the
session's Arrow batches to a few MB, as whole texts go through them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrace.llm import byte_bpe, mixing, personal_data, quality, simhash
from pagetrace.llm.common import small_batches, stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near-duplicates: five-word shingles, two fingerprint words, at least 0.8 of the bits equal; of
#: these candidates, those whose sets of shingles have an exact Jaccard of at least 0.8 if a text
#: has fewer than 64 shingles, whose votes say little, and of at least 0.5 otherwise.
SHINGLE = 5
WORDS = 2
RADIUS = 24
FLOORS = (64, 0.8, 0.5)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tail probability says that they are usable."""
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    model = quality.fit(docs, quality.graded(table(spark, sf_dir, "labels")))
    return quality.scored(docs, model).where(F.col("_tail") >= quality.KEEP).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays; repeated rows count as documents."""
    small_batches(spark)
    numbered = stored(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row")), "pipeline-numbered")
    keyed = numbered.select(F.struct("doc_id", F.col("_row").alias("row")).alias("key"), "text")
    groups = simhash.alike(keyed, RADIUS, SHINGLE, WORDS, FLOORS, key="key")
    first = groups.where("key = component_id").select(F.col("key.row").alias("_row"))
    return numbered.join(first, "_row", "left_semi").select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data give way to their kind in brackets; every document stays."""
    found = personal_data.find(docs.select(*COLUMNS))
    found = found.withColumn("_redacted", personal_data.redacted(F.col("text"), F.col("_spans")))
    size = F.when(F.size("_spans") > 0, F.length("_redacted")).otherwise(F.col("n_chars")).cast("bigint")
    return found.select("doc_id", F.col("_redacted").alias("text"), "lang", "source", size.alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    mixed = mixing.mix(docs, COLUMNS).where("_copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*COLUMNS)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of them and of their decoded bytes."""
    small_batches(spark)
    return byte_bpe.encoded(docs, keep_ids=True)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("byte_bpe", encode_bytes),
]

#: The first two stages cannot be expressed in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
