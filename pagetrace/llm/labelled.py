"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetrace.llm.common import held_out

#: Labelled documents that a classifier is fitted on, about.
SAMPLE = 8192


def sample(docs: DataFrame, labels: DataFrame, label: Column, size: int = SAMPLE, seed: int = 7) -> DataFrame:
    """(text, label) of about ``size`` labelled documents, chosen by a hash of the id; held-out rows never.

    Labels that are null, or whose id is null, count as none; an id with several labels takes the
    highest. The chosen ids are at most about ``size`` rows, whatever the tables' sizes.
    """
    known = labels.where(F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).alias("label"))
    known = known.where("label IS NOT NULL")
    total = known.count()
    share = min(1.0, size / max(1, total))
    chosen = known.where(F.xxhash64("doc_id", F.lit(seed)) / F.lit(2.0**64) + 0.5 <= share)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", F.col("label").cast("int").alias("label"))
