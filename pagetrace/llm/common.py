"""What the operators share: readers, the shared folder, split rules, Arrow helpers."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrace.session import checkpoint_dir

#: Words as all contracts here define them: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)
WORD_BYTES_RE = re.compile(WORD.encode())

ArrowBatches = Iterator[pa.RecordBatch]

ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of an Arrow batch where a session has Spark's own limit: a task holds several copies of one, in both processes.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder under the checkpoint folder, which driver and executors share."""
    return f"{checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame, kind: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and reread: cuts lineage, survives lost executors."""
    path = shared_folder(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of the session have ``BATCH_BYTES``; a limit that the user has set stays."""
    if spark.conf.get(ARROW_BYTES) == f"{64 << 20}b":
        spark.conf.set(ARROW_BYTES, f"{BATCH_BYTES}b")


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Rows whose labels are never learnt: crc32 of the id as text leaves 2 modulo 4."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def batches(function: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[ArrowBatches], ArrowBatches]:
    def run(given: ArrowBatches) -> ArrowBatches:
        for batch in given:
            if batch.num_rows:
                yield function(batch)

    return run


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch, null as the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def record_batch(columns: dict[str, object], types: Sequence[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    arrays = []
    for name, kind in types:
        values = columns[name]
        arrays.append(values if isinstance(values, pa.Array) else pa.array(values, kind))
    return pa.RecordBatch.from_arrays([a.cast(t) for a, (_, t) in zip(arrays, types, strict=True)], [n for n, _ in types])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))
