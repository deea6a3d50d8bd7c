"""Readers and writers: database tables, images, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrace.operators.catalog import is_image

# Fixed values -------------------------------------------------------------
# Case-insensitive glob for .jpg .jpeg .png .webp.
IMAGE_GLOB = "*.{[jJ][pP][gG],[jJ][pP][eE][gG],[pP][nN][gG],[wW][eE][bB][pP]}"
# --------------------------------------------------------------------------


def read_database(
    spark: SparkSession, url: str, name: str, split_on: str, bounds: tuple[int, int], parts: int, **options: str
) -> DataFrame:
    """A database table read by ranges of an integer column; filters are pushed to the database."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=name, partitionColumn=split_on, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts, **options)
        .load()
    )


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, filename, length, content) of the image files below ``path``."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", IMAGE_GLOB).load(path)
    )
    named = files.withColumn("filename", F.regexp_extract("path", r"([^/]+)$", 1))
    return named.where(is_image(F.col("filename"))).select("path", "filename", "length", "content")


def write_report(report: DataFrame, path: str, kind: str = "json") -> None:
    """Replace a report; the commit protocol shows either the old or the new one."""
    report.write.mode("overwrite").format(kind).save(path)
