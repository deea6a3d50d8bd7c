"""Catalogue operators: pages, projects, upserts, deletes, numbering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetrace.operators.numbering import number_rows

# Fixed values -------------------------------------------------------------
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".webp"]
# --------------------------------------------------------------------------


def extension(filename: Column) -> Column:
    """Lower-cased suffix with its dot; empty for names without one."""
    return F.lower(F.regexp_extract(filename, r"[^/.][^/]*?(\.[^./]+)$", 1))


def is_image(filename: Column) -> Column:
    return extension(filename).isin(IMAGE_EXTENSIONS)


def natural_key(filename: Column) -> Column:
    """Array that sorts names with digit runs compared as numbers."""
    stem = F.regexp_replace(filename, r"(?<=[^/])\.[^./]+$", "")
    parts = F.regexp_extract_all(stem, F.lit(r"(\d+|\D+)"), F.lit(1))

    def part(value: Column) -> Column:
        digits = F.ltrim(value, F.lit("0"))
        # The length in front makes longer numbers sort after shorter ones.
        number = F.concat(F.lit("0"), F.lpad(F.length(digits).cast("string"), 4, "0"), digits)
        return F.when(value.rlike(r"^\d"), number).otherwise(F.concat(F.lit("1"), F.lower(value)))

    return F.transform(parts, part)


def pending_ocr(assets: DataFrame) -> DataFrame:
    """Ready pages without text, marked as taken into processing."""
    waiting = assets.where((F.col("status") == "ready") & F.col("ocr_text").isNull())
    return waiting.withColumn("status", F.lit("processing"))


def project_progress(assets: DataFrame) -> DataFrame:
    counts = assets.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("ocr_text").isNotNull()).alias("completed"),
        F.count_if(F.col("status") == "processing").alias("processing"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )
    return counts.withColumn("state", progress_state()).withColumn("percent", progress_percent())


def progress_state() -> Column:
    return (
        F.when(F.col("processing") > 0, "processing")
        .when(F.col("failed") > 0, "completed_with_errors")
        .when((F.col("total") > 0) & (F.col("completed") == F.col("total")), "completed")
        .otherwise("idle")
    )


def progress_percent() -> Column:
    share = F.col("completed").cast("double") / F.nullif(F.col("total"), F.lit(0)).cast("double")
    return F.coalesce(F.bround(share * 100).cast("long"), F.lit(0).cast("long"))


def page_totals(assets: DataFrame, page_size: int) -> DataFrame:
    return assets.groupBy("project_id").agg(F.count(F.lit(1)).alias("total")).withColumn(
        "total_pages", F.greatest(F.lit(1), F.ceil(F.col("total") / page_size)).cast("long")
    )


def listing_page(assets: DataFrame, page: int, page_size: int, order: Sequence[Column]) -> DataFrame:
    """One page of a listing; Spark keeps only offset + limit rows per task."""
    return assets.orderBy(*order).offset((page - 1) * page_size).limit(page_size)


def append_unseen(known: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    return known.unionByName(incoming.join(known.select(key), key, "left_anti"))


def renumber_pages(assets: DataFrame) -> DataFrame:
    """Number every project's pages 1..n in natural filename order."""
    keyed = assets.withColumn("_natural", natural_key(F.col("filename")))
    order = [F.col("_natural"), F.col("created_at"), F.col("asset_id")]
    return number_rows(keyed.drop("page_order"), ["project_id"], order, into="page_order").drop("_natural")


def number_uploads(existing: DataFrame, uploads: DataFrame) -> DataFrame:
    """Continue after each project's last page; skipped files still use a number."""
    last = existing.groupBy("project_id").agg(F.max("page_order").alias("_last"))
    keyed = uploads.withColumn("_natural", natural_key(F.col("filename")))
    numbered = number_rows(
        keyed, ["project_id"], [F.col("_natural"), F.col("asset_id")], into="_index"
    )
    return (
        numbered.where(is_image(F.col("filename")))
        .join(last, "project_id", "left")
        .withColumn("page_order", F.coalesce("_last", F.lit(0)) + F.col("_index"))
        .drop("_last", "_index", "_natural")
    )


def newest_per_key(rows: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """One row per key, the one with the greatest version.

    ``max_by`` combines map-side, so a key with very many versions stays cheap.
    """
    rest = [c for c in rows.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*version)).alias("_row")
    return rows.groupBy(*keys).agg(newest).select(*keys, "_row.*").select(*rows.columns)


def upsert(
    stored: DataFrame, incoming: DataFrame, keys: Sequence[str], version: Sequence[str]
) -> DataFrame:
    return newest_per_key(stored.unionByName(incoming), keys, version)


def without_projects(
    doomed: DataFrame, tables: dict[str, DataFrame], assets: str = "assets", truth: str = "ground_truth"
) -> dict[str, DataFrame]:
    """Every table without the doomed projects; truth rows go through their page."""
    doomed = doomed.select("project_id").distinct()
    pages = tables[assets].join(doomed, "project_id", "left_semi").select("asset_id").distinct()
    return {
        name: rows.join(pages, "asset_id", "left_anti")
        if name == truth
        else rows.join(doomed, "project_id", "left_anti")
        for name, rows in tables.items()
    }


def delete_pages(assets: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pages kept, and a one-row count of the pages deleted."""
    ids = ids.select("asset_id").distinct()
    kept = assets.join(ids, "asset_id", "left_anti")
    deleted = assets.join(ids, "asset_id", "left_semi").agg(F.count(F.lit(1)).alias("deleted_count"))
    return kept, deleted


def clone_project(assets: DataFrame, prefix: str) -> DataFrame:
    """Copy the pages that have content: new ids, numbers 1..n, fresh states, equal hash.

    ``content`` is the page's bytes or text; its hash is kept beside the copy's.
    """
    usable = assets.where(F.col("content").isNotNull())
    order = [F.col("page_order"), F.col("asset_id")]
    numbered = number_rows(
        usable, ["project_id"], order, into="_position", bucket=F.floor(F.col("page_order") / 4096)
    )
    return numbered.select(
        F.concat(F.lit(prefix), F.col("project_id").cast("string")).alias("project_id"),
        F.concat(F.lit(prefix), F.col("asset_id").cast("string")).alias("asset_id"),
        F.col("asset_id").alias("source_asset_id"),
        "filename",
        F.col("_position").alias("page_order"),
        F.lit("ready").alias("status"),
        F.lit("pending").alias("vision_status"),
        F.lit("pending").alias("dialogue_status"),
        F.sha2(F.col("content").cast("binary"), 256).alias("sha256"),
    )


def manifest(assets: DataFrame) -> DataFrame:
    """Content-addressed list of inputs: hash of the bytes and of the canonical record."""
    from pagetrace.functions.hashing import fingerprint

    return assets.select(
        "project_id",
        "asset_id",
        F.sha2(F.col("content").cast("binary"), 256).alias("content_sha256"),
        fingerprint(
            asset_id=F.col("asset_id"), filename=F.col("filename"), page_order=F.col("page_order")
        ).alias("record_sha256"),
    )


def manifest_difference(expected: DataFrame, actual: DataFrame, key: str = "asset_id") -> DataFrame:
    """Rows that differ between two manifests; empty means the lock holds."""
    fields = [c for c in expected.columns if c != key]
    left = expected.select(F.col(key), F.struct(*fields).alias("_e"))
    right = actual.select(F.col(key), F.struct(*fields).alias("_a"))
    joined = left.join(right, key, "full_outer")
    return joined.where(~F.col("_e").eqNullSafe(F.col("_a"))).select(
        key,
        F.when(F.col("_e").isNull(), "unexpected")
        .when(F.col("_a").isNull(), "missing")
        .otherwise("changed")
        .alias("difference"),
    )


def thumbnails(projects: DataFrame, assets: DataFrame) -> DataFrame:
    first = assets.groupBy("project_id").agg(
        F.min_by("file_path", F.struct("page_order", "created_at")).alias("thumbnail_path")
    )
    return projects.join(first, "project_id", "left")


def problem_pages(assets: DataFrame) -> DataFrame:
    failed = (
        (F.col("status") == "failed")
        | (F.col("vision_status") == "failed")
        | (F.col("dialogue_status") == "failed")
    )
    return assets.groupBy("project_id").agg(
        F.count_if(failed).alias("failed_pages"),
        F.count_if(F.col("dialogue_status") == "needs_review").alias("review_pages"),
    )


def row_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows lost and gained between two snapshots (with multiplicity)."""
    lost = before.exceptAll(after).withColumn("change", F.lit("lost"))
    return lost.unionByName(after.exceptAll(before).withColumn("change", F.lit("gained")))
