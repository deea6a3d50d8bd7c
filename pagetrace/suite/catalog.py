"""Catalogue queries over the assets, projects and truth lenses."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagetrace.operators import catalog as C
from pagetrace.operators.numbering import with_neighbours
from pagetrace.sources.lenses import lens, table, with_lenses

QUERIES = {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return register



# The lens names look like ch<digit>_p<number>.<ext>: that order, spelled out.
NATURAL_ORDER = (
    "cast(regexp_extract(filename, '^ch([0-9]+)_p', 1) AS bigint), "
    "cast(regexp_extract(filename, '_p([0-9]+)', 1) AS bigint)"
)


@query(
    "asset_scan_filtered",
    with_lenses("assets")
    + """ SELECT project_id, asset_id, page_order, status FROM assets
    WHERE project_id % 2 = 0 AND status IN ('ready', 'failed') AND ocr_text IS NULL""",
)
def asset_scan_filtered(spark, d):
    a = lens(spark, d, "assets")
    kept = a.where((F.col("project_id") % 2 == 0) & F.col("status").isin("ready", "failed") & F.col("ocr_text").isNull())
    return kept.select("project_id", "asset_id", "page_order", "status")


@query(
    "image_filename_filter",
    with_lenses("assets")
    + """ SELECT lower(regexp_extract(filename, '(\\.[^.]+)$', 1)) AS ext, count(*) AS files,
      count(*) FILTER (WHERE lower(regexp_extract(filename, '(\\.[^.]+)$', 1)) IN ('.jpg','.jpeg','.png','.webp')) AS images
    FROM assets GROUP BY 1""",
)
def image_filename_filter(spark, d):
    a = lens(spark, d, "assets").withColumn("ext", C.extension(F.col("filename")))
    return a.groupBy("ext").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(C.is_image(F.col("filename"))).alias("images")
    )


@query(
    "ocr_work_queue",
    with_lenses("assets")
    + """ SELECT project_id, asset_id, 'processing' AS status FROM assets
    WHERE status = 'ready' AND ocr_text IS NULL""",
)
def ocr_work_queue(spark, d):
    return C.pending_ocr(lens(spark, d, "assets")).select("project_id", "asset_id", "status")


@query(
    "project_progress",
    with_lenses("assets")
    + """, c AS (SELECT project_id, count(*) AS total, count(ocr_text) AS completed,
        count(*) FILTER (WHERE status = 'processing') AS processing,
        count(*) FILTER (WHERE status = 'failed') AS failed FROM assets GROUP BY 1)
    SELECT *, CASE WHEN processing > 0 THEN 'processing' WHEN failed > 0 THEN 'completed_with_errors'
        WHEN completed = total THEN 'completed' ELSE 'idle' END AS state,
      cast(round_even(cast(completed AS double) / total * 100, 0) AS bigint) AS percent FROM c""",
)
def project_progress(spark, d):
    return C.project_progress(lens(spark, d, "assets"))


@query(
    "listing_totals",
    with_lenses("assets")
    + """ SELECT project_id, count(*) AS total, cast(greatest(1, ceil(count(*) / 50.0)) AS bigint) AS total_pages
    FROM assets GROUP BY 1""",
)
def listing_totals(spark, d):
    return C.page_totals(lens(spark, d, "assets"), 50)


@query(
    "listing_page_by_order",
    with_lenses("assets")
    + " SELECT asset_id, filename, page_order FROM assets ORDER BY page_order, asset_id LIMIT 50 OFFSET 100",
)
def listing_page_by_order(spark, d):
    page = C.listing_page(lens(spark, d, "assets"), 3, 50, [F.col("page_order"), F.col("asset_id")])
    return page.select("asset_id", "filename", "page_order")


@query(
    "listing_newest_first",
    with_lenses("assets")
    + """ SELECT asset_id, filename FROM assets ORDER BY created_at DESC, asset_id LIMIT 50""",
)
def listing_newest_first(spark, d):
    order = [F.col("created_at").desc(), F.col("asset_id")]
    return C.listing_page(lens(spark, d, "assets"), 1, 50, order).select("asset_id", "filename")


@query(
    "natural_page_renumber",
    with_lenses("assets")
    + f""" SELECT project_id, asset_id, filename, row_number() OVER (
        PARTITION BY project_id ORDER BY {NATURAL_ORDER}, created_at, asset_id) AS page_order FROM assets""",
)
def natural_page_renumber(spark, d):
    return C.renumber_pages(lens(spark, d, "assets")).select("project_id", "asset_id", "filename", "page_order")


@query(
    "upload_append_numbering",
    with_lenses("assets")
    + f""", known AS (SELECT * FROM assets WHERE asset_id % 4 <> 0),
    last AS (SELECT project_id, max(page_order) AS last FROM known GROUP BY 1),
    uploads AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY {NATURAL_ORDER}, asset_id) AS i
      FROM assets WHERE asset_id % 4 = 0)
    SELECT u.project_id, asset_id, filename, coalesce(last, 0) + i AS page_order
    FROM uploads u LEFT JOIN last USING (project_id) WHERE filename NOT LIKE '%.gif'""",
)
def upload_append_numbering(spark, d):
    a = lens(spark, d, "assets")
    new = F.col("asset_id") % 4 == 0
    return C.number_uploads(a.where(~new), a.where(new)).select("project_id", "asset_id", "filename", "page_order")


@query(
    "newest_truth_per_region",
    with_lenses("truth")
    + """ SELECT id, asset_id, region_id, verified_text FROM truth
    QUALIFY row_number() OVER (PARTITION BY asset_id, region_id ORDER BY created_at DESC, id DESC) = 1""",
)
def newest_truth_per_region(spark, d):
    t = lens(spark, d, "truth")
    return C.newest_per_key(t, ["asset_id", "region_id"], ["created_at", "id"]).drop("created_at")


@query(
    "truth_upsert",
    with_lenses("truth")
    + """, stored AS (SELECT * FROM truth WHERE id % 2 = 0
        QUALIFY row_number() OVER (PARTITION BY asset_id, region_id ORDER BY created_at DESC, id DESC) = 1),
    feed AS (SELECT id, asset_id, region_id, upper(verified_text) AS verified_text, created_at FROM truth WHERE id % 2 = 1)
    SELECT id, asset_id, region_id, verified_text FROM (SELECT * FROM stored UNION ALL SELECT * FROM feed)
    QUALIFY row_number() OVER (PARTITION BY asset_id, region_id ORDER BY created_at DESC, id DESC) = 1""",
)
def truth_upsert(spark, d):
    t = lens(spark, d, "truth")
    keys, version = ["asset_id", "region_id"], ["created_at", "id"]
    stored = C.newest_per_key(t.where("id % 2 = 0"), keys, version)
    feed = t.where("id % 2 = 1").withColumn("verified_text", F.upper("verified_text"))
    return C.upsert(stored, feed, keys, version).drop("created_at")


@query(
    "project_cascade_delete",
    with_lenses("assets", "projects", "truth")
    + """, doomed AS (SELECT project_id FROM projects WHERE project_id % 10 = 3),
    pages AS (SELECT asset_id FROM assets WHERE project_id IN (FROM doomed))
    SELECT 'projects' AS table_name, count(*) AS kept FROM projects WHERE project_id NOT IN (FROM doomed)
    UNION ALL SELECT 'assets', count(*) FROM assets WHERE project_id NOT IN (FROM doomed)
    UNION ALL SELECT 'ground_truth', count(*) FROM truth WHERE asset_id NOT IN (FROM pages)
    UNION ALL SELECT 'story_analyses', count(*) FROM projects WHERE project_id % 2 = 0 AND project_id NOT IN (FROM doomed)
    UNION ALL SELECT 'short_scripts', count(*) FROM projects WHERE project_id % 3 = 0 AND project_id NOT IN (FROM doomed)""",
)
def project_cascade_delete(spark, d):
    projects = lens(spark, d, "projects")
    tables = {
        "projects": projects,
        "assets": lens(spark, d, "assets"),
        "ground_truth": lens(spark, d, "truth"),
        "story_analyses": projects.where("project_id % 2 = 0"),
        "short_scripts": projects.where("project_id % 3 = 0"),
    }
    kept = C.without_projects(projects.where("project_id % 10 = 3"), tables)
    out = None
    for name, rows in kept.items():
        one = rows.agg(F.count(F.lit(1)).alias("kept")).select(F.lit(name).alias("table_name"), "kept")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "asset_batch_delete",
    with_lenses("assets")
    + """ SELECT 'kept' AS side, count(*) AS n, sum(asset_id) AS id_sum FROM assets WHERE asset_id % 7 <> 1
    UNION ALL SELECT 'deleted', count(*), NULL FROM assets WHERE asset_id % 7 = 1""",
)
def asset_batch_delete(spark, d):
    a = lens(spark, d, "assets")
    kept, deleted = C.delete_pages(a, a.where("asset_id % 7 = 1").select("asset_id"))
    left = kept.agg(F.count(F.lit(1)).alias("n"), F.sum("asset_id").alias("id_sum"))
    return left.select(F.lit("kept").alias("side"), "n", "id_sum").union(
        deleted.select(F.lit("deleted"), "deleted_count", F.lit(None).cast("long"))
    )


def _documents(spark, d):
    return table(spark, d, "documents").select(
        F.col("source").alias("project_id"),
        F.col("doc_id").alias("asset_id"),
        F.concat(F.lit("p"), F.col("doc_id"), F.lit(".jpg")).alias("filename"),
        (F.col("doc_id") + 1).alias("page_order"),
        F.when(F.col("doc_id") % 9 != 0, F.col("text")).alias("content"),
    )


@query(
    "dataset_clone_manifest",
    """SELECT concat('copy-', source) AS project_id, concat('copy-', cast(doc_id AS varchar)) AS asset_id,
      doc_id AS source_asset_id, concat('p', cast(doc_id AS varchar), '.jpg') AS filename,
      row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page_order,
      'ready' AS status, 'pending' AS vision_status, 'pending' AS dialogue_status, sha256(text) AS sha256
    FROM documents WHERE doc_id % 9 <> 0""",
)
def dataset_clone_manifest(spark, d):
    return C.clone_project(_documents(spark, d), "copy-")


@query(
    "input_manifest",
    """SELECT source AS project_id, doc_id AS asset_id, sha256(text) AS content_sha256,
      sha256(concat('{"asset_id":', cast(doc_id AS varchar), ',"filename":"p', cast(doc_id AS varchar),
        '.jpg","page_order":', cast(doc_id + 1 AS varchar), '}')) AS record_sha256
    FROM documents WHERE doc_id % 9 <> 0""",
)
def input_manifest(spark, d):
    return C.manifest(_documents(spark, d).where(F.col("content").isNotNull()))


@query(
    "manifest_lock_check",
    """SELECT doc_id AS asset_id, CASE WHEN doc_id % 10 = 1 THEN 'missing' ELSE 'changed' END AS difference
    FROM documents WHERE doc_id % 10 = 1 OR doc_id % 10 = 2""",
)
def manifest_lock_check(spark, d):
    expected = table(spark, d, "documents").select(F.col("doc_id").alias("asset_id"), F.sha2("text", 256).alias("hash"))
    actual = table(spark, d, "documents").where("doc_id % 10 <> 1").select(
        F.col("doc_id").alias("asset_id"),
        F.when(F.col("doc_id") % 10 == 2, F.sha2(F.concat("text", F.lit("!")), 256))
        .otherwise(F.sha2("text", 256))
        .alias("hash"),
    )
    return C.manifest_difference(expected, actual)


@query(
    "project_thumbnails",
    with_lenses("assets", "projects")
    + """ SELECT p.project_id, name, content_type, (SELECT arg_min(file_path, row(page_order, created_at))
      FROM assets a WHERE a.project_id = p.project_id) AS thumbnail_path FROM projects p""",
)
def project_thumbnails(spark, d):
    return C.thumbnails(lens(spark, d, "projects"), lens(spark, d, "assets"))


@query(
    "problem_page_counts",
    with_lenses("assets")
    + """ SELECT project_id,
      count(*) FILTER (WHERE 'failed' IN (status, vision_status, dialogue_status)) AS failed_pages,
      count(*) FILTER (WHERE dialogue_status = 'needs_review') AS review_pages FROM assets GROUP BY 1""",
)
def problem_page_counts(spark, d):
    return C.problem_pages(lens(spark, d, "assets"))


@query(
    "listing_append_unseen",
    with_lenses("assets")
    + """ SELECT asset_id, max(batch) AS batch FROM (
      SELECT asset_id, 1 AS batch FROM assets WHERE asset_id % 3 <> 0
      UNION ALL SELECT asset_id, 2 FROM assets WHERE asset_id % 3 = 0) GROUP BY 1""",
)
def listing_append_unseen(spark, d):
    a = lens(spark, d, "assets").select("asset_id")
    known = a.where("asset_id % 3 <> 0").withColumn("batch", F.lit(1))
    incoming = a.where("asset_id % 2 = 0 OR asset_id % 3 = 0").withColumn("batch", F.lit(2))
    return C.append_unseen(known, incoming, "asset_id")


@query(
    "truth_snapshot_changes",
    with_lenses("truth")
    + """ SELECT id, verified_text, 'lost' AS change FROM truth WHERE id % 50 = 7
    UNION ALL SELECT id, concat(verified_text, '*'), 'gained' FROM truth WHERE id % 50 = 7""",
)
def truth_snapshot_changes(spark, d):
    before = lens(spark, d, "truth").select("id", "verified_text")
    after = before.withColumn(
        "verified_text",
        F.when(F.col("id") % 50 == 7, F.concat("verified_text", F.lit("*"))).otherwise(F.col("verified_text")),
    )
    return C.row_changes(before, after)


@query(
    "page_order_neighbours",
    with_lenses("assets")
    + """ SELECT project_id, asset_id, lag(asset_id) OVER w AS previous_id, lead(asset_id) OVER w AS next_id
    FROM assets WINDOW w AS (PARTITION BY project_id ORDER BY page_order)""",
)
def page_order_neighbours(spark, d):
    near = with_neighbours(lens(spark, d, "assets"), ["project_id"], "page_order", ["asset_id"])
    return near.select(
        "project_id",
        "asset_id",
        F.col("previous.asset_id").alias("previous_id"),
        F.col("next.asset_id").alias("next_id"),
    )
