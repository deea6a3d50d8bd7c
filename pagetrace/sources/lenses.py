"""Driver tables seen as model tables.

Each lens is one projection without windows, so a hot project or page costs no
more than its rows. The same text runs on both engines (``SQL`` below); only the
line split of ``blocks`` differs, see ``SQL["blocks"]``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrace.operators.components import PAGE_BOUND, large_keys
from pagetrace.session import deal, tasks_for

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

_SHARED = {
    # Catalogue: project = customer, page = order.
    "assets": """
        SELECT o_custkey AS project_id, o_orderkey AS asset_id, o_orderkey AS page_order,
          concat('ch', cast(o_orderkey % 7 AS string), '_p', cast(o_orderkey % 1000 AS string),
                 CASE WHEN o_orderkey % 50 = 0 THEN '.gif' WHEN o_orderkey % 3 = 0 THEN '.PNG' ELSE '.jpg' END) AS filename,
          CASE WHEN o_orderkey % 23 = 0 THEN 'excluded' WHEN o_orderstatus = 'P' THEN 'processing'
               WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'ready' END AS status,
          CASE o_orderkey % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' ELSE 'completed' END AS vision_status,
          CASE o_orderkey % 4 WHEN 0 THEN 'needs_review' WHEN 1 THEN 'failed' ELSE 'completed' END AS dialogue_status,
          CASE WHEN o_orderstatus = 'O' AND o_orderkey % 10 <> 0 THEN 'text' END AS ocr_text,
          concat('uploads/', cast(o_orderkey AS string)) AS file_path,
          o_orderdate AS created_at
        FROM orders""",
    # Projects: one per customer.
    "projects": """
        SELECT c_custkey AS project_id, c_name AS name, c_mktsegment AS content_type FROM customer""",
    # Geometry: page = order, block = packed line key; equal keys are merged.
    "boxes": """
        SELECT asset_id, block_id, x0, y0, x0 + w AS x1, y0 + h AS y1, confidence FROM (
          SELECT l_orderkey AS asset_id,
            (l_partkey * 100003 + l_suppkey) * 8 + l_linenumber AS block_id,
            cast(min((l_partkey * 37) % 400) AS int) AS x0, cast(min((l_suppkey * 53) % 300) AS int) AS y0,
            cast(min(20 + cast(l_quantity AS int)) AS int) AS w, cast(min(12 + 2 * l_linenumber) AS int) AS h,
            min(cast(l_partkey % 100 AS double) / cast(100 AS double)) AS confidence
          FROM lineitem GROUP BY l_orderkey, (l_partkey * 100003 + l_suppkey) * 8 + l_linenumber) t""",
    # Dialogues with a synthetic correction.
    "dialogues": """
        SELECT conv_id AS asset_id, turn AS region_id, turn + 1 AS ord,
          CASE role WHEN 'user' THEN 'dialogue' WHEN 'assistant' THEN 'narration' ELSE 'game_ui' END AS text_role,
          text AS raw_text,
          CASE WHEN (conv_id + turn) % 3 = 0 THEN replace(text, 'ou', 'o') ELSE text END AS clean_text,
          cast((conv_id * 31 + turn * 7) % 101 AS double) / cast(100 AS double) AS confidence,
          cast((conv_id * 17 + turn * 11) % 101 AS double) / cast(100 AS double) AS ocr_confidence,
          (conv_id + turn * 3) % 7 = 0 AS needs_review,
          CASE (conv_id + turn) % 4 WHEN 0 THEN 'unchanged' WHEN 1 THEN 'ocr_typo' WHEN 2 THEN 'fragmented_ocr' ELSE 'low_confidence' END AS reason_code
        FROM conversations""",
    # Verification history with repeated keys.
    "truth": """
        SELECT event_id AS id, user_id AS asset_id, event_id % 10 AS region_id,
          concat(event_type, ':', cast(event_id AS string)) AS verified_text, ts AS created_at
        FROM events""",
    # Stage and model-call telemetry: run = day-of-log bucket, page = user.
    "stages": """
        SELECT event_id AS ord, event_id % 16 AS run_id, user_id AS asset_id,
          CASE event_type WHEN 'signup' THEN 'ocr' WHEN 'view' THEN 'vision_layout' WHEN 'click' THEN 'dialogue_correction'
            WHEN 'purchase' THEN CASE WHEN event_id % 16 < 8 THEN 'page_total' ELSE 'story_grounding' END
            ELSE CASE WHEN event_id % 3 = 0 THEN 'reliability_total' ELSE 'coverage_calculation' END END AS stage,
          value AS duration_seconds, event_type <> 'error' AS success, ts
        FROM events""",
    "calls": """
        SELECT event_id AS ord, event_id % 16 AS run_id, user_id AS asset_id,
          CASE event_type WHEN 'signup' THEN 'vision_layout' WHEN 'view' THEN 'dialogue_correction'
            WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'reading_order' ELSE 'vision_recovery' END
            WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'story_analyzer' ELSE 'story_analyzer_repair' END
            ELSE CASE WHEN event_id % 2 = 0 THEN 'coverage_recovery' ELSE 'dialogue_recovery' END END AS stage,
          1 + event_id % 3 AS attempt, value AS duration_seconds, ts
        FROM events""",
}

_BLOCKS_SPARK = """
    SELECT doc_id AS asset_id, source AS project_id, cast(pos AS bigint) AS block_id, t AS text,
      cast((doc_id * 31 + pos * 7) % 101 AS double) / cast(100 AS double) AS confidence
    FROM documents LATERAL VIEW posexplode(split(text, '\\n')) x AS pos, t"""
_BLOCKS_DUCKDB = """
    SELECT asset_id, project_id, block_id, text,
      cast((asset_id * 31 + block_id * 7) % 101 AS double) / cast(100 AS double) AS confidence
    FROM (SELECT doc_id AS asset_id, source AS project_id,
                 generate_subscripts(p, 1) - 1 AS block_id, unnest(p) AS text
          FROM (SELECT doc_id, source, string_split(text, chr(10)) AS p FROM documents))"""

# Lenses that group: their rows are dealt by the grouping before it, so that no scan task holds the groups of a whole file. The page comes first.
DEALT = {"boxes": ("lineitem", ["l_orderkey", "(l_partkey * 100003 + l_suppkey) * 8 + l_linenumber"])}

SPARK = {**_SHARED, "blocks": _BLOCKS_SPARK}
SQL = {**_SHARED, "blocks": _BLOCKS_DUCKDB}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lens(spark: SparkSession, folder: str, name: str, whole_pages: bool = False) -> DataFrame:
    """The lens as a DataFrame over the driver tables of ``folder``.

    With ``whole_pages`` a page's rows lie in one task, so that steps a page need no shuffle; for pages of few rows.
    """
    text = SPARK[name]
    used = {t: table(spark, folder, t) for t in TABLES if f"FROM {t}" in text}
    if name in DEALT:
        source, by = DEALT[name]
        used[source] = deal(used[source], *(by[:1] if whole_pages else by), rows=used[source].count())
    for t in used:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(text, **used)


def page_boxes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame | None, int]:
    """The box lens, its pages that may have more than ``PAGE_BOUND`` boxes, and its number of tasks; without any, whole pages in one task."""
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("asset_id"))
    large = large_keys(lines, ["asset_id"], PAGE_BOUND)
    return lens(spark, folder, "boxes", whole_pages=large is None), large, tasks_for(spark, lines.count())


def with_lenses(*names: str) -> str:
    """``WITH`` prefix for an oracle query that uses the named lenses."""
    return "WITH RECURSIVE " + ", ".join(f"{name} AS ({SQL[name]})" for name in names)
