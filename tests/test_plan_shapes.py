"""Plans keep to what they need: columns, filters, shuffles, no driver-side or crossed joins."""

import re

import pytest
from pyspark.sql import functions as F

from pagetrace.operators import dialogue as D
from pagetrace.operators.catalog import newest_per_key
from pagetrace.suite.registry import registered
from tests.oracle import ROOT

FOLDER = f"{ROOT}/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def of(spark, name):
    return plan(registered()[name][0](spark, FOLDER))


def test_scan_reads_two_columns(spark):
    text = of(spark, "project_progress")
    (schema,) = set(re.findall(r"ReadSchema: struct<([^>]*)>", text))
    assert "o_totalprice" not in schema and "o_orderdate" not in schema


def test_filter_reaches_the_scan(spark):
    from pagetrace.sources.lenses import lens

    text = plan(lens(spark, FOLDER, "assets").where("asset_id = 7").select("filename"))
    assert "EqualTo(o_orderkey,7)" in text


def test_newest_row_combines_before_its_one_shuffle(spark):
    rows = spark.range(100).selectExpr("id % 3 AS k", "id AS v", "'x' AS t")
    text = plan(newest_per_key(rows, ["k"], ["v"]))
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1
    assert text.count("partial_max_by") >= 1


def test_settling_keeps_one_partitioning_of_the_dialogues(spark):
    """Truth, answers and gates are joined to rows that stay where they are."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        base = spark.range(10).selectExpr("id AS asset_id", "id AS region_id", "1 AS ord", "'t' AS raw_text", "1.0D AS ocr_average", "1.0D AS ocr_minimum")
        truth = base.select("asset_id", "region_id", F.lit("v").alias("verified_text"))
        once = len(re.findall("Exchange", plan(D.screen(base, truth))))
        again = D.apply_truth(D.screen(base, truth).drop("verified_text", "human_verified").withColumn("decision", F.lit("d")), truth)
        assert len(re.findall("Exchange", plan(again))) == once + 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize(
    "name",
    ["dialogue_screening", "block_assignment", "uncovered_candidates", "candidate_best_overlap", "story_input_safety_issues",
     "closest_claim_per_region", "page_recall_audit", "nearby_context", "script_reference_issues"],
)
def test_no_crossed_joins(spark, name):
    text = of(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_decisions_stay_in_the_jvm(spark):
    assert "Python" not in of(spark, "correction_decisions")
