"""Audit queries: verified regions, input safety, totals, preservation, run comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagetrace.functions import text as T
from pagetrace.operators import audit as A
from pagetrace.operators import dialogue as D
from pagetrace.operators.catalog import newest_per_key
from pagetrace.sources.lenses import lens, table, with_lenses
from pagetrace.sources.story_lens import story, with_story

QUERIES = {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return register


@query(
    "verified_region_audit",
    with_lenses("dialogues", "truth")
    + """, newest AS (SELECT asset_id, region_id, verified_text FROM truth QUALIFY row_number() OVER (PARTITION BY asset_id, region_id ORDER BY created_at DESC, id DESC) = 1),
    v AS (SELECT d.asset_id, d.region_id, CASE WHEN (d.asset_id + d.region_id) % 3 = 0 THEN n.verified_text ELSE d.raw_text END AS verified_text, n.verified_text AS t
      FROM dialogues d LEFT JOIN newest n USING (asset_id, region_id) WHERE d.needs_review)
    SELECT asset_id, region_id, verified_text, t IS NOT NULL AS ground_truth_exists, t IS NOT NULL AND coalesce(t = verified_text, false) AS ground_truth_matches FROM v""",
)
def verified_region_audit(spark, d):
    truth = newest_per_key(lens(spark, d, "truth"), ["asset_id", "region_id"], ["created_at", "id"])
    rows = lens(spark, d, "dialogues").join(truth.select("asset_id", "region_id", F.col("verified_text").alias("_t")), D.REGION, "left")
    k = (F.col("asset_id") + F.col("region_id")) % 3 == 0
    stored = rows.withColumns(
        {
            "decision": F.when(F.col("needs_review"), "verified").otherwise("auto_accepted"),
            "human_verified": F.lit(False),
            "verified_text": F.when(k, F.col("_t")).otherwise(F.col("raw_text")),
        }
    )
    return A.verified_regions(stored.drop("_t"), truth)


def _safety(spark, d):
    rows = story(spark, d, "evidence")
    k = F.col("asset_id") + F.col("region_id")
    evidence = rows.select(
        "project_id", "asset_id", "region_id",
        F.when(k % 29 == 4, "needs_review").when(k % 31 == 5, "guessed").when(k % 3 == 0, "verified").otherwise("auto_accepted").alias("decision"),
        F.when(k % 3 == 0, "verified").otherwise("clean").alias("text_source"), F.col("evidence_text").alias("final_text"),
    )
    evidence = evidence.unionByName(evidence.where((F.col("asset_id") % 37 == 6) & (F.col("region_id") == 1)))
    truth = rows.where((k % 3 == 0) & (k % 5 != 0)).select(
        "asset_id", "region_id", F.when(k % 7 == 1, F.lit("other")).otherwise(F.col("evidence_text")).alias("verified_text")
    )
    pages = rows.where("region_id = 1").select(
        "project_id", "asset_id",
        F.to_json(
            F.struct(
                "asset_id",
                F.array(F.struct(F.when(F.col("asset_id") % 41 == 7, "x").alias("Audit_ID"), F.concat(F.lit('say "audit_id": '), "evidence_text").alias("text"))).alias("dialogues"),
            )
        ).alias("json"),
    )
    return evidence, truth, pages


SAFETY = with_story("evidence") + """, e AS (SELECT project_id, asset_id, region_id, asset_id + region_id AS k, evidence_text FROM evidence),
  d AS (SELECT * FROM e UNION ALL SELECT * FROM e WHERE asset_id % 37 = 6 AND region_id = 1),
  issues AS (SELECT project_id, asset_id, region_id, 'duplicate_region' AS issue FROM e WHERE asset_id % 37 = 6 AND region_id = 1
    UNION ALL SELECT project_id, asset_id, region_id, 'review_gated_region' FROM d WHERE k % 29 = 4
    UNION ALL SELECT project_id, asset_id, region_id, 'non_authoritative_decision' FROM d WHERE k % 29 = 4 OR k % 31 = 5
    UNION ALL SELECT project_id, asset_id, region_id, 'verified_text_without_truth' FROM d WHERE k % 3 = 0 AND (k % 5 = 0 OR (k % 7 = 1 AND evidence_text <> 'other'))
    UNION ALL SELECT project_id, asset_id, NULL, 'audit_only_key' FROM e WHERE region_id = 1 AND asset_id % 41 = 7)"""


@query("story_input_safety_issues", SAFETY + " SELECT * FROM issues")
def story_input_safety_issues(spark, d):
    return A.input_safety_issues(*_safety(spark, d))


@query(
    "story_input_safety",
    SAFETY + """, s AS (SELECT project_id, count(*) AS represented_regions, count(*) FILTER (WHERE k % 3 = 0) AS v FROM d GROUP BY 1),
    i AS (SELECT project_id, count(*) AS issue_count, count(*) FILTER (WHERE issue = 'verified_text_without_truth') AS u, bool_or(issue = 'audit_only_key') AS a FROM issues GROUP BY 1),
    q AS (SELECT project_id, count(*) AS review_queue_count FROM d WHERE k % 29 = 4 GROUP BY 1)
    SELECT project_id, CASE WHEN coalesce(issue_count, 0) = 0 AND coalesce(review_queue_count, 0) = 0 AND project_id % 6 <> 5 THEN 'PASS' ELSE 'FAIL' END AS audit_status,
      coalesce(issue_count, 0) AS issue_count, coalesce(review_queue_count, 0) AS review_queue_count, represented_regions, v - coalesce(u, 0) AS ground_truth_backed_dialogues, coalesce(a, false) AS audit_only_contamination
    FROM s LEFT JOIN i USING (project_id) LEFT JOIN q USING (project_id)""",
)
def story_input_safety(spark, d):
    evidence, truth, pages = _safety(spark, d)
    summary = evidence.select("project_id").distinct().withColumn("status", F.when(F.col("project_id") % 6 == 5, "blocked").otherwise("ready"))
    issues = A.input_safety_issues(evidence, truth, pages)
    return A.input_safety(summary, evidence, issues, evidence.where("decision = 'needs_review'"))


@query(
    "forbidden_key_scan",
    """SELECT event_id, event_id % 3 = 0 AS forbidden FROM events""",
)
def forbidden_key_scan(spark, d):
    k = F.col("event_id") % 3
    text = (
        F.when(k == 0, F.concat(F.lit('{"a":[{"Expected_Text" :'), "props", F.lit("}]}")))
        .when(k == 1, F.concat(F.lit('{"a":"audit_id\\": 1","b":'), "props", F.lit("}")))
        .otherwise(F.col("props"))
    )
    return table(spark, d, "events").select("event_id", A.forbidden_key(text).alias("forbidden"))


@query(
    "region_reference_invariants",
    with_story("evidence")
    + """ SELECT project_id, count(*) + count(*) FILTER (WHERE region_id = 2) AS represented_regions, count(*) AS unique_region_references FROM evidence GROUP BY 1""",
)
def region_reference_invariants(spark, d):
    rows = story(spark, d, "evidence")
    return A.invariants(rows.unionByName(rows.where("region_id = 2")))


@query(
    "story_event_totals",
    with_story("evidence", "events")
    + """, c AS (SELECT project_id, count(*) FILTER (WHERE project_id % 2 = 1 AND region_id = 1) AS unresolved_evidence FROM evidence GROUP BY 1)
    SELECT project_id, unresolved_evidence, count(event_id) AS total_events, count(*) FILTER (WHERE story_role = 'main_story') AS main_story_events,
      count(*) FILTER (WHERE story_role = 'supporting_context') AS supporting_context_events, count(*) FILTER (WHERE story_role = 'main_story' AND event_ord % 7 <> 1) AS script_ready_main_story_events,
      coalesce(sum(CASE WHEN event_ord % 7 = 1 THEN 2 ELSE 0 END), 0)::bigint AS unsupported_claims,
      unresolved_evidence = 0 AND count(*) FILTER (WHERE story_role = 'main_story' AND event_ord % 7 <> 1) > 0 AS usable
    FROM c LEFT JOIN events USING (project_id) GROUP BY 1, 2""",
)
def story_event_totals(spark, d):
    bad = F.col("event_ord") % 7 == 1
    events = story(spark, d, "events").withColumns({"script_ready": ~bad, "unsupported_claims": F.when(bad, 2).otherwise(0)})
    coverage = story(spark, d, "evidence").groupBy("project_id").agg(
        F.count_if((F.col("project_id") % 2 == 1) & (F.col("region_id") == 1)).alias("unresolved_regions")
    )
    return A.event_totals(events, coverage)


@query(
    "truth_preservation",
    with_lenses("truth")
    + """, n AS (SELECT * FROM truth QUALIFY row_number() OVER (PARTITION BY asset_id, region_id ORDER BY created_at DESC, id DESC) = 1)
    SELECT 2 * count(*) FILTER (WHERE asset_id % 10 = 3) AS changed_rows, 0::bigint AS repeated_keys, count(*) AS before_count, count(*) AS after_count,
      count(*) FILTER (WHERE asset_id % 10 = 3) = 0 AS unchanged FROM n""",
)
def truth_preservation(spark, d):
    keys = ["asset_id", "region_id"]
    before = newest_per_key(lens(spark, d, "truth"), keys, ["created_at", "id"]).select(*keys, "verified_text")
    after = before.withColumn(
        "verified_text", F.when(F.col("asset_id") % 10 == 3, F.concat("verified_text", F.lit("!"))).otherwise(F.col("verified_text"))
    )
    return A.preservation(before, after, keys)


@query(
    "recovered_region_provenance",
    with_lenses("dialogues")
    + """ SELECT asset_id, region_id, CASE WHEN region_id % 3 = 0 THEN 'vision' ELSE 'recovery_metadata_preserved' END AS provenance FROM dialogues WHERE region_id % 3 = 0 OR region_id % 4 = 1 OR region_id = 2""",
)
def recovered_region_provenance(spark, d):
    r = F.col("region_id")
    regions = lens(spark, d, "dialogues").select(
        "asset_id", "region_id", F.when(r % 3 == 0, "vision").alias("provenance"), F.when(r % 4 == 1, F.lit(True)).alias("recovered"),
        F.when(r == 2, F.lit(0.5)).alias("recovery_confidence"),
    )
    return A.recovered_provenance(regions)


@query(
    "batch_experiment_diff",
    with_lenses("dialogues")
    + """, base AS (SELECT *, region_id = 3 AS isolated FROM dialogues)
    SELECT asset_id, region_id, 'row' AS field FROM base WHERE isolated
    UNION ALL SELECT asset_id, region_id, 'clean_text' FROM base WHERE NOT isolated AND (asset_id + region_id) % 6 = 1
    UNION ALL SELECT asset_id, region_id, 'decision' FROM base WHERE NOT isolated AND (asset_id + region_id) % 4 = 2""",
)
def batch_experiment_diff(spark, d):
    """Runs without and with the recovered region: siblings must not change, here some do."""
    rows = lens(spark, d, "dialogues").withColumn("decision", F.lit("auto_accepted"))
    k = F.col("asset_id") + F.col("region_id")
    without = A.snapshot("final", rows.where("region_id <> 3"))
    changed = rows.withColumns(
        {
            "clean_text": F.when(k % 6 == 1, F.concat("clean_text", F.lit("!"))).otherwise(F.col("clean_text")),
            "decision": F.when(k % 4 == 2, "needs_review").otherwise(F.col("decision")),
        }
    )
    joined = A.snapshot("final", changed)
    return A.compare_runs(without, joined, ["raw_text", "clean_text", "confidence", "reason_code", "decision"])


@query(
    "batch_experiment_merge",
    with_lenses("dialogues")
    + """ SELECT asset_id, region_id, ord, CASE WHEN region_id = 3 THEN 'needs_review' ELSE 'auto_accepted' END AS decision FROM dialogues""",
)
def batch_experiment_merge(spark, d):
    rows = lens(spark, d, "dialogues")
    trusted = rows.where("region_id <> 3").withColumn("decision", F.lit("auto_accepted")).withColumn("ord", F.lit(0))
    isolated = rows.where("region_id = 3").withColumn("decision", F.lit("needs_review")).withColumn("ord", F.lit(1))
    return A.merge_experiments(trusted, isolated, rows).select("asset_id", "region_id", "ord", "decision")


@query(
    "dialogue_state_snapshot",
    with_lenses("dialogues") + " SELECT asset_id, region_id, reason_code AS decision, CASE WHEN region_id % 2 = 0 THEN raw_text ELSE clean_text END AS text FROM dialogues",
)
def dialogue_state_snapshot(spark, d):
    rows = lens(spark, d, "dialogues").withColumns(
        {
            "decision": F.col("reason_code"),
            "verified_text": F.when(F.col("region_id") % 4 == 0, F.col("raw_text")).otherwise(F.lit("")),
            "recovered_text": F.when(F.col("region_id") % 4 == 2, F.col("raw_text")),
        }
    )
    return A.state_snapshot(rows)


@query(
    "script_hash_ids",
    """SELECT doc_id, concat('human-event-', substr(sha256(concat(source, '|r1|', doc_id, '|', n_chars)), 1, 16)) AS event_id,
      concat('p', substr(sha256(cast(doc_id AS varchar)), 1, 8)) AS short FROM documents""",
)
def script_hash_ids(spark, d):
    from pagetrace.functions.hashing import short_id

    return table(spark, d, "documents").select(
        "doc_id",
        short_id("human-event-", "|", 16, F.col("source"), F.lit("r1"), F.col("doc_id"), F.col("n_chars")).alias("event_id"),
        short_id("p", "|", 8, F.col("doc_id")).alias("short"),
    )


@query(
    "text_function_sweep",
    r"""SELECT doc_id, len(list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda t: length(t) > 1))) AS semantic_tokens,
      len(string_split_regex(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '\s+')) AS words, length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) >= 4 AS usable,
      md5(translate(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '"''“”‘’«»', '')) AS unquoted_md5, CASE WHEN length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) <= 2000 THEN length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) END AS bounded_length FROM documents""",
)
def text_function_sweep(spark, d):
    text = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id",
        F.size(T.semantic_tokens(text)).cast("long").alias("semantic_tokens"),
        T.word_count(text).cast("long").alias("words"),
        T.usable_recovery(text).alias("usable"),
        F.md5(T.without_quotes(text)).alias("unquoted_md5"),
        F.length(T.bounded_text(text, 2000)).cast("long").alias("bounded_length"),
    )
