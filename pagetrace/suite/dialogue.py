"""Dialogue queries over the block, dialogue, truth and box lenses."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagetrace.functions import text as T
from pagetrace.functions.numeric import round_exact_sql
from pagetrace.operators import dialogue as D
from pagetrace.operators.numbering import with_neighbours
from pagetrace.plans.page import settle_dialogues
from pagetrace.sources.lenses import lens, table, with_lenses

QUERIES = {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return register


TRIM = "trim({0}, ' ' || chr(9) || chr(10) || chr(13))"
SUSPICIOUS = r"regexp_matches({0}, '[#<>_|\\]|[0-9][A-Za-zÀ-ỹ]|[A-Za-zÀ-ỹ][0-9]')"
EVEN_QUOTES = "(length({0}) - length(replace({0}, '\"', ''))) % 2 = 0"
WORDS = "string_split_regex(trim(upper({0}), ' ' || chr(9) || chr(10) || chr(13)), '\\s+')"


def _regions_of(blocks):
    """Regions of three consecutive blocks; every eleventh block stays unassigned."""
    region = (F.floor(F.col("block_id") / 3) + 1).alias("region_id")
    cited = blocks.where("block_id % 11 <> 10").select("asset_id", region, F.col("block_id").alias("pos"), "block_id")
    regions = cited.select("asset_id", "region_id").distinct().withColumn("type", F.lit("speech_bubble"))
    return regions, cited


REGION_BLOCKS = """, region_blocks AS (SELECT asset_id, block_id // 3 + 1 AS region_id, block_id AS pos, block_id
    FROM blocks WHERE block_id % 11 <> 10)"""
DIALOGUES_SQL = """, built AS (SELECT asset_id, region_id, region_id AS ord,
      string_agg(trim(text, ' ' || chr(9) || chr(10) || chr(13)), ' ' ORDER BY pos) AS raw_text,
      avg(confidence) AS ocr_average, min(confidence) AS ocr_minimum, count(*) AS valid_blocks
    FROM region_blocks JOIN blocks USING (asset_id, block_id) GROUP BY 1, 2)"""


def _built(spark, d):
    blocks = lens(spark, d, "blocks")
    regions, cited = _regions_of(blocks)
    order = regions.select("asset_id", (F.col("region_id") - 1).alias("pos"), "region_id")
    return D.build_dialogues(blocks, regions, cited, order)


@query(
    "fast_path_share_by_source",
    with_lenses("blocks")
    + REGION_BLOCKS
    + f""", built AS (SELECT project_id, asset_id, region_id, string_agg({TRIM.format('text')}, ' ' ORDER BY pos) AS raw_text,
      min(confidence) AS low FROM region_blocks JOIN blocks USING (asset_id, block_id) GROUP BY 1, 2, 3)
    SELECT project_id, count(*) AS dialogues,
      count(*) FILTER (WHERE low >= 0.92 AND length({TRIM.format('raw_text')}) >= 2
        AND NOT {SUSPICIOUS.format('raw_text')} AND {EVEN_QUOTES.format('raw_text')}) AS fast_path
    FROM built GROUP BY 1""",
)
def fast_path_share_by_source(spark, d):
    blocks = lens(spark, d, "blocks")
    _, cited = _regions_of(blocks)
    evidence = D.region_evidence(cited, blocks)
    sources = table(spark, d, "documents").select(F.col("doc_id").alias("asset_id"), F.col("source").alias("project_id"))
    fast = T.passes_fast_path(F.col("raw_text"), F.col("ocr_minimum"))
    return evidence.join(sources, "asset_id").groupBy("project_id").agg(
        F.count(F.lit(1)).alias("dialogues"), F.count_if(fast).alias("fast_path")
    )


@query(
    "page_text_concat",
    with_lenses("blocks")
    + f""" SELECT asset_id, md5(string_agg(text, chr(10) ORDER BY block_id)) AS ocr_text_md5, count(*) AS lines
    FROM blocks WHERE {TRIM.format('text')} <> '' GROUP BY 1""",
)
def page_text_concat(spark, d):
    text = D.page_text(lens(spark, d, "blocks"))
    return text.select(
        "asset_id", F.md5("ocr_text").alias("ocr_text_md5"), F.size(F.split("ocr_text", "\n")).cast("long").alias("lines")
    )


@query(
    "dialogues_in_reading_order",
    with_lenses("blocks") + REGION_BLOCKS + DIALOGUES_SQL
    + " SELECT asset_id, region_id, ord, raw_text, valid_blocks, ocr_minimum, round(ocr_average, 6) AS ocr_average FROM built",
)
def dialogues_in_reading_order(spark, d):
    return _built(spark, d).select(
        "asset_id", "region_id", "ord", "raw_text", "valid_blocks", "ocr_minimum", F.round("ocr_average", 6).alias("ocr_average")
    )


@query(
    "reading_order_unknown_regions",
    with_lenses("dialogues")
    + """ SELECT asset_id, region_id, ord FROM dialogues WHERE region_id % 3 <> 1""",
)
def reading_order_unknown_regions(spark, d):
    rows = lens(spark, d, "dialogues")
    order = rows.select("asset_id", F.col("region_id").alias("pos"), "region_id")
    regions = rows.where("region_id % 3 <> 1").select("asset_id", "region_id", F.lit("narration").alias("type"))
    blocks = rows.select("asset_id", F.col("region_id").alias("block_id"), F.col("raw_text").alias("text"), "confidence")
    cited = rows.select("asset_id", "region_id", F.lit(0).alias("pos"), F.col("region_id").alias("block_id"))
    return D.build_dialogues(blocks, regions, cited, order).select("asset_id", "region_id", "ord")


@query(
    "dialogue_screening",
    with_lenses("blocks", "truth") + REGION_BLOCKS + DIALOGUES_SQL
    + f""", newest AS (SELECT asset_id, region_id, verified_text FROM truth
        QUALIFY row_number() OVER (PARTITION BY asset_id, region_id ORDER BY created_at DESC, id DESC) = 1),
    j AS (SELECT b.*, n.verified_text, ocr_minimum >= 0.92 AND length({TRIM.format('raw_text')}) >= 2
        AND NOT {SUSPICIOUS.format('raw_text')} AND {EVEN_QUOTES.format('raw_text')} AS fast
      FROM built b LEFT JOIN newest n USING (asset_id, region_id))
    SELECT asset_id, region_id, CASE WHEN verified_text IS NOT NULL THEN 'ground_truth' WHEN fast THEN 'fast_path' ELSE 'uncertain' END AS correction_path,
      CASE WHEN verified_text IS NOT NULL THEN verified_text WHEN fast THEN raw_text END AS clean_text,
      CASE WHEN verified_text IS NOT NULL THEN 1.0::double WHEN fast THEN ocr_minimum END AS confidence FROM j""",
)
def dialogue_screening(spark, d):
    from pagetrace.operators.catalog import newest_per_key

    truth = newest_per_key(lens(spark, d, "truth"), ["asset_id", "region_id"], ["created_at", "id"])
    return D.screen(_built(spark, d), truth).select("asset_id", "region_id", "correction_path", "clean_text", "confidence")


@query(
    "suspicious_ocr_blocks",
    with_lenses("blocks")
    + f""" SELECT project_id, count(*) AS blocks, count(*) FILTER (WHERE {SUSPICIOUS.format('text')}) AS suspicious FROM blocks GROUP BY 1""",
)
def suspicious_ocr_blocks(spark, d):
    return lens(spark, d, "blocks").groupBy("project_id").agg(
        F.count(F.lit(1)).alias("blocks"), F.count_if(T.suspicious_ocr(F.col("text"))).alias("suspicious")
    )


# A page's answer is the JSON of its lines, spoiled in known ways by page number.
RESPONSE_SPOILED = [5, 6, 7, 8, 9, 11]


def _responses(spark, d):
    documents = table(spark, d, "documents").select(F.col("doc_id").alias("asset_id"), "text", (F.col("doc_id") % 13).alias("k"))

    def item(line, i):
        changed = (F.col("asset_id") + i) % 3 == 0
        return F.struct(
            i.alias("region_id"),
            F.when(changed, "changed").otherwise("unchanged").alias("action"),
            F.when(changed, F.concat(F.lit(" "), line, F.lit("!"))).alias("clean_text"),
            (((F.col("asset_id") * 31 + i * 7) % 101) / 100).alias("confidence"),
            F.when((F.col("asset_id") + i) % 5 == 0, "review").otherwise("accept").alias("decision"),
            F.when((F.col("k") == 8) & (i == 0), "made_up")
            .when((F.col("asset_id") + i) % 4 == 0, "low_confidence")
            .otherwise("ocr_typo")
            .alias("reason_code"),
        )

    items = F.transform(F.split("text", "\n"), item)
    listed = (
        F.when(F.col("k") == 5, F.concat(items, F.slice(items, 1, 1)))
        .when(F.col("k") == 9, F.slice(items, 2, F.size(items)))
        .otherwise(items)
    )
    body = F.to_json(F.struct(listed.alias("items")))
    text = (
        F.when(F.col("k") == 6, F.regexp_replace(body, r'^(.*?"confidence":)[0-9.]+', "$1true"))
        .when(F.col("k") == 7, F.substring(body, F.lit(1), F.length(body) - 2))
        .when(F.col("k") == 10, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(F.col("k") == 11, F.lit("[1, 2]"))
        .otherwise(body)
    )
    return documents.select("asset_id", text.alias("raw_json"))


@query(
    "compact_correction_decode",
    with_lenses("blocks")
    + f""" , b AS (SELECT *, asset_id % 13 IN ({', '.join(map(str, RESPONSE_SPOILED))}) OR asset_id IN (SELECT asset_id FROM blocks WHERE {TRIM.format('text')} = '') AS bad FROM blocks)
    SELECT asset_id, block_id AS region_id, NOT bad AS response_accepted,
      CASE WHEN bad THEN text WHEN (asset_id + block_id) % 3 = 0 THEN {TRIM.format("concat(text, '!')")} ELSE {TRIM.format('text')} END AS clean_text,
      CASE WHEN bad THEN 0.0 ELSE confidence END AS confidence,
      bad OR (asset_id + block_id) % 5 = 0 OR (asset_id + block_id) % 4 = 0 AS needs_review,
      CASE WHEN bad THEN 'needs_review' WHEN (asset_id + block_id) % 4 = 0 THEN 'low_confidence' ELSE 'ocr_typo' END AS reason_code FROM b""",
)
def compact_correction_decode(spark, d):
    originals = lens(spark, d, "blocks").select("asset_id", F.col("block_id").alias("region_id"), F.col("text").alias("raw_text"))
    return D.decode_compact(originals, _responses(spark, d))


def _corrupted(rows):
    """Corrections with missing, invented, repeated, reordered and altered rows."""
    kept = rows.where("(asset_id + region_id) % 11 <> 0").select(
        "asset_id",
        "region_id",
        F.lit(0).alias("pos"),
        F.when((F.col("asset_id") + F.col("region_id")) % 7 == 1, F.col("ord") + 1).otherwise(F.col("ord")).alias("ord"),
        F.when((F.col("asset_id") + F.col("region_id")) % 7 == 2, F.upper("raw_text")).otherwise(F.col("raw_text")).alias("raw_text"),
        F.when((F.col("asset_id") + F.col("region_id")) % 7 == 3, F.lit("  ")).otherwise(F.col("clean_text")).alias("clean_text"),
        F.when((F.col("asset_id") + F.col("region_id")) % 7 == 4, F.lit(1.5)).otherwise(F.col("confidence")).alias("confidence"),
    )
    again = kept.where("asset_id % 5 = 0 AND region_id = 1").withColumn("pos", F.lit(1))
    invented = kept.where("asset_id % 6 = 0 AND region_id = 0").withColumn("region_id", F.lit(99).cast("long"))
    return kept.unionByName(again).unionByName(invented)


ISSUES = """, n AS (SELECT asset_id, region_id, asset_id + region_id AS k FROM dialogues),
    issues AS (
      SELECT asset_id, region_id, 'missing' AS issue FROM n WHERE k % 11 = 0
      UNION ALL SELECT asset_id, region_id, CASE k % 7 WHEN 1 THEN 'order_mismatch' WHEN 3 THEN 'empty_clean_text' WHEN 4 THEN 'invalid_confidence' END
        FROM n WHERE k % 11 <> 0 AND k % 7 IN (1, 3, 4)
      UNION ALL SELECT asset_id, region_id, 'raw_text_mismatch' FROM n JOIN dialogues USING (asset_id, region_id)
        WHERE k % 11 <> 0 AND k % 7 = 2 AND upper(raw_text) <> raw_text
      UNION ALL SELECT asset_id, region_id, 'duplicate' FROM n WHERE k % 11 <> 0 AND asset_id % 5 = 0 AND region_id = 1
      UNION ALL SELECT asset_id, 99, 'invalid' FROM n WHERE k % 11 <> 0 AND asset_id % 6 = 0 AND region_id = 0)"""


@query(
    "correction_reconciliation",
    with_lenses("dialogues") + ISSUES + " SELECT * FROM issues",
)
def correction_reconciliation(spark, d):
    rows = lens(spark, d, "dialogues")
    return D.correction_issues(rows, _corrupted(rows))


@query(
    "correction_batch_validity",
    with_lenses("dialogues") + ISSUES
    + """, i AS (SELECT asset_id, count(*) AS issue_count FROM issues GROUP BY 1),
    o AS (SELECT asset_id, count(*) AS total_original, count(*) FILTER (WHERE (asset_id + region_id) % 11 <> 0)
        + count(*) FILTER (WHERE (asset_id + region_id) % 11 <> 0 AND asset_id % 5 = 0 AND region_id = 1)
        + count(*) FILTER (WHERE (asset_id + region_id) % 11 <> 0 AND asset_id % 6 = 0 AND region_id = 0) AS total_corrected
      FROM dialogues GROUP BY 1)
    SELECT asset_id, total_original, total_corrected, coalesce(issue_count, 0) AS issue_count,
      coalesce(issue_count, 0) = 0 AND total_original = total_corrected AS is_valid FROM o LEFT JOIN i USING (asset_id)""",
)
def correction_batch_validity(spark, d):
    rows = lens(spark, d, "dialogues")
    return D.correction_verdicts(rows, _corrupted(rows))


@query(
    "correction_safety",
    with_lenses("dialogues")
    + """ SELECT asset_id, count(*) FILTER (WHERE needs_review OR confidence < 0.9) AS review_count,
      count(*) FILTER (WHERE needs_review OR confidence < 0.9) = 0 AS safe FROM dialogues GROUP BY 1""",
)
def correction_safety(spark, d):
    return D.page_safety(lens(spark, d, "dialogues"))


@query(
    "correction_review_items",
    with_lenses("dialogues")
    + " SELECT asset_id, region_id, confidence, reason_code FROM dialogues WHERE needs_review OR confidence < 0.9",
)
def correction_review_items(spark, d):
    return D.safety(lens(spark, d, "dialogues")).select("asset_id", "region_id", "confidence", "reason_code")


@query(
    "risky_word_changes",
    with_lenses("dialogues")
    + f""", w AS (SELECT asset_id, region_id, {WORDS.format('raw_text')} AS a, {WORDS.format('clean_text')} AS b FROM dialogues),
    c AS (SELECT *, len(list_filter(range(1, len(a) + 1), lambda i: a[i] <> b[i])) AS changed FROM w)
    SELECT asset_id, region_id, CASE WHEN len(a) <> len(b) THEN true ELSE changed >= 2 OR (len(a) <= 12 AND changed >= 1) END AS risky FROM c""",
)
def risky_word_changes(spark, d):
    return lens(spark, d, "dialogues").select(
        "asset_id", "region_id", T.risky_change(F.col("raw_text"), F.col("clean_text")).alias("risky")
    )


SCORED = f""", sim AS (SELECT *, CASE WHEN greatest(length(raw_text), length(clean_text)) = 0 THEN 1.0
        ELSE 1.0 - cast(levenshtein(lower(raw_text), lower(clean_text)) AS double) / cast(greatest(length(raw_text), length(clean_text)) AS double) END AS similarity FROM dialogues),
    blended AS (SELECT *, greatest(0.0, least(1.0, ocr_confidence * 0.45::double + similarity * 0.35::double + confidence * 0.2::double
        - CASE WHEN needs_review THEN 0.15::double ELSE 0.0::double END)) AS s FROM sim),
    scored AS (SELECT * REPLACE (needs_review OR s < 0.75 AS needs_review), {round_exact_sql('similarity', 3)} AS text_similarity, {round_exact_sql('s', 3)} AS correction_score FROM blended)"""


def _scored(spark, d):
    rows = lens(spark, d, "dialogues").withColumnRenamed("ocr_confidence", "ocr_average")
    return D.score(rows, T.similarity_levenshtein)


@query(
    "correction_scores",
    with_lenses("dialogues") + SCORED
    + " SELECT asset_id, region_id, ocr_confidence, text_similarity, correction_score, needs_review FROM scored",
)
def correction_scores(spark, d):
    return _scored(spark, d).select("asset_id", "region_id", "ocr_confidence", "text_similarity", "correction_score", "needs_review")


@query(
    "reattached_corrections",
    with_lenses("dialogues") + " SELECT asset_id, region_id, ord, raw_text, concat(clean_text, ' (answer)') AS clean_text FROM dialogues",
)
def reattached_corrections(spark, d):
    """Answers change order and source text and invent a region a page; the originals' fields win."""
    rows = lens(spark, d, "dialogues").select("asset_id", "region_id", "ord", "raw_text", "clean_text")
    answers = rows.withColumns({"ord": F.col("ord") + 100, "raw_text": F.lit("changed"), "clean_text": F.concat("clean_text", F.lit(" (answer)"))})
    invented = answers.select("asset_id", F.lit(999).cast("long").alias("region_id"), "ord", "raw_text", "clean_text").distinct()
    done = D.reattach(rows.drop("clean_text"), answers.unionByName(invented))
    return done.select("asset_id", "region_id", "ord", "raw_text", "clean_text")


DECIDE = f""", words AS (SELECT *, {WORDS.format('raw_text')} AS a, {WORDS.format('clean_text')} AS b FROM scored),
    risk AS (SELECT *, CASE WHEN len(a) <> len(b) THEN true ELSE changed >= 2 OR (len(a) <= 12 AND changed >= 1) END AS risky_text_change
      FROM (SELECT *, len(list_filter(range(1, len(a) + 1), lambda i: a[i] <> b[i])) AS changed FROM words)),
    tiny AS (SELECT *, reason_code IN ('ocr_typo', 'unchanged') AND text_similarity >= 0.96 AND ocr_confidence >= 0.6 AND confidence >= 0.97 AND len(a) = len(b) AS tiny FROM risk),
    decided AS (SELECT *, CASE WHEN tiny OR (NOT needs_review AND NOT risky_text_change AND
        (correction_score >= 0.9 OR (correction_score >= 0.75 AND ocr_confidence >= 0.65))) THEN 'auto_accepted' ELSE 'needs_recovery' END AS decision,
      CASE WHEN tiny THEN 'tiny_ocr_typo' END AS calibration_rule FROM tiny)"""
DECIDED = SCORED + DECIDE


@query(
    "correction_decisions",
    with_lenses("dialogues") + DECIDED
    + " SELECT asset_id, region_id, risky_text_change, decision, calibration_rule FROM decided",
)
def correction_decisions(spark, d):
    return D.decide(_scored(spark, d)).select("asset_id", "region_id", "risky_text_change", "decision", "calibration_rule")


def _recoveries(rows):
    """Second-pass answers: two thirds of the regions, some twice, some unsure."""
    k = F.col("asset_id") + F.col("region_id")
    given = rows.where("(asset_id + region_id) % 3 <> 2").select(
        "asset_id",
        "region_id",
        F.when(k % 2 == 0, F.col("clean_text")).otherwise(F.concat("clean_text", F.lit(" ok"))).alias("recovered_text"),
        (((F.col("asset_id") * 13 + F.col("region_id") * 5) % 12) / 10).alias("confidence"),
        F.when(k % 5 == 0, "fragmented_ocr").otherwise("ocr_typo").alias("reason_code"),
        (k % 4 == 0).alias("still_uncertain"),
    )
    return given.unionByName(given.where("(asset_id + region_id) % 9 = 4"))


RECOVER = """, answers AS (SELECT asset_id, region_id, CASE WHEN (asset_id + region_id) % 2 = 0 THEN clean_text ELSE concat(clean_text, ' ok') END AS r_text,
        cast((asset_id * 13 + region_id * 5) % 12 AS double) / 10 AS r_conf, (asset_id + region_id) % 2 = 0 AS same_text,
        CASE WHEN (asset_id + region_id) % 5 = 0 THEN 'fragmented_ocr' ELSE 'ocr_typo' END AS r_code, (asset_id + region_id) % 4 = 0 AS unsure
      FROM dialogues WHERE (asset_id + region_id) % 3 <> 2 AND (asset_id + region_id) % 9 <> 4),
    joined AS (SELECT d.*, r_text, r_conf, r_code, unsure, r_text IS NOT NULL AS given,
        coalesce(same_text AND r_code NOT IN ('proper_name_uncertain', 'ambiguous_visual', 'needs_review')
          AND reason_code NOT IN ('proper_name_uncertain', 'ambiguous_visual', 'needs_review')
          AND CASE WHEN reason_code = 'fragmented_ocr' OR r_code = 'fragmented_ocr'
            THEN confidence >= 0.98 AND r_conf >= 0.98 AND text_similarity >= 0.97 AND ocr_confidence >= 0.8
            ELSE confidence >= 0.95 AND r_conf >= 0.95 AND text_similarity >= 0.94 AND ocr_confidence >= 0.6 END, false) AS agreed
      FROM decided d LEFT JOIN answers USING (asset_id, region_id)),
    recovered AS (SELECT * REPLACE (
        CASE WHEN decision <> 'needs_recovery' THEN decision
          WHEN least(1.0, greatest(0.0, coalesce(r_conf, 0.0))) >= 0.9 AND given AND NOT (unsure AND NOT agreed) THEN 'auto_recovered' ELSE 'needs_review' END AS decision,
        CASE WHEN decision = 'needs_recovery' THEN coalesce(r_text, clean_text) ELSE clean_text END AS clean_text),
      CASE WHEN decision = 'needs_recovery' THEN least(1.0, greatest(0.0, coalesce(r_conf, 0.0))) END AS recovery_confidence,
      CASE WHEN decision = 'needs_recovery' THEN coalesce(r_code, 'needs_review') END AS recovery_reason_code,
      CASE WHEN decision = 'needs_recovery' THEN agreed END AS agreement_evidence FROM joined)"""
RECOVERED = DECIDED + RECOVER


@query(
    "recovery_merge",
    with_lenses("dialogues") + RECOVERED
    + " SELECT asset_id, region_id, decision, clean_text, recovery_confidence, recovery_reason_code, agreement_evidence FROM recovered",
)
def recovery_merge(spark, d):
    rows = lens(spark, d, "dialogues")
    decided = D.decide(_scored(spark, d))
    return D.recover(decided, _recoveries(rows)).select(
        "asset_id", "region_id", "decision", "clean_text", "recovery_confidence", "recovery_reason_code", "agreement_evidence"
    )


def _truth_and_regions(spark, d):
    rows = lens(spark, d, "dialogues")
    truth = rows.where("(asset_id + region_id) % 10 = 3").select(
        "asset_id",
        "region_id",
        F.when(F.col("region_id") == 1, F.lit("   ")).otherwise(F.concat(F.lit(" fixed "), F.col("asset_id"))).alias("verified_text"),
    )
    regions = rows.select(
        "asset_id",
        "region_id",
        F.when(F.col("region_id") % 3 == 0, "vision_ocr_recovery").otherwise("original_layout").alias("region_source"),
        ((F.col("asset_id") + F.col("region_id")) % 2 == 0).alias("needs_review"),
    )
    return truth, regions


OVERLAID = RECOVERED + """, final AS (SELECT asset_id, region_id, verified, gated, needs_review AS r,
      CASE WHEN verified THEN concat('fixed ', cast(asset_id AS varchar)) ELSE clean_text END AS clean_text,
      CASE WHEN verified THEN 'verified' WHEN gated THEN 'needs_review' ELSE decision END AS decision
    FROM (SELECT *, (asset_id + region_id) % 10 = 3 AND region_id <> 1 AS verified,
        region_id % 3 = 0 AND (asset_id + region_id) % 2 = 0 AS gated FROM recovered))"""


@query(
    "verified_truth_and_review_gate",
    with_lenses("dialogues") + OVERLAID
    + " SELECT asset_id, region_id, clean_text, decision, CASE WHEN verified THEN false ELSE r OR gated END AS needs_review FROM final",
)
def verified_truth_and_review_gate(spark, d):
    truth, regions = _truth_and_regions(spark, d)
    recovered = D.recover(D.decide(_scored(spark, d)), _recoveries(lens(spark, d, "dialogues"))).withColumn("reason", F.lit(""))
    gated = D.gate_recovered_regions(D.apply_truth(recovered, truth), regions)
    return gated.select("asset_id", "region_id", "clean_text", "decision", "needs_review")


@query(
    "page_dialogue_status",
    with_lenses("dialogues") + OVERLAID
    + " SELECT asset_id, CASE WHEN bool_or(decision = 'needs_review') THEN 'needs_review' ELSE 'completed' END AS dialogue_status FROM final GROUP BY 1",
)
def page_dialogue_status(spark, d):
    return D.dialogue_status(verified_truth_and_review_gate(spark, d))


@query(
    "evidence_batch_split",
    with_lenses("dialogues")
    + """ SELECT asset_id, CASE WHEN region_id % 3 = 0 THEN 'recovered' ELSE 'trusted' END AS batch, count(*) AS dialogues,
      0::bigint AS lost FROM dialogues GROUP BY 1, 2""",
)
def evidence_batch_split(spark, d):
    rows = lens(spark, d, "dialogues")
    _, regions = _truth_and_regions(spark, d)
    split = D.evidence_batches(rows, regions)
    recombined = split.where("batch = 'trusted'").unionByName(split.where("batch = 'recovered'"))
    problems = D.lost_or_invented(rows, recombined).groupBy("asset_id").agg(F.count(F.lit(1)).alias("lost"))
    counted = split.groupBy("asset_id", "batch").agg(F.count(F.lit(1)).alias("dialogues"))
    return counted.join(problems, "asset_id", "left").fillna(0, subset=["lost"])


def _settled(spark, d):
    from pagetrace.operators.catalog import newest_per_key

    truth = newest_per_key(lens(spark, d, "truth"), ["asset_id", "region_id"], ["created_at", "id"])
    built = _built(spark, d)
    originals = built.select("asset_id", "region_id", "raw_text")
    k = F.col("asset_id") + F.col("region_id")
    corrections = originals.select(
        "asset_id", "region_id",
        F.when(k % 3 == 0, F.replace("raw_text", F.lit("ou"), F.lit("o"))).otherwise(F.col("raw_text")).alias("clean_text"),
        (0.9 + (k % 11) / 100).alias("confidence"), (k % 7 == 0).alias("needs_review"),
        F.when(k % 3 == 0, "ocr_typo").otherwise("unchanged").alias("reason_code"),
    )
    regions = originals.select(
        "asset_id", "region_id",
        F.when(F.col("region_id") % 5 == 0, "local_ocr_recovery").otherwise("original_layout").alias("region_source"),
        (k % 2 == 0).alias("needs_review"),
    )
    return settle_dialogues(built, corrections, _recoveries(corrections), truth, regions)


# The corrections answer every region; only rows of the path 'uncertain' take them. Verified rows
# never show what a second pass would have said about them.
SETTLED = (
    with_lenses("blocks", "truth") + REGION_BLOCKS + DIALOGUES_SQL
    + f""", newest AS (SELECT asset_id, region_id, {TRIM.format('verified_text')} AS truth_text FROM truth
      QUALIFY row_number() OVER (PARTITION BY asset_id, region_id ORDER BY created_at DESC, id DESC) = 1),
    screened AS (SELECT b.*, truth_text, asset_id + region_id AS k, CASE WHEN truth_text <> '' THEN 'ground_truth'
        WHEN ocr_minimum >= 0.92 AND length({TRIM.format('raw_text')}) >= 2 AND NOT {SUSPICIOUS.format('raw_text')}
          AND {EVEN_QUOTES.format('raw_text')} THEN 'fast_path' ELSE 'uncertain' END AS path
      FROM built b LEFT JOIN newest USING (asset_id, region_id)),
    dialogues AS (SELECT asset_id, region_id, raw_text, truth_text, path, ocr_average AS ocr_confidence,
        CASE path WHEN 'ground_truth' THEN truth_text WHEN 'fast_path' THEN raw_text
          ELSE CASE WHEN k % 3 = 0 THEN replace(raw_text, 'ou', 'o') ELSE raw_text END END AS clean_text,
        CASE path WHEN 'ground_truth' THEN 1.0 WHEN 'fast_path' THEN ocr_minimum ELSE 0.9::double + cast(k % 11 AS double) / 100 END AS confidence,
        path = 'uncertain' AND k % 7 = 0 AS needs_review,
        CASE WHEN path = 'uncertain' THEN CASE WHEN k % 3 = 0 THEN 'ocr_typo' ELSE 'unchanged' END END AS reason_code FROM screened)"""
    + SCORED.replace("AS needs_review),", f"AS needs_review, {round_exact_sql('ocr_confidence', 3)} AS ocr_confidence),")
    + DECIDE + RECOVER
    + """, settled AS (SELECT *, path = 'ground_truth' AS known, region_id % 5 = 0 AND (asset_id + region_id) % 2 = 0 AS gated FROM recovered)
    SELECT asset_id, region_id, replace(path, 'uncertain', 'model') AS correction_path, CASE WHEN known THEN truth_text ELSE clean_text END AS clean_text,
      CASE WHEN known THEN 'verified' WHEN gated THEN 'needs_review' ELSE decision END AS decision,
      NOT known AND (needs_review OR gated) AS needs_review, ocr_confidence, CASE WHEN NOT known THEN text_similarity END AS text_similarity,
      CASE WHEN NOT known THEN correction_score END AS correction_score, CASE WHEN NOT known THEN recovery_confidence END AS recovery_confidence,
      CASE WHEN NOT known THEN recovery_reason_code END AS recovery_reason_code, CASE WHEN NOT known THEN agreement_evidence END AS agreement_evidence FROM settled"""
)


@query("settled_dialogue_rows", SETTLED)
def settled_dialogue_rows(spark, d):
    """Every dialogue as the composed page dataflow leaves it."""
    passed = ["text_similarity", "correction_score", "recovery_confidence", "recovery_reason_code", "agreement_evidence"]
    return _settled(spark, d).select(
        "asset_id", "region_id", "correction_path", "clean_text", "decision", "needs_review", "ocr_confidence",
        *[F.when(~F.col("human_verified"), F.col(name)).alias(name) for name in passed],
    )


@query("settled_dialogues", f"SELECT decision, correction_path, count(*) AS dialogues, count(*) FILTER (WHERE needs_review) AS reviewed FROM ({SETTLED}) GROUP BY 1, 2")
def settled_dialogues(spark, d):
    """The composed page dataflow by outcome."""
    return _settled(spark, d).groupBy("decision", "correction_path").agg(
        F.count(F.lit(1)).alias("dialogues"), F.count_if("needs_review").alias("reviewed")
    )


@query(
    "dialogue_context",
    with_lenses("dialogues")
    + """ SELECT asset_id, region_id, lag(clean_text) OVER w AS previous_text, lead(clean_text) OVER w AS next_text
    FROM dialogues WINDOW w AS (PARTITION BY asset_id ORDER BY ord)""",
)
def dialogue_context(spark, d):
    near = with_neighbours(lens(spark, d, "dialogues"), ["asset_id"], "ord", ["clean_text"], span=2)
    return near.select(
        "asset_id", "region_id", F.col("previous.clean_text").alias("previous_text"), F.col("next.clean_text").alias("next_text")
    )


BOXED = """, region_blocks AS (SELECT asset_id, block_id % 8 // 2 AS region_id, block_id FROM boxes),
    boxed AS (SELECT asset_id, region_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1
      FROM region_blocks JOIN boxes USING (asset_id, block_id) GROUP BY 1, 2)"""


def _box_regions(spark, d):
    boxes = lens(spark, d, "boxes")
    region = F.floor(F.col("block_id") % 8 / 2)
    return boxes, boxes.select("asset_id", region.alias("region_id"), "block_id")


@query(
    "region_bounding_boxes",
    with_lenses("boxes") + BOXED
    + " SELECT *, (x0 + x1) / 2 AS center_x, (y0 + y1) / 2 AS center_y FROM boxed",
)
def region_bounding_boxes(spark, d):
    boxes, cited = _box_regions(spark, d)
    return D.region_boxes(cited, boxes)


@query(
    "review_queue",
    with_lenses("boxes", "assets") + BOXED
    + """ SELECT a.project_id, a.asset_id, a.filename, a.page_order, a.asset_id % 5 AS region_id,
      CASE WHEN a.asset_id % 3 = 0 THEN 'recovered_visual_text_requires_review' WHEN a.asset_id % 3 = 1 THEN 'fragmented_ocr' ELSE 'ocr_typo' END AS review_reason_code,
      x0, y0, x1, y1
    FROM assets a LEFT JOIN boxed b ON b.asset_id = a.asset_id AND b.region_id = a.asset_id % 5 WHERE a.asset_id % 4 = 0""",
)
def review_queue(spark, d):
    boxes, cited = _box_regions(spark, d)
    assets = lens(spark, d, "assets")
    k = F.col("asset_id")
    none = F.lit(None)
    dialogues = assets.select(
        "asset_id",
        (k % 5).alias("region_id"),
        F.when(k % 4 == 0, "needs_review").otherwise("auto_accepted").alias("decision"),
        F.lit("raw").alias("raw_text"), F.lit("clean").alias("clean_text"), none.cast("string").alias("recovered_text"),
        none.cast("double").alias("correction_score"), none.cast("double").alias("recovery_confidence"),
        F.lit(0.5).alias("confidence"), F.lit("").alias("reason"),
        F.when(k % 3 == 0, D.VISUAL_REVIEW_CODE).otherwise("ocr_typo").alias("reason_code"),
        F.when(k % 3 == 1, "fragmented_ocr").alias("recovery_reason_code"),
    )
    queue = D.review_queue(dialogues, assets, cited, boxes)
    return queue.select("project_id", "asset_id", "filename", "page_order", "region_id", "review_reason_code", "x0", "y0", "x1", "y1")


@query(
    "evidence_box_lookup",
    with_lenses("boxes") + BOXED
    + """, req AS (SELECT o_orderkey AS asset_id, o_orderkey % 6 AS region_id FROM orders)
    SELECT r.asset_id, r.region_id, CASE WHEN b.x0 IS NOT NULL THEN 'speech_bubble' END AS text_role, x0, y0, x1, y1, b.x0 IS NOT NULL AS found
    FROM req r LEFT JOIN boxed b USING (asset_id, region_id)""",
)
def evidence_box_lookup(spark, d):
    boxes, cited = _box_regions(spark, d)
    regions = cited.select("asset_id", "region_id").distinct().withColumn("type", F.lit("speech_bubble"))
    wanted = table(spark, d, "orders").select(F.col("o_orderkey").alias("asset_id"), (F.col("o_orderkey") % 6).alias("region_id"))
    return D.evidence_lookup(wanted, regions, cited, boxes).drop("center_x", "center_y")


@query(
    "dialogue_verification_batch",
    with_lenses("dialogues")
    + """ SELECT asset_id, region_id, CASE WHEN v THEN concat('v', cast(region_id AS varchar)) ELSE clean_text END AS clean_text,
      CASE WHEN v THEN 'verified' ELSE 'needs_review' END AS decision,
      CASE WHEN bool_and(v) OVER (PARTITION BY asset_id) THEN 'completed' ELSE 'needs_review' END AS dialogue_status
    FROM (SELECT *, asset_id % 3 = 0 OR region_id = 2 AS v FROM dialogues)""",
)
def dialogue_verification_batch(spark, d):
    none = F.lit(None)
    dialogues = lens(spark, d, "dialogues").select(
        "asset_id", "region_id", "raw_text", "clean_text", F.lit(True).alias("needs_review"), F.lit("needs_review").alias("decision"),
        none.cast("string").alias("verified_text"), none.cast("boolean").alias("human_verified"),
        none.cast("string").alias("recovered_text"), none.cast("double").alias("correction_score"), none.cast("double").alias("recovery_confidence"),
    )
    feed = dialogues.where("asset_id % 3 = 0 OR region_id = 2").select(
        "asset_id", "region_id", F.concat(F.lit(" v"), "region_id").alias("verified_text"), F.lit(2).alias("version")
    )
    older = feed.withColumn("verified_text", F.lit("old")).withColumn("version", F.lit(1))
    stray = feed.withColumn("region_id", F.lit(77).cast("long"))
    stored = spark.createDataFrame([], "asset_id long, region_id long, raw_text string, ai_text string, verified_text string, correction_score double, recovery_confidence double")
    updated, _, status, _ = D.verify_dialogues(dialogues, stored, older.unionByName(feed).unionByName(stray))
    return updated.join(status, "asset_id").select("asset_id", "region_id", "clean_text", "decision", "dialogue_status")


@query(
    "recovery_attempt_ranking",
    with_lenses("boxes")
    + """ SELECT asset_id, block_id AS candidate_id, block_id % 3 <> 0 AS resolved,
      CASE block_id % 3 WHEN 0 THEN 'unresolved_visual_candidate' WHEN 1 THEN 'local_ocr_recovery' ELSE 'vision_ocr_recovery' END AS region_source,
      CASE block_id % 3 WHEN 0 THEN NULL ELSE confidence < 0.9 END AS needs_review,
      CASE block_id % 3 WHEN 0 THEN 'local_ocr_recovery_empty,vision_ocr_recovery_empty' WHEN 1 THEN '' ELSE 'local_ocr_recovery_unusable' END AS issues
    FROM boxes""",
)
def recovery_attempt_ranking(spark, d):
    boxes = lens(spark, d, "boxes")
    k = F.col("block_id") % 3

    def attempt(rank, source):
        text = F.when(k == 0, " ").otherwise("Hãy đi")
        return boxes.select(
            "asset_id", F.col("block_id").alias("candidate_id"), F.lit(rank).alias("rank"), F.lit(source).alias("source"),
            text.alias("text"), "confidence", (F.lit(rank == 2) | (k == 1)).alias("usable"), F.lit(False).alias("needs_review"),
        )

    attempts = attempt(1, "local_ocr_recovery").unionByName(attempt(2, "vision_ocr_recovery"))
    ranked = D.rank_attempts(attempts)
    return ranked.select(
        "asset_id", "candidate_id", "resolved", "region_source", "needs_review", F.array_join("issues", ",").alias("issues")
    )


@query(
    "resolver_hook",
    """SELECT doc_id AS asset_id, 'c' || cast(doc_id AS varchar) AS candidate_id, 1 AS rank, 'local_ocr_recovery' AS source,
      md5(text) AS text, 0.95::double AS confidence,
      length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) >= 4 AS usable, false AS needs_review FROM documents""",
)
def resolver_hook(spark, d):
    candidates = table(spark, d, "documents").select(
        F.col("doc_id").alias("asset_id"), F.concat(F.lit("c"), "doc_id").alias("candidate_id"),
        *[F.lit(0).alias(c) for c in ("x0", "y0", "x1", "y1")], F.col("text").alias("content"),
    )

    def read(frame):
        text = frame["content"]
        return frame.assign(
            text=text,
            confidence=0.95,
            usable=text.map(lambda t: sum(c.isalnum() for c in t) >= 4),
            needs_review=False,
        )

    return D.resolve_with(candidates, read, "local_ocr_recovery", 1).withColumn("text", F.md5("text"))
