"""Story queries: input building, grounding, coverage and recovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagetrace.functions.numeric import round_exact_sql
from pagetrace.operators import story_input as S
from pagetrace.sources.lenses import table, with_lenses
from pagetrace.sources.story_lens import with_story

QUERIES = {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return register


# --- Pages with JSON columns, spoiled in known ways by document number --------

PAGE_COLUMNS = """SELECT doc_id AS asset_id, concat(source, '_', cast(doc_id % 200 AS string)) AS project_id,
    cast(floor(doc_id / 200) AS bigint) + 1 - CASE WHEN doc_id % 97 = 1 AND doc_id >= 200 THEN 1 ELSE 0 END AS page_order, text,
    CASE WHEN doc_id % 31 = 2 THEN 'excluded' WHEN doc_id % 131 = 3 THEN 'processing' ELSE 'ready' END AS status,
    CASE WHEN doc_id % 7 = 5 THEN 'no_dialogue' WHEN doc_id % 137 = 4 THEN 'failed' ELSE 'completed' END AS vision_status,
    CASE WHEN doc_id % 141 = 5 THEN 'needs_review' WHEN doc_id % 143 = 6 THEN 'pending' ELSE 'completed' END AS dialogue_status
  FROM documents"""


def story_assets(spark, d):
    documents = table(spark, d, "documents").withColumn("source", F.coalesce("source", F.lit("")))  # joins the name as nothing, as in the SQL
    pages = spark.sql(PAGE_COLUMNS.replace("FROM documents", "FROM {documents}"), documents=documents)
    k = F.col("asset_id")

    def dialogue(line, i):
        turn = (k + i) % 4
        noted = F.when((k + i) % 17 == 0, F.concat(line, F.lit(" *TRANS NOTE: nota"))).otherwise(line)
        return F.struct(
            F.when((k % 171 == 11) & (i == 1), F.lit(1).cast("long")).when((k + i) % 997 == 5, F.lit(-1).cast("long")).otherwise((i + 1).cast("long")).alias("region_id"),
            (i + 1).cast("long").alias("order"),
            F.when((k % 167 == 10) & (i == 1), "needs_review")
            .when((k % 173 == 12) & (i == 0), "verified")
            .when(turn == 1, "auto_recovered").when(turn == 2, "verified").otherwise("auto_accepted").alias("decision"),
            F.when((k % 173 == 12) & (i == 0), F.lit(" ")).when(turn == 2, F.concat(F.lit("V "), noted)).alias("verified_text"),
            F.when(turn == 1, F.concat(F.lit(" R "), noted)).alias("recovered_text"),
            noted.alias("clean_text"),
            (turn == 2).alias("human_verified"),
        )

    lines = F.split("text", "\n")
    body = F.to_json(F.transform(lines, dialogue))
    kinds = F.array(*[F.lit(x) for x in ("speech_bubble", "narration", "thought", "game_ui", "sfx", "note")])
    regions = F.to_json(
        F.transform(lines, lambda line, i: F.struct((i + 1).alias("id"), F.get(kinds, i % 6).alias("type")))
    )
    return pages.select(
        "project_id", "asset_id", "page_order", "status", "vision_status", "dialogue_status",
        F.when(k % 147 == 7, F.concat(body, F.lit("]")))
        .when(k % 153 == 8, F.lit("[]"))
        .when(k % 159 == 9, F.lit(None))
        .when(k % 179 == 13, F.regexp_replace(body, '^\\[\\{"region_id":1,', '[{"region_id":true,'))
        .otherwise(body)
        .alias("dialogues"),
        F.when(k % 11 != 3, regions).otherwise(F.lit("{broken")).alias("vision_regions"),
    )


def story_projects(spark, d):
    known = table(spark, d, "documents").select(F.concat(F.coalesce("source", F.lit("")), F.lit("_"), F.col("doc_id") % 200).alias("project_id"))
    empty = table(spark, d, "region").select(F.concat(F.lit("empty_"), "r_regionkey").alias("project_id"))
    return known.unionByName(empty).distinct()


STORY_INPUT = with_lenses("blocks") + f""", pages AS ({PAGE_COLUMNS}),
  stops AS (SELECT asset_id, project_id, page_order, status, vision_status,
      CASE WHEN status = 'excluded' THEN 'asset_excluded' WHEN status <> 'ready' THEN 'asset_not_ready' WHEN vision_status = 'no_dialogue' THEN NULL
        WHEN vision_status <> 'completed' THEN 'vision_not_ready' WHEN dialogue_status = 'needs_review' THEN 'dialogue_review_required'
        WHEN dialogue_status <> 'completed' THEN 'dialogue_not_ready' END AS stop FROM pages),
  lines AS (SELECT s.asset_id, s.project_id, page_order, block_id AS i, (s.asset_id + block_id) % 4 AS turn,
      CASE WHEN (s.asset_id + block_id) % 17 = 0 THEN concat(text, ' *TRANS NOTE: nota') ELSE text END AS noted
    FROM stops s JOIN blocks b ON b.asset_id = s.asset_id WHERE stop IS NULL AND vision_status = 'completed'
      AND s.asset_id % 147 <> 7 AND s.asset_id % 153 <> 8 AND s.asset_id % 159 <> 9),
  typed AS (SELECT *, asset_id % 173 = 12 AND i = 0 AS blank_verified,
      CASE WHEN asset_id % 171 = 11 AND i = 1 THEN 1 WHEN (asset_id + i) % 997 = 5 THEN -1 ELSE i + 1 END AS region_id, i + 1 AS ord,
      CASE WHEN asset_id % 167 = 10 AND i = 1 THEN 'needs_review' WHEN asset_id % 173 = 12 AND i = 0 THEN 'verified'
        WHEN turn = 1 THEN 'auto_recovered' WHEN turn = 2 THEN 'verified' ELSE 'auto_accepted' END AS decision FROM lines),
  texts AS (SELECT *, asset_id % 179 = 13 AND i = 0 AS bool_id,
      CASE WHEN blank_verified THEN NULL WHEN decision = 'verified' OR turn = 2 THEN concat('V ', noted) WHEN turn = 1 THEN concat('R ', noted) ELSE trim(noted) END AS final_text,
      CASE WHEN blank_verified THEN NULL WHEN decision = 'verified' OR turn = 2 THEN 'verified' WHEN turn = 1 THEN 'recovered' ELSE 'clean' END AS text_source FROM typed),
  coded AS (SELECT *, CASE WHEN region_id < 1 OR bool_id THEN 'invalid_dialogue_reference'
      WHEN asset_id % 171 = 11 AND i = 1 AND NOT asset_id % 997 = 5 AND NOT (asset_id % 179 = 13) THEN 'duplicate_dialogue_reference'
      WHEN decision = 'needs_review' THEN 'unsupported_dialogue_decision' WHEN final_text IS NULL THEN 'missing_authoritative_text' END AS code FROM texts),
  issues AS (SELECT project_id, asset_id, page_order, NULL::bigint AS region_id, stop AS code FROM stops WHERE stop IS NOT NULL
    UNION ALL SELECT project_id, asset_id, page_order, NULL, 'duplicate_page_order' FROM (SELECT *, row_number() OVER (PARTITION BY project_id, page_order
        ORDER BY cast(asset_id AS varchar)) AS r FROM stops WHERE status <> 'excluded') WHERE r > 1
    UNION ALL SELECT project_id, asset_id, page_order, NULL, 'invalid_dialogues' FROM stops WHERE stop IS NULL AND vision_status = 'completed'
        AND (asset_id % 147 = 7 OR asset_id % 153 = 8 OR asset_id % 159 = 9)
    UNION ALL SELECT project_id, asset_id, page_order, CASE WHEN code IN ('unsupported_dialogue_decision', 'missing_authoritative_text') THEN region_id END, code
      FROM coded WHERE code IS NOT NULL),
  blocked AS (SELECT DISTINCT project_id FROM issues WHERE code <> 'asset_excluded'),
  roles AS (SELECT *, CASE WHEN note > 0 THEN rtrim(substr(final_text, 1, cast(note AS bigint) - 1), ' *''"') ELSE trim(final_text) END AS evidence_text,
      CASE WHEN contains(up, 'ACHIEVEMENT') OR contains(up, 'UNLOCKED') OR contains(up, 'SYSTEM') OR contains(up, 'THÀNH TỰU') OR contains(up, 'ĐẶC QUYỀN') THEN 'game_ui'
        WHEN regexp_matches(up, '^\\s*\\*?TRANS\\s*NOTE\\s*:') THEN 'translator_note' WHEN asset_id % 11 = 3 THEN 'other'
        ELSE (['dialogue', 'narration', 'thought', 'game_ui', 'sfx', 'other'])[i % 6 + 1] END AS text_role
    FROM (SELECT *, upper(final_text) AS up, strpos(upper(final_text), '*TRANS NOTE:') AS note FROM coded WHERE code IS NULL AND project_id NOT IN (FROM blocked)))"""


def _input(spark, d):
    return S.build_story_input(story_projects(spark, d), story_assets(spark, d))


@query(
    "story_input_projects",
    STORY_INPUT
    + """ SELECT p.project_id, CASE WHEN total IS NULL THEN 'empty' WHEN b.project_id IS NOT NULL THEN 'blocked' ELSE 'ready' END AS status,
      coalesce(total, 0) AS total_assets, coalesce(n, 0) AS source_pages, coalesce(n_d, 0) AS dialogue_pages, coalesce(n_n, 0) AS no_dialogue_pages, coalesce(n_e, 0) AS dialogue_count
    FROM (SELECT DISTINCT project_id FROM pages UNION ALL SELECT concat('empty_', cast(r_regionkey AS varchar)) FROM region) p
    LEFT JOIN (SELECT project_id, count(*) AS total FROM pages GROUP BY 1) t USING (project_id) LEFT JOIN blocked b USING (project_id)
    LEFT JOIN (SELECT project_id, count(*) AS n, count(*) FILTER (WHERE vision_status = 'completed') AS n_d, count(*) FILTER (WHERE vision_status = 'no_dialogue') AS n_n
      FROM stops WHERE stop IS NULL AND project_id NOT IN (FROM blocked) GROUP BY 1) k USING (project_id)
    LEFT JOIN (SELECT project_id, count(*) AS n_e FROM roles GROUP BY 1) e USING (project_id)""",
)
def story_input_projects(spark, d):
    return _input(spark, d)["projects"]


@query("story_input_issues", STORY_INPUT + """ SELECT project_id, asset_id, page_order, region_id, code,
      CASE WHEN code = 'asset_excluded' THEN 'warning' ELSE 'error' END AS severity FROM issues
    UNION ALL SELECT concat('empty_', cast(r_regionkey AS varchar)), NULL, NULL, NULL, 'project_has_no_assets', 'error' FROM region""")
def story_input_issues(spark, d):
    return S.sorted_issues(_input(spark, d)["issues"])


@query(
    "story_input_evidence",
    STORY_INPUT
    + """ SELECT project_id, asset_id, page_order, region_id, ord, decision, final_text, text_source, evidence_text,
      CASE WHEN note > 0 THEN substr(final_text, cast(note AS bigint)) END AS excluded_text, text_role FROM roles""",
)
def story_input_evidence(spark, d):
    return _input(spark, d)["evidence"]


@query(
    "story_input_pages",
    STORY_INPUT
    + """ SELECT project_id, asset_id, page_order, CASE vision_status WHEN 'completed' THEN 'dialogue' ELSE 'no_dialogue' END AS page_type
    FROM stops WHERE stop IS NULL AND project_id NOT IN (FROM blocked)""",
)
def story_input_pages(spark, d):
    return _input(spark, d)["pages"]


# --- Grounding over the conversation story world --------------------------------

NORM = "trim(regexp_replace(replace(upper(strip_accents({0})), 'ẞ', 'SS'), '\\s+', ' ', 'g'))"
HOLDS = "regexp_matches({0}, concat('(^|[^A-Z0-9])', regexp_escape({1}), '([^A-Z0-9]|$)'))"
CAUSAL = r"regexp_matches({0}, '\bVI\b|\bBOI\b|\bNHO\b|DAN DEN|CHO PHEP|\bBECAUSE\b|\bTHEREFORE\b|RESULTS? IN|\bCAUSES?\b|\bGRANTS?\b')"
NAME_ONLY = "len(regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}\\p{{M}}_]+')) = 1 AND length(trim({0})) <= 30 AND NOT regexp_matches({0}, '[!?]')"

SOURCES_SQL = """, pages_ AS (SELECT DISTINCT project_id, asset_id, page_order AS expected FROM evidence),
  located AS (SELECT s.*, expected, CASE WHEN len(region_ids) = 0 OR list_min(region_ids) <= 0 THEN 'invalid_source_shape' WHEN expected IS NULL THEN 'invalid_asset_reference'
      WHEN page_order <> expected THEN 'wrong_page_order' END AS code, list_sort(list_distinct(region_ids)) AS uniq
    FROM claim_sources s LEFT JOIN pages_ p USING (project_id, asset_id)),
  spread AS (SELECT l.project_id, event_id, claim_id, source_ord, l.asset_id, l.page_order, uniq, u.region_id, e.region_id IS NOT NULL AS hit
    FROM located l, unnest(uniq) u(region_id) LEFT JOIN evidence e ON e.project_id = l.project_id AND e.asset_id = l.asset_id AND e.region_id = u.region_id WHERE code IS NULL),
  sound AS (SELECT project_id, event_id, claim_id, source_ord, asset_id, page_order, any_value(uniq) AS uniq FROM spread GROUP BY ALL HAVING bool_and(hit)),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY project_id, event_id, claim_id, asset_id, page_order, uniq ORDER BY source_ord) AS r FROM sound),
  valid AS (SELECT project_id, event_id, claim_id, source_ord, asset_id, page_order, unnest(uniq) AS region_id FROM ranked WHERE r = 1)"""


def _world(spark, d):
    from pagetrace.operators import grounding as G
    from pagetrace.sources.story_lens import story_world

    w = story_world(spark, d)
    w["valid"], w["claim_issues"] = G.validate_sources(w["claims"], w["claim_sources"], w["pages"], w["evidence"], G.CLAIM)
    return w


def _judged(spark, d):
    from pagetrace.plans.story import ground_story
    from pagetrace.sources.story_lens import story_world

    w = story_world(spark, d)
    w["result"] = ground_story(w)
    w.update(valid=w["result"]["valid_sources"], judged=w["result"]["claims"], grounded=w["result"]["events"])
    return w


@query(
    "claim_source_validation",
    with_story("evidence", "claims", "claim_sources") + SOURCES_SQL
    + """ SELECT project_id, event_id, claim_id, code, asset_id, NULL::bigint AS region_id FROM located WHERE code IS NOT NULL
    UNION ALL SELECT project_id, event_id, claim_id, 'duplicate_region_reference', asset_id, NULL FROM located WHERE code IS NULL AND len(uniq) < len(region_ids)
    UNION ALL SELECT project_id, event_id, claim_id, 'invalid_region_reference', asset_id, region_id FROM spread WHERE NOT hit
    UNION ALL SELECT project_id, event_id, claim_id, 'duplicate_source_reference', asset_id, NULL FROM ranked WHERE r > 1
    UNION ALL SELECT project_id, event_id, claim_id, 'missing_source_references', NULL, NULL FROM claims c
      WHERE NOT EXISTS (SELECT 1 FROM claim_sources s WHERE s.claim_id = c.claim_id AND s.project_id = c.project_id)""",
)
def claim_source_validation(spark, d):
    return _world(spark, d)["claim_issues"]


@query(
    "valid_claim_regions",
    with_story("evidence", "claims", "claim_sources") + SOURCES_SQL + " SELECT * FROM valid",
)
def valid_claim_regions(spark, d):
    return _world(spark, d)["valid"]


@query(
    "repeated_salient_tokens",
    with_story("evidence")
    + f""" SELECT project_id, token, count(*) AS regions FROM (SELECT DISTINCT project_id, asset_id, region_id,
      unnest(regexp_extract_all({NORM.format('evidence_text')}, '[A-Z0-9]+')) AS token FROM evidence)
    WHERE length(token) >= 4 AND NOT regexp_matches(token, '^[0-9]+$') GROUP BY 1, 2 HAVING count(*) >= 2""",
)
def repeated_salient_tokens(spark, d):
    from pagetrace.operators import grounding as G
    from pagetrace.sources.story_lens import story

    return G.repeated_tokens(story(spark, d, "evidence"))


@query(
    "name_only_regions",
    with_story("evidence")
    + f" SELECT project_id, asset_id, region_id, {NORM.format('evidence_text')} AS normalized FROM evidence WHERE {NAME_ONLY.format('evidence_text')}",
)
def name_only_regions(spark, d):
    from pagetrace.functions import text as T
    from pagetrace.sources.story_lens import story

    rows = story(spark, d, "evidence").where(T.name_only(F.col("evidence_text")))
    return rows.select("project_id", "asset_id", "region_id", T.normalize_name(F.col("evidence_text")).alias("normalized"))


JUDGED = SOURCES_SQL + f""", ev AS (SELECT *, {NORM.format('evidence_text')} AS n FROM evidence),
  cited AS (SELECT v.project_id, event_id, claim_id, list(n ORDER BY source_ord, region_id) AS texts, bool_or(text_role = 'game_ui') AS ui
    FROM valid v JOIN ev USING (project_id, asset_id, region_id) GROUP BY 1, 2, 3),
  names_raw AS (SELECT project_id, trim(name) AS name, 0 AS kind, char_ord AS a, '' AS b, 0 AS c FROM characters
    UNION ALL SELECT project_id, trim(evidence_text), 1, page_order, cast(asset_id AS varchar), ord FROM evidence WHERE {NAME_ONLY.format('evidence_text')}),
  names AS (SELECT project_id, {NORM.format('name')} AS nn, arg_min(name, row(kind, a, b, c)) AS name FROM names_raw GROUP BY 1, 2 HAVING nn <> ''),
  tokens AS (SELECT project_id, token FROM (SELECT DISTINCT project_id, asset_id, region_id, unnest(regexp_extract_all(n, '[A-Z0-9]+')) AS token FROM ev)
    WHERE length(token) >= 4 AND NOT regexp_matches(token, '^[0-9]+$') GROUP BY 1, 2 HAVING count(*) >= 2),
  first_in AS (SELECT c.project_id, c.event_id, c.claim_id, claim_ord, text, claim_type, subject, coalesce(texts, []) AS texts, coalesce(ui, false) AS ui,
      {NORM.format('text')} AS n, {NORM.format("coalesce(subject, '')")} AS s FROM claims c LEFT JOIN cited USING (project_id, event_id, claim_id)),
  first_foreign AS (SELECT f.claim_id, f.project_id, count(*) AS k, min(name) AS name FROM first_in f JOIN names m ON m.project_id = f.project_id AND {HOLDS.format('n', 'nn')}
      AND NOT list_bool_or(list_concat([false], list_transform(texts, lambda t: {HOLDS.format('t', 'nn')}))) GROUP BY 1, 2),
  first_token AS (SELECT DISTINCT f.claim_id, f.project_id FROM (SELECT project_id, claim_id, texts, unnest(list_distinct(regexp_extract_all(n, '[A-Z0-9]+'))) AS token FROM first_in) f
      JOIN tokens t ON t.project_id = f.project_id AND t.token = f.token WHERE NOT list_contains(regexp_extract_all(array_to_string(texts, ' '), '[A-Z0-9]+'), f.token)),
  first_ AS (SELECT i.*, ff.k, ff.name, CASE WHEN len(texts) = 0 THEN 'No valid source references.'
      WHEN claim_type IN ('speaker_attribution', 'actor_attribution') AND NOT (s <> '' AND list_bool_or(list_transform(texts, lambda t: {HOLDS.format('t', 's')}))) THEN 'Source evidence does not identify the attributed subject.'
      WHEN claim_type = 'causal_relation' AND NOT {CAUSAL.format("array_to_string(texts, ' ')")} THEN 'Source evidence does not explicitly state a causal relation.'
      WHEN ff.k IS NOT NULL OR ft.claim_id IS NOT NULL THEN 'Named entity attribution is not present in the sources.'
      WHEN {CAUSAL.format('n')} AND NOT {CAUSAL.format("array_to_string(texts, ' ')")} THEN 'Claim implies causality not stated by the sources.'
      WHEN ui THEN 'Game UI evidence requires review before script use.' END AS reason
    FROM first_in i LEFT JOIN first_foreign ff USING (project_id, claim_id) LEFT JOIN first_token ft USING (project_id, claim_id)),
  fix AS (SELECT *, trim(regexp_replace(text, concat('(^|[^\\p{{L}}\\p{{N}}_])', regexp_escape(name), '(?:[’'']s)?($|[^\\p{{L}}\\p{{N}}_])'), '\\1a character\\2', 'i')) AS raw_fix
    FROM first_ WHERE reason = 'Named entity attribution is not present in the sources.' AND claim_type <> 'causal_relation' AND k = 1),
  second_in AS (SELECT project_id, event_id, claim_id, texts, ui, CASE WHEN starts_with(raw_fix, 'a character') THEN concat('A', substr(raw_fix, 2)) ELSE raw_fix END AS fixed FROM fix WHERE raw_fix <> trim(text)),
  second_n AS (SELECT *, {NORM.format('fixed')} AS n FROM second_in),
  second_bad AS (SELECT DISTINCT f.project_id, f.claim_id FROM second_n f JOIN names m ON m.project_id = f.project_id AND {HOLDS.format('n', 'nn')}
        AND NOT list_bool_or(list_concat([false], list_transform(texts, lambda t: {HOLDS.format('t', 'nn')})))
      UNION SELECT f.project_id, f.claim_id FROM (SELECT project_id, claim_id, texts, unnest(list_distinct(regexp_extract_all(n, '[A-Z0-9]+'))) AS token FROM second_n) f
        JOIN tokens t ON t.project_id = f.project_id AND t.token = f.token WHERE NOT list_contains(regexp_extract_all(array_to_string(texts, ' '), '[A-Z0-9]+'), f.token)),
  second_ AS (SELECT n.*, CASE WHEN b.claim_id IS NOT NULL THEN 'Named entity attribution is not present in the sources.'
      WHEN {CAUSAL.format('n')} AND NOT {CAUSAL.format("array_to_string(texts, ' ')")} THEN 'Claim implies causality not stated by the sources.'
      WHEN ui THEN 'Game UI evidence requires review before script use.' END AS reason2 FROM second_n n LEFT JOIN second_bad b USING (project_id, claim_id)),
  judged AS (SELECT f.project_id, f.event_id, f.claim_id, claim_ord, CASE WHEN fixed IS NOT NULL AND reason2 IS NULL THEN fixed ELSE text END AS text,
      CASE WHEN fixed IS NOT NULL THEN reason2 ELSE reason END AS reason, CASE WHEN fixed IS NOT NULL AND reason2 IS NULL THEN name END AS removed_attribution, claim_type
    FROM first_ f LEFT JOIN second_ s USING (project_id, event_id, claim_id))"""
ALL_STORY = ("evidence", "events", "claims", "claim_sources", "characters", "character_sources", "progression")


@query(
    "claim_verdicts",
    with_story(*ALL_STORY) + JUDGED
    + """ SELECT project_id, event_id, claim_id, text, reason, removed_attribution,
      CASE WHEN reason IS NULL AND removed_attribution IS NOT NULL THEN 'claim_deattributed' WHEN reason IS NULL THEN NULL
        WHEN reason LIKE 'Named%' THEN 'unsupported_named_attribution' WHEN reason LIKE 'Claim implies%' THEN 'unsupported_causal_inference' WHEN reason LIKE 'Game UI%' THEN 'game_ui_claim_requires_review'
        WHEN claim_type = 'speaker_attribution' THEN 'unsupported_speaker_attribution' WHEN claim_type = 'actor_attribution' THEN 'unsupported_actor_attribution'
        WHEN claim_type = 'causal_relation' THEN 'unsupported_causal_inference' ELSE 'unsupported_claim' END AS code FROM judged""",
)
def claim_verdicts(spark, d):
    return _judged(spark, d)["judged"].select("project_id", "event_id", "claim_id", "text", "reason", "removed_attribution", "code")


GROUNDED = JUDGED + """, grounded AS (SELECT e.*, coalesce(g, 0) AS grounded_claims, coalesce(b, 1) AS unsupported_claims, coalesce(b = 0, false) AS script_ready
    FROM events e LEFT JOIN (SELECT project_id, event_id, count(*) FILTER (WHERE reason IS NULL) AS g, count(*) FILTER (WHERE reason IS NOT NULL) AS b FROM judged GROUP BY 1, 2) USING (project_id, event_id))"""


@query(
    "grounded_events",
    with_story(*ALL_STORY) + GROUNDED + " SELECT project_id, event_id, story_role, grounded_claims, unsupported_claims, script_ready FROM grounded",
)
def grounded_events(spark, d):
    return _judged(spark, d)["grounded"].select("project_id", "event_id", "story_role", "grounded_claims", "unsupported_claims", "script_ready")


@query(
    "merged_event_sources",
    with_story(*ALL_STORY) + JUDGED
    + """ SELECT v.project_id, v.event_id, v.asset_id, v.page_order, array_to_string(list_sort(list(DISTINCT v.region_id)), ',') AS regions
    FROM valid v JOIN judged j USING (project_id, event_id, claim_id) WHERE reason IS NULL GROUP BY 1, 2, 3, 4""",
)
def merged_event_sources(spark, d):
    from pagetrace.operators import grounding as G

    w = _judged(spark, d)
    return G.merged_sources(w["valid"], w["judged"]).select(
        "project_id", "event_id", "asset_id", "page_order", F.array_join(F.transform("region_ids", lambda r: r.cast("string")), ",").alias("regions")
    )


@query(
    "story_progression_check",
    with_story(*ALL_STORY) + GROUNDED
    + """, p AS (SELECT *, nullif(trim(event_id), '') AS id FROM progression),
    f AS (SELECT *, row_number() OVER (PARTITION BY project_id, id ORDER BY pos) AS r FROM p)
    SELECT f.project_id, pos, coalesce(id, f.event_id) AS event_id, CASE WHEN id IS NULL THEN 'invalid_progression_event_id' WHEN r > 1 THEN 'duplicate_progression_event'
      WHEN g.event_id IS NULL THEN 'nonexistent_progression_event' WHEN NOT script_ready THEN 'unsupported_progression_event'
      WHEN story_role <> 'main_story' THEN 'contextual_progression_event' END AS code
    FROM f LEFT JOIN grounded g ON g.project_id = f.project_id AND g.event_id = f.id""",
)
def story_progression_check(spark, d):
    from pagetrace.operators import grounding as G

    w = _judged(spark, d)
    return G.check_progression(w["progression"], w["grounded"])


CHARACTERS = f""", c_located AS (SELECT s.*, list_sort(list_distinct(region_ids)) AS uniq FROM character_sources s JOIN (SELECT DISTINCT project_id, asset_id, page_order FROM evidence) p USING (project_id, asset_id, page_order) WHERE list_min(region_ids) > 0),
  c_spread AS (SELECT l.project_id, character_id, l.asset_id, u.region_id, evidence_text FROM c_located l, unnest(uniq) u(region_id)
    LEFT JOIN evidence e ON e.project_id = l.project_id AND e.asset_id = l.asset_id AND e.region_id = u.region_id),
  c_valid AS (SELECT * FROM c_spread WHERE (project_id, character_id) NOT IN (SELECT (project_id, character_id) FROM c_spread WHERE evidence_text IS NULL)),
  people AS (SELECT c.project_id, c.character_id, CASE WHEN max(v.region_id) IS NULL THEN 'No valid source references.'
      WHEN NOT bool_or({HOLDS.format(NORM.format('evidence_text'), NORM.format('name'))}) THEN 'No source contains character name evidence.' END AS reason
    FROM characters c LEFT JOIN c_valid v USING (project_id, character_id) GROUP BY 1, 2)"""


@query(
    "character_name_evidence",
    with_story(*ALL_STORY) + CHARACTERS + " SELECT * FROM people",
)
def character_name_evidence(spark, d):
    from pagetrace.operators import grounding as G

    w = _world(spark, d)
    valid, _ = G.validate_sources(w["characters"], w["character_sources"], w["pages"], w["evidence"], G.CHARACTER)
    return G.ground_characters(w["characters"], valid, w["evidence"])[0].select("project_id", "character_id", "reason")


@query(
    "grounding_summary",
    with_story(*ALL_STORY) + GROUNDED.replace(SOURCES_SQL, SOURCES_SQL + CHARACTERS)
    + """ SELECT project_id, total_characters, grounded_characters, unsupported_characters, total_events, total_events AS grounded_events, unsupported_events, script_ready_events
    FROM (SELECT project_id, count(*) AS total_characters, count(*) FILTER (WHERE reason IS NULL) AS grounded_characters, count(reason) AS unsupported_characters FROM people GROUP BY 1)
    JOIN (SELECT project_id, count(*) AS total_events, count(*) FILTER (WHERE grounded_claims = 0) AS unsupported_events, count(*) FILTER (WHERE script_ready) AS script_ready_events FROM grounded GROUP BY 1) USING (project_id)""",
)
def grounding_summary(spark, d):
    from pagetrace.operators import grounding as G

    w = _judged(spark, d)
    valid, _ = G.validate_sources(w["characters"], w["character_sources"], w["pages"], w["evidence"], G.CHARACTER)
    people, _ = G.ground_characters(w["characters"], valid, w["evidence"])
    return G.grounding_summary(w["events"].select("project_id").distinct(), people, w["grounded"])


@query(
    "event_page_counts",
    with_story(*ALL_STORY) + JUDGED
    + """ SELECT v.project_id, v.event_id, count(DISTINCT v.asset_id) AS pages, count(DISTINCT (v.asset_id, v.region_id)) AS regions
    FROM valid v JOIN judged j USING (project_id, event_id, claim_id) WHERE reason IS NULL GROUP BY 1, 2""",
)
def event_page_counts(spark, d):
    from pagetrace.operators import grounding as G

    w = _judged(spark, d)
    regions = G.grounded_regions(w["valid"], w["judged"])
    return regions.groupBy("project_id", "event_id").agg(
        F.countDistinct("asset_id").alias("pages"), F.count(F.lit(1)).alias("regions")
    )


@query(
    "evidence_guard",
    with_story("evidence", "events")
    + """ SELECT DISTINCT project_id FROM evidence WHERE text_role IN ('dialogue', 'narration', 'thought') AND evidence_text <> ''
      AND project_id NOT IN (SELECT project_id FROM events WHERE project_id % 3 <> 1)""",
)
def evidence_guard(spark, d):
    from pagetrace.operators import grounding as G
    from pagetrace.sources.story_lens import story

    return G.evidence_guard(story(spark, d, "evidence"), story(spark, d, "events").where("project_id % 3 <> 1"))


@query(
    "story_structure_issues",
    with_story(*ALL_STORY)
    + """ SELECT project_id, 'event' AS entity_type, event_id AS entity_id, 'invalid_story_role' AS code FROM events WHERE event_ord % 11 = 1
    UNION ALL SELECT project_id, 'event', event_id, 'invalid_importance' FROM events WHERE event_ord % 7 = 2
    UNION ALL SELECT project_id, 'event', event_id, 'missing_summary' FROM events WHERE event_ord % 7 = 3
    UNION ALL SELECT project_id, 'event', event_id, 'duplicate_event_id' FROM events WHERE event_ord % 13 = 3
    UNION ALL SELECT project_id, 'claim', claim_id, 'invalid_claim_type' FROM claims WHERE claim_type = 'actor_attribution'
    UNION ALL SELECT project_id, 'claim', claim_id, 'source_region_ids' FROM claim_sources WHERE list_min(region_ids) <= 0
    UNION ALL SELECT project_id, 'claim', claim_id, 'missing_sources' FROM claims WHERE claim_id NOT IN (SELECT claim_id FROM claim_sources)
    UNION ALL SELECT project_id, 'character', character_id, 'missing_sources' FROM characters WHERE (project_id, character_id) NOT IN (SELECT (project_id, character_id) FROM character_sources)""",
)
def story_structure_issues(spark, d):
    from pagetrace.operators import grounding as G
    from pagetrace.sources.story_lens import story_world

    w = story_world(spark, d)
    k = F.col("event_ord")
    events = w["events"].withColumns(
        {
            "story_role": F.when(k % 11 == 1, "side").otherwise(F.col("story_role")),
            "importance": F.when(k % 7 == 2, F.lit(1.5)).otherwise(F.col("importance")),
            "summary": F.when(k % 7 == 3, F.lit(" ")).otherwise(F.lit("s")),
        }
    )
    # Only the id column is repeated, so the copies pass every other test.
    fine = events.withColumns({"story_role": F.lit("main_story"), "importance": F.lit(0.1), "summary": F.lit("s")})
    events = events.unionByName(fine.where("event_ord % 13 = 3"))
    claims = w["claims"].withColumn("claim_type", F.when(F.col("claim_type") == "actor_attribution", "guess").otherwise(F.col("claim_type")))
    claims = claims.withColumn("text", F.lit("t"))
    people = w["characters"].withColumn("name", F.lit("n"))
    return G.structure_issues(people, events, claims, w["claim_sources"], w["character_sources"])


# --- Coverage and recovery ---------------------------------------------------------

COVERED = JUDGED + f""", cites AS (SELECT DISTINCT v.project_id, v.asset_id, v.page_order, v.region_id FROM valid v JOIN judged j USING (project_id, event_id, claim_id) WHERE reason IS NULL),
  regions AS (SELECT e.*, CASE WHEN text_role IN ('dialogue', 'narration', 'thought') THEN 'primary' WHEN text_role IN ('game_ui', 'other') THEN 'context' ELSE 'excluded' END AS category,
      c.asset_id IS NOT NULL AS covered, (text_role IN ('dialogue', 'narration', 'thought') AND {NAME_ONLY.format('evidence_text')}) OR (e.asset_id + e.region_id) % 10 = 1 AS marked
    FROM evidence e LEFT JOIN cites c USING (project_id, asset_id, page_order, region_id)),
  open_ AS (SELECT * FROM regions WHERE category = 'primary' AND NOT covered AND NOT marked)"""


def _coverage(spark, d):
    from pagetrace.operators import coverage as V
    from pagetrace.operators import grounding as G

    w = _judged(spark, d)
    cited = G.grounded_regions(w["valid"], w["judged"])
    w["asides"] = w["evidence"].where("(asset_id + region_id) % 10 = 1")
    w["regions"] = V.covered_regions(w["evidence"], cited, w["asides"])
    return w


@query(
    "coverage_report",
    with_story(*ALL_STORY) + COVERED
    + f""" SELECT project_id, eligible_regions, important_regions, covered_regions, non_story_relevant_regions, unresolved_regions, optional_context_regions,
      {round_exact_sql('coalesce(cast(resolved AS double) / nullif(important_regions, 0), 1.0)', 4)} AS coverage_score FROM (
      SELECT project_id, count(*) FILTER (WHERE category <> 'excluded') AS eligible_regions, count(*) FILTER (WHERE category = 'primary') AS important_regions,
      count(*) FILTER (WHERE category <> 'excluded' AND covered AND NOT marked) AS covered_regions, count(*) FILTER (WHERE category <> 'excluded' AND marked) AS non_story_relevant_regions,
      count(*) FILTER (WHERE category = 'primary' AND NOT covered AND NOT marked) AS unresolved_regions, count(*) FILTER (WHERE category = 'context' AND NOT covered) AS optional_context_regions,
      count(*) FILTER (WHERE category = 'primary' AND (covered OR marked)) AS resolved FROM regions GROUP BY 1)""",
)
def coverage_report(spark, d):
    from pagetrace.operators import coverage as V

    return V.coverage_report(_coverage(spark, d)["regions"])


@query("uncovered_regions", with_story(*ALL_STORY) + COVERED + " SELECT project_id, asset_id, page_order, region_id, text_role FROM open_")
def uncovered_regions(spark, d):
    from pagetrace.operators import coverage as V

    return V.uncovered_important(_coverage(spark, d)["regions"]).select("project_id", "asset_id", "page_order", "region_id", "text_role")


@query(
    "nearby_context",
    with_story("evidence")
    + """ SELECT DISTINCT e.project_id, e.asset_id, e.region_id FROM evidence e JOIN evidence t USING (project_id, asset_id) WHERE (t.asset_id + t.region_id) % 4 = 0 AND abs(e.ord - t.ord) <= 1""",
)
def nearby_context(spark, d):
    from pagetrace.operators import coverage as V
    from pagetrace.sources.story_lens import story

    e = story(spark, d, "evidence")
    return V.nearby_context(e, e.where("(asset_id + region_id) % 4 = 0")).select("project_id", "asset_id", "region_id")


TOKENS = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+'), lambda t: length(t) > 1))"
def _overlaps(regions, order, claims):
    return f""", r_tokens AS (SELECT project_id, asset_id, page_order, region_id, {TOKENS.format('evidence_text')} AS a FROM {regions}),
  c_tokens AS (SELECT project_id, {order} AS o, text, {TOKENS.format('text')} AS b FROM {claims}),
  ov AS (SELECT r.project_id, r.asset_id, r.page_order, r.region_id, coalesce(max(cast(len(list_intersect(a, b)) AS double) / nullif(len(a), 0)), 0.0) AS overlap,
      arg_max(text, row(len(list_intersect(a, b)), -o)) FILTER (WHERE len(list_intersect(a, b)) > 0) AS closest_text
    FROM r_tokens r LEFT JOIN c_tokens c ON r.project_id = c.project_id GROUP BY 1, 2, 3, 4)"""


@query(
    "closest_claim_per_region",
    with_story("evidence", "claims")
    + _overlaps("evidence", "row_number() OVER (PARTITION BY project_id ORDER BY claim_id)", "claims")
    + " SELECT project_id, asset_id, region_id, overlap, closest_text FROM ov",
)
def closest_claim_per_region(spark, d):
    from pagetrace.operators import coverage as V
    from pagetrace.operators.numbering import number_rows
    from pagetrace.sources.story_lens import story_world

    w = story_world(spark, d)
    said = number_rows(w["claims"], ["project_id"], [F.col("claim_id")], into="n").select("project_id", F.col("n").alias("claim_ord"), "text")
    return V.with_overlap(w["evidence"], said).select("project_id", "asset_id", "region_id", "overlap", "closest_text")


SLOTS = COVERED + ", said AS (SELECT j.*, event_ord * 10 + claim_ord AS o FROM judged j JOIN events USING (project_id, event_id) WHERE reason IS NULL)" + _overlaps("open_", "o", "said") + """,
  slots AS (SELECT *, concat('slot_', cast(row_number() OVER (PARTITION BY project_id ORDER BY page_order, asset_id, ord, region_id) AS varchar)) AS slot_id,
      concat('coverage_recovery_p', cast(page_order AS varchar), '_r', cast(region_id AS varchar), '_', substr(sha256(cast(asset_id AS varchar)), 1, 8)) AS event_id
    FROM open_ JOIN ov USING (project_id, asset_id, page_order, region_id))"""


@query(
    "recovery_slots",
    with_story(*ALL_STORY) + SLOTS
    + f""" SELECT project_id, asset_id, region_id, slot_id, event_id, closest_text AS closest_grounded_claim, {round_exact_sql('overlap', 4)} AS normalized_token_overlap,
      overlap >= 0.8 AS equivalent_grounded_proposition FROM slots""",
)
def recovery_slots(spark, d):
    from pagetrace.plans.story import cover_and_recover

    w = _judged(spark, d)
    asides = w["evidence"].where("(asset_id + region_id) % 10 = 1")
    return cover_and_recover(w, w["result"], non_story=asides)["slots"].select(
        "project_id", "asset_id", "region_id", "slot_id", "event_id", "closest_grounded_claim", "normalized_token_overlap", "equivalent_grounded_proposition"
    )


COMPATIBLE = """CASE reason WHEN 'standalone_label' THEN len(tk) BETWEEN 1 AND 4 AND length(trim(evidence_text)) <= 40 AND NOT regexp_matches(evidence_text, '[.!?;:]')
      WHEN 'sfx_or_annotation' THEN text_role IN ('sfx', 'translator_note') WHEN 'non_story_ui' THEN text_role = 'game_ui' OR list_has_any(tk, ['system', 'achievement', 'unlocked', 'level', 'hp', 'mp'])
      WHEN 'repeated_information' THEN overlap >= 0.6 WHEN 'redundant_context' THEN overlap >= 0.5 WHEN 'greeting_or_filler' THEN len(tk) BETWEEN 1 AND 5
      WHEN 'no_factual_story_content' THEN len(tk) BETWEEN 1 AND 2 AND NOT regexp_matches(evidence_text, '\\p{Nd}') ELSE false END"""


@query(
    "non_story_reason_compatibility",
    with_story("evidence")
    + f""", r AS (SELECT *, {TOKENS.format('evidence_text')} AS tk, cast(region_id % 10 AS double) / 10 AS overlap,
      unnest(['standalone_label', 'repeated_information', 'non_story_ui', 'greeting_or_filler', 'sfx_or_annotation', 'redundant_context', 'no_factual_story_content', 'other']) AS reason FROM evidence)
    SELECT asset_id, region_id, reason, {COMPATIBLE} AS compatible FROM r""",
)
def non_story_reason_compatibility(spark, d):
    from pagetrace.operators import coverage as V
    from pagetrace.sources.story_lens import story

    reasons = F.array(*[F.lit(c) for c in [*V.NON_STORY_CODES, "other"]])
    rows = story(spark, d, "evidence").withColumn("reason", F.explode(reasons))
    fits = V.reason_compatible(F.col("reason"), F.col("evidence_text"), F.col("text_role"), (F.col("region_id") % 10) / 10)
    return rows.select("asset_id", "region_id", "reason", fits.alias("compatible"))


# Answers to the slots: one kind per slot number, one unknown slot per project.
ANSWERS_SQL = SLOTS + f""", numbered AS (SELECT *, cast(substr(slot_id, 6) AS bigint) AS n FROM slots),
  verdicts AS (SELECT project_id, slot_id, n, n % 8 AS k, CASE n % 8
      WHEN 0 THEN CASE WHEN len({TOKENS.format('evidence_text')}) BETWEEN 1 AND 4 AND length(trim(evidence_text)) <= 40 AND NOT regexp_matches(evidence_text, '[.!?;:]') THEN NULL ELSE 'incompatible_non_story_reason_code' END
      WHEN 1 THEN 'invalid_non_story_reason_code' WHEN 3 THEN 'fixed_slot_claim_not_anchored_to_evidence' WHEN 4 THEN 'model_supplied_backend_owned_field'
      WHEN 7 THEN CASE WHEN {CAUSAL.format(NORM.format('evidence_text'))} THEN NULL ELSE 'unsafe_fixed_slot_event' END END AS code FROM numbered WHERE n % 8 NOT IN (5, 6))"""


def _answers(slots):
    n = F.col("slot") % 8
    none = F.lit(None)
    rows = slots.where("slot % 8 <> 6").select(
        "project_id", F.col("slot").alias("pos"), "slot_id",
        F.when(n.isin(0, 1), "non_story_relevant").otherwise("new_event").alias("decision"),
        F.when(n == 0, "standalone_label").when(n == 1, "made_up").alias("reason_code"),
        F.when(n == 4, F.array(F.lit("asset_id"))).alias("supplied_fields"),
        F.when(n == 3, F.array(F.lit("Xqzt wvfk")))
        .when(n == 7, F.array(F.concat("evidence_text", F.lit(" because"))))
        .when(n > 1, F.array("evidence_text")).alias("claims"),
    )
    stray = slots.select("project_id").distinct().select(
        "project_id", F.lit(0).cast("long").alias("pos"), F.lit("slot_x").alias("slot_id"), F.lit("new_event").alias("decision"),
        none.cast("string").alias("reason_code"), none.cast("array<string>").alias("supplied_fields"), none.cast("array<string>").alias("claims"),
    )
    return rows.unionByName(rows.where("slot_id IS NOT NULL AND pos % 8 = 5")).unionByName(stray)


def _recovered(spark, d):
    from pagetrace.operators import coverage as V
    from pagetrace.plans.story import cover_and_recover

    w = _judged(spark, d)
    asides = w["evidence"].where("(asset_id + region_id) % 10 = 1")
    slots = cover_and_recover(w, w["result"], non_story=asides)["slots"]
    outputs = _answers(slots)
    verdict, issues, _ = V.validate_slot_outputs(outputs, slots, w["events"], w)
    return slots, outputs, verdict, issues


@query(
    "slot_answer_verdicts",
    with_story(*ALL_STORY) + ANSWERS_SQL + """ SELECT project_id, slot_id, code, code IS NULL AS valid,
      code IS NULL OR code IN ('incompatible_non_story_reason_code', 'fixed_slot_claim_not_anchored_to_evidence', 'unsafe_fixed_slot_event') AS structurally_valid FROM verdicts""",
)
def slot_answer_verdicts(spark, d):
    return _recovered(spark, d)[2].select("project_id", "slot_id", "code", "valid", "structurally_valid")


@query(
    "slot_answer_metrics",
    with_story(*ALL_STORY) + ANSWERS_SQL
    + f""", m AS (SELECT project_id, count(*) AS requested_slots, count(*) FILTER (WHERE n % 8 <> 6) AS returned_known_slots, count(*) FILTER (WHERE n % 8 = 5) AS duplicate_slots, 1 AS unknown_slots FROM numbered GROUP BY 1),
    v AS (SELECT project_id, count(*) FILTER (WHERE code IS NULL) AS ok, count(*) FILTER (WHERE code IN ('incompatible_non_story_reason_code', 'fixed_slot_claim_not_anchored_to_evidence', 'unsafe_fixed_slot_event')) AS sem FROM verdicts GROUP BY 1),
    r AS (SELECT m.*, coalesce(ok, 0) AS valid_slots, coalesce(sem, 0) AS semantic_rejections, coalesce(ok, 0) + coalesce(sem, 0) AS structurally_valid_slots FROM m LEFT JOIN v USING (project_id))
    SELECT *, requested_slots - structurally_valid_slots AS missing_slots, requested_slots - valid_slots AS unresolved_slots,
      {round_exact_sql('cast(structurally_valid_slots AS double) / requested_slots', 4)} AS structural_completeness, {round_exact_sql('cast(valid_slots AS double) / requested_slots', 4)} AS decision_completeness FROM r""",
)
def slot_answer_metrics(spark, d):
    from pagetrace.operators import coverage as V

    slots, outputs, verdict, issues = _recovered(spark, d)
    return V.slot_metrics(slots, outputs, verdict, issues)


DECISIONS_SQL = f""", open_ AS (SELECT *, (asset_id * 7 + region_id) % 9 AS k FROM evidence WHERE region_id <> 1),
  verdicts AS (SELECT project_id, asset_id, page_order, region_id, 0 AS again, CASE k
      WHEN 0 THEN CASE WHEN len({TOKENS.format('evidence_text')}) BETWEEN 1 AND 5 THEN NULL ELSE 'incompatible_non_story_reason_code' END
      WHEN 1 THEN 'missing_non_story_reason_code' WHEN 2 THEN 'unknown_non_story_reason_code' WHEN 3 THEN 'duplicate_region_decision' WHEN 5 THEN 'recovery_event_does_not_cover_region'
      WHEN 6 THEN 'recovery_event_id_conflict' WHEN 7 THEN 'unsafe_recovery_event' WHEN 8 THEN 'unknown_recovery_disposition' END AS code FROM open_
    UNION ALL SELECT project_id, asset_id, page_order, region_id, 1, 'repeated_duplicate' FROM open_ WHERE k = 3
    UNION ALL SELECT project_id, asset_id, page_order, region_id, 0, 'unknown_region' FROM evidence WHERE region_id = 1)"""


def _decisions(spark, d):
    from pagetrace.operators import coverage as V
    from pagetrace.sources.story_lens import story

    e = story(spark, d, "evidence")
    k = (F.col("asset_id") * 7 + F.col("region_id")) % 9
    open_rows = e.where("region_id <> 1").withColumn("overlap", F.lit(0.0))
    named = F.concat(F.lit("r"), "asset_id", F.lit("_"), "region_id")
    base = e.select(
        *V.KEY, (F.col("asset_id") * 100 + F.col("region_id")).alias("pos"), k.alias("k"),
        F.when(k < 4, "non_story_relevant").when(k < 8, "new_event").otherwise("later").alias("disposition"),
        F.when(k == 0, "greeting_or_filler").when(k == 2, "because").when(k == 3, "standalone_label").alias("reason_code"),
        F.when(k == 1, "says hello").alias("reason"), F.when(k.between(4, 7), named).alias("event_id"),
    )
    again = base.where("k = 3 AND region_id <> 1").withColumn("pos", F.col("pos") + 50)
    decisions = base.unionByName(again)
    events = base.where("k BETWEEN 4 AND 7")
    sources = events.where("k <> 5").select("project_id", "event_id", *V.REFERENCE)
    ready = events.where("k <> 7").select("project_id", "event_id")
    taken = events.where("k = 6").select("project_id", "event_id")
    return open_rows, decisions, V.validate_decisions(decisions, open_rows, taken, sources, ready)


@query("recovery_decision_verdicts", with_story("evidence") + DECISIONS_SQL + " SELECT * FROM verdicts")
def recovery_decision_verdicts(spark, d):
    verdicts = _decisions(spark, d)[2]
    again = (F.col("pos") - F.col("asset_id") * 100 - F.col("region_id") > 0).cast("int")
    return verdicts.select("project_id", "asset_id", "page_order", "region_id", again.alias("again"), "code")


@query(
    "recovery_reason_repair",
    with_story("evidence") + DECISIONS_SQL
    + """ SELECT 'repairable' AS part, project_id, count(*) AS n FROM verdicts WHERE code = 'missing_non_story_reason_code' GROUP BY 2
    UNION ALL SELECT 'issues', project_id, count(*) FROM verdicts WHERE code IS NOT NULL AND code <> 'missing_non_story_reason_code' GROUP BY 2
    UNION ALL SELECT 'open', project_id, count(*) FROM verdicts WHERE code IS NOT NULL AND code NOT IN ('missing_non_story_reason_code', 'unknown_region', 'repeated_duplicate') GROUP BY 2""",
)
def recovery_reason_repair(spark, d):
    from pagetrace.operators import coverage as V

    open_rows, decisions, verdicts = _decisions(spark, d)
    left = V.unresolved(open_rows, verdicts)
    repairable = V.repairable_reasons(decisions, left)
    issues = verdicts.where("code IS NOT NULL").select(*V.KEY, "code")
    kept, still_open = V.apply_repairs(issues, left, repairable, issues.where(F.lit(False)))
    out = None
    for part, rows in (("repairable", repairable), ("issues", kept), ("open", still_open)):
        one = rows.groupBy("project_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "project_id", "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "recovered_event_merge",
    with_story("events", "progression", "evidence")
    + """, added AS (SELECT project_id, event_id, CASE WHEN event_ord % 5 = 1 THEN event_id ELSE concat('new_', event_id) END AS new_id, event_ord FROM events WHERE event_ord % 2 = 1)
    SELECT project_id, count(*) AS events, count(*) FILTER (WHERE clash) AS collisions, any_value(p) AS progression FROM (
      SELECT project_id, event_id, false AS clash FROM events UNION ALL SELECT project_id, new_id, new_id = event_id FROM added)
    JOIN (SELECT project_id, count(*) AS p FROM (SELECT project_id, pos, event_id FROM progression UNION ALL SELECT project_id, 0, new_id FROM added
      WHERE (project_id, new_id) NOT IN (SELECT (project_id, event_id) FROM progression)) GROUP BY 1) USING (project_id) GROUP BY 1""",
)
def recovered_event_merge(spark, d):
    from pagetrace.operators import coverage as V
    from pagetrace.sources.story_lens import story

    events = story(spark, d, "events")
    fresh = F.when(F.col("event_ord") % 5 == 1, F.col("event_id")).otherwise(F.concat(F.lit("new_"), "event_id"))
    added = events.where("event_ord % 2 = 1").withColumn("event_id", fresh)
    merged, collisions = V.merge_events(events, added)
    listed = V.extend_progression(story(spark, d, "progression"), added.select("project_id", F.col("event_ord").alias("pos"), "event_id"))
    counts = merged.groupBy("project_id").agg(F.count(F.lit(1)).alias("events"))
    clashes = collisions.groupBy("project_id").agg(F.count(F.lit(1)).alias("collisions"))
    lines = listed.groupBy("project_id").agg(F.count(F.lit(1)).alias("progression"))
    return counts.join(clashes, "project_id", "left").join(lines, "project_id", "left").fillna(0)


@query(
    "continuation_merge",
    with_story("events", "evidence")
    + """, second AS (SELECT *, event_ord % 3 = 0 AS clash FROM events),
    cites AS (SELECT project_id, event_id, event_ord // 100 AS asset_id, event_ord % 100 + 1 AS region_id, clash FROM second),
    still AS (SELECT count(*) AS n, e.project_id FROM evidence e LEFT JOIN cites c ON c.project_id = e.project_id AND c.asset_id = e.asset_id AND c.region_id = e.region_id
      WHERE c.event_id IS NULL OR c.clash GROUP BY 2)
    SELECT project_id, count(*) FILTER (WHERE event_ord % 3 = 0) + count(*) FILTER (WHERE event_ord % 3 <> 0) AS events, count(*) FILTER (WHERE clash) AS conflicts, any_value(n) AS open_regions
    FROM second JOIN still USING (project_id) GROUP BY 1""",
)
def continuation_merge(spark, d):
    from pagetrace.operators import coverage as V
    from pagetrace.sources.story_lens import story

    events, evidence = story(spark, d, "events"), story(spark, d, "evidence")
    first = events.where("event_ord % 3 = 0")
    sources = events.select(
        "project_id", "event_id", F.floor(F.col("event_ord") / 100).alias("asset_id"), (F.col("event_ord") % 100 + 1).alias("region_id")
    ).withColumn("page_order", F.col("asset_id") % 5 + 1)
    merged, issues, left = V.merge_continuation(first, events, sources, evidence.select(*V.KEY), sources)
    counts = merged.groupBy("project_id").agg(F.count(F.lit(1)).alias("events"))
    clashes = issues.groupBy("project_id").agg(F.count(F.lit(1)).alias("conflicts"))
    regions = left.groupBy("project_id").agg(F.count(F.lit(1)).alias("open_regions"))
    return counts.join(clashes, "project_id", "left").join(regions, "project_id", "left").fillna(0)


@query(
    "story_source_revision",
    STORY_INPUT + """ SELECT p.project_id, true AS same_when_shuffled, coalesce(n > 0, false) AS changed_when_moved FROM
      (SELECT DISTINCT project_id FROM pages UNION ALL SELECT concat('empty_', cast(r_regionkey AS varchar)) FROM region) p
      LEFT JOIN (SELECT project_id, count(*) AS n FROM stops WHERE stop IS NULL AND project_id NOT IN (FROM blocked) GROUP BY 1) k USING (project_id)""",
)
def story_source_revision(spark, d):
    built = _input(spark, d)
    first = S.source_revision(built["projects"], built["pages"], built["evidence"])
    again = S.source_revision(built["projects"], built["pages"].repartition(3), built["evidence"].repartition(5, "final_text"))
    moved = S.source_revision(built["projects"], built["pages"].withColumn("page_order", F.col("page_order") + 1), built["evidence"])
    a, b, c = (r.select("project_id", F.col("source_revision").alias(n)) for r, n in ((first, "a"), (again, "b"), (moved, "c")))
    joined = a.join(b, "project_id").join(c, "project_id")
    return joined.select("project_id", (F.col("a") == F.col("b")).alias("same_when_shuffled"), (F.col("a") != F.col("c")).alias("changed_when_moved"))
