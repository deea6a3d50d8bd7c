"""Review and script queries over the conversation story world.

The world's own events stand in for grounded ones here, so these queries do not
wait for the grounding rules: every event is ready unless its number says not.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pagetrace.functions import text as T
from pagetrace.functions.numeric import round_exact_sql
from pagetrace.operators import review as V
from pagetrace.operators import script as P
from pagetrace.plans.story import plan_scripts
from pagetrace.sources.story_lens import story, with_story

QUERIES = {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return register


WORLD = with_story("evidence", "events", "claims", "progression") + """, ev AS (SELECT *, event_ord % 7 <> 1 AS script_ready, CASE WHEN event_ord % 7 = 1 THEN 1 ELSE 0 END AS unsupported_claims FROM events),
  er AS (SELECT project_id, event_id, event_ord // 100 AS asset_id, (event_ord // 100) % 5 + 1 AS page_order, event_ord % 100 + 1 AS region_id FROM ev WHERE event_ord % 11 <> 4),
  open_ AS (SELECT project_id, asset_id, page_order, region_id, evidence_text FROM evidence ANTI JOIN er USING (project_id, asset_id, page_order, region_id)),
  st AS (SELECT DISTINCT project_id, CASE WHEN project_id % 3 = 0 THEN 'partial' ELSE 'ready' END AS status, CASE WHEN project_id % 6 = 5 THEN 'r0' ELSE 'r1' END AS source_revision,
      CASE WHEN project_id % 5 = 0 THEN NULL WHEN project_id % 7 = 6 THEN 'r0' ELSE 'r1' END AS review_source_revision, 'r1' AS current_revision FROM evidence),
  live AS (SELECT project_id FROM st WHERE source_revision = 'r1' AND coalesce(review_source_revision, 'r1') = 'r1'),
  edits AS (SELECT project_id, event_id, concat('edited ', event_id) AS text FROM ev WHERE event_ord % 5 = 1 AND project_id % 2 = 1),
  res AS (SELECT project_id, asset_id, page_order, region_id, CASE WHEN (asset_id + region_id) % 2 = 0 THEN 'added_to_story' ELSE 'non_story_relevant' END AS action,
      concat('added ', cast(asset_id AS varchar), '-', cast(region_id AS varchar)) AS text, concat('human-', cast(asset_id AS varchar), '-', cast(region_id AS varchar)) AS event_id
    FROM open_ WHERE project_id % 3 <> 1 OR region_id = 1)"""


def _world(spark, d):
    w = {n: story(spark, d, n) for n in ("evidence", "events", "claims", "progression")}
    bad = F.col("event_ord") % 7 == 1
    ev = w["events"].withColumns({"script_ready": ~bad, "unsupported_claims": F.when(bad, 1).otherwise(0)})
    asset = F.floor(F.col("event_ord") / 100)
    er = ev.where("event_ord % 11 <> 4").select(
        "project_id", "event_id", asset.alias("asset_id"), (asset % 5 + 1).alias("page_order"), (F.col("event_ord") % 100 + 1).alias("region_id")
    )
    place = ["project_id", "asset_id", "page_order", "region_id"]
    open_rows = w["evidence"].join(er, place, "left_anti").select(*place, "evidence_text")
    p = F.col("project_id")
    stories = w["evidence"].select("project_id").distinct().select(
        "project_id", F.when(p % 3 == 0, "partial").otherwise("ready").alias("status"),
        F.when(p % 6 == 5, "r0").otherwise("r1").alias("source_revision"),
        F.when(p % 5 == 0, F.lit(None)).when(p % 7 == 6, "r0").otherwise("r1").alias("review_source_revision"),
        F.lit(None).cast("string").alias("approval_source_revision"), F.lit(None).cast("string").alias("approval_story_fingerprint"),
        F.lit(False).alias("approved"),
    )
    revisions = stories.select("project_id", F.lit("r1").alias("current_revision"))
    edits = ev.where("event_ord % 5 = 1 AND project_id % 2 = 1").select("project_id", "event_id", F.concat(F.lit("edited "), "event_id").alias("text"))
    tag = F.concat("asset_id", F.lit("-"), "region_id")
    res = open_rows.where("project_id % 3 <> 1 OR region_id = 1").select(
        "project_id", "asset_id", "page_order", "region_id",
        F.when((F.col("asset_id") + F.col("region_id")) % 2 == 0, "added_to_story").otherwise("non_story_relevant").alias("action"),
        F.concat(F.lit("added "), tag).alias("text"), F.concat(F.lit("human-"), tag).alias("event_id"),
    )
    w.update(ev=ev, er=er, open=open_rows, stories=stories, revisions=revisions, edits=edits, res=res)
    return w


def _compose(w, stories=None):
    return V.compose_review(stories or w["stories"], w["revisions"], w["ev"], w["claims"], w["er"], w["open"], w["edits"], w["res"])


@query(
    "final_story_events",
    WORLD + """, first_ AS (SELECT project_id, event_id, min(row(page_order, region_id)) AS spot FROM er GROUP BY 1, 2),
    ai AS (SELECT e.project_id, e.event_id, coalesce(d.text, summary) AS summary, story_role, CASE WHEN d.text IS NOT NULL THEN 'human_edited' ELSE 'ai_grounded' END AS provenance,
        coalesce(spot[1], 1000000000) AS page, coalesce(spot[2], event_ord) AS region, 0 AS kind, event_ord AS o
      FROM ev e LEFT JOIN (SELECT * FROM edits WHERE project_id IN (FROM live)) d USING (project_id, event_id) LEFT JOIN first_ USING (project_id, event_id) WHERE script_ready),
    all_ AS (SELECT * FROM ai UNION ALL SELECT project_id, event_id, text, 'main_story', 'human_added', page_order, region_id, 1, 0 FROM res WHERE action = 'added_to_story' AND project_id IN (FROM live))
    SELECT project_id, event_id, summary, story_role, provenance, row_number() OVER (PARTITION BY project_id ORDER BY page, region, kind, o, event_id) AS position FROM all_""",
)
def final_story_events(spark, d):
    return _compose(_world(spark, d))["events"].drop("ai_original_summary")


@query(
    "review_states",
    WORLD + """, t AS (SELECT project_id, count(*) AS total FROM open_ GROUP BY 1),
    l AS (SELECT o.project_id, count(*) AS remaining FROM open_ o LEFT JOIN (SELECT * FROM res WHERE project_id IN (FROM live)) r USING (project_id, asset_id, region_id) WHERE r.action IS NULL GROUP BY 1),
    j AS (SELECT st.*, coalesce(total, 0) AS unresolved_total, coalesce(remaining, 0) AS unresolved_remaining, project_id IN (FROM live) AS applicable,
        project_id IN (SELECT project_id FROM edits) AS edited FROM st LEFT JOIN t USING (project_id) LEFT JOIN l USING (project_id)),
    k AS (SELECT *, applicable AND unresolved_remaining = 0 AND (review_source_revision IS NOT NULL OR unresolved_total = 0) AS review_complete FROM j)
    SELECT project_id, CASE WHEN NOT applicable THEN 'stale' WHEN review_complete THEN 'reviewed' WHEN unresolved_total > unresolved_remaining OR edited THEN 'in_progress' ELSE 'none' END AS review_status,
      NOT applicable AS stale, unresolved_total - unresolved_remaining AS resolved_by_human, unresolved_total, unresolved_remaining, review_complete,
      applicable AND (status = 'ready' OR review_complete) AS final_story_ready, false AS story_approved, false AS approval_invalidated FROM k""",
)
def review_states(spark, d):
    return _compose(_world(spark, d))["states"].drop("final_story_fingerprint")


@query(
    "review_approvals",
    WORLD + """, l AS (SELECT o.project_id, count(*) AS remaining FROM open_ o LEFT JOIN (SELECT * FROM res WHERE project_id IN (FROM live)) r USING (project_id, asset_id, region_id) WHERE r.action IS NULL GROUP BY 1),
    t AS (SELECT project_id, count(*) AS total FROM open_ GROUP BY 1),
    k AS (SELECT st.project_id, st.project_id IN (FROM live) AND coalesce(remaining, 0) = 0 AND (review_source_revision IS NOT NULL OR total IS NULL) AS done FROM st LEFT JOIN l USING (project_id) LEFT JOIN t USING (project_id))
    SELECT project_id, done AS approved_now, done AND project_id % 2 = 1 AND project_id NOT IN (SELECT project_id FROM ev WHERE script_ready) AS still_approved_after_change, CASE WHEN done THEN NULL ELSE 'not_ready_for_approval' END AS reject FROM k""",
)
def review_approvals(spark, d):
    """Approve what can be approved, then change every summary: the approvals must fall."""
    from pagetrace.session import cut

    w = _world(spark, d)
    states = cut(_compose(w)["states"])
    updated, rejected = V.approve_stories(w["stories"], states, w["stories"])
    updated = cut(updated)
    again = _compose(w, updated)["states"].select("project_id", F.col("story_approved").alias("approved_now"))
    changed = dict(w, ev=w["ev"].withColumn("summary", F.concat("summary", F.lit("?"))), edits=w["edits"].withColumn("text", F.concat("text", F.lit("?"))))
    after = _compose(changed, updated)["states"].select("project_id", F.col("story_approved").alias("still_approved_after_change"))
    return again.join(after, "project_id").join(rejected, "project_id", "left")


REQUESTS = """, q AS (SELECT project_id, event_ord AS seq, CASE WHEN event_ord % 6 = 1 THEN 'nowhere' ELSE event_id END AS event_id,
      CASE event_ord % 8 WHEN 3 THEN '  ' WHEN 5 THEN repeat('x', 2001) ELSE concat(' new ', event_id) END AS text, CASE WHEN event_ord % 10 = 3 THEN 'r0' ELSE 'r1' END AS revision FROM ev)"""


@query(
    "event_edit_requests",
    WORLD + REQUESTS + """ SELECT q.project_id, seq, CASE WHEN revision <> 'r1' OR source_revision <> 'r1' THEN 'sources_changed' WHEN coalesce(review_source_revision, 'r1') <> 'r1' THEN 'older_review'
      WHEN e.event_id IS NULL THEN 'event_not_found' WHEN trim(q.text) = '' THEN 'empty_text' WHEN length(trim(q.text)) > 2000 THEN 'text_too_long' END AS reject
    FROM q JOIN st USING (project_id) LEFT JOIN (SELECT * FROM ev WHERE script_ready) e ON e.project_id = q.project_id AND e.event_id = q.event_id""",
)
def event_edit_requests(spark, d):
    w = _world(spark, d)
    k = F.col("event_ord")
    requests = w["ev"].select(
        "project_id", k.alias("seq"), F.when(k % 6 == 1, "nowhere").otherwise(F.col("event_id")).alias("event_id"),
        F.when(k % 8 == 3, "  ").when(k % 8 == 5, F.repeat(F.lit("x"), F.lit(2001))).otherwise(F.concat(F.lit(" new "), "event_id")).alias("text"),
        F.when(k % 10 == 3, "r0").otherwise("r1").alias("revision"),
    )
    judged, _ = V.apply_edits(requests, w["stories"], w["revisions"], w["ev"], w["res"])
    return judged.select("project_id", "seq", "reject")


@query(
    "evidence_resolution_requests",
    WORLD + """, q AS (SELECT project_id, asset_id * 100 + region_id AS seq, asset_id, region_id, CASE region_id % 5 WHEN 1 THEN 'added_to_story' WHEN 2 THEN 'skip' ELSE 'non_story_relevant' END AS action,
        CASE WHEN asset_id % 4 = 1 THEN ' ' ELSE 'told' END AS text, CASE WHEN asset_id % 6 = 2 THEN 'r0' ELSE 'r1' END AS revision FROM evidence
      UNION ALL SELECT project_id, asset_id * 100 + region_id + 50, asset_id, region_id, 'non_story_relevant', NULL, 'r1' FROM evidence WHERE region_id = 3),
    j AS (SELECT q.*, o.region_id IS NOT NULL AS known, r.region_id IS NOT NULL AS done, source_revision, review_source_revision FROM q JOIN st USING (project_id) LEFT JOIN open_ o USING (project_id, asset_id, region_id)
      LEFT JOIN (SELECT * FROM res WHERE region_id = 1) r USING (project_id, asset_id, region_id)),
    b AS (SELECT *, CASE WHEN NOT known THEN 'evidence_not_found' WHEN revision <> 'r1' OR source_revision <> 'r1' THEN 'sources_changed' WHEN coalesce(review_source_revision, 'r1') <> 'r1' THEN 'older_review'
        WHEN done THEN 'already_reviewed' WHEN action = 'added_to_story' AND trim(text) = '' THEN 'empty_text' WHEN action = 'skip' THEN 'unsupported_action' END AS reject FROM j),
    f AS (SELECT *, min(seq) FILTER (WHERE reject IS NULL) OVER (PARTITION BY project_id, asset_id, region_id) AS first_ FROM b)
    SELECT project_id, seq, CASE WHEN reject IS NULL AND seq > first_ THEN 'already_reviewed' ELSE reject END AS reject,
      CASE WHEN reject IS NULL AND seq = first_ AND action = 'added_to_story' THEN concat('human-event-', substr(sha256(concat(project_id, '|r1|', asset_id, '|', region_id)), 1, 16)) END AS event_id FROM f""",
)
def evidence_resolution_requests(spark, d):
    w = _world(spark, d)
    a, r = F.col("asset_id"), F.col("region_id")
    base = w["evidence"].select(
        "project_id", (a * 100 + r).alias("seq"), "asset_id", "region_id",
        F.when(r % 5 == 1, "added_to_story").when(r % 5 == 2, "skip").otherwise("non_story_relevant").alias("action"),
        F.when(a % 4 == 1, " ").otherwise("told").alias("text"), F.when(a % 6 == 2, "r0").otherwise("r1").alias("revision"),
    )
    later = w["evidence"].where("region_id = 3").select(
        "project_id", (a * 100 + r + 50).alias("seq"), "asset_id", "region_id", F.lit("non_story_relevant").alias("action"),
        F.lit(None).cast("string").alias("text"), F.lit("r1").alias("revision"),
    )
    judged = V.apply_resolutions(base.unionByName(later), w["stories"], w["revisions"], w["open"], w["res"].where("region_id = 1"))
    return judged.select("project_id", "seq", "reject", "event_id")


@query(
    "story_result_status",
    WORLD + """ SELECT st.project_id, CASE WHEN coalesce(n, 0) = 0 AND coalesce(m, false) THEN 'ready' ELSE 'partial' END AS story_status,
      CASE WHEN source_revision <> 'r1' THEN 'stale' WHEN coalesce(n, 0) = 0 AND coalesce(m, false) THEN 'ready' ELSE 'partial' END AS status, source_revision <> 'r1' AS stale
    FROM st LEFT JOIN (SELECT project_id, count(*) AS n FROM open_ GROUP BY 1) USING (project_id)
      LEFT JOIN (SELECT project_id, bool_or(script_ready AND story_role = 'main_story') AS m FROM ev GROUP BY 1) USING (project_id)""",
)
def story_result_status(spark, d):
    w = _world(spark, d)
    open_counts = w["open"].groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))
    coverage = w["stories"].select("project_id").join(open_counts, "project_id", "left").select("project_id", F.coalesce("n", F.lit(0)).alias("unresolved_regions"))
    status = V.result_status(w["stories"], coverage, w["ev"])
    return V.serialized_status(w["stories"].drop("status").join(status, "project_id"), w["revisions"])


SCRIPT = WORLD + r""", told AS (SELECT project_id, event_id, claim_ord, claim_id, translate(trim(text), '"''“”‘’«»', '') AS fact FROM claims WHERE trim(text) <> ''),
  safe AS (SELECT * FROM ev WHERE script_ready AND (project_id, event_id) IN (SELECT (project_id, event_id) FROM claims)),
  prog AS (SELECT project_id, trim(event_id) AS event_id, min(pos) AS pos FROM progression GROUP BY 1, 2),
  main_ AS (SELECT s.*, pos FROM safe s LEFT JOIN prog USING (project_id, event_id) WHERE pos IS NOT NULL OR story_role = 'main_story'),
  units AS (SELECT m.project_id, m.event_id, claim_id, fact, row_number() OVER (PARTITION BY m.project_id ORDER BY pos IS NULL, coalesce(pos, event_ord), m.event_id, claim_ord) AS n FROM main_ m JOIN told USING (project_id, event_id)),
  last_ AS (SELECT project_id, max(n) AS n FROM units GROUP BY 1),
  placed AS (SELECT project_id, least(n, 5) AS beat, n AS unit, event_id, claim_id, fact FROM units
    UNION ALL SELECT u.project_id, b.beat, u.n, event_id, claim_id, fact FROM units u JOIN last_ l ON l.project_id = u.project_id AND l.n = u.n, range(1, 6) b(beat) WHERE b.beat > u.n
    UNION ALL SELECT project_id, 2, 1000000000, c.e, c.c, c.f FROM (SELECT project_id, arg_min({'e': event_id, 'c': claim_id, 'f': fact}, row(event_ord, claim_ord)) AS c FROM safe JOIN told USING (project_id, event_id)
      WHERE story_role = 'supporting_context' AND project_id IN (SELECT project_id FROM units) GROUP BY 1)),
  told_beats AS (SELECT project_id, beat, string_agg(fact, ' ' ORDER BY unit) AS fact_text, count(DISTINCT event_id) AS events, count(DISTINCT claim_id) AS claims FROM placed GROUP BY 1, 2),
  prefix AS (SELECT * FROM (VALUES (1, 'hook', 'Mở đầu, '), (2, 'setup', 'Về bối cảnh, '), (3, 'development', 'Tiếp đó, '), (4, 'payoff', 'Điểm chính là: '), (5, 'ending', 'Tóm lại, ')) t(beat, role, prefix))"""


def _clean_progression(w):
    return w["progression"].withColumn("event_id", T.strip(F.col("event_id")))


def _scripts(w, selections=None, styles=None):
    return plan_scripts(w["ev"], w["claims"], _clean_progression(w), selections, styles)


@query("script_beat_units", SCRIPT + " SELECT project_id, beat, claim_id, event_id, fact AS fact_text FROM placed")
def script_beat_units(spark, d):
    w = _world(spark, d)
    units = P.beat_units(P.safe_events(w["ev"], w["claims"]), w["claims"], _clean_progression(w))
    return units.select("project_id", "beat", "claim_id", "event_id", "fact_text")


@query("script_beats", SCRIPT + " SELECT project_id, beat, role, fact_text, events, claims FROM told_beats JOIN prefix USING (beat)")
def script_beats(spark, d):
    told = _scripts(_world(spark, d))["beats"]
    return told.select(
        "project_id", "beat", "role", "fact_text", F.size("source_event_ids").cast("long").alias("events"), F.size("claim_ids").cast("long").alias("claims")
    )


PHRASES = "(VALUES " + ", ".join(f"('{s}', '{r}', '{i}', '{t}')" for s, r, i, t in P.STYLE_PREFIXES) + ") t(style, role, phrase, styled)"


@query(
    "script_segments_with_style",
    SCRIPT + f""" SELECT project_id, segment_id, type, concat(CASE WHEN good THEN styled ELSE prefix END, fact_text) AS text,
      CASE WHEN good THEN 'bounded_model_style' ELSE 'deterministic_fallback' END AS renderer_mode
    FROM (SELECT b.project_id, concat('segment_', cast(b.beat AS varchar)) AS segment_id, p.role AS type, fact_text, prefix, project_id % 4 NOT IN (1, 2) AS good,
        (['natural', 'funny', 'emotional', 'dramatic'])[project_id % 4 + 1] AS style FROM told_beats b JOIN prefix p USING (beat)) x
    JOIN {PHRASES} ON t.style = x.style AND t.role = x.type""",
)
def script_segments_with_style(spark, d):
    w = _world(spark, d)
    p = F.col("project_id") % 4
    styles = w["stories"].select("project_id", F.get(F.array(*[F.lit(s) for s in P.STYLES]), p.cast("int")).alias("style"))
    beats = F.explode(F.sequence(F.lit(1), F.lit(5)))
    types = F.array(*[F.lit(t) for t in P.SEGMENT_TYPES])
    rows = styles.withColumn("pos", beats)
    # Two of four projects get an unusable choice: a foreign phrase, or two beats swapped.
    selections = rows.select(
        "project_id", "pos",
        F.concat(F.lit("beat_"), F.when((p == 2) & (F.col("pos") < 3), 3 - F.col("pos")).otherwise(F.col("pos"))).alias("beat_id"),
        F.concat(F.when((p == 1) & (F.col("pos") == 5), "odd").otherwise(F.col("style")), F.lit("_"), F.get(types, F.col("pos") - 1)).alias("style_phrase_id"),
    )
    out = _scripts(w, selections, styles)["segments"]
    return out.select("project_id", "segment_id", "type", "text", "renderer_mode")


@query(
    "script_totals",
    SCRIPT + f""", s AS (SELECT project_id, concat(prefix, fact_text) AS text FROM told_beats JOIN prefix USING (beat)),
    c AS (SELECT project_id, count(*) AS segment_count, cast(sum(len(string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), '\\s+'))) AS bigint) AS word_count FROM s GROUP BY 1)
    SELECT project_id, segment_count, word_count, (SELECT count(DISTINCT event_id) FROM placed p WHERE p.project_id = c.project_id) AS source_event_count,
      {round_exact_sql('cast(word_count AS double) / 150.0::double * 60.0::double', 1)} AS estimated_duration_seconds FROM c""",
)
def script_totals(spark, d):
    return _scripts(_world(spark, d))["totals"]


@query(
    "script_problem_projects",
    WORLD + """, safe AS (SELECT * FROM ev WHERE script_ready AND project_id % 5 <> 2 AND (project_id % 5 <> 3 OR story_role = 'supporting_context'))
    SELECT project_id, CASE WHEN n IS NULL THEN 'no_script_ready_events' ELSE 'no_main_story_events' END AS problem FROM (SELECT DISTINCT project_id FROM ev)
    LEFT JOIN (SELECT project_id, count(*) AS n, bool_or(story_role = 'main_story') AS m FROM safe GROUP BY 1) USING (project_id) WHERE n IS NULL OR NOT m""",
)
def script_problem_projects(spark, d):
    w = _world(spark, d)
    ev = w["ev"].where("project_id % 5 <> 2 AND (project_id % 5 <> 3 OR story_role = 'supporting_context')")
    return P.script_problems(w["ev"].select("project_id").distinct(), P.safe_events(ev, w["claims"]))


@query(
    "script_reference_issues",
    SCRIPT + """, names AS (SELECT DISTINCT project_id, upper(t) AS detail FROM (SELECT c.project_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ỹ]+')) AS t FROM claims c JOIN safe USING (project_id, event_id))
        WHERE length(t) >= 3 AND (t = upper(t) OR t = concat(upper(substr(t, 1, 1)), lower(substr(t, 2)))) AND upper(t) NOT IN ('A', 'AN', 'THE')),
    seg AS (SELECT project_id, beat, list(DISTINCT event_id) AS events, list(DISTINCT claim_id) AS claims FROM placed GROUP BY 1, 2),
    cut_ AS (SELECT project_id, beat, CASE WHEN project_id % 4 = 1 AND beat = 3 THEN list_append(events, 'ghost') ELSE events END AS events,
        CASE WHEN project_id % 4 = 2 AND beat = 1 THEN list_append(claims, 'ghost_c') ELSE claims END AS claims FROM seg),
    words AS (SELECT DISTINCT project_id, beat, unnest(regexp_extract_all(upper(concat(prefix, fact_text, CASE WHEN project_id % 3 = 0 THEN ' Zorblat' ELSE '' END)), '[\\p{L}\\p{N}\\p{M}_]+')) AS w FROM told_beats JOIN prefix USING (beat)),
    cited AS (SELECT DISTINCT p.project_id, p.beat, unnest(regexp_extract_all(upper(c.text), '[\\p{L}\\p{N}\\p{M}_]+')) AS w FROM placed p JOIN claims c ON c.project_id = p.project_id AND c.claim_id = p.claim_id)
    SELECT project_id, concat('segment_', cast(beat AS varchar)) AS segment_id, 'unsafe_event' AS code, 'ghost' AS detail FROM cut_ WHERE list_contains(events, 'ghost')
    UNION ALL SELECT project_id, concat('segment_', cast(beat AS varchar)), unnest(['foreign_claim', 'claims_used_mismatch']), unnest(['ghost_c', NULL]) FROM cut_ WHERE list_contains(claims, 'ghost_c')
    UNION ALL SELECT DISTINCT w.project_id, concat('segment_', cast(w.beat AS varchar)), 'leaked_name', w.w FROM words w JOIN names n ON n.project_id = w.project_id AND n.detail = w.w
      WHERE (w.project_id, w.beat, w.w) NOT IN (SELECT (project_id, beat, w) FROM cited)""",
)
def script_reference_issues(spark, d):
    w = _world(spark, d)
    p = F.col("project_id")
    safe = P.safe_events(w["ev"], w["claims"])
    segments = _scripts(w)["segments"].withColumns(
        {
            "text": F.when(p % 3 == 0, F.concat("text", F.lit(" Zorblat"))).otherwise(F.col("text")),
            "source_event_ids": F.when((p % 4 == 1) & (F.col("pos") == 3), F.array_append("source_event_ids", F.lit("ghost"))).otherwise(F.col("source_event_ids")),
            "source_claim_ids": F.when((p % 4 == 2) & (F.col("pos") == 1), F.array_append("source_claim_ids", F.lit("ghost_c"))).otherwise(F.col("source_claim_ids")),
        }
    )
    return P.script_issues(segments, safe, w["claims"])


def _stored_scripts(w):
    p = F.col("project_id")
    scripts = w["stories"].select(
        "project_id", F.lit("natural").alias("style"), F.when(p % 4 == 1, "old").otherwise("fp").alias("source_story_fingerprint"),
        F.lit(7).alias("source_story_approved_at"), F.lit(True).alias("approved"), F.lit(None).cast("string").alias("approval_fingerprint"),
    )
    reviews = w["stories"].select(
        "project_id", (p % 5 != 2).alias("story_approved"), F.lit("fp").alias("final_story_fingerprint"), F.when(p % 6 == 3, 8).otherwise(7).alias("approved_at")
    )
    return scripts, reviews


@query(
    "script_states_and_handoff",
    SCRIPT + """ SELECT st.project_id, CASE WHEN bad THEN 'stale' WHEN st.project_id % 2 = 0 THEN 'approved' WHEN st.project_id % 3 = 0 THEN 'edited' ELSE 'generated' END AS status, bad AS stale,
      NOT bad AND st.project_id % 2 = 0 AS script_approved, bad OR st.project_id % 2 = 1 AS approval_invalidated, CASE WHEN NOT bad AND st.project_id % 2 = 0 THEN coalesce(n, 0) ELSE 0 END AS handed_over
    FROM (SELECT project_id, project_id % 5 = 2 OR project_id % 4 = 1 OR project_id % 6 = 3 AS bad FROM st) st
    LEFT JOIN (SELECT project_id, count(*) AS n FROM told_beats GROUP BY 1) USING (project_id)""",
)
def script_states_and_handoff(spark, d):
    w = _world(spark, d)
    segments = _scripts(w)["segments"]
    scripts, reviews = _stored_scripts(w)
    edits = segments.where("project_id % 3 = 0 AND pos = 2").select("project_id", "segment_id", F.lit("by hand").alias("text"))
    final = P.with_edits(segments, edits)
    prints = P.script_fingerprints(scripts, final).withColumnRenamed("script_fingerprint", "_f")
    # Even projects were approved with their current content, odd ones with something else.
    stored = scripts.join(prints, "project_id").withColumn(
        "approval_fingerprint", F.when(F.col("project_id") % 2 == 0, F.col("_f")).otherwise(F.lit("other"))
    ).drop("_f")
    states = P.script_states(stored, segments, edits, reviews)
    handed = P.handoff(states, final).groupBy("project_id").agg(F.count(F.lit(1)).alias("handed_over"))
    joined = states.join(handed, "project_id", "left").fillna(0, subset=["handed_over"])
    return joined.select("project_id", "status", "stale", "script_approved", "approval_invalidated", "handed_over")


@query(
    "segment_edit_requests",
    SCRIPT + """, q AS (SELECT project_id, beat AS seq, CASE WHEN beat = 4 THEN 'segment_9' ELSE concat('segment_', cast(beat AS varchar)) END AS segment_id,
        CASE beat WHEN 3 THEN ' ' WHEN 5 THEN repeat('y', 4001) ELSE 'fine' END AS text FROM told_beats)
    SELECT project_id, seq, CASE WHEN project_id % 5 = 2 OR project_id % 4 = 1 OR project_id % 6 = 3 THEN 'older_story' WHEN segment_id = 'segment_9' THEN 'segment_not_found'
      WHEN trim(text) = '' THEN 'empty_text' WHEN length(text) > 4000 THEN 'text_too_long' END AS reject FROM q""",
)
def segment_edit_requests(spark, d):
    w = _world(spark, d)
    segments = _scripts(w)["segments"]
    scripts, reviews = _stored_scripts(w)
    none = segments.where(F.lit(False)).select("project_id", "segment_id", "text")
    states = P.script_states(scripts, segments, none, reviews)
    pos = F.col("pos")
    requests = segments.select(
        "project_id", pos.alias("seq"), F.when(pos == 4, "segment_9").otherwise(F.col("segment_id")).alias("segment_id"),
        F.when(pos == 3, " ").when(pos == 5, F.repeat(F.lit("y"), F.lit(4001))).otherwise("fine").alias("text"),
    )
    return P.judge_segment_edits(requests, segments, states).select("project_id", "seq", "reject")


@query(
    "script_approval_problems",
    SCRIPT + """ SELECT project_id, 'story_not_approved' AS problem FROM st WHERE project_id % 5 = 2 OR project_id % 4 = 1 OR project_id % 6 = 3
    UNION ALL SELECT st.project_id, CASE WHEN coalesce(n, 0) <> 5 THEN 'not_five_segments' WHEN st.project_id % 7 = 3 THEN 'invalid_source_events' END FROM st
      LEFT JOIN (SELECT project_id, count(*) AS n FROM told_beats GROUP BY 1) USING (project_id) WHERE coalesce(n, 0) <> 5 OR st.project_id % 7 = 3""",
)
def script_approval_problems(spark, d):
    w = _world(spark, d)
    segments = _scripts(w)["segments"]
    scripts, reviews = _stored_scripts(w)
    none = segments.where(F.lit(False)).select("project_id", "segment_id", "text")
    states = P.script_states(scripts, segments, none, reviews)
    usable = P.safe_events(w["ev"], w["claims"]).where("project_id % 7 <> 3")
    return P.approval_problems(states, P.with_edits(segments, none), usable, reviews)
