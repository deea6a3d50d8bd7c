"""Five-beat scripts from usable events, their checks, edits and hand-off.

Tables: events(project_id, event_id, event_ord, story_role, script_ready,
unsupported_claims), claims(project_id, event_id, claim_ord, claim_id, text),
progression(project_id, pos, event_id), segments(project_id, pos, segment_id,
type, text, source_event_ids, source_claim_ids, factual_claims_used).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetrace.functions import text as T
from pagetrace.functions.hashing import canonical_json
from pagetrace.operators.numbering import number_rows

EVENT = ["project_id", "event_id"]
SEGMENT = ["project_id", "segment_id"]
BEAT = ["project_id", "beat"]
#: Units of a beat that one task joins into a piece of its text.
PIECE = 1024

# Fixed values -------------------------------------------------------------
SEGMENT_TYPES = ["hook", "setup", "development", "payoff", "ending"]
STYLES = ["natural", "funny", "emotional", "dramatic"]
MAX_SEGMENT_TEXT = 4000
LANGUAGE = "vi"
STYLE_PREFIXES = [
    ("natural", "hook", "natural_hook", "Mở đầu câu chuyện, "),
    ("natural", "setup", "natural_setup", "Trong hoàn cảnh đó, "),
    ("natural", "development", "natural_development", "Sau đó, "),
    ("natural", "payoff", "natural_payoff", "Điểm quan trọng là, "),
    ("natural", "ending", "natural_ending", "Cuối cùng, "),
    ("funny", "hook", "funny_hook", "Nói vui một chút: "),
    ("funny", "setup", "funny_setup", "Trước hết: "),
    ("funny", "development", "funny_development", "Rồi câu chuyện tiếp tục: "),
    ("funny", "payoff", "funny_payoff", "Điểm đáng chú ý là: "),
    ("funny", "ending", "funny_ending", "Chốt lại: "),
    ("emotional", "hook", "emotional_hook", "Chậm lại một nhịp: "),
    ("emotional", "setup", "emotional_setup", "Từ bối cảnh ấy: "),
    ("emotional", "development", "emotional_development", "Tiếp theo: "),
    ("emotional", "payoff", "emotional_payoff", "Điểm đọng lại là: "),
    ("emotional", "ending", "emotional_ending", "Khép lại: "),
    ("dramatic", "hook", "dramatic_hook", "Mở đầu: "),
    ("dramatic", "setup", "dramatic_setup", "Bối cảnh: "),
    ("dramatic", "development", "dramatic_development", "Rồi: "),
    ("dramatic", "payoff", "dramatic_payoff", "Điểm nhấn: "),
    ("dramatic", "ending", "dramatic_ending", "Kết lại: "),
]
FALLBACK_PREFIXES = [
    ("hook", "Mở đầu, "),
    ("setup", "Về bối cảnh, "),
    ("development", "Tiếp đó, "),
    ("payoff", "Điểm chính là: "),
    ("ending", "Tóm lại, "),
]
# --------------------------------------------------------------------------


def safe_events(events: DataFrame, claims: DataFrame) -> DataFrame:
    """Events a script may use: ready, with claims, none of them unsupported."""
    told = claims.select(*EVENT).distinct()
    ready = F.coalesce("script_ready", F.lit(False)) & (F.coalesce("unsupported_claims", F.lit(0)) == 0)
    return events.where(ready).join(told, EVENT, "left_semi")


def script_problems(projects: DataFrame, safe: DataFrame) -> DataFrame:
    """Projects that cannot have a script, with the reason."""
    counts = safe.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("_n"), F.bool_or(F.col("story_role") == "main_story").alias("_main")
    )
    joined = projects.select("project_id").join(counts, "project_id", "left")
    problem = F.when(F.col("_n").isNull(), "no_script_ready_events").when(~F.col("_main"), "no_main_story_events")
    return joined.select("project_id", problem.alias("problem")).where("problem IS NOT NULL")


def beat_units(safe: DataFrame, claims: DataFrame, progression: DataFrame) -> DataFrame:
    """(project_id, beat, unit, event_id, claim_id, fact_text): which claim is told where.

    Main claims follow the progression, then the remaining main events; the nth
    goes to beat min(n, 5). Beats left empty repeat the last claim, and the first
    context claim closes beat 2. Projects without a main claim yield nothing.
    """
    listed = progression.groupBy(*EVENT).agg(F.min("pos").alias("_pos"))
    ordered = safe.select(*EVENT, "event_ord", F.coalesce("story_role", F.lit("main_story")).alias("_role")).join(listed, EVENT, "left")
    # A listed event is told in its listed place whatever its role.
    main = ordered.where(F.col("_pos").isNotNull() | (F.col("_role") == "main_story"))
    fact = claims.where(T.non_blank(F.col("text")).isNotNull() & F.col("claim_id").isNotNull()).select(
        *EVENT, "claim_ord", "claim_id", T.without_quotes(F.col("text")).alias("fact_text")
    )
    units = main.join(fact, EVENT).select(
        "project_id", "event_id", "claim_id", "fact_text",
        F.col("_pos").isNull().cast("int").alias("_late"),
        F.coalesce("_pos", "event_ord").cast("long").alias("_rank"),
        "claim_ord",
    )
    numbered = number_rows(
        units, ["project_id"], [F.col("_late"), F.col("_rank"), F.col("event_id"), F.col("claim_ord")],
        into="n",
    ).select("project_id", "n", "event_id", "claim_id", "fact_text")
    placed = numbered.select("project_id", F.least("n", F.lit(5)).cast("int").alias("beat"), F.col("n").alias("unit"), "event_id", "claim_id", "fact_text")
    last = numbered.groupBy("project_id").agg(F.max_by(F.struct("n", "event_id", "claim_id", "fact_text"), "n").alias("_l"))
    fill = last.where("_l.n < 5").select(
        "project_id", F.explode(F.sequence((F.col("_l.n") + 1).cast("int"), F.lit(5))).alias("beat"),
        F.col("_l.n").alias("unit"), "_l.event_id", "_l.claim_id", "_l.fact_text",
    )
    context = ordered.where("_role = 'supporting_context'").join(fact, EVENT)
    extra = context.groupBy("project_id").agg(
        F.min_by(F.struct("event_id", "claim_id", "fact_text"), F.struct("event_ord", "claim_ord")).alias("_c")
    ).join(last.select("project_id"), "project_id", "left_semi")
    # Beat 2 holds one claim of its own, whose unit is at most 2.
    added = extra.select(
        "project_id", F.lit(2).alias("beat"), F.lit(3).cast("long").alias("unit"), "_c.event_id", "_c.claim_id", "_c.fact_text"
    )
    return placed.unionByName(fill).unionByName(added)


def _role() -> Column:
    return F.get(F.array(*[F.lit(t) for t in SEGMENT_TYPES]), F.col("beat") - 1)


def beat_names(units: DataFrame) -> DataFrame:
    """(project_id, beat, beat_id, role) of every beat that is told."""
    return units.select(*BEAT).distinct().select(*BEAT, F.concat(F.lit("beat_"), "beat").alias("beat_id"), _role().alias("role"))


def _told_ids(units: DataFrame, name: str, into: str) -> DataFrame:
    """Distinct ids of every beat in the order in which they are first told."""
    firsts = units.groupBy(*BEAT, name).agg(F.min("unit").alias("unit"))
    ordered = F.array_sort(F.collect_list(F.struct("unit", name)))
    return firsts.groupBy(*BEAT).agg(F.transform(ordered, lambda u: u[name]).alias(into))


def beats(units: DataFrame) -> DataFrame:
    """One row per beat, as a writer needs it: its text and its lists of distinct ids.

    Claims are sorted and joined in pieces of ``PIECE`` units, and repeats of an id leave by
    grouping, so a task sees a whole beat only as pieces of its text. What needs no
    text (``beat_totals``) works on the flat units.
    """
    piece = units.groupBy(*BEAT, F.floor(F.col("unit") / PIECE).alias("_piece")).agg(
        F.array_sort(F.collect_list(F.struct("unit", "fact_text"))).alias("_u")
    )
    piece = piece.select(*BEAT, "_piece", F.array_join(F.transform("_u", lambda u: u["fact_text"]), " ").alias("_text"))
    texts = piece.groupBy(*BEAT).agg(F.array_sort(F.collect_list(F.struct("_piece", "_text"))).alias("_p"))
    joined = texts.join(_told_ids(units, "event_id", "source_event_ids"), BEAT).join(_told_ids(units, "claim_id", "claim_ids"), BEAT)
    return joined.select(
        *BEAT,
        F.concat(F.lit("beat_"), "beat").alias("beat_id"),
        _role().alias("role"),
        "source_event_ids",
        "claim_ids",
        F.array_join(F.transform("_p", lambda p: p["_text"]), " ").alias("fact_text"),
    )


def beat_totals(units: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """``script_totals`` of the segments that ``render`` makes, from flat units alone.

    Prefix and facts meet at white space, so words add up; no text is joined.
    """
    fallback = F.broadcast(units.sparkSession.createDataFrame(FALLBACK_PREFIXES, "role string, _fallback string"))
    words = units.groupBy(*BEAT).agg(F.sum(T.word_count(F.col("fact_text"))).alias("_words")).withColumn("role", _role())
    words = words.join(fallback, "role")
    if chosen is not None:
        words = words.join(chosen, BEAT, "left")
    else:
        words = words.withColumn("prefix", F.lit(None).cast("string"))
    counted = words.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("segment_count"),
        F.sum(F.col("_words") + T.word_count(F.coalesce("prefix", "_fallback"))).cast("long").alias("word_count"),
    )
    events = units.select(*EVENT).distinct().groupBy("project_id").agg(F.count("event_id").alias("source_event_count"))
    joined = counted.join(events, "project_id", "left").fillna(0)
    return joined.withColumn("estimated_duration_seconds", T.narration_seconds(F.col("word_count")))


def checked_selections(beat_rows: DataFrame, selections: DataFrame, styles: DataFrame) -> DataFrame:
    """Chosen prefixes of the projects whose selections fit their beats place by place.

    selections(project_id, pos, beat_id, style_phrase_id); styles(project_id,
    style). Any missing, reordered or foreign entry rejects the project's choice.
    """
    spark = beat_rows.sparkSession
    table = F.broadcast(spark.createDataFrame(STYLE_PREFIXES, "style string, role string, style_phrase_id string, prefix string"))
    expected = beat_rows.select("project_id", F.col("beat").alias("pos"), "beat_id", "role").join(styles, "project_id")
    given = selections.select("project_id", "pos", F.col("beat_id").alias("_beat"), "style_phrase_id")
    joined = expected.join(given, ["project_id", "pos"], "full_outer").join(
        table, ["style", "role", "style_phrase_id"], "left"
    )
    fits = F.col("beat_id").eqNullSafe(F.col("_beat")) & F.col("prefix").isNotNull()
    sound = joined.groupBy("project_id").agg(F.bool_and(fits).alias("_ok")).where("_ok")
    return joined.join(sound.select("project_id"), "project_id", "left_semi").select("project_id", F.col("pos").alias("beat"), "prefix")


def render(beat_rows: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """Segments from beats: the chosen prefix where a project has one, else the fallback."""
    spark = beat_rows.sparkSession
    fallback = F.broadcast(spark.createDataFrame(FALLBACK_PREFIXES, "role string, _fallback string"))
    joined = beat_rows.join(fallback, "role")
    if chosen is not None:
        joined = joined.join(chosen, ["project_id", "beat"], "left")
    else:
        joined = joined.withColumn("prefix", F.lit(None).cast("string"))
    return joined.select(
        "project_id",
        F.col("beat").alias("pos"),
        F.concat(F.lit("segment_"), "beat").alias("segment_id"),
        F.col("role").alias("type"),
        F.concat(F.coalesce("prefix", "_fallback"), "fact_text").alias("text"),
        "source_event_ids",
        F.col("claim_ids").alias("source_claim_ids"),
        F.col("claim_ids").alias("factual_claims_used"),
        F.when(F.col("prefix").isNotNull(), "bounded_model_style").otherwise("deterministic_fallback").alias("renderer_mode"),
    )


def script_issues(segments: DataFrame, safe: DataFrame, claims: DataFrame) -> DataFrame:
    """(project_id, segment_id, code, detail): everything that makes a script unusable."""
    none = F.lit(None).cast("string")
    types = F.array(*[F.lit(t) for t in SEGMENT_TYPES])

    def blank_in(name: str) -> Column:
        return F.exists(name, lambda x: T.non_blank(x).isNull())

    def repeated_in(name: str) -> Column:
        trimmed = F.transform(name, T.strip)
        return F.size(F.array_distinct(trimmed)) < F.size(trimmed)

    def missing(name: str) -> Column:
        return F.coalesce(F.size(name) < 1, F.lit(True)) | F.coalesce(blank_in(name), F.lit(False))

    same = (F.size(F.array_except("factual_claims_used", "source_claim_ids")) == 0) & (
        F.size(F.array_except("source_claim_ids", "factual_claims_used")) == 0
    )
    tests = {
        "wrong_segment_type": ~F.lower(T.strip(F.col("type"))).eqNullSafe(F.get(types, F.col("pos") - 1)),
        "missing_text": T.non_blank(F.col("text")).isNull(),
        "missing_events": missing("source_event_ids"),
        "repeated_events": repeated_in("source_event_ids"),
        "missing_claims": missing("source_claim_ids"),
        "repeated_claims": repeated_in("source_claim_ids"),
        "claims_used_mismatch": ~F.coalesce(same, F.lit(False)),
    }
    found = F.array_compact(F.array(*[F.when(test, F.lit(code)) for code, test in tests.items()]))
    own = segments.select(*SEGMENT, F.explode(found).alias("code"), none.alias("detail"))
    per_project = segments.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("_n"), F.count_distinct("segment_id").alias("_ids")
    )
    shape = F.array_compact(
        F.array(
            F.when(F.col("_n") != len(SEGMENT_TYPES), F.lit("not_five_segments")),
            F.when(F.col("_ids") < F.col("_n"), F.lit("repeated_segment_id")),
        )
    )
    whole = per_project.select("project_id", none.alias("segment_id"), F.explode(shape).alias("code"), none.alias("detail"))

    usable = safe.select(*EVENT)
    cited_events = segments.select(*SEGMENT, F.explode("source_event_ids").alias("event_id"))
    unsafe = cited_events.join(usable, EVENT, "left_anti").select(
        *SEGMENT, F.lit("unsafe_event").alias("code"), F.col("event_id").alias("detail")
    )
    told = claims.join(usable, EVENT, "left_semi")
    allowed = cited_events.join(told.select(*EVENT, "claim_id"), EVENT).select(*SEGMENT, "claim_id").distinct()
    cited_claims = segments.select(*SEGMENT, F.explode("source_claim_ids").alias("claim_id"))
    foreign = cited_claims.join(allowed, [*SEGMENT, "claim_id"], "left_anti").select(
        *SEGMENT, F.lit("foreign_claim").alias("code"), F.col("claim_id").alias("detail")
    )
    leaked = _leaked_names(segments, told, cited_claims)
    return own.unionByName(whole).unionByName(unsafe).unionByName(foreign).unionByName(leaked)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.upper(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0))


def _leaked_names(segments: DataFrame, told: DataFrame, cited_claims: DataFrame) -> DataFrame:
    """Names of the project's claims that a segment says without citing a claim that has them."""
    names = told.select("project_id", F.explode(T.capitalized_names(F.col("text"))).alias("detail")).distinct()
    said = segments.select(*SEGMENT, F.explode(F.array_distinct(_words(F.col("text")))).alias("detail"))
    cited = cited_claims.join(told.select("project_id", "claim_id", "text"), ["project_id", "claim_id"]).select(
        *SEGMENT, F.explode(F.array_distinct(_words(F.col("text")))).alias("detail")
    ).distinct()
    loose = said.join(cited, [*SEGMENT, "detail"], "left_anti")
    return loose.join(names, ["project_id", "detail"], "left_semi").select(
        *SEGMENT, F.lit("leaked_name").alias("code"), "detail"
    )


def script_totals(segments: DataFrame) -> DataFrame:
    """Words, narration seconds at 150 words a minute, segments and cited events per project."""
    counted = segments.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("segment_count"), F.sum(T.word_count(F.col("text"))).cast("long").alias("word_count")
    )
    events = segments.select("project_id", F.explode("source_event_ids").alias("_e")).groupBy("project_id").agg(
        F.count_distinct("_e").alias("source_event_count")
    )
    joined = counted.join(events, "project_id", "left").fillna(0)
    return joined.withColumn("estimated_duration_seconds", T.narration_seconds(F.col("word_count")))


def with_edits(segments: DataFrame, edits: DataFrame) -> DataFrame:
    """Segments with human texts in place; the generated text is kept beside them."""
    joined = segments.join(edits.select(*SEGMENT, F.col("text").alias("_edit")), SEGMENT, "left")
    edited = F.col("_edit").isNotNull()
    return joined.withColumns(
        {
            "generated_text": F.when(edited, F.col("text")),
            "text": F.coalesce("_edit", "text"),
            "provenance": F.when(edited, "human_edited").otherwise("ai_generated"),
        }
    ).drop("_edit")


def script_fingerprints(scripts: DataFrame, segments: DataFrame) -> DataFrame:
    """(project_id, script_fingerprint) over style, source story and the five segments."""
    fields = ["segment_id", "type", "text", "source_event_ids", "source_claim_ids"]
    row = F.struct("pos", F.sha2(canonical_json(**{f: F.col(f) for f in fields}), 256).alias("h"))
    body = segments.groupBy("project_id").agg(F.array_sort(F.collect_list(row)).alias("_s"))
    joined = scripts.select("project_id", "style", "source_story_fingerprint").join(body, "project_id", "left")
    hashes = F.array_join(F.transform("_s", lambda s: s["h"]), ",")
    whole = canonical_json(
        style=F.col("style"), source_story_fingerprint=F.col("source_story_fingerprint"), segments=F.coalesce(hashes, F.lit(""))
    )
    return joined.select("project_id", F.sha2(whole, 256).alias("script_fingerprint"))


def script_states(
    scripts: DataFrame, segments: DataFrame, edits: DataFrame, reviews: DataFrame
) -> DataFrame:
    """Status, counts and approval of stored scripts against the current story review.

    scripts(project_id, style, source_story_fingerprint, source_story_approved_at,
    approved, approval_fingerprint), reviews(project_id, story_approved,
    final_story_fingerprint, approved_at).
    """
    final = with_edits(segments, edits)
    prints = script_fingerprints(scripts, final)
    totals = script_totals(final).select("project_id", "word_count", "estimated_duration_seconds")
    edited = edits.select("project_id").distinct().withColumn("_edited", F.lit(True))
    joined = (
        scripts.join(reviews.select("project_id", "story_approved", "final_story_fingerprint", F.col("approved_at").alias("_story_at")), "project_id", "left")
        .join(prints, "project_id")
        .join(totals, "project_id", "left")
        .join(edited, "project_id", "left")
    )
    stale = (
        ~F.coalesce("story_approved", F.lit(False))
        | ~F.col("source_story_fingerprint").eqNullSafe(F.col("final_story_fingerprint"))
        | ~F.col("source_story_approved_at").eqNullSafe(F.col("_story_at"))
    )
    approved = ~stale & F.col("approved") & F.coalesce(F.col("approval_fingerprint") == F.col("script_fingerprint"), F.lit(False))
    return joined.select(
        "project_id",
        F.when(stale, "stale").when(approved, "approved").when(F.col("_edited"), "edited").otherwise("generated").alias("status"),
        stale.alias("stale"),
        "style",
        "source_story_fingerprint",
        "script_fingerprint",
        "word_count",
        "estimated_duration_seconds",
        approved.alias("script_approved"),
        (F.col("approved") & ~approved).alias("approval_invalidated"),
    )


def judge_segment_edits(requests: DataFrame, segments: DataFrame, states: DataFrame) -> DataFrame:
    """requests(project_id, seq, segment_id, text) with ``reject`` (NULL when taken)."""
    known = segments.select(*SEGMENT).distinct().withColumn("_known", F.lit(True))
    joined = requests.join(states.select("project_id", "stale"), "project_id", "left").join(known, SEGMENT, "left")
    value = T.strip(F.coalesce("text", F.lit("")))
    reject = (
        F.when(F.coalesce("stale", F.lit(True)), "older_story")
        .when(F.col("_known").isNull(), "segment_not_found")
        .when(value == "", "empty_text")
        .when(F.length(value) > MAX_SEGMENT_TEXT, "text_too_long")
    )
    return joined.select(*requests.columns, reject.alias("reject"))


def accepted_edits(judged: DataFrame) -> DataFrame:
    """Newest accepted text per segment."""
    return judged.where("reject IS NULL").groupBy(*SEGMENT).agg(F.max_by(T.strip(F.col("text")), "seq").alias("text"))


def approval_problems(states: DataFrame, final_segments: DataFrame, story_events: DataFrame, reviews: DataFrame) -> DataFrame:
    """Reasons a script cannot be approved; projects without a row can.

    ``story_events`` are the final story's usable events.
    """
    joined = states.join(reviews.select("project_id", "story_approved"), "project_id", "left")
    base = joined.where(F.col("stale") | ~F.coalesce("story_approved", F.lit(False))).select(
        "project_id", F.lit("story_not_approved").alias("problem")
    )
    types = F.array(*[F.lit(t) for t in SEGMENT_TYPES])
    incomplete = ~F.col("type").eqNullSafe(F.get(types, F.col("pos") - 1)) | T.non_blank(F.col("text")).isNull()
    counts = final_segments.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("_n"), F.bool_or(incomplete).alias("_gap"),
        F.bool_or(F.coalesce(F.size("source_event_ids") < 1, F.lit(True))).alias("_bare"),
    )
    cited = final_segments.select("project_id", F.explode("source_event_ids").alias("event_id")).distinct()
    unknown = cited.join(story_events.select(*EVENT), EVENT, "left_anti").select("project_id").distinct().withColumn("_unknown", F.lit(True))
    shape = states.select("project_id").join(counts, "project_id", "left").join(unknown, "project_id", "left").select(
        "project_id",
        F.when(F.coalesce("_n", F.lit(0)) != len(SEGMENT_TYPES), "not_five_segments")
        .when(F.col("_gap"), "segments_incomplete")
        .when(F.col("_bare") | F.col("_unknown"), "invalid_source_events")
        .alias("problem"),
    ).where("problem IS NOT NULL")
    return base.unionByName(shape)


def handoff(states: DataFrame, final_segments: DataFrame) -> DataFrame:
    """Narration records of approved scripts: one row per segment with the script's header."""
    header = states.where("script_approved").select(
        "project_id", F.lit(LANGUAGE).alias("language"), "style", F.lit("approved").alias("status"),
        "script_fingerprint", "source_story_fingerprint", "word_count", "estimated_duration_seconds",
    )
    rows = final_segments.select("project_id", "pos", "segment_id", "type", "text", "source_event_ids", "source_claim_ids")
    return header.join(rows, "project_id")
