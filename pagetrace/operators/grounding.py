"""Claims, characters and progressions checked against the evidence they cite.

Tables: pages(project_id, asset_id, page_order), evidence(project_id, asset_id,
page_order, region_id, evidence_text, text_role), events(project_id, event_ord,
event_id, summary, importance, emotion, story_role), claims(project_id, event_id,
claim_ord, claim_id, text, claim_type, subject), claim_sources(project_id,
event_id, claim_id, source_ord, asset_id, page_order, region_ids), characters
(project_id, char_ord, character_id, name), character_sources, progression
(project_id, pos, event_id). Ids are unique per project (claims per event), as
``structure_issues`` checks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetrace.functions import text as T
from pagetrace.session import cut

EVENT = ["project_id", "event_id"]
CLAIM = [*EVENT, "claim_id"]
CHARACTER = ["project_id", "character_id"]

# Fixed values -------------------------------------------------------------
CLAIM_TYPES = ["fact", "speaker_attribution", "actor_attribution", "causal_relation"]
STORY_ROLES = ["main_story", "supporting_context"]
NO_SOURCE = "No valid source references."
NO_SUBJECT = "Source evidence does not identify the attributed subject."
NO_CAUSE = "Source evidence does not explicitly state a causal relation."
FOREIGN_NAME = "Named entity attribution is not present in the sources."
IMPLIED_CAUSE = "Claim implies causality not stated by the sources."
UI_SOURCE = "Game UI evidence requires review before script use."
# --------------------------------------------------------------------------


def validate_sources(
    owners: DataFrame, sources: DataFrame, pages: DataFrame, evidence: DataFrame, key: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """(valid source regions, issues) of the entities in ``owners`` by ``key``.

    A source is dropped whole for a bad shape, an unknown page, a wrong page order
    or any unknown region; a repeat of an earlier valid source is dropped too, a
    region repeated inside a source only reported. Valid rows are one per region:
    key, source_ord, asset_id, page_order, region_id.
    """
    key = list(key)
    ids = F.col("region_ids")
    positive = F.coalesce(F.forall(ids, lambda r: F.coalesce(r > 0, F.lit(False))), F.lit(False))
    shaped = (
        T.non_blank(F.col("asset_id").cast("string")).isNotNull()
        & F.coalesce(F.col("page_order") > 0, F.lit(False))
        & F.coalesce(F.size(ids) > 0, F.lit(False))
        & positive
    )
    known = pages.select("project_id", "asset_id", F.col("page_order").alias("_expected"))
    located = sources.withColumn("_shaped", shaped).join(known, ["project_id", "asset_id"], "left")
    code = (
        F.when(~F.col("_shaped"), "invalid_source_shape")
        .when(F.col("_expected").isNull(), "invalid_asset_reference")
        .when(F.col("page_order") != F.col("_expected"), "wrong_page_order")
    )
    located = located.withColumn("_code", code)
    fine = located.where("_code IS NULL").withColumn("_unique", F.array_sort(F.array_distinct(ids)))
    regions = evidence.select("project_id", "asset_id", "region_id").withColumn("_hit", F.lit(True))
    exploded = fine.select(*key, "source_ord", "asset_id", "page_order", "_unique", F.explode("_unique").alias("region_id"))
    checked = exploded.join(regions, ["project_id", "asset_id", "region_id"], "left")
    judged = checked.groupBy(*key, "source_ord").agg(
        F.bool_and(F.col("_hit").isNotNull()).alias("_ok"),
        F.first("asset_id").alias("asset_id"),
        F.first("page_order").alias("page_order"),
        F.first("_unique").alias("_unique"),
    )
    sound = judged.where("_ok")
    signature = ["asset_id", "page_order", "_unique"]
    kept = sound.groupBy(*key, *signature).agg(
        F.min("source_ord").alias("source_ord"), F.count(F.lit(1)).alias("_n")
    )
    valid = kept.select(*key, "source_ord", "asset_id", "page_order", F.explode("_unique").alias("region_id"))

    none = F.lit(None).cast("long")
    def issue(rows: DataFrame, name: Column, region: Column = none) -> DataFrame:
        return rows.select(*key, name.alias("code"), F.col("asset_id"), region.alias("region_id"))

    repeats = kept.where("_n > 1").withColumn("_again", F.explode(F.sequence(F.lit(2), F.col("_n").cast("int"))))
    sourceless = owners.join(sources.select(*key).distinct(), key, "left_anti").withColumn(
        "asset_id", F.lit(None).cast(sources.schema["asset_id"].dataType)
    )
    issues = (
        issue(located.where("_code IS NOT NULL"), F.col("_code"))
        .unionByName(issue(fine.where(F.size("_unique") < F.size("region_ids")), F.lit("duplicate_region_reference")))
        .unionByName(
            issue(checked.where("_hit IS NULL"), F.lit("invalid_region_reference"), F.col("region_id").cast("long"))
        )
        .unionByName(issue(repeats, F.lit("duplicate_source_reference")))
        .unionByName(issue(sourceless, F.lit("missing_source_references")))
    )
    return valid, issues


def source_index_problems(pages: DataFrame, evidence: DataFrame) -> DataFrame:
    """Rows that make an index unusable: repeated pages or repeated regions of a page."""
    page = pages.groupBy("project_id", "asset_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    region = evidence.groupBy("project_id", "asset_id", "region_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    none = F.lit(None).cast("long").alias("region_id")
    return page.select("project_id", "asset_id", none, F.lit("duplicate_asset").alias("problem")).unionByName(
        region.select("project_id", "asset_id", F.col("region_id").cast("long").alias("region_id"), F.lit("duplicate_region").alias("problem"))
    )


def repeated_tokens(evidence: DataFrame) -> DataFrame:
    """(project_id, token) for salient tokens found in at least two regions."""
    spread = evidence.select("project_id", F.explode(T.salient_tokens(F.col("evidence_text"))).alias("token"))
    return spread.groupBy("project_id", "token").agg(F.count(F.lit(1)).alias("regions")).where("regions >= 2")


def known_names(characters: DataFrame, evidence: DataFrame) -> DataFrame:
    """Names that may be removed from a claim: characters first, then one-word regions.

    (project_id, name, normalized, anchor), one spelling per normalised name: the
    first character's, else the first region's.
    """
    people = characters.select(
        "project_id", T.strip(F.col("name")).alias("name"), F.lit(0).alias("_kind"),
        F.col("char_ord").cast("long").alias("_a"), F.lit("").alias("_b"), F.lit(0).cast("long").alias("_c"),
    )
    lone = evidence.where(T.name_only(F.col("evidence_text"))).select(
        "project_id", T.strip(F.col("evidence_text")).alias("name"), F.lit(1).alias("_kind"),
        F.col("page_order").cast("long").alias("_a"), F.col("asset_id").cast("string").alias("_b"), F.col("ord").cast("long").alias("_c"),
    )
    names = people.unionByName(lone).withColumn("normalized", T.normalize_name(F.col("name")))
    return (
        names.where("normalized <> ''")
        .groupBy("project_id", "normalized")
        .agg(F.min_by("name", F.struct("_kind", "_a", "_b", "_c")).alias("name"))
        .withColumn("anchor", T.name_anchor(F.col("normalized")))
    )


def cited_evidence(valid: DataFrame, evidence: DataFrame, key: Sequence[str]) -> DataFrame:
    """Per entity: normalised texts and roles of its cited regions, in source order."""
    joined = valid.join(
        evidence.select("project_id", "asset_id", "region_id", "text_role", T.normalize_name(F.col("evidence_text")).alias("_n")),
        ["project_id", "asset_id", "region_id"],
    )
    # An entity's own citations: as many rows as the model listed for it.
    row = F.struct("source_ord", "region_id", F.col("_n").alias("text"), F.col("text_role").alias("role"))
    grouped = joined.groupBy(*key).agg(F.array_sort(F.collect_list(row)).alias("_cited"))
    return grouped.select(
        *key,
        F.transform("_cited", lambda c: c["text"]).alias("source_texts"),
        F.exists("_cited", lambda c: c["role"] == "game_ui").alias("cites_ui"),
    )


def _foreign_names(claims: DataFrame, names: DataFrame) -> DataFrame:
    """(claim, name) where the claim's text holds a known name that no cited region holds."""
    # Anchors and names meet by ids; only what has met gets the texts.
    spread = claims.select(*CLAIM, F.explode(T.name_anchors(F.col("_norm"))).alias("anchor"))
    pairs = spread.join(names, ["project_id", "anchor"]).select(*CLAIM, "normalized", "name").distinct()
    met = pairs.join(claims.select(*CLAIM, "_norm", "source_texts"), CLAIM)
    named = met.where(T.contains_name(F.col("_norm"), F.col("normalized")))
    absent = ~F.exists("source_texts", lambda t: T.contains_name(t, F.col("normalized")))
    return named.where(F.coalesce(absent, F.lit(True))).select(*CLAIM, "normalized", "name")


def _foreign_tokens(claims: DataFrame, tokens: DataFrame) -> DataFrame:
    """Claims with a repeated project token that no cited region holds."""
    def runs(text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit("[A-Z0-9]+"), F.lit(0))

    own = F.filter(F.array_distinct(runs(F.col("_norm"))), lambda t: (F.length(t) >= 4) & ~t.rlike("^[0-9]+$"))
    cited = runs(F.array_join(F.coalesce("source_texts", F.array().cast("array<string>")), " "))
    missing = claims.select(*CLAIM, F.explode(F.array_except(own, cited)).alias("token"))
    return missing.join(tokens.select("project_id", "token"), ["project_id", "token"], "left_semi").select(*CLAIM).distinct()


def _failures(claims: DataFrame, names: DataFrame, tokens: DataFrame) -> DataFrame:
    """claims(.., text, claim_type, subject, source_texts, cites_ui) with ``reason``."""
    # Names, tokens and verdicts read the claims, so citations are joined and texts folded once.
    ready = cut(
        claims.withColumn("_norm", T.normalize_name(F.col("text"))).withColumn("_subject", T.normalize_name(F.col("subject")))
    )
    foreign = _foreign_names(ready, names).groupBy(*CLAIM).agg(
        F.count(F.lit(1)).alias("_foreign"), F.min("name").alias("foreign_name")
    )
    flagged = ready.join(foreign, CLAIM, "left").join(
        _foreign_tokens(ready, tokens).withColumn("_token", F.lit(True)), CLAIM, "left"
    )
    texts = F.coalesce("source_texts", F.array().cast("array<string>"))
    causal = T.states_causality(F.array_join(texts, " "))
    subject_found = (F.col("_subject") != "") & F.exists(texts, lambda t: T.contains_name(t, F.col("_subject")))
    kind = F.coalesce("claim_type", F.lit("fact"))
    reason = (
        F.when(F.size(texts) == 0, NO_SOURCE)
        .when(kind.isin("speaker_attribution", "actor_attribution") & ~subject_found, NO_SUBJECT)
        .when((kind == "causal_relation") & ~causal, NO_CAUSE)
        .when(F.col("_foreign").isNotNull() | F.col("_token").isNotNull(), FOREIGN_NAME)
        .when(T.states_causality(F.col("_norm")) & ~causal, IMPLIED_CAUSE)
        .when(F.coalesce("cites_ui", F.lit(False)), UI_SOURCE)
    )
    return flagged.withColumn("reason", reason).drop("_norm", "_subject", "_token")


def _deattributed(text: Column, name: Column) -> Column:
    """The text with the name's first mention replaced by "a character"."""
    literal = F.concat(F.lit(r"\Q"), F.replace(name, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    pattern = F.concat(F.lit(r"(?isuU)^(.*?)(?<!\w)"), literal, F.lit(r"(?:[’']s)?(?!\w)"))
    changed = T.strip(F.regexp_replace(text, pattern, F.lit("$1a character")))
    return F.when(
        changed.startswith("a character"), F.concat(F.lit("A"), F.substring(changed, F.lit(2), F.length(changed)))
    ).otherwise(changed)


def judge_claims(
    claims: DataFrame, valid: DataFrame, evidence: DataFrame, characters: DataFrame
) -> DataFrame:
    """Every claim with its verdict: ``reason`` NULL when grounded, ``code`` for the issue.

    A claim that fails only for one foreign name is repaired by taking the name out
    and judged again; ``original_text`` and ``removed_attribution`` record that.
    """
    names = cut(known_names(characters, evidence))
    tokens = cut(repeated_tokens(evidence))
    cited = cited_evidence(valid, evidence, CLAIM)
    ready = claims.join(cited, CLAIM, "left")
    first = cut(_failures(ready, names, tokens))
    candidate = (
        (F.col("reason") == FOREIGN_NAME)
        & (F.coalesce("claim_type", F.lit("fact")) != "causal_relation")
        & (F.col("_foreign") == 1)
    )
    repaired = _deattributed(F.col("text"), F.col("foreign_name"))
    attempted = first.withColumn("_repaired", F.when(candidate, repaired)).withColumn(
        "_try", F.coalesce(F.col("_repaired") != T.strip(F.col("text")), F.lit(False))
    )
    again = attempted.where("_try").select(
        *CLAIM, F.col("_repaired").alias("text"), F.lit("fact").alias("claim_type"),
        F.lit(None).cast("string").alias("subject"), "source_texts", "cites_ui",
    )
    second = _failures(again, names, tokens).select(*CLAIM, F.col("reason").alias("_second"))
    joined = attempted.join(second, CLAIM, "left")
    final = F.when(F.col("_try"), F.col("_second")).otherwise(F.col("reason"))
    fixed = F.col("_try") & F.col("_second").isNull()
    judged = joined.withColumn("_final", final).withColumn("_fixed", fixed)
    kind = F.col("claim_type")
    code = (
        F.when(F.col("_final").isNull() & F.col("_fixed"), "claim_deattributed")
        .when(F.col("_final").isNull(), F.lit(None))
        .when(F.col("_final") == FOREIGN_NAME, "unsupported_named_attribution")
        .when(F.col("_final") == IMPLIED_CAUSE, "unsupported_causal_inference")
        .when(F.col("_final") == UI_SOURCE, "game_ui_claim_requires_review")
        .when(kind == "speaker_attribution", "unsupported_speaker_attribution")
        .when(kind == "actor_attribution", "unsupported_actor_attribution")
        .when(kind == "causal_relation", "unsupported_causal_inference")
        .otherwise("unsupported_claim")
    )
    return judged.select(
        *CLAIM, "claim_ord",
        F.when(F.col("_fixed"), F.col("_repaired")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("_fixed"), "fact").otherwise(F.coalesce("claim_type", F.lit("fact"))).alias("claim_type"),
        F.when(~F.col("_fixed"), F.col("subject")).alias("subject"),
        F.col("_final").alias("reason"),
        code.alias("code"),
        F.when(F.col("_fixed"), F.col("text")).alias("original_text"),
        F.when(F.col("_fixed"), F.col("foreign_name")).alias("removed_attribution"),
    )


def ground_events(events: DataFrame, judged: DataFrame) -> DataFrame:
    counts = judged.groupBy(*EVENT).agg(
        F.count_if(F.col("reason").isNull()).alias("grounded_claims"),
        F.count_if(F.col("reason").isNotNull()).alias("unsupported_claims"),
    )
    joined = events.join(counts, EVENT, "left")
    has_claims = F.col("grounded_claims").isNotNull()
    zero = F.lit(0).cast("long")
    return joined.withColumns(
        {
            "script_ready": has_claims & F.coalesce(F.col("unsupported_claims") == 0, F.lit(False)),
            "missing_claims": ~has_claims,
            "grounded_claims": F.coalesce("grounded_claims", zero),
            # An event without claims counts one unsupported entry.
            "unsupported_claims": F.coalesce("unsupported_claims", zero + 1),
        }
    )


def grounded_regions(valid: DataFrame, judged: DataFrame) -> DataFrame:
    """Regions cited by grounded claims: project, event, asset, page, region (distinct)."""
    good = judged.where("reason IS NULL").select(*CLAIM)
    cited = valid.join(good, CLAIM, "left_semi")
    return cited.select(*EVENT, "asset_id", "page_order", "region_id").distinct()


def merged_sources(valid: DataFrame, judged: DataFrame) -> DataFrame:
    """Union of an event's grounded sources per page, with the page's first appearance."""
    good = judged.where("reason IS NULL").select(*CLAIM, "claim_ord")
    cited = valid.join(good, CLAIM)
    return cited.groupBy(*EVENT, "asset_id", "page_order").agg(
        F.array_sort(F.collect_set("region_id")).alias("region_ids"),
        F.min(F.struct("claim_ord", "source_ord")).alias("first_seen"),
    )


def ground_characters(characters: DataFrame, valid: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(characters with verdicts, supporting sources): only sources that name them count."""
    texts = evidence.select("project_id", "asset_id", "region_id", T.normalize_name(F.col("evidence_text")).alias("_n"))
    named = characters.withColumn("_name", T.normalize_name(F.col("name")))
    cited = valid.join(texts, ["project_id", "asset_id", "region_id"]).join(
        named.select(*CHARACTER, "_name"), CHARACTER
    )
    per_source = cited.groupBy(*CHARACTER, "source_ord", "asset_id", "page_order").agg(
        F.bool_or(T.contains_name(F.col("_n"), F.col("_name"))).alias("_named")
    )
    supporting = per_source.where("_named").drop("_named")
    totals = per_source.groupBy(*CHARACTER).agg(F.count_if("_named").alias("_support"))
    joined = named.drop("_name").join(totals, CHARACTER, "left")
    reason = F.when(F.col("_support").isNull(), NO_SOURCE).when(
        F.col("_support") == 0, "No source contains character name evidence."
    )
    return joined.withColumn("reason", reason).drop("_support"), supporting


def check_progression(progression: DataFrame, events: DataFrame) -> DataFrame:
    """Each progression entry with the code that removes it (NULL when kept), order by pos."""
    named = progression.withColumn("_id", T.non_blank(F.col("event_id")))
    first = named.where("_id IS NOT NULL").groupBy("project_id", "_id").agg(F.min("pos").alias("_first"))
    known = events.select("project_id", F.col("event_id").alias("_id"), "script_ready", F.coalesce("story_role", F.lit("main_story")).alias("_role"))
    joined = named.join(first, ["project_id", "_id"], "left").join(known, ["project_id", "_id"], "left")
    code = (
        F.when(F.col("_id").isNull(), "invalid_progression_event_id")
        .when(F.col("pos") > F.col("_first"), "duplicate_progression_event")
        .when(F.col("script_ready").isNull(), "nonexistent_progression_event")
        .when(~F.col("script_ready"), "unsupported_progression_event")
        .when(F.col("_role") != "main_story", "contextual_progression_event")
    )
    return joined.select("project_id", "pos", F.coalesce("_id", "event_id").alias("event_id"), code.alias("code"))


def grounding_summary(projects: DataFrame, characters: DataFrame, events: DataFrame) -> DataFrame:
    people = characters.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("total_characters"),
        F.count_if(F.col("reason").isNull()).alias("grounded_characters"),
        F.count_if(F.col("reason").isNotNull()).alias("unsupported_characters"),
    )
    happenings = events.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count(F.lit(1)).alias("grounded_events"),
        F.count_if(F.col("grounded_claims") == 0).alias("unsupported_events"),
        F.count_if("script_ready").alias("script_ready_events"),
    )
    joined = projects.select("project_id").join(people, "project_id", "left").join(happenings, "project_id", "left")
    return joined.fillna(0)


def evidence_guard(evidence: DataFrame, events: DataFrame) -> DataFrame:
    """Projects with primary-role text whose analysis has no event."""
    primary = evidence.where(F.col("text_role").isin(T.PRIMARY_ROLES) & (F.coalesce("evidence_text", F.lit("")) != ""))
    return primary.select("project_id").distinct().join(events.select("project_id"), "project_id", "left_anti")


def structure_issues(
    characters: DataFrame, events: DataFrame, claims: DataFrame, claim_sources: DataFrame, character_sources: DataFrame
) -> DataFrame:
    """(project_id, entity_type, entity_id, code): everything that makes a result malformed.

    A project with any row here is rejected whole by ``well_formed_projects``.
    """
    def rows(df: DataFrame, kind: str, entity: str, tests: dict[str, Column]) -> DataFrame:
        found = F.array(*[F.when(test, F.lit(code)) for code, test in tests.items()])
        return df.select(
            "project_id", F.lit(kind).alias("entity_type"), F.col(entity).cast("string").alias("entity_id"),
            F.explode(F.array_compact(found)).alias("code"),
        )

    def blank(name: str) -> Column:
        return T.non_blank(F.col(name)).isNull()

    def repeated(df: DataFrame, kind: str, key: Sequence[str]) -> DataFrame:
        many = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
        return many.select(
            "project_id", F.lit(kind).alias("entity_type"), F.col(key[-1]).cast("string").alias("entity_id"),
            F.lit(f"duplicate_{kind}_id").alias("code"),
        )

    def sourceless(df: DataFrame, kind: str, sources: DataFrame, key: Sequence[str]) -> DataFrame:
        return df.join(sources.select(*key).distinct(), list(key), "left_anti").select(
            "project_id", F.lit(kind).alias("entity_type"), F.col(key[-1]).cast("string").alias("entity_id"),
            F.lit("missing_sources").alias("code"),
        )

    def bad_source(sources: DataFrame, kind: str, entity: str) -> DataFrame:
        positive = F.forall("region_ids", lambda r: F.coalesce(r > 0, F.lit(False)))
        return rows(
            sources, kind, entity,
            {
                "source_asset_id": T.non_blank(F.col("asset_id").cast("string")).isNull(),
                "source_page_order": ~F.coalesce(F.col("page_order") > 0, F.lit(False)),
                "source_region_ids": ~F.coalesce((F.size("region_ids") > 0) & positive, F.lit(False)),
            },
        )

    role_bad = ~F.coalesce(T.strip(F.col("story_role")).isin(STORY_ROLES), F.lit(False))
    type_bad = ~F.coalesce(T.strip(F.col("claim_type")).isin(CLAIM_TYPES), F.lit(False))
    claimless = events.join(claims.select(*EVENT).distinct(), EVENT, "left_anti").select(
        "project_id", F.lit("event").alias("entity_type"), F.col("event_id").cast("string").alias("entity_id"),
        F.lit("missing_claims").alias("code"),
    )
    parts = [
        rows(characters, "character", "character_id", {"missing_id": blank("character_id"), "missing_name": blank("name")}),
        repeated(characters, "character", CHARACTER),
        rows(
            events, "event", "event_id",
            {
                "missing_id": blank("event_id"), "missing_summary": blank("summary"), "missing_emotion": blank("emotion"),
                "invalid_story_role": role_bad,
                "invalid_importance": ~F.coalesce(F.col("importance").between(0.0, 1.0), F.lit(False)),
            },
        ),
        repeated(events, "event", EVENT),
        claimless,
        rows(
            claims, "claim", "claim_id",
            {"missing_id": blank("claim_id"), "missing_text": blank("text"), "invalid_claim_type": type_bad},
        ),
        repeated(claims, "claim", CLAIM),
        sourceless(claims, "claim", claim_sources, CLAIM),
        sourceless(characters, "character", character_sources, CHARACTER),
        bad_source(claim_sources, "claim", "claim_id"),
        bad_source(character_sources, "character", "character_id"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def well_formed_projects(projects: DataFrame, issues: DataFrame) -> DataFrame:
    return projects.select("project_id").join(issues.select("project_id"), "project_id", "left_anti")
