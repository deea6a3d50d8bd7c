"""A story world over the conversations: five conversations make a project.

Page = conversation, region = turn + 1. Every assistant turn is an event with a
claim of its own whole text, altered in known ways so that every verdict of the
grounding rules occurs. A seventh of the turns have their first word as a region of
its own beside them, for the rules about names. The texts below run on both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagetrace.sources.lenses import table

STORY = {
    "evidence": """
        SELECT cast(floor(conv_id / 5) AS bigint) AS project_id, conv_id AS asset_id, conv_id % 5 + 1 AS page_order,
          turn + 1 AS region_id, turn + 1 AS ord,
          CASE WHEN (conv_id + turn) % 9 = 8 THEN 'sfx' WHEN (conv_id + turn) % 9 = 7 THEN 'game_ui' WHEN role = 'user' THEN 'dialogue' WHEN role = 'assistant' THEN 'narration' ELSE 'game_ui' END AS text_role,
          CASE WHEN (conv_id + turn) % 7 = 3 THEN concat(text, ' dan den do') ELSE text END AS evidence_text
        FROM conversations
        UNION ALL
        SELECT cast(floor(conv_id / 5) AS bigint), conv_id, conv_id % 5 + 1, turn + 51, turn + 51,
          CASE WHEN role = 'user' THEN 'dialogue' WHEN role = 'assistant' THEN 'narration' ELSE 'game_ui' END,
          split_part(replace(text, chr(10), ' '), ' ', 1)
        FROM conversations WHERE (conv_id + turn) % 7 = 0""",
    "turns": """
        SELECT cast(floor(conv_id / 5) AS bigint) AS project_id, conv_id, turn, conv_id % 5 + 1 AS page_order,
          concat('e', cast(conv_id AS string), '_', cast(turn AS string)) AS event_id,
          text AS sentence, split_part(replace(text, chr(10), ' '), ' ', 1) AS lead, (conv_id + turn * 5) % 12 AS k
        FROM conversations WHERE role = 'assistant'""",
    "events": """
        SELECT project_id, conv_id * 100 + turn AS event_ord, event_id, sentence AS summary, cast(0.5 AS double) AS importance,
          'neutral' AS emotion, CASE WHEN turn % 4 = 3 THEN 'supporting_context' ELSE 'main_story' END AS story_role
        FROM turns""",
    "claims": """
        SELECT project_id, event_id, 1 AS claim_ord, concat(event_id, '_c1') AS claim_id,
          CASE k WHEN 1 THEN concat(sentence, ' because it was so') WHEN 2 THEN concat('Zorblat said ', sentence)
            WHEN 3 THEN concat('Zorblat met Quixana: ', sentence) WHEN 4 THEN concat('Zorblat''s word: ', sentence) ELSE sentence END AS text,
          CASE k WHEN 5 THEN 'speaker_attribution' WHEN 6 THEN 'actor_attribution' WHEN 7 THEN 'causal_relation' ELSE 'fact' END AS claim_type,
          CASE k WHEN 5 THEN lead WHEN 6 THEN 'Zorblat' END AS subject
        FROM turns
        UNION ALL
        SELECT project_id, event_id, 2, concat(event_id, '_c2'), lead, 'fact', NULL FROM turns WHERE k % 4 = 0""",
    "claim_sources": """
        SELECT project_id, event_id, concat(event_id, '_c1') AS claim_id, 1 AS source_ord, conv_id AS asset_id,
          CASE WHEN (conv_id + turn) % 13 = 1 THEN page_order + 1 ELSE page_order END AS page_order,
          CASE WHEN (conv_id + turn) % 13 = 2 THEN array[turn + 1, turn + 101] WHEN (conv_id + turn) % 13 = 3 THEN array[turn + 1, turn + 1]
            WHEN (conv_id + turn) % 13 = 4 THEN array[-1] ELSE array[turn, turn + 1] END AS region_ids
        FROM turns WHERE (conv_id + turn) % 13 <> 5
        UNION ALL
        SELECT project_id, event_id, concat(event_id, '_c1'), 2, CASE WHEN turn % 3 = 1 THEN conv_id ELSE conv_id + 1000000 END, page_order,
          array[turn + 1, turn] FROM turns WHERE (conv_id + turn) % 13 > 5 AND (conv_id + turn) % 3 = 0
        UNION ALL
        SELECT project_id, event_id, concat(event_id, '_c2'), 1, conv_id, page_order, array[turn + 1] FROM turns WHERE k % 4 = 0""",
    "characters": """
        SELECT project_id, cast(1 AS bigint) AS char_ord, 'zor' AS character_id, 'Zorblat' AS name FROM turns GROUP BY project_id
        UNION ALL SELECT project_id, 2, 'qui', ' Quixana ' FROM turns GROUP BY project_id
        UNION ALL SELECT project_id, 3 + conv_id, concat('c', cast(conv_id AS string)), max(lead) FROM turns WHERE turn = 1 GROUP BY project_id, conv_id""",
    "character_sources": """
        SELECT project_id, 'zor' AS character_id, 1 AS source_ord, min(conv_id) AS asset_id, min(page_order) AS page_order, array[cast(1 AS bigint)] AS region_ids FROM turns GROUP BY project_id
        UNION ALL SELECT project_id, concat('c', cast(conv_id AS string)), 1, conv_id, page_order, array[turn, turn + 1] FROM turns WHERE turn = 1""",
    "progression": """
        SELECT project_id, conv_id * 100 + turn * 2 AS pos, CASE WHEN k = 9 THEN ' ' WHEN k = 10 THEN concat(event_id, 'x') ELSE event_id END AS event_id FROM turns
        UNION ALL SELECT project_id, conv_id * 100 + turn * 2 + 1, concat(' ', event_id) FROM turns WHERE k = 11""",
}
NEEDS = {
    "evidence": [], "turns": [], "events": ["turns"], "claims": ["turns"], "claim_sources": ["turns"],
    "characters": ["turns"], "character_sources": ["turns"], "progression": ["turns"],
}


def story(spark: SparkSession, folder: str, name: str) -> DataFrame:
    text = STORY[name]
    bound = {t: story(spark, folder, t) for t in NEEDS[name]}
    if "FROM conversations" in text:
        bound["conversations"] = table(spark, folder, "conversations")
    for used in bound:
        text = text.replace(f"FROM {used}", f"FROM {{{used}}}")
    # Array literals differ: array[...] in the oracle, array(...) here.
    text = text.replace("array[", "array(").replace("]", ")")
    return spark.sql(text, **bound)


def story_world(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    world = {name: story(spark, folder, name) for name in STORY if name != "turns"}
    world["pages"] = world["evidence"].select("project_id", "asset_id", "page_order").distinct()
    return world


def with_story(*names: str) -> str:
    """``WITH`` prefix for oracle queries over the story world."""
    wanted = [n for n in STORY if n in names or any(n in NEEDS[m] for m in names)]
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({STORY[n]})" for n in wanted)
