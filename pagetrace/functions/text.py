"""Text rules as column expressions (JVM-side unless the name says ``arrow``)."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Sequence
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetrace.functions.numeric import round_exact

# Fixed values -------------------------------------------------------------
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0                　"
SUSPICIOUS_OCR = r"[#<>_|\\]|\d(?=[A-Za-zÀ-ỹ])|(?<=[A-Za-zÀ-ỹ])\d"
REASON_CODES = [
    "unchanged", "ocr_typo", "low_confidence", "ambiguous_visual",
    "proper_name_uncertain", "fragmented_ocr", "needs_review",
]
REVIEW_REASON_CODES = [
    "low_confidence", "ambiguous_visual", "proper_name_uncertain",
    "fragmented_ocr", "needs_review",
]
UNCERTAIN_REASONS = ["proper_name_uncertain", "ambiguous_visual", "needs_review"]
UI_MARKERS = ["THÀNH TỰU", "ĐẶC QUYỀN", "ACHIEVEMENT", "UNLOCKED", "SYSTEM"]
TRANSLATOR_NOTE = r"(?iuU)(?:\*|\b)TRANS\s*NOTE\s*:"
TRANSLATOR_NOTE_PREFIX = r"(?iuU)^\s*\*?TRANS\s*NOTE\s*:"
ROLE_BY_REGION_TYPE = {
    "speech_bubble": "dialogue",
    "dialogue": "dialogue",
    "narration": "narration",
    "thought": "thought",
    "game_ui": "game_ui",
    "translator_note": "translator_note",
    "note": "other",
    "sfx": "sfx",
}
PRIMARY_ROLES = ["dialogue", "narration", "thought"]
CONTEXT_ROLES = ["game_ui", "other"]
CAUSALITY = (
    r"(?U)\bVI\b|\bBOI\b|\bNHO\b|DAN DEN|CHO PHEP|\bBECAUSE\b|\bTHEREFORE\b"
    r"|RESULTS? IN|\bCAUSES?\b|\bGRANTS?\b"
)
QUOTE_CHARACTERS = "\"'“”‘’«»"
# --------------------------------------------------------------------------


def strip(text: Column) -> Column:
    """Trim every Unicode whitespace character, not only blanks."""
    return F.btrim(text, F.lit(WHITESPACE))


def non_blank(text: Column) -> Column:
    """Trimmed text, NULL when nothing is left."""
    return F.nullif(strip(text), F.lit(""))


def words(text: Column) -> Column:
    """Whitespace-separated words; blank text has none."""
    trimmed = strip(F.coalesce(text, F.lit("")))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, r"(?U)\s+")
    )


def word_count(text: Column) -> Column:
    return F.size(words(text))


def suspicious_ocr(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(SUSPICIOUS_OCR)


def even_quotes(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))) % 2 == 0


def passes_fast_path(text: Column, min_confidence: Column) -> Column:
    """Unchanged text is trusted when every block is confident and it looks clean."""
    return F.coalesce(
        (min_confidence >= 0.92)
        & (F.length(strip(text)) >= 2)
        & ~suspicious_ocr(text)
        & even_quotes(text),
        F.lit(False),
    )


@F.pandas_udf(T.DoubleType())
def similarity_arrow(raw: pd.Series, clean: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp ratio of lower-cased texts; Spark has no built-in for it.

    Equal pairs answer 1.0 without the matcher.
    """
    return pd.Series(
        [
            1.0 if a == b else SequenceMatcher(None, a, b).ratio()
            for a, b in zip(raw.fillna("").str.lower(), clean.fillna("").str.lower())
        ],
        index=raw.index,
        dtype="float64",
    )


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance, word by word where that is known to be the least.

    Editing each word into its counterpart is one way, so its cost is never too small; the
    distance is never under the difference of the lengths, nor under 1 for unequal texts. Where
    both meet, as for corrections that only drop or only add characters inside words, the full
    table is not needed, whose work grows with the square of the length.
    """
    left, right = F.split(a, " "), F.split(b, " ")
    steps = F.zip_with(left, right, lambda x, y: F.when(x == y, 0).otherwise(F.levenshtein(x, y)))
    by_word = F.when(
        (F.size(left) == F.size(right)) & (F.size(left) > 1), F.aggregate(steps, F.lit(0), lambda total, step: total + step)
    )
    least = F.greatest(F.abs(F.length(a) - F.length(b)), (a != b).cast("int"))
    return F.when(by_word == least, least).otherwise(F.levenshtein(a, b))


def similarity_levenshtein(raw: Column, clean: Column) -> Column:
    """Built-in alternative: 1 - edit distance / longer length (a different measure)."""
    longest = F.greatest(F.length(raw), F.length(clean))
    same = F.lower(raw) == F.lower(clean)
    return F.when((longest == 0) | same, F.lit(1.0)).otherwise(
        1.0 - edit_distance(F.lower(raw), F.lower(clean)).cast("double") / longest.cast("double")
    )


def changed_words(raw: Column, clean: Column) -> Column:
    pairs = F.zip_with(words(F.upper(raw)), words(F.upper(clean)), lambda a, b: (a != b).cast("int"))
    return F.aggregate(pairs, F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(1)))


def risky_change(raw: Column, clean: Column) -> Column:
    """A different word count, any changed word in <= 12 words, or two changed words."""
    raw_count, clean_count = word_count(raw), word_count(clean)
    changed = changed_words(raw, clean)
    return (
        F.when(raw_count != clean_count, True)
        .when((raw_count <= 12) & (changed >= 1), True)
        .otherwise(changed >= 2)
    )


def quoted_names(text: Column) -> Column:
    return F.array_distinct(
        F.transform(
            F.regexp_extract_all(text, F.lit('"([^"\\n]+)"'), F.lit(1)),
            lambda x: F.upper(strip(x)),
        )
    )


def tiny_typo(row: dict[str, Column]) -> Column:
    """A near-identical correction with high confidence on all sides and names kept."""
    return F.coalesce(
        row["reason_code"].isin("ocr_typo", "unchanged")
        & (row["text_similarity"] >= 0.96)
        & (row["ocr_confidence"] >= 0.60)
        & (row["confidence"] >= 0.97)
        & (word_count(row["raw_text"]) == word_count(row["clean_text"]))
        & (F.size(F.array_except(quoted_names(row["raw_text"]), quoted_names(row["clean_text"]))) == 0),
        F.lit(False),
    )


def recovery_agrees(row: dict[str, Column], recovery: dict[str, Column]) -> Column:
    """Two independent passes with the same text, neither of them unsure."""
    fragmented = F.coalesce(row["reason_code"] == "fragmented_ocr", F.lit(False)) | F.coalesce(
        recovery["reason_code"] == "fragmented_ocr", F.lit(False)
    )

    def limits(confidence: float, similarity: float, ocr: float) -> Column:
        return (
            (row["confidence"] >= confidence)
            & (recovery["confidence"] >= confidence)
            & (row["text_similarity"] >= similarity)
            & (row["ocr_confidence"] >= ocr)
        )

    blocked = F.coalesce(row["reason_code"].isin(UNCERTAIN_REASONS), F.lit(False)) | F.coalesce(
        recovery["reason_code"].isin(UNCERTAIN_REASONS), F.lit(False)
    )
    return F.coalesce(
        (strip(recovery["recovered_text"]) == strip(row["clean_text"]))
        & ~blocked
        & F.when(fragmented, limits(0.98, 0.97, 0.80)).otherwise(limits(0.95, 0.94, 0.60)),
        F.lit(False),
    )


def authoritative_text(row: dict[str, Column]) -> Column:
    """Struct(text, source): verified, else recovered, else clean; raw text never counts.

    A verified decision with blank text does not fall through.
    """
    verified = F.coalesce(row["decision"] == "verified", F.lit(False)) | F.coalesce(
        row["human_verified"], F.lit(False)
    )
    sources = [("recovered", non_blank(row["recovered_text"])), ("clean", non_blank(row["clean_text"]))]
    text = F.when(verified, non_blank(row["verified_text"])).otherwise(
        F.coalesce(*[value for _, value in sources])
    )
    source = F.when(verified, F.when(non_blank(row["verified_text"]).isNotNull(), F.lit("verified")))
    for label, value in sources:
        source = source.when(value.isNotNull(), F.lit(label))
    return F.struct(text.alias("text"), source.alias("source"))


def note_position(text: Column) -> Column:
    """1-based start of a translator note, 0 when there is none.

    The cheap word test spares nearly every text the pattern search.
    """
    mentions = F.contains(F.upper(text), F.lit("TRANS"))
    return F.when(mentions, F.regexp_instr(text, F.lit(TRANSLATOR_NOTE))).otherwise(F.lit(0))


def evidence_text(text: Column, note_at: Column | None = None) -> Column:
    """Text before a translator note; pass ``note_at`` when it is already a column."""
    at = note_position(text) if note_at is None else note_at
    return F.when(at == 0, strip(text)).otherwise(
        F.rtrim(F.substring(text, F.lit(1), at - 1), F.lit(" *'\""))
    )


def excluded_text(text: Column, note_at: Column | None = None) -> Column:
    at = note_position(text) if note_at is None else note_at
    return F.when(at > 0, non_blank(F.substring(text, at, F.length(text))))


def text_role(text: Column, region_type: Column, note_at: Column | None = None) -> Column:
    """Region type mapped to a role; UI markers and note prefixes override it."""
    at = note_position(text) if note_at is None else note_at
    kind = F.lower(strip(F.coalesce(region_type, F.lit(""))))
    mapping = F.create_map(*[F.lit(x) for pair in ROLE_BY_REGION_TYPE.items() for x in pair])
    upper = F.upper(text)
    has_marker = F.lit(False)
    for marker in UI_MARKERS:
        has_marker = has_marker | F.contains(upper, F.lit(marker))
    return (
        F.when(has_marker, F.lit("game_ui"))
        .when((at > 0) & text.rlike(TRANSLATOR_NOTE_PREFIX), F.lit("translator_note"))
        .otherwise(F.coalesce(F.try_element_at(mapping, kind), F.lit("other")))
    )


def role_category(role: Column) -> Column:
    return (
        F.when(role.isin(PRIMARY_ROLES), F.lit("primary"))
        .when(role.isin(CONTEXT_ROLES), F.lit("context"))
        .otherwise(F.lit("excluded"))
    )


_LAST = 0x1FBFF


def _ranges(codes: Sequence[int]) -> str:
    """A character class of the code points, given in ascending order."""
    parts, start = [], None
    for code, following in zip(codes, [*codes[1:], None], strict=True):
        start = code if start is None else start
        if following != code + 1:
            parts.append(f"\\x{{{start:x}}}-\\x{{{code:x}}}")
            start = None
    return f"[{''.join(parts)}]"


def _seldom(codes: Sequence[int]) -> str:
    """The class of ``codes`` behind a test of one or two ranges that most letters fail.

    A class of many ranges is tried range by range at every character of a text.
    """
    common = [(0, min(codes) - 1), (0x1EA0, 0x1EF9)]
    free = [(low, high) for low, high in common if not any(low <= c <= high for c in codes)]
    return "(?![" + "".join(f"\\x{{{low:x}}}-\\x{{{high:x}}}" for low, high in free) + "])" + _ranges(codes)


@lru_cache(maxsize=1)
def _combining() -> str:
    """Marks with a combining class; vowel signs and enclosing marks have none and stay."""
    return _seldom([c for c in range(0x300, _LAST) if unicodedata.combining(chr(c))])


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str]:
    """Characters whose compatibility decomposition, marks dropped, is one other character."""
    source, target = [], []
    for code in range(0x80, _LAST):
        char = chr(code)
        if unicodedata.combining(char) or 0xD800 <= code <= 0xDFFF:
            continue
        base = "".join(
            c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c)
        )
        if len(base) == 1 and base != char:
            source.append(char)
            target.append(base)
    return "".join(source), "".join(target)


@lru_cache(maxsize=1)
def _compositions() -> list[tuple[str, str, str]]:
    """(mark, bases, composed characters) of the general combining marks, lower classes first."""
    bases = [chr(c) for c in [*range(0x41, 0x590), *range(0x1E00, 0x2000)] if chr(c).isalpha()]
    marks = sorted((chr(c) for c in range(0x300, 0x346)), key=unicodedata.combining)
    found = []
    for mark in marks:
        pairs = [(b, unicodedata.normalize("NFKC", b + mark)) for b in bases]
        pairs = [(b, c) for b, c in pairs if len(c) == 1]
        if pairs:
            found.append((mark, "".join(b for b, _ in pairs), "".join(c for _, c in pairs)))
    return found


@lru_cache(maxsize=1)
def _compatible() -> tuple[str, str, list[tuple[str, str]]]:
    """Characters that compatibility composition turns into one other, and letters that it spells out."""
    source, target, spelled = [], [], []
    for code in [*range(0xA0, 0xD800), *range(0xF900, _LAST)]:
        char, whole = chr(code), unicodedata.normalize("NFKC", chr(code))
        if len(whole) == 1 and whole != char:
            source.append(char)
            target.append(whole)
        elif char.isalpha() and len(whole) > 1 and (code < 0x2200 or 0xFB00 <= code < 0xFB50):
            spelled.append((char, whole))
    return "".join(source), "".join(target), spelled


def composed(text: Column) -> Column:
    """Compatibility composition for letters, in the JVM; texts without marks or such letters pass untouched.

    A mark joins the character before it where the two have a composed form; a second round
    serves marks that came in another order.
    """
    source, target, _ = _compatible()
    done = F.translate(_spelled_out(text), source, target)
    marks = _rows(["mark", "bases", "whole"], _compositions())
    joined = F.aggregate(F.concat(marks, marks), done, _with_mark)
    return F.when(text.rlike(r"[\x{300}-\x{345}]"), joined).otherwise(done)


def _rows(names: list[str], rows: list[tuple[str, ...]]) -> Column:
    """A constant array of structs, as one literal that the optimiser folds."""
    kind = ",".join(f"{n}:string" for n in names)
    return F.from_json(F.lit(json.dumps([dict(zip(names, r, strict=True)) for r in rows])), f"array<struct<{kind}>>")


def _spelled_out(text: Column) -> Column:
    """Ligatures and other letters that stand for several, as those."""
    spelled = _compatible()[2]
    rows = _rows(["char", "whole"], spelled)
    done = F.aggregate(rows, text, lambda so_far, r: F.replace(so_far, r["char"], r["whole"]))
    return F.when(text.rlike(_seldom(sorted(ord(c) for c, _ in spelled))), done).otherwise(text)


def _with_mark(text: Column, row: Column) -> Column:
    """``text`` with the row's mark joined to the characters before it, where they are among its bases."""
    pieces = F.split(text, row["mark"], -1)

    def join(so_far: Column, piece: Column) -> Column:
        last = F.right(so_far, F.lit(1))
        fits = F.contains(row["bases"], last) & (last != "")
        whole = F.call_function("translate", last, row["bases"], row["whole"])
        head = F.left(so_far, F.length(so_far) - 1)
        return F.concat(F.when(fits, F.concat(head, whole)).otherwise(F.concat(so_far, row["mark"])), piece)

    rest = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.aggregate(rest, F.element_at(pieces, 1), join)


def normalize_name(text: Column) -> Column:
    """Accents folded, upper case, single blanks (decomposition by ``translate``).

    Signs that decompose into several characters (fractions, squared words) stay as they are;
    ``normalize_name_arrow`` expands those as well.
    """
    source, target = _fold_table()
    given = F.coalesce(text, F.lit(""))
    folded = F.translate(_spelled_out(given), source, target)
    unmarked = F.when(given.rlike(r"[^\x00-\x7f]"), F.regexp_replace(folded, _combining() + "+", "")).otherwise(given)
    return strip(F.regexp_replace(F.upper(unmarked), r"(?U)\s+", " "))


@F.pandas_udf(T.StringType())
def normalize_name_arrow(text: pd.Series) -> pd.Series:
    """The full decomposition, for scripts the table does not reach."""

    def fold(value):
        decomposed = unicodedata.normalize("NFKD", value or "")
        kept = "".join(c for c in decomposed if not unicodedata.combining(c))
        return " ".join(kept.upper().split())

    return text.map(fold)


def contains_name(normalized_text: Column, normalized_name: Column) -> Column:
    """Word-bounded containment; both sides already normalised."""
    literal = F.concat(
        F.lit(r"\Q"), F.replace(normalized_name, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")
    )
    bounded = F.concat(F.lit("(?<![A-Z0-9])"), literal, F.lit("(?![A-Z0-9])"))
    return (
        (normalized_name != "")
        & F.contains(normalized_text, normalized_name)
        & F.rlike(normalized_text, bounded)
    )


def name_anchors(normalized_text: Column) -> Column:
    """Join keys of a text for name look-ups: alphanumeric runs plus other characters.

    Every name bounded by non-alphanumerics has each of its runs among these.
    """
    runs = F.regexp_extract_all(normalized_text, F.lit("[A-Z0-9]+"), F.lit(0))
    others = F.split(F.regexp_replace(normalized_text, r"[A-Z0-9\s]+", ""), "")
    return F.filter(F.array_distinct(F.concat(runs, others)), lambda x: x != "")


def name_anchor(normalized_name: Column) -> Column:
    """The longest run of a name, or its first character when it has none."""
    runs = F.regexp_extract_all(normalized_name, F.lit("[A-Z0-9]+"), F.lit(0))
    longest = F.aggregate(
        runs, F.lit(""), lambda acc, x: F.when(F.length(x) > F.length(acc), x).otherwise(acc)
    )
    return F.when(longest != "", longest).otherwise(F.substring(normalized_name, 1, 1))


def states_causality(normalized_text: Column) -> Column:
    return normalized_text.rlike(CAUSALITY)


def name_only(text: Column) -> Column:
    """Exactly one word of at most 30 characters without ``!`` or ``?``."""
    value = F.coalesce(text, F.lit(""))
    found = F.regexp_extract_all(value, F.lit(r"[\p{L}\p{N}\p{M}_À-ỹ]+"), F.lit(0))
    return (F.size(found) == 1) & (F.length(strip(value)) <= 30) & ~value.rlike("[!?]")


def semantic_tokens(text: Column) -> Column:
    """Distinct lower-case letter/digit runs longer than one character."""
    found = F.regexp_extract_all(
        F.lower(composed(F.coalesce(text, F.lit("")))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)
    )
    return F.array_distinct(F.filter(found, lambda x: F.length(x) > 1))


def salient_tokens(text: Column) -> Column:
    """Distinct normalised runs of at least four characters that are not numbers."""
    found = F.regexp_extract_all(normalize_name(text), F.lit("[A-Z0-9]+"), F.lit(0))
    return F.array_distinct(
        F.filter(found, lambda x: (F.length(x) >= 4) & ~x.rlike("^[0-9]+$"))
    )


def capitalized_names(text: Column) -> Column:
    """Capitalised or all-upper words of three letters and more, upper-cased."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-zÀ-ỹ]+"), F.lit(0))
    shaped = F.filter(
        found,
        lambda x: (F.length(x) >= 3)
        & ((x == F.upper(x)) | (x == F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 10**6))))),
    )
    upper = F.transform(shaped, lambda x: F.upper(x))
    return F.array_distinct(F.filter(upper, lambda x: ~x.isin("A", "AN", "THE")))


def contains_token(text: Column, token: Column) -> Column:
    """Upper-cased text holds ``token`` between non-word characters."""
    upper = F.upper(F.coalesce(text, F.lit("")))
    pattern = F.concat(F.lit(r"(?U)(?<!\w)\Q"), token, F.lit(r"\E(?!\w)"))
    return F.contains(upper, token) & F.rlike(upper, pattern)


def usable_recovery(text: Column) -> Column:
    """At least four letters or digits."""
    kept = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]", "")
    return F.length(kept) >= 4


def without_quotes(text: Column) -> Column:
    return F.translate(strip(text), QUOTE_CHARACTERS, "")


def bounded_text(text: Column, longest: int) -> Column:
    """Trimmed text within the limit, NULL when blank or too long."""
    value = non_blank(text)
    return F.when(F.length(value) <= longest, value)


def narration_seconds(word_total: Column) -> Column:
    return round_exact(word_total.cast("double") / F.lit(150.0) * F.lit(60.0), 1)


def unfenced(text: Column) -> Column:
    """A model response without its markdown fence."""
    value = strip(text)
    opened = F.regexp_replace(value, r"^```[^\n]*(?:\n|$)", "")
    closed = F.regexp_replace(opened, r"(?:^|\n)[^\S\n]*```[^\S\n]*$", "")
    return F.when(value.startswith("```"), strip(closed)).otherwise(value)
