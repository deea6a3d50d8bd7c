"""Personal data spans by weak supervision, in DataFrame operations only.

Candidates are the matches of the base patterns (also those that fail their check) and of
looser patterns. Labelers vote on each: the base rule, a gazetteer, the words before it, its
shape and its borders; +1 for, -1 against, 0 abstains. Expectation-maximisation estimates, per
kind, how reliable each labeler is, and its posteriors train the span classifier, naive Bayes
over categorical features. Base spans stay; other candidates the classifier is sure of are
added unless they overlap one.

Two passes over the documents, no join: the first sums candidates by votes and features, a
table whose size is bounded by the product of their values and not by the input; estimates
come from that table; the second applies them row by row. Null and empty texts have no span.
Equal rows give equal rows. An empty table gives no row and an untrained classifier that adds
nothing. Spans are code point offsets, end exclusive. Extra columns stay untouched. Gathering
the spans of one document takes time that grows with the square of its number of matches.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetrace.llm.common import table

#: In the order in which spans of one start are listed.
KINDS = ["email", "ip", "card", "phone"]
# The base patterns, without the backtracking that costs time or stack on long runs: a run that
# fails from its first character fails from every other, so a match begins where a run or the
# last match ends, and runs are possessive. Digit runs under 12 digits can only fail as a card.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What else may be personal data, written in other ways.
LOOSE = {
    "email": r"[A-Za-z0-9._%+-]{1,64}\x20?[(\[](?:at|AT)[)\]]\x20?[A-Za-z0-9-]{1,64}(?:(?:\.|\x20?[(\[](?:dot|DOT)[)\]]\x20?)[A-Za-z0-9-]{1,32}){1,4}",
    "phone": r"(?<![0-9A-Za-z+(.-])(?:\([0-9]{3}\)|[0-9]{3})[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])",
}
MARK = {"email": r"@", "phone": r"\+"}
LOOSE_MARK = {"email": r"[(\[](?:at|AT)[)\]]", "phone": r"[0-9]{3}[\x20.-][0-9]{4}"}
#: Words before a span that speak for its kind, and those that speak for another kind of number.
CUES = {
    "email": r"(?i)\b(e-?mails?|mail|contact|write|reach|adress\w*|correo)\b",
    "ip": r"(?i)\b(ip|ips|host|server|address|from|client|login)\b",
    "card": r"(?i)\b(cards?|credit|visa|mastercard|amex|payment|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(call|phone|tel|telephone|mobile|cell|fax|whatsapp|telefon|tél|teléfono)\b",
}
AGAINST = r"(?i)\b(order|ref|reference|isbn|issn|invoice|version|ver|id|no|nr|serial|sku|section|chapter|page)\b"
DOMAINS = r"(?i)\.(com|org|net|edu|gov|info|io|co|uk|de|fr|es|it|nl|eu|us|ca|au|ch|at|be|jp|br|in|mx|ru|cn)$"
PREFIXES = r"^\+(1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
CARD_PREFIX = r"^(4|5[1-5]|2[2-7]|3[47]|3[068]|6)"
PUBLIC_IP = r"^(?!0|127\.|22[4-9]|2[3-9][0-9])"
BEFORE = 32
LABELERS = ["rule", "gazetteer", "context", "shape", "border"]
FEATURES = ["check", "digits", "length", "left", "right", "cue", "style"]
ROUNDS = 50
SURE = 0.9


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes the check sum, counted from its right end."""
    backwards = F.split(F.reverse(digits), "")
    doubled = F.transform(
        backwards,
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)
        ),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        # Parts may have leading zeros and any length, so they are compared as texts.
        return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike(r"^(|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    digits = _digits(value)
    if kind == "card":
        return F.length(digits).between(12, 19) & luhn(digits)
    return F.length(digits).between(9, 15)


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of the leftmost non-overlapping matches."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(values, F.split(text, pattern, -1), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g")))
    span = "struct<start:int,end:int,value:string>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["g"]
        end = begin + F.length(x["m"])
        found = F.struct(begin.cast("int").alias("start"), end.cast("int").alias("end"), x["m"].alias("value"))
        return F.struct(end.cast("int").alias("at"), F.array_append(acc["out"], found).alias("out"))

    return F.aggregate(F.filter(pairs, lambda x: x["m"].isNotNull()), start, step, lambda acc: acc["out"])


_CANDIDATE = "array<struct<kind:string,start:int,end:int,value:string,ok:boolean,base:boolean>>"


def _as_candidates(found: Column, kind: str, base: bool) -> Column:
    return F.transform(
        found,
        lambda x: F.struct(
            F.lit(kind).alias("kind"),
            x["start"].alias("start"),
            x["end"].alias("end"),
            x["value"].alias("value"),
            (passes(kind, x["value"]) if base else F.lit(False)).alias("ok"),
            F.lit(base).alias("base"),
        ),
    ).cast(_CANDIDATE)


def candidates(text: Column) -> Column:
    """Array of (kind, start, end, value, ok, base); ``ok`` and ``base`` together are base spans."""
    none = F.array().cast(_CANDIDATE)
    parts = []
    for kind in KINDS:
        found = _as_candidates(matches(text, BASE[kind]), kind, True)
        parts.append(F.when(text.rlike(MARK.get(kind, BASE[kind])), found).otherwise(none))
    for kind, pattern in LOOSE.items():
        parts.append(F.when(text.rlike(LOOSE_MARK[kind]), _as_candidates(matches(text, pattern), kind, False)).otherwise(none))
    return F.concat(*parts)


def _by_kind(kind: Column, choices: dict[str, Column], otherwise: Column) -> Column:
    found = None
    for name, value in choices.items():
        found = F.when(kind == name, value) if found is None else found.when(kind == name, value)
    return found.otherwise(otherwise)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _seen(c: Column, text: Column) -> Column:
    """A candidate with the text around it."""
    before = F.substring(text, F.greatest(c["start"] - BEFORE + 1, F.lit(1)), F.least(c["start"], F.lit(BEFORE)))
    return F.struct(
        *(c[n].alias(n) for n in ("kind", "start", "end", "value", "ok", "base")),
        before.alias("before"),
        F.substring(text, c["end"] + 1, F.lit(1)).alias("after"),
        F.length(_digits(c["value"])).alias("digits"),
    )


def _class_of(char: Column) -> Column:
    return (
        F.when(char == "", "end").when(char.rlike(r"[0-9]"), "digit").when(char.rlike(r"\p{L}|_"), "letter").when(char.rlike(r"\s"), "space").otherwise("mark")
    )


def _judged(s: Column) -> Column:
    """Votes and features of a candidate."""
    kind, value = s["kind"], s["value"]
    left, right = F.substring(s["before"], -1, 1), s["after"]
    cue = _by_kind(kind, {k: s["before"].rlike(p) for k, p in CUES.items()}, F.lit(False))
    votes = {
        "rule": F.when(s["ok"], 1).otherwise(-1),
        "gazetteer": _by_kind(
            kind,
            {
                "email": _vote(value.rlike(DOMAINS), s["base"]),
                "ip": _vote(value.rlike(PUBLIC_IP), F.lit(True)),
                "card": _vote(_digits(value).rlike(CARD_PREFIX), F.lit(True)),
                "phone": _vote(value.rlike(PREFIXES), s["base"]),
            },
            F.lit(0),
        ),
        "context": _vote(cue, s["before"].rlike(AGAINST)),
        # Only what is telling: most numbers of the right length are nobody's card.
        "shape": _by_kind(
            kind,
            {
                "email": _vote(value.rlike(r"^[A-Za-z0-9]+[._-][A-Za-z0-9]+@"), value.rlike(r"\.\.|--|^[._%+-]")),
                "ip": _vote(F.lit(False), value.rlike(r"(^|\.)0[0-9]")),
                "card": _vote(value.rlike(r"^(([0-9]{4}[\x20-]){3}[0-9]{4}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})$"), s["digits"] > 19),
                "phone": _vote(value.rlike(r"[\x20().-]"), s["digits"] < 9),
            },
            F.lit(0),
        ),
        "border": _vote(F.lit(False), left.rlike(r"[\p{L}0-9_]") | right.rlike(r"[\p{L}0-9_]")),
    }
    features = {
        "check": F.when(s["ok"], "passed").when(s["base"], "failed").otherwise("none"),
        "digits": F.least(s["digits"], F.lit(24)).cast("string"),
        "length": F.least(F.floor(F.log2(F.length(value))), F.lit(8)).cast("string"),
        "left": _class_of(left),
        "right": _class_of(right),
        "cue": F.when(cue, "for").when(s["before"].rlike(AGAINST), "against").otherwise("none"),
        "style": F.when(~s["base"], "loose").when(value.rlike(r"[\x20(]"), "spaced").when(value.contains("-"), "dashed").otherwise("plain"),
    }
    return F.struct(
        *(s[n].alias(n) for n in ("kind", "start", "end", "ok", "base")),
        *(v.cast("int").alias(n) for n, v in votes.items()),
        *(v.alias(f"f_{n}") for n, v in features.items()),
    )


def judged(docs: DataFrame) -> DataFrame:
    """docs with ``_judged``: the candidates of each text with votes and features."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.withColumn("_found", candidates(text))
    found = found.withColumn("_seen", F.transform("_found", lambda c: _seen(c, text)))
    return found.withColumn("_judged", F.transform("_seen", _judged)).drop("_found", "_seen")


@dataclass
class Model:
    """Labeler reliabilities and classifier weights; a few hundred numbers at most."""

    prior: dict[str, float] = field(default_factory=dict)
    reliability: dict[tuple[str, str, int, int], float] = field(default_factory=dict)
    bias: dict[str, float] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)

    def score(self, judged: Column) -> Column:
        """Probability that a candidate is personal data."""
        if not self.bias:
            return F.lit(0.0)
        table_of = F.create_map(*(F.lit(v) for pair in sorted(self.weights.items()) for v in pair))
        parts = [
            F.coalesce(F.try_element_at(table_of, F.concat_ws(":", judged["kind"], F.lit(n), judged[f"f_{n}"])), F.lit(0.0)) for n in FEATURES
        ]
        bias = _by_kind(judged["kind"], {k: F.lit(v) for k, v in sorted(self.bias.items())}, F.lit(-30.0))
        total = sum(parts, bias)
        return 1 / (1 + F.exp(-F.greatest(F.least(total, F.lit(30.0)), F.lit(-30.0))))


def estimate(counts: list[dict]) -> Model:
    """EM over vote patterns per kind, then naive Bayes on its posteriors; ``counts`` have votes, features and n."""
    model = Model()
    for kind in sorted({c["kind"] for c in counts}):
        own = sorted((c for c in counts if c["kind"] == kind), key=lambda c: [c[n] for n in LABELERS] + [c[f"f_{n}"] for n in FEATURES])
        total = sum(c["n"] for c in own)
        prior = 0.5
        # What is believed of a labeler beforehand weighs as much as all candidates: nearly all
        # are true, and without it a class that hardly occurs would be taken over by the other.
        # Labelers are right four times in five, the rule nearly always; no vote says nothing.
        given = {}
        for n in LABELERS:
            right = 0.57 if n == "rule" else 0.48
            given |= {(n, v, y): 0.4 if v == 0 else right if (v > 0) == bool(y) else 0.6 - right for v in (-1, 0, 1) for y in (0, 1)}
        believed = dict(given)
        posterior: list[float] = []
        for _ in range(ROUNDS):
            posterior = []
            for c in own:
                odds = math.log(prior / (1 - prior)) + sum(math.log(given[n, c[n], 1] / given[n, c[n], 0]) for n in LABELERS)
                posterior.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
            mass = sum(p * c["n"] for p, c in zip(posterior, own, strict=True))
            prior = (mass + total / 2) / (2 * total)
            for n in LABELERS:
                for y, whole in ((1, mass), (0, total - mass)):
                    for v in (-1, 0, 1):
                        part = sum((p if y else 1 - p) * c["n"] for p, c in zip(posterior, own, strict=True) if c[n] == v)
                        given[n, v, y] = (part + total * believed[n, v, y]) / (whole + total)
        model.prior[kind] = prior
        model.reliability |= {(kind, *k): v for k, v in given.items()}
        yes, no = 0.0, 0.0
        by_value: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
        for p, c in zip(posterior, own, strict=True):
            yes, no = yes + p * c["n"], no + (1 - p) * c["n"]
            for n in FEATURES:
                cell = by_value[f"{kind}:{n}:{c[f'f_{n}']}"]
                cell[0] += p * c["n"]
                cell[1] += (1 - p) * c["n"]
        model.bias[kind] = math.log((yes + 1) / (no + 1))
        for name, (a, b) in by_value.items():
            model.weights[name] = math.log((a + 1) / (yes + 2)) - math.log((b + 1) / (no + 2))
    return model


def fit(docs: DataFrame) -> Model:
    """Estimates from every candidate of every text; what reaches the driver is bounded by votes times features."""
    found = judged(docs.select("text")).select(F.explode("_judged").alias("c"))
    names = ["kind", *LABELERS, *(f"f_{n}" for n in FEATURES)]
    counts = found.groupBy(*(F.col(f"c.{n}").alias(n) for n in names)).agg(F.count(F.lit(1)).alias("n"))
    return estimate([r.asDict() for r in counts.collect()])


def _listed(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def _sorted(spans: Column) -> Column:
    order = _by_kind_number
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), order(s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_sort(keyed)


def _by_kind_number(kind: Column) -> Column:
    return _by_kind(kind, {k: F.lit(i) for i, k in enumerate(KINDS)}, F.lit(len(KINDS)))


def find(docs: DataFrame, model: Model | None = None, sure: float = SURE) -> DataFrame:
    """docs with ``_base`` and ``_spans``, arrays of (start, k, end, kind) in the listed order; columns of these names are replaced."""
    model = fit(docs) if model is None else model
    found = judged(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_given"), "text"))
    found = found.withColumn("_base", _sorted(F.filter("_judged", lambda c: c["base"] & c["ok"])))
    free = lambda c: ~F.exists("_base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    more = F.filter("_judged", lambda c: ~(c["base"] & c["ok"]) & (model.score(c) >= sure) & free(c))
    found = found.withColumn("_more", F.when(F.size("_judged") > 0, _sorted(more)).otherwise(_sorted(F.filter("_judged", lambda c: F.lit(False)))))
    own = [F.col(f"_given.`{c}`").alias(c) for c in docs.columns if c not in ("_base", "_spans")]
    return found.select(*own, "_base", F.array_sort(F.concat("_base", "_more")).alias("_spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans are merged into the first."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        own = s["start"] >= acc["at"]
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(own, piece).otherwise(acc["out"]).alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, rest)).otherwise(text)


def op9_personal_data(spark, sf_dir):
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def of_kind(kind):
        return F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [of_kind(k) for k in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(_listed(F.col("_base")).cast("binary"), 256).alias("base_sha256"), _listed(F.col("_spans")).alias("spans")
    )


QUERIES = {"op9_personal_data": (op9_personal_data, None)}
