"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are of documents, so token labels are derived first: parts of words (the word and its
beginnings) that stand in toxic documents and all but never in others form a lexicon, and the
words of toxic documents that hold one are labelled toxic. A field with two states learns
emission weights over hashed parts of words, and transitions, from windows around those words
and as many elsewhere. Forward-backward marginals over the whole text give the spans (marginal
0.5 or more, in code points) and, through a calibrated combination of the highest marginal and
the expected number of toxic words, the score of the document.

Fitting reads a bounded sample of labelled documents (``sample``); held-out rows, lang, source
and doc_id are never inputs. All texts are scored, whole. Null and empty texts have no word and
get the score of a document without any. Without labels of both kinds the score is the share of
toxic labels (0 without labels). Equal rows get equal scores; an empty table gives no row; null
ids count as not held out. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrace.llm.common import ArrowBatches, held_out, sigmoid, table
from pagetrace.llm.labelled import SAMPLE, sample

_WORD = re.compile(r"[^\W\d_]+|\d+")
BUCKETS = 1 << 17
BEGINNINGS = (4, 5, 6)
#: Words on each side of a labelled one, windows a document, and parts in the lexicon, at most.
SIDE = 6
WINDOWS = 6
#: A part enters the lexicon with so many toxic documents, and by so much likelier in them.
SUPPORT = 3
LIKELIER = 12.0
SPAN = 0.5
PREDICT = 0.3
#: Documents that are tagged together.
ROWS = 2000
CACHE = 300_000
NONE = -12.0


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def parts_of(word: str) -> list[str]:
    """The word and its beginnings."""
    return ["=" + word, *(word[:n] for n in BEGINNINGS if len(word) > n)]


def buckets_of(word: str) -> list[int]:
    found = [crc32(p.encode()) % BUCKETS for p in parts_of(word)]
    return found + [crc32(("~" + word[-3:]).encode()) % BUCKETS] + [BUCKETS] * (len(BEGINNINGS) + 1 - len(found))


@dataclass
class Field:
    """Emission weights by bucket, log transition weights [[oo, ot], [to, tt]] and the score's calibration."""

    weights: np.ndarray
    bias: float
    moves: np.ndarray
    calibration: tuple[float, float, float] = (0.0, 1.0, 1.0)
    constant: float | None = None
    known: dict[str, float] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def emission(self, word: str) -> float:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            found = self.known[word] = self.bias + float(self.weights[buckets_of(word)].sum())
        return found

    def logits(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Log odds of the toxic state's marginal, for each word of each text."""
        lengths = np.array([len(t) for t in texts])
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        starts = np.concatenate([[0], np.cumsum(lengths)])
        emissions = np.fromiter((self.emission(w) for i in order for w in texts[i]), np.float64, int(starts[-1]))
        (oo, ot), (to, tt) = np.exp(self.moves)
        starts = starts[:-1]
        ahead, back = emissions.copy(), np.zeros(len(emissions))
        longest = int(lengths[0]) if len(lengths) else 0
        alive = np.searchsorted(-lengths, -np.arange(longest + 1), "left")  # texts longer than t
        for t in range(1, longest):
            at = starts[: alive[t]] + t
            ratio = np.exp(ahead[at - 1])
            ahead[at] += np.log((ot + tt * ratio) / (oo + to * ratio))
        for t in range(longest - 2, -1, -1):
            at = starts[: alive[t + 1]] + t
            ratio = np.exp(emissions[at + 1] + back[at + 1])
            back[at] = np.log((to + tt * ratio) / (oo + ot * ratio))
        whole = ahead + back
        found: list[np.ndarray] = [np.zeros(0)] * len(texts)
        for i, start, n in zip(order.tolist(), starts.tolist(), lengths.tolist(), strict=True):
            found[i] = whole[start : start + n]
        return found

    def score(self, highest: np.ndarray, expected: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(highest), self.constant)
        a, b, c = self.calibration
        return sigmoid(a + b * highest + c * expected)


def summary(logits: np.ndarray) -> tuple[float, float]:
    """Highest log odds, and the logarithm of one plus the expected number of toxic words above chance."""
    if not len(logits):
        return NONE, 0.0
    p = sigmoid(logits)
    return float(np.clip(logits.max(), NONE, -NONE)), float(np.log1p(p[p >= 0.05].sum()))


def lexicon(given: DataFrame) -> list[str]:
    """Parts of words that tell toxic documents; each batch is counted before the shuffle."""

    def count(batches: ArrowBatches) -> ArrowBatches:
        for batch in batches:
            found: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for part in {p for w in set(words_of(text or "")) if len(w) > 2 for p in parts_of(w)}:
                    found[part][label] += 1
            # Parts of toxic documents decide; others need no row.
            names = [p for p, c in found.items()]
            columns = [pa.array(names), pa.array([found[p][1] for p in names], pa.int64()), pa.array([found[p][0] for p in names], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "toxic", "clean"])

    counts = given.mapInArrow(count, "part string, toxic bigint, clean bigint").groupBy("part")
    counts = counts.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where(F.col("toxic") >= SUPPORT)
    sizes = dict(given.groupBy("label").count().collect())
    ratio = (F.col("toxic") / F.lit(sizes.get(1, 0) + 1.0)) / ((F.col("clean") + 0.5) / F.lit(sizes.get(0, 0) + 1.0))
    best = counts.withColumn("ratio", ratio).where(F.col("ratio") >= LIKELIER)
    return [r["part"] for r in best.orderBy("part").collect()]


def windows(given: DataFrame, parts: frozenset[str]) -> list[tuple[list[str], list[int]]]:
    """Words and token labels around lexicon words and elsewhere, ``WINDOWS`` a document at most."""

    def cut(batches: ArrowBatches) -> ArrowBatches:
        for batch in batches:
            words, tags = [], []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = words_of(text or "")
                hits = [i for i, w in enumerate(own) if len(w) > 2 and any(p in parts for p in parts_of(w))] if label else []
                marked = set(hits)
                spread = max(1, len(own) // 3)
                # Which hits have a window is drawn from the whole text.
                drawn = sorted(hits, key=lambda i: crc32(f"{i}:{own[i]}".encode()))[: WINDOWS - 2]
                for i in [*drawn, *range(spread // 2, len(own), spread)][:WINDOWS]:
                    part = range(max(0, i - SIDE), min(len(own), i + SIDE + 1))
                    words.append(" ".join(own[j] for j in part))
                    tags.append("".join("1" if j in marked else "0" for j in part))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(tags, pa.string())], ["words", "tags"])

    rows = given.mapInArrow(cut, "words string, tags string").collect()
    return sorted((r["words"].split(" "), [int(c) for c in r["tags"]]) for r in rows)


def train(cuts: list[tuple[list[str], list[int]]], rounds: int = 60, decay: float = 1e-4) -> Field:
    """Maximum likelihood by Adam on all windows at once."""
    width = 2 * SIDE + 1
    known: dict[str, list[int]] = {}
    ids = np.full((len(cuts), width, len(BEGINNINGS) + 2), BUCKETS, np.int64)
    tags, mask = np.zeros((len(cuts), width)), np.zeros((len(cuts), width), bool)
    for i, (words, own) in enumerate(cuts):
        for j, word in enumerate(words):
            ids[i, j] = known.setdefault(word, buckets_of(word))
        tags[i, : len(own)], mask[i, : len(own)] = own, True
    pairs = mask[:, 1:] & mask[:, :-1]
    seen = np.array([[(pairs & (tags[:, :-1] == a) & (tags[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)], float)
    weights, bias, moves = np.zeros(BUCKETS + 1), -3.0, np.zeros((2, 2))
    state = [(np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)), (np.zeros(1), np.zeros(1)), (np.zeros((2, 2)), np.zeros((2, 2)))]
    for step in range(1, rounds + 1):
        emissions = np.where(mask, bias + weights[ids].sum(-1), 0.0)
        alpha, beta = np.zeros((len(cuts), width, 2)), np.zeros((len(cuts), width, 2))
        alpha[:, 0, 1] = emissions[:, 0]
        for t in range(1, width):
            following = np.logaddexp(alpha[:, t - 1, 0, None] + moves[0], alpha[:, t - 1, 1, None] + moves[1])
            following[:, 1] += emissions[:, t]
            alpha[:, t] = np.where(mask[:, t, None], following, alpha[:, t - 1])
        for t in range(width - 2, -1, -1):
            ahead = beta[:, t + 1] + np.stack([np.zeros(len(cuts)), emissions[:, t + 1]], -1)
            before = np.logaddexp(moves[:, 0] + ahead[:, 0, None], moves[:, 1] + ahead[:, 1, None])
            beta[:, t] = np.where(mask[:, t + 1, None], before, 0.0)
        total = np.logaddexp(alpha[:, 0, 0] + beta[:, 0, 0], alpha[:, 0, 1] + beta[:, 0, 1])
        marginal = np.where(mask, np.exp(np.minimum(alpha[..., 1] + beta[..., 1] - total[:, None], 0)), 0)
        expected = np.empty((2, 2))
        for a in (0, 1):
            for b in (0, 1):
                joint = alpha[:, :-1, a] + moves[a, b] + (emissions[:, 1:] if b else 0) + beta[:, 1:, b] - total[:, None]
                expected[a, b] = np.exp(np.minimum(joint, 0))[pairs].sum()
        apart = (marginal - tags) * mask
        slope = np.bincount(ids.ravel(), np.repeat(apart.ravel(), ids.shape[-1]), BUCKETS + 1) + decay * len(cuts) * weights
        slope[BUCKETS] = 0
        slopes = [slope, np.array([apart.sum()]), expected - seen + 0.01 * moves]
        moved = []
        for (first, second), own in zip(state, slopes, strict=True):
            own = own / len(cuts)
            first += 0.1 * (own - first)
            second += 0.01 * (own**2 - second)
            moved.append(0.25 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6))
        weights, bias, moves = weights - moved[0], bias - float(moved[1][0]), moves - moved[2]
    weights[np.abs(weights) < 1e-6] = 0
    return Field(weights, bias, moves)


def calibrate(model: Field, given: DataFrame) -> tuple[float, float, float]:
    """Logistic regression of the document labels on the summaries, on the sample."""

    def summarise(batches: ArrowBatches) -> ArrowBatches:
        for batch in batches:
            logits = model.logits([words_of(t or "") for t in batch.column(0).to_pylist()])
            high, sums = zip(*map(summary, logits), strict=True) if logits else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(high, pa.float64()), pa.array(sums, pa.float64()), batch.column(1)], ["h", "s", "label"])

    rows = np.array(sorted(tuple(r) for r in given.mapInArrow(summarise, "h double, s double, label int").collect()))
    x, y = np.column_stack([np.ones(len(rows)), rows[:, 0] / -NONE, rows[:, 1]]), rows[:, 2]
    found = np.zeros(3)
    for _ in range(30):
        p = sigmoid(x @ found)
        found = found - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3), x.T @ (p - y) + 1e-2 * found)
    return float(found[0]), float(found[1]) / -NONE, float(found[2])


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Field:
    given = sample(docs, labels, F.col("toxic"), size).where("label IN (0, 1)")
    counts = dict(given.groupBy("label").count().collect())
    if len(counts) < 2:
        return Field(np.zeros(BUCKETS + 1), 0.0, np.zeros((2, 2)), constant=float(1 in counts))
    model = train(windows(given, frozenset(lexicon(given))))
    model.calibration = calibrate(model, given)
    return model


def spans_of(text: str, logits: np.ndarray) -> str:
    """start:end of runs of words whose marginal is at least ``SPAN``, comma-joined."""
    if not len(logits) or logits.max() < 0:
        return ""
    found: list[list[int]] = []
    last = -2
    lower = text.lower()
    # Lower-casing can lengthen a character; offsets are of the text itself.
    shift = None if len(lower) == len(text) else np.concatenate([[0], np.cumsum([len(c.lower()) for c in text])])
    for number, match in enumerate(_WORD.finditer(lower)):
        if logits[number] >= np.log(SPAN / (1 - SPAN)):
            start, end = match.span() if shift is None else (int(np.searchsorted(shift, match.start(), "right") - 1), int(np.searchsorted(shift, match.end(), "left")))
            if number == last + 1:
                found[-1][1] = end
            else:
                found.append([start, end])
            last = number
    return ",".join(f"{a}:{b}" for a, b in found)


def tagged(docs: DataFrame, model: Field, predict: float = PREDICT, key: str = "doc_id") -> DataFrame:
    """(key, score, predicted, spans) of every text."""
    kind = dict(docs.select(key).dtypes)[key]

    def tag(batches: ArrowBatches) -> ArrowBatches:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = [t or "" for t in part.column(1).to_pylist()]
                logits = model.logits([words_of(t) for t in texts])
                high, sums = (np.array(c) for c in zip(*map(summary, logits), strict=True))
                score = model.score(high, sums)
                columns = [part.column(0), pa.array(score), pa.array((score >= predict).astype(np.int32)), pa.array(list(map(spans_of, texts, logits)))]
                yield pa.RecordBatch.from_arrays(columns, [key, "score", "predicted", "spans"])

    return docs.select(key, "text").mapInArrow(tag, f"`{key}` {kind}, score double, predicted int, spans string")


def op3_toxic_spans(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = tagged(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted", "spans")


QUERIES = {"op3_toxic_spans": (op3_toxic_spans, None)}
