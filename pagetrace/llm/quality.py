"""Quality by ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades, and ordered thresholds cut
its score: P(grade <= k) = logistic(threshold k - score). Features are relative frequencies of
words and of word shapes (runs of letters, capitals and digits as one character each), and
bucketed figures of the whole text: how often words repeat, their length, the share of marks,
capitals and digits, lines and size. A document gets its expected grade and the probability of
each tail; selection keeps those whose tail probability at a grade is high enough.

Grades here: 0 low quality, 1 usable but toxic, 2 good; documents are kept at grade 1 or more.
Fitting reads a bounded sample of labelled documents (``sample``), held-out rows never; all
texts are scored, whole. Null and empty texts have no word, and the figures of an empty text.
Without two grades in the sample nothing is learnt: every document has the expected grade of
the sample (the highest without labels) and is kept. Equal rows get equal scores; an empty table gives
no row; null ids count as not held out. Extra columns stay untouched.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from pagetrace.llm.common import ArrowBatches, held_out, sigmoid, table
from pagetrace.llm.labelled import SAMPLE, sample

BUCKETS = 1 << 14
GRADES = 3
KEEP_AT = 1
KEEP = 0.5
CACHE = 100_000
#: What a text's figures weigh beside its words, whose frequencies sum to one.
FIGURE = 0.5

_CLASSES = bytes(
    ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else ord("0") if 48 <= b <= 57 else b for b in range(256)
)
_RUNS = re.compile(rb"a{2,}|A{2,}|0{2,}|([^\sa0A])\1+")


def _bucket(name: str) -> int:
    return crc32(name.encode()) % BUCKETS


def _level(share: float) -> int:
    """Twenty steps on a square-root scale."""
    return min(20, int(20 * share**0.5))


def counted(text: str) -> tuple[Counter, Counter, list[str]]:
    """Words, shapes, and the names of the whole text's figures."""
    row = text.lower().split()
    words = Counter(row)
    classes = text.encode().translate(_CLASSES)
    shapes = Counter(_RUNS.sub(lambda m: m[0][:1], classes).split())
    total, size = words.total(), max(1, len(classes))
    letters, capitals, digits, spaces = (classes.count(c) for c in (b"a", b"A", b"0", b" "))
    figures = {
        "different": _level(len(words) / max(1, total)),
        "common": _level(words.most_common(1)[0][1] / total if total else 0),
        "again": _level(sum(map(eq, row, row[1:])) / max(1, total)),
        "long": min(20, size // max(1, total)),
        "capitals": _level(capitals / size),
        "digits": _level(digits / size),
        "marks": _level(max(0, size - letters - capitals - digits - spaces) / size),
        "shape": _level(shapes.most_common(1)[0][1] / total if total else 0),
        "lines": _level(text.count("\n") / max(1, total)),
        "size": total.bit_length(),
    }
    return words, shapes, [f"{n}:{v}" for n, v in figures.items()]


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values, each bucket once."""
    words, shapes, figures = counted(text)
    total = max(1, words.total())
    found: dict[int, float] = {}
    for prefix, counts in (("w", words), ("s", {k.decode("ascii", "replace"): n for k, n in shapes.items()})):
        for name, n in counts.items():
            b = _bucket(prefix + name)
            found[b] = found.get(b, 0.0) + n / total
    for name in figures:
        b = _bucket("f" + name)
        found[b] = found.get(b, 0.0) + FIGURE
    return np.fromiter(found, np.int32, len(found)), np.fromiter(found.values(), np.float32, len(found))


@dataclass
class Ordinal:
    """Shared weights and ordered thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray
    known: dict[str, float] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def _of(self, name: str) -> float:
        found = self.known.get(name)
        if found is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            found = self.known[name] = float(self.weights[_bucket(name)])
        return found

    def score(self, text: str) -> float:
        words, shapes, figures = counted(text)
        total = max(1, words.total())
        found = sum(self._of("w" + w) * n for w, n in words.items()) + sum(self._of("s" + s.decode("ascii", "replace")) * n for s, n in shapes.items())
        return found / total + FIGURE * sum(self._of("f" + f) for f in figures)

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, .., a column each."""
        return 1 - sigmoid(self.thresholds[None] - scores[:, None])


def train(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, rounds: int = 250, decay: float = 3e-4) -> Ordinal:
    """Maximum likelihood by Adam on all rows; thresholds are the first and logarithms of the steps."""
    owner = np.repeat(np.arange(len(rows)), [len(b) for b, _ in rows])
    bucket, value = (np.concatenate([r[k] for r in rows]) for k in (0, 1))
    share = np.bincount(grades, minlength=GRADES) / len(grades)
    start = np.clip(np.cumsum(share)[:-1], 0.01, 0.99)
    start = np.maximum.accumulate(np.log(start / (1 - start)))
    free = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 0.05))])
    weights = np.zeros(BUCKETS)
    state = [(np.zeros_like(weights), np.zeros_like(weights)), (np.zeros_like(free), np.zeros_like(free))]
    at = np.arange(len(grades))
    for step in range(1, rounds + 1):
        thresholds = np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))])
        scores = np.bincount(owner, weights[bucket] * value, len(rows))
        # Cumulative probabilities with 0 before the first grade and 1 behind the last.
        below = np.column_stack([np.zeros(len(rows)), sigmoid(thresholds[None] - scores[:, None]), np.ones(len(rows))])
        steep = below * (1 - below)
        chance = np.maximum(below[at, grades + 1] - below[at, grades], 1e-9)
        by_score = (steep[at, grades + 1] - steep[at, grades]) / chance
        by_threshold = np.array([(steep[:, k + 1] * ((grades == k + 1).astype(float) - (grades == k)) / chance).sum() for k in range(GRADES - 1)])
        slopes = [
            np.bincount(bucket, by_score[owner] * value, BUCKETS) / len(rows) + decay * weights,
            np.concatenate([[by_threshold.sum()], np.cumsum(by_threshold[::-1])[::-1][1:] * np.exp(free[1:])]) / len(rows),
        ]
        moved = []
        for (first, second), own in zip(state, slopes, strict=True):
            first += 0.1 * (own - first)
            second += 0.01 * (own**2 - second)
            moved.append(0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8))
        weights, free = weights - moved[0], free - moved[1]
    return Ordinal(weights.astype(np.float64), np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))]))


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 low quality, 1 usable but toxic, 2 good."""
    toxic = F.coalesce(F.col("toxic"), F.lit(0))
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, F.when(toxic == 1, 1).otherwise(2)).alias("grade"))


def fit(docs: DataFrame, ratings: DataFrame, size: int = SAMPLE) -> Ordinal:
    """From docs (doc_id, text) and ratings (doc_id, grade)."""

    def take(batches: ArrowBatches) -> ArrowBatches:
        for batch in batches:
            found = [features(t or "") for t in batch.column(0).to_pylist()]
            columns = [pa.array([f[k].tobytes() for f in found], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(1)], ["b", "v", "grade"])

    given = sample(docs, ratings, F.col("grade"), size).where(F.col("label").between(0, GRADES - 1))
    rows = sorted((bytes(r["b"]), bytes(r["v"]), r["grade"]) for r in given.mapInArrow(take, "b binary, v binary, grade int").collect())
    grades = np.array([g for _, _, g in rows], np.int64)
    if len(set(grades.tolist())) < 2:
        own = int(grades[0]) if len(grades) else GRADES - 1
        return Ordinal(np.zeros(BUCKETS), np.array([-60.0 if k <= own else 60.0 for k in range(1, GRADES)]))
    return train([(np.frombuffer(b, np.int32), np.frombuffer(v, np.float32)) for b, v, _ in rows], grades)


def scored(docs: DataFrame, model: Ordinal) -> DataFrame:
    """docs with ``_expected`` grade and ``_tail`` probability of being kept; columns of these names are replaced."""
    docs = docs.drop("_expected", "_tail")
    names = docs.columns
    kinds = StructType([*docs.schema.fields]).add("_expected", DoubleType()).add("_tail", DoubleType())
    text = names.index("text")

    def rate(batches: ArrowBatches) -> ArrowBatches:
        for batch in batches:
            tails = model.tails(np.array([model.score(t or "") for t in batch.column(text).to_pylist()], np.float64))
            columns = [*batch.columns, pa.array(tails.sum(axis=1)), pa.array(tails[:, KEEP_AT - 1])]
            yield pa.RecordBatch.from_arrays(columns, [*names, "_expected", "_tail"])

    return docs.mapInArrow(rate, kinds)


def op7_ordinal_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, graded(table(spark, sf_dir, "labels")))
    return scored(docs, model).select(
        "doc_id",
        held_out().alias("held_out"),
        F.col("_expected").alias("expected_grade"),
        F.col("_tail").alias("tail_probability"),
        (F.col("_tail") >= KEEP).alias("kept"),
    )


QUERIES = {"op7_ordinal_quality": (op7_ordinal_quality, None)}
