import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from pagetrace.llm import importance as I
from pagetrace.llm.registry import registered
from pagetrace.llm.words import word_lists
from tests.llm.fixtures import documents, none, odd_documents
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def buckets(text):
    own = words(text)
    features = own + [f"{a} {b}" for a, b in zip(own, own[1:], strict=False)]
    return [crc32(f.encode()) % 10000 for f in features]


def brute(docs, target, percent=25, least=20):
    """{doc_id: (n_features, weight, score, rank)} from the contract's words."""
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(buckets(text))
    for text in target:
        t.update(buckets(text))
    s_all, t_all = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for b in range(10000)}
    out, drawable = {}, []
    for doc_id, text in docs:
        own = buckets(text)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[doc_id] = [len(own), weight, score, None]
        if len(words(text)) >= least:
            drawable.append((-score, doc_id))
    for rank, (_, doc_id) in enumerate(sorted(drawable)[: percent * len(drawable) // 100], 1):
        out[doc_id][3] = rank
    return {k: tuple(v) for k, v in out.items()}


def test_oracle(spark):
    fn, sql = registered()["op12_importance_resampling"]
    assert compare(spark, connect(FOLDER), FOLDER, fn, sql)[0] is None


@pytest.mark.parametrize(("seed", "percent"), [(1, 25), (2, 100), (3, 1)])
def test_brute_force(spark, seed, percent):
    own = random.Random(seed)
    some = ["a", "B", "c9", "É", "straße", "日本", "x" * 40, "the", "of"]
    texts = [own.choice([" ", ", ", "\n"]).join(own.choice(some) for _ in range(own.choice([0, 3, 19, 20, 60]))) for _ in range(150)] + [None]
    target = ["the of the É 日本", None, "", "c9 c9 c9"]
    docs = documents(spark, texts)
    found = I.resample(docs, documents(spark, target), percent).collect()
    assert {r["doc_id"]: (r["n_features"], r["weight"], r["score"], r["rank"]) for r in found} == brute(list(enumerate(texts)), target, percent)


@pytest.mark.parametrize("wanted", [0, 1, 7, 300, 301, 600, 999, 1000, 5000])
def test_cutoff_among_ties(spark, wanted):
    rows = spark.range(1000).select((-F.col("id") % 3).alias("score"), (F.col("id") % 10 * 10**12).alias("doc"), "id")
    cut = I.cutoff(rows, ["score", "doc", "id"], wanted, at_once=3)
    if wanted == 0:
        assert cut is None
        return
    taken = sorted((r["score"], r["doc"], r["id"]) for r in rows.collect())[:wanted]
    everything = sorted((r["score"], r["doc"], r["id"]) for r in rows.collect())
    assert [r for r in everything if list(r[: len(cut)]) <= cut] == taken


def test_ranks_follow_the_keys_over_partitions(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("a"), F.lit(1).alias("b"))
    found = I.ranked(rows, ["b", "a"]).collect()
    assert all(r["_rank"] == r["a"] + 1 for r in found) and len(found) == 5000


@pytest.mark.parametrize("piece", [1, 5, 64])
def test_pieces_of_long_texts_give_the_same_features(piece, monkeypatch):
    own = random.Random(piece)
    text = " ".join(own.choice(["a", "bc", "É", "x" * 30, "--"]) for _ in range(200))
    assert [w.decode() for part in word_lists(text, piece) for w in part] == words(text)
    monkeypatch.setattr("pagetrace.llm.importance.word_lists", lambda t: word_lists(t, piece))
    found = list(I.feature_buckets(text))
    assert sum(n for n, _ in found) == len(words(text))
    assert sorted(b for _, part in found for b in part.tolist()) == sorted(buckets(text))


def test_odd_rows(spark):
    found = I.resample(odd_documents(spark), odd_documents(spark), percent=100).collect()
    assert len(found) == 10 and [r["rank"] for r in found if r["rank"] is not None] == [1]
    assert all((r["n_features"], r["weight"]) == (0, 0) for r in found if r["doc_id"] in (1, 2))
    assert I.resample(none(spark), none(spark)).collect() == []
    # Rows of one id and one text are drawn as rows.
    docs = documents(spark, ["w " * 30] * 8).withColumn("doc_id", F.lit(None).cast("bigint"))
    ranks = sorted(r["rank"] or 0 for r in I.resample(docs, none(spark), percent=50).collect())
    assert ranks == [0, 0, 0, 0, 1, 2, 3, 4]
