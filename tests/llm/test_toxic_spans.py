import math
import random
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagetrace.llm import toxic_spans as T
from pagetrace.llm.registry import registered
from tests.llm.fixtures import documents, none, odd_documents


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    rows = registered()["op3_toxic_spans"][0](spark, folder)
    assert rows.count() == 1000
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    own = rows.join(labels, "doc_id").where("held_out").collect()
    toxic, clean = ([r["score"] for r in own if r["toxic"] == k] for k in (1, 0))
    wins = np.mean([(a > b) + 0.5 * (a == b) for a in toxic for b in clean])
    assert wins > 0.8
    assert sum(r["predicted"] for r in own if r["toxic"] == 0) <= 0.05 * len(clean)
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in own)
    held = rows.select("doc_id", "held_out").limit(50).collect()
    from zlib import crc32

    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in held)


def test_marginals_equal_enumeration():
    random_ = np.random.default_rng(3)
    model = T.Field(np.zeros(T.BUCKETS + 1), 0.0, random_.normal(size=(2, 2)))
    texts = [[f"w{random_.integers(9)}" for _ in range(n)] for n in (5, 0, 1, 7, 3)]
    model.known = {f"w{i}": float(v) for i, v in enumerate(random_.normal(size=9) * 2)}
    for words, logits in zip(texts, model.logits(texts), strict=True):
        mass = np.zeros((len(words), 2))
        for path in np.ndindex(*[2] * len(words)):
            weight = np.exp(sum(model.known[w] * s for w, s in zip(words, path, strict=True)) + sum(model.moves[a, b] for a, b in zip(path, path[1:], strict=False)))
            for t, s in enumerate(path):
                mass[t, s] += weight
        assert len(logits) == len(words) and np.allclose(logits, np.log(mass[:, 1] / mass[:, 0]) if len(words) else 0)


def toxic_corpus(spark, n=400):
    own = random.Random(1)
    texts, labels = [], []
    for i in range(n):
        words = [own.choice(["alpha", "beta", "gamma", "delta"]) + own.choice("abcdefgh") for _ in range(60)]
        if i % 4 == 0:
            words[own.randrange(60)] = "nastyxx" + own.choice("abcdefgh")
        texts.append(" ".join(words) + ".")
        labels.append((i, None if i == 1 else 1, int(i % 4 == 0) if i != 3 else None, "extra"))
    return documents(spark, texts), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int, score string")


def test_spans_are_offsets_in_the_text(spark):
    docs, labels = toxic_corpus(spark)
    model = T.fit(docs, labels)
    probe = documents(spark, ["İİ alphaa NASTYXXz betab nastyxxq nastyxxr", "alphaa betab", "", None])
    rows = {r["doc_id"]: r for r in T.tagged(probe, model).collect()}
    assert rows[0]["spans"] == "10:18,25:42" and rows[0]["score"] > 0.9 and rows[0]["predicted"] == 1
    assert rows[1]["spans"] == "" and rows[1]["score"] < 0.3
    assert rows[2]["score"] == rows[3]["score"] < 0.3


def test_fits_agree_and_odd_rows(spark):
    docs, labels = toxic_corpus(spark)
    first, again = T.fit(docs, labels), T.fit(docs.repartition(7), labels.repartition(3))
    assert np.allclose(first.weights, again.weights) and np.allclose(first.calibration, again.calibration)
    assert T.tagged(odd_documents(spark), first).count() == 10
    assert T.tagged(none(spark), first).collect() == []


def test_without_both_labels(spark):
    docs, labels = toxic_corpus(spark, 40)
    for given, score in ((labels.limit(0), 0.0), (labels.where("toxic = 1"), 1.0), (labels.withColumn("toxic", F.lit(0)), 0.0)):
        assert {r["score"] for r in T.tagged(docs, T.fit(docs, given)).collect()} == {score}
    assert T.fit(none(spark), labels).constant == 0.0


def plain_marginals(words, model):
    """P(toxic) of each word by the textbook recursions in logarithms, from the weights."""
    out = []
    if not words:
        return out
    parts = lambda w: ["=" + w, *(w[:n] for n in (4, 5, 6) if len(w) > n), "~" + w[-3:]]
    toxic = [model.bias + sum(model.weights[crc32(p.encode()) % T.BUCKETS] for p in parts(w)) for w in words]
    emit = [(0.0, e) for e in toxic]
    add = np.logaddexp
    ahead, back = [emit[0]], [(0.0, 0.0)]
    for e in emit[1:]:
        a = ahead[-1]
        ahead.append(tuple(e[s] + add(a[0] + model.moves[0][s], a[1] + model.moves[1][s]) for s in (0, 1)))
    for e in emit[:0:-1]:
        b = back[0]
        back.insert(0, tuple(add(model.moves[s][0] + e[0] + b[0], model.moves[s][1] + e[1] + b[1]) for s in (0, 1)))
    for a, b in zip(ahead, back, strict=True):
        whole = add(a[0] + b[0], a[1] + b[1])
        out.append((a[0] + b[0] - whole, a[1] + b[1] - whole))
    return out


def test_every_row_equals_a_plain_scorer(spark):
    """Score, decision and offsets of all rows from the fitted weights, word by word."""
    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    model = T.fit(docs, labels)
    got = {r["doc_id"]: r for r in T.tagged(docs, model).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for row in rows:
        text = row["text"]
        found = [(m.start(), m.end(), m.group()) for m in T._WORD.finditer(text.lower())] if len(text.lower()) == len(text) else None
        words = [w for _, _, w in found] if found is not None else T.words_of(text)
        marginals = plain_marginals(words, model)
        high, sums = T.summary(np.array([t - o for o, t in marginals]))
        a, b, c = model.calibration
        score = 1 / (1 + math.exp(-max(-60, min(60, a + b * high + c * sums))))
        own = got[row["doc_id"]]
        assert own["score"] == pytest.approx(score, abs=1e-6) and own["predicted"] == int(own["score"] >= 0.3)
        if found is not None:
            spans = []
            for (start, end, _), (o, t) in zip(found, marginals, strict=True):
                if t - o >= 0:
                    spans.append((start, end))
            joined = own["spans"].split(",") if own["spans"] else []
            covered = [(s, e) for s, e in spans if any(int(x.split(":")[0]) <= s and e <= int(x.split(":")[1]) for x in joined)]
            # Words at exactly one half may fall to either side by rounding.
            assert covered == spans or any(abs(t - o) < 1e-6 for o, t in marginals)
