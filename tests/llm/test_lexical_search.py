import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagetrace.llm import lexical_search as L
from pagetrace.llm.registry import registered
from tests.llm.fixtures import documents, none, odd_documents
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def brute(docs, items, k=20):
    """(item_id, rank, doc_id, score) of every item row, by scoring every document."""
    counts = [(doc_id, Counter(terms(text))) for doc_id, text in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, total = len(counts), sum(c.total() for _, c in counts)
    held = Counter(t for _, c in counts for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, c in counts:
            m = 100 - 25 + (25 * c.total() * n_docs) // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t]
            )
            scored += [(-score, doc_id is None, doc_id or 0, doc_id)] if score > 0 else []
        out += [(item_id, rank, doc_id, -s) for rank, (s, _, _, doc_id) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def asked(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "item_id bigint, text string, item int, terms string")


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_oracle(spark):
    fn, sql = registered()["op13_lexical_search"]
    assert compare(spark, connect(FOLDER), FOLDER, fn, sql)[0] is None


@pytest.mark.parametrize(("seed", "k", "part", "block", "step"), [(1, 20, 10**6, 8192, 64), (2, 3, 10**6, 16, 1), (3, 50, 50, 64, 64)])
def test_brute_force(spark, seed, k, part, block, step, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", block)
    own = random.Random(seed)
    some = [f"t{i}" for i in range(90)] + ["É", "日本", "ÀB", "x" * 40]
    weights = [1 / (i + 1) for i in range(len(some))]
    texts = [own.choice([" ", ", ", "\n"]).join(own.choices(some, weights, k=own.choice([0, 1, 5, 30, 200]))) for _ in range(150)]
    texts += texts[:20] + [None, "", "T1 t1 T2"]
    items = [(i, " ".join(own.choices(some, k=own.choice([1, 4, 12])))) for i in range(12)]
    # More terms than fit one word of bits, repeats of an item, nothing to ask for, unknown terms.
    items += [(50, " ".join(some + some[:10])), (3, "t1 t1 t1 T5"), (51, None), (52, "?"), (53, "unknown words"), (None, "t7 t8")]
    got = found(L.ranked_search(documents(spark, texts), asked(spark, items), k, part))
    assert got == brute(list(enumerate(texts)), items, k)


def test_groups_are_left_out_only_below_the_kth_score():
    """Every document of a skipped group scores less than the last one kept, and ties go to the smaller id."""
    random_ = np.random.default_rng(3)
    lengths = random_.integers(1, 12, 500)
    lists = [np.sort(random_.choice(40, n, replace=False)) for n in lengths]
    flat, counts = np.concatenate(lists), random_.integers(1, 4, lengths.sum())
    block = L.Block(np.full(500, 30), lengths, flat, counts, 500, 15_000)
    evaluated = []
    whole = L.Block.scores

    def watched(rows, weights):
        evaluated.extend(rows.tolist())
        return whole(block, rows, weights)

    block.scores = watched
    ids = random_.permutation(500)
    own = [5, 9, 17, 33]
    best = L.block_best(block, ids, own, [1000, 3000, 10, 7], np.zeros(40, np.int64), 10, step=8)
    weights = np.zeros(40, np.int64)
    weights[own] = [1000, 3000, 10, 7]
    exact = {r: s for r, s in enumerate(whole(block, np.arange(500), weights).tolist()) if s > 0}
    assert best == sorted(exact.items(), key=lambda x: (-x[1], ids[x[0]]))[:10] or best == [(s, r) for r, s in sorted(exact.items(), key=lambda x: (-x[1], ids[x[0]]))[:10]]
    assert len(set(evaluated)) < len(exact)


def test_odd_rows(spark):
    items = [(1, "same text"), (2, "word"), (None, "日本 é")]
    rows = [(r["doc_id"], r["text"]) for r in odd_documents(spark).collect()]
    assert found(L.ranked_search(odd_documents(spark), asked(spark, items))) == brute(rows, items)
    assert L.ranked_search(none(spark), asked(spark, items)).collect() == []
    assert L.ranked_search(odd_documents(spark), asked(spark, items).where("item_id = 9")).collect() == []


def test_one_source_of_equal_documents(spark):
    docs = spark.range(3000).select((3000 - F.col("id")).alias("doc_id"), F.when(F.col("id") < 1000, F.lit("same words")).otherwise(F.concat(F.lit("other "), F.col("id").cast("string"))).alias("text"))
    got = L.ranked_search(docs, asked(spark, [(1, "same")]), k=5).collect()
    assert sorted((r["rank"], r["doc_id"]) for r in got) == [(i, 2000 + i) for i in range(1, 6)]
