import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from pagetrace.llm import decontamination as D
from pagetrace.llm.registry import registered
from tests.llm.fixtures import documents, none, odd_documents
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
#: The contract's words, after A-Z are lower-cased.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id bigint, text string, row int, gram string, class string"


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, size):
    """(n_words, hit words, digest of the items) by comparing every window with every item's."""
    own, hit, ids = words(text), set(), set()
    for item_id, item in items:
        other = words(item)
        n = min(size, len(other))
        grams = {tuple(other[i : i + n]) for i in range(len(other) - n + 1)} if n else set()
        for at in range(len(own) - n + 1):
            if tuple(own[at : at + n]) in grams:
                hit |= set(range(at, at + n))
                ids |= {item_id} - {None}
    return len(own), sorted(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, "g", "c") for i, t in rows], ITEMS)


def found(df):
    return sorted((r["doc_id"], r["_n_words"], r["_hit"], r["_n_items"], r["_items_sha256"]) for r in df.collect())


def test_oracle(spark):
    fn, sql = registered()["op11_benchmark_decontamination"]
    assert compare(spark, connect(FOLDER), FOLDER, fn, sql)[0] is None


@pytest.mark.parametrize(("seed", "size", "part_bytes"), [(1, 3, 2**25), (2, 10, 2**25), (3, 4, 12_000)])
def test_brute_force(spark, seed, size, part_bytes):
    own = random.Random(seed)
    some = ["a", "B", "c9", "É", "straße", "日本", "x" * 40]
    items = [(i, " ".join(own.choice(some) for _ in range(own.choice([1, 2, 5, size, size + 3, 30])))) for i in range(25)]
    items += [(3, "a B other text of the same id"), (100, items[0][1]), (None, items[1][1]), (101, ""), (102, None), (103, "-- !")]
    texts = []
    for _ in range(60):
        parts = [own.choice(items)[1] or "" if own.random() < 0.3 else " ".join(own.choice([*some, "q", "Zz"]) for _ in range(own.randint(0, 15))) for _ in range(own.randint(0, 5))]
        texts.append(own.choice([", ", " \n", "--"]).join(parts))
    docs = documents(spark, [*texts, None, ""])
    got = found(D.scan(docs, items_of(spark, items), ["doc_id"], size, part_bytes))
    assert got == [(i, *brute(t, items, size)) for i, t in enumerate([*texts, None, ""])]


def test_a_passage_in_most_documents_and_a_long_text(spark):
    own = random.Random(5)
    passage = " ".join(f"w{own.randint(0, 9)}" for _ in range(40))
    items = [(i, passage + f" tail{i}") for i in range(30)]
    texts = [f"start {passage} end {i}" for i in range(300)] + [(passage + " between ") * 800]
    docs = documents(spark, texts)
    got = found(D.scan(docs, items_of(spark, items), ["doc_id"]))
    assert got[:2] + got[-1:] == [(i, *brute(texts[i], items, 10)) for i in (0, 1, 300)]
    assert {r[3] for r in got} == {30}


def test_removing_spans_and_documents(spark):
    items = items_of(spark, [(1, "one two three four"), (2, "Solo")])
    docs = documents(spark, ["Keep, one TWO three! four; rest.", "solo", "none here", None, "(one two three four)", "one two three"])
    spans = {r["doc_id"]: r["text"] for r in D.without_spans(docs, items).collect()}
    assert spans == {0: "Keep, rest.", 1: "", 2: "none here", 3: None, 4: "(", 5: "one two three"}
    assert D.without_spans(docs, items).columns == docs.columns
    assert sorted(r["doc_id"] for r in D.without_documents(docs, items).collect()) == [2, 3, 5]
    assert sorted(r["doc_id"] for r in D.without_documents(docs, items, share=0.7).collect()) == [0, 2, 3, 5]
    # What is left holds no window any more, unless cutting joins the rest into one.
    left = documents(spark, [spans[i] for i in range(6)])
    assert D.scan(left, items, ["doc_id"]).where(F.size("_hit") > 0).count() == 0


def test_odd_rows(spark):
    items = items_of(spark, [(1, "same text here"), (2, "日本"), (2, "\U0001f600 日本"), (None, None)])
    got = D.scan(odd_documents(spark), items, ["doc_id", "row", "_base"]).collect()
    assert len(got) == 10 and all(r["row"] in (1, None) for r in got)
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append((r["_n_words"], r["_hit"], r["_n_items"]))
    assert by_id[3].count((3, [0, 1, 2], 1)) == 2 and by_id[4] == [(3, [0, 1, 2], 1)]
    # The smiley is a word of its own; é and 日本 as well.
    assert by_id[6] == [(4, [1, 2], 1)]
    assert sorted(by_id[None]) == [(0, [], 0), (2, [], 0)] and by_id[5] == [(30_001, [], 0)]
    assert D.scan(none(spark), items, ["doc_id"]).collect() == []
    nothing = D.scan(odd_documents(spark), items.where("item_id > 5"), ["doc_id"]).collect()
    assert len(nothing) == 10 and all(r["_hit"] == [] for r in nothing)


def test_no_python_in_the_plan(spark):
    fn, _ = registered()["op11_benchmark_decontamination"]
    plan = fn(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
