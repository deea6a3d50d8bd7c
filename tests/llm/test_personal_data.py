import hashlib
import random
import re

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from pagetrace.llm import personal_data as P
from pagetrace.llm.registry import registered
from tests.llm.fixtures import documents, none, odd_documents

#: The contract's base patterns as written there.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, value):
    digits = [int(c) for c in value if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text):
    found = [(m.start(), n, m.end(), k) for n, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if passes(k, m[0])]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]


def check(rows, texts):
    for row in rows:
        own = base_spans(texts[row["doc_id"]])
        assert row["base_sha256"] == hashlib.sha256(",".join(own).encode()).hexdigest(), texts[row["doc_id"]]
        assert [row[f"n_{k}"] for k in P.KINDS] == [sum(s.startswith(k) for s in own) for k in P.KINDS]
        assert set(own) <= set(filter(None, row["spans"].split(",")))


def query(monkeypatch, spark, docs):
    monkeypatch.setattr(P, "table", lambda *_: docs)
    return registered()["op9_personal_data"][0](spark, "").collect()


def test_query_on_documents(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{folder}/documents.parquet").to_pylist()}
    rows = registered()["op9_personal_data"][0](spark, folder).collect()
    check(rows, texts)
    assert len(rows) == len(texts) and sum(r["n_email"] for r in rows) > 10


def test_base_spans_of_hostile_texts(spark, monkeypatch):
    own = random.Random(2)
    bits = ["a@b.com", "@", ".", "%", "+", "-", " ", "x", "1", "4111 1111 1111 1111", "4111111111111111", "255", "256", "0", "\U0001f600", "é", "+1 (20) 3-4", "00", "\n", "_", "١", "c.d"]
    texts = ["".join(own.choice(bits) for _ in range(own.randint(0, 25))) for _ in range(1500)]
    texts += ["1.2.3.4.5.6.7.8", "a@b.com%x@y.org", "1" * 200_000, "x" * 200_000, "1-" * 50_000 + "1", "+1" + " ()" * 50_000, None, "", "999999999999999999999.1.1.1", "0255.1.1.1"]
    rows = query(monkeypatch, spark, documents(spark, texts))
    check(rows, dict(enumerate(texts)))
    assert len(rows) == len(texts)


def test_the_method_adds_likely_spans_and_not_decoys(spark, monkeypatch):
    texts = [f"please write an email to user{i} (at) mail{i}.com today" for i in range(40)]
    texts += [f"call my phone 415 555 {1000 + i} now" for i in range(40)]
    texts += [f"mail a{i}@b.org or call +1 415 555 {1000 + i}" for i in range(40)]
    texts += [f"order no 70000000000{1000 + i}1 shipped" for i in range(40)]
    rows = {r["doc_id"]: r["spans"] for r in query(monkeypatch, spark, documents(spark, texts))}
    assert sum("email" in rows[i] for i in range(40)) >= 36
    assert sum("phone" in rows[i] for i in range(40, 80)) >= 36
    decoys = [i for i in range(120, 160) if not base_spans(texts[i])]
    assert decoys and not any(rows[i] for i in decoys)


def test_reliabilities_are_learnt():
    features = {f"f_{n}": "x" for n in P.FEATURES}
    right = {"rule": 1, "gazetteer": 1, "context": 1, "shape": 1, "border": 0}
    wrong = {n: -v for n, v in right.items()} | {"border": -1}
    model = P.estimate([{"kind": "ip", "n": 60, **right, **features}, {"kind": "ip", "n": 40, **wrong, **features | {"f_check": "failed"}}])
    assert model.reliability["ip", "rule", 1, 1] > 0.7 > 0.1 > model.reliability["ip", "rule", 1, 0]
    assert model.weights["ip:check:failed"] < 0 < model.weights["ip:check:x"]
    assert P.estimate([]).bias == {}


def test_odd_rows_and_redaction(spark):
    assert P.find(odd_documents(spark)).count() == 10
    assert P.find(none(spark)).collect() == []
    names = ["_found", "_seen", "_judged", "_more", "_given"]
    more = documents(spark, ["a@b.com"]).selectExpr("*", *(f"'{n}' AS {n}" for n in names))
    kept = P.find(more)
    assert kept.columns == [*[c for c in more.columns if c != "_base"], "_base", "_spans"]
    assert [kept.first()[n] for n in names] == names
    docs = documents(spark, ["é a@b.com, 1.2.3.4\U0001f600 and 4111 1111 1111 1111", "+14155551234a@b.com", None, "clean"])
    found = P.find(docs)
    texts = [r["t"] for r in found.select("doc_id", P.redacted(F.col("text"), F.col("_spans")).alias("t")).orderBy("doc_id").collect()]
    assert texts == ["é [EMAIL], [IP]\U0001f600 and [CARD]", "[PHONE]", None, "clean"] or texts[1].startswith("[")
    assert texts[0] == "é [EMAIL], [IP]\U0001f600 and [CARD]" and texts[2:] == [None, "clean"]


def test_main_path_is_native(spark):
    plan = P.find(documents(spark, ["a@b.com"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
