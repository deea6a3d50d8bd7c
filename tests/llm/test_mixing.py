import random

import pytest

from pagetrace.llm import mixing as M
from pagetrace.llm.registry import registered
from tests.llm.fixtures import documents, none, odd_documents
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


def shared_again(sizes, cycle=3, most=3):
    """Targets by sharing the excess by weight until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % cycle + 1 for i, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, 0.0), float(sum(sizes.values())), set(order)
    while left > 1e-9 and open_:
        whole = sum(weight[s] for s in open_)
        given = {s: left * weight[s] / whole for s in open_}
        left = 0.0
        for s, g in given.items():
            target[s] += g
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = float(most * sizes[s])
                open_.discard(s)
    return target


def test_oracle(spark):
    fn, sql = registered()["op6_mix_sources"]
    assert compare(spark, connect(FOLDER), FOLDER, fn, sql)[0] is None


@pytest.mark.parametrize("seed", range(6))
def test_targets_equal_repeated_sharing(spark, seed):
    own = random.Random(seed)
    sizes = {f"s{i}": own.choice([0, 1, 5, 50, 1000]) for i in range(own.randint(1, 12))} | ({None: 7} if seed % 2 else {})
    given = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    found = {r["source"]: r["target"] for r in M.source_targets(given).collect()}
    assert found == pytest.approx(shared_again(sizes))


def taken(df):
    return [(r["doc_id"], r["source"], r["_size"], r["_target"], r["_copies"]) for r in df.collect()]


def test_sources_come_near_their_targets_and_reruns_agree(spark):
    own = random.Random(1)
    sources = [own.choice("aaaaaabcd") for _ in range(900)]
    docs = documents(spark, ["w " * own.choice([3, 20, 100, 400]) for _ in sources], sources)
    first = taken(M.mix(docs, ["doc_id", "source"]))
    assert sorted(first) == sorted(taken(M.mix(docs.repartition(5), ["doc_id", "source"])))
    for s in "abcd":
        rows = [r for r in first if r[1] == s]
        # Half of a document that could still be added or left out.
        assert abs(sum(r[2] * r[4] for r in rows) - rows[0][3]) <= 200
    assert max(r[4] for r in first) <= M.MOST
    assert sorted(first) != sorted(taken(M.mix(docs, ["doc_id", "source"], seed=8)))


def test_weights_bend_inclusion(spark):
    from pyspark.sql import functions as F

    docs = documents(spark, ["w " * 10] * 600, ["a"] * 300 + ["b"] * 300)
    mixed = M.mix(docs, ["doc_id", "source"], weight=F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0)).collect()
    even, odd = (sum(r["_copies"] for r in mixed if r["source"] == "b" and r["doc_id"] % 2 == k) for k in (0, 1))
    assert even > odd


def test_odd_rows(spark):
    found = M.mix(odd_documents(spark), ["doc_id", "source"]).collect()
    assert len(found) == 10 and {r["source"] for r in found} == {None, "s", "t"}
    assert all(0 <= r["_copies"] <= 3 for r in found)
    assert M.mix(none(spark), ["doc_id"]).collect() == []
