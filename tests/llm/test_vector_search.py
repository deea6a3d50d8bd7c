import numpy as np
import pytest

from pagetrace.llm import vector_search as V
from pagetrace.llm.registry import registered
from tests.llm.fixtures import odd_vectors
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


def test_oracle(spark):
    fn, sql = registered()["op10_vector_search"]
    assert compare(spark, connect(FOLDER), FOLDER, fn, sql)[0] is None


def brute(rows, queries, k):
    """From (id, whole numbers): (query, rank, id, score)."""
    out = []
    for q, x in queries:
        scored = sorted((-sum(a * b for a, b in zip(x, v, strict=False)), i) for i, v in rows if i != q)[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize(("k", "copies"), [(1, 1), (3, 40), (10, 200), (50, 5)])
def test_ties_and_hot_vectors(spark, k, copies, monkeypatch):
    random = np.random.default_rng(k)
    values = random.integers(-3, 4, (60, 5)).astype(float).tolist()
    rows = [(i, v) for i, v in enumerate([values[0]] * copies + values)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = V.top_k(df, df.where("vec_id % 7 = 0"), k, scale=1)
    whole = [(i, [int(x) for x in v]) for i, v in rows]
    assert sorted(tuple(r) for r in found.collect()) == brute(whole, [r for r in whole if r[0] % 7 == 0], k)


def test_bounds_hold_for_wide_and_large_components():
    random = np.random.default_rng(5)
    for scale in (10, 10**4, 2**28):
        exact = random.integers(-scale, scale + 1, (300, 8))
        queries = random.integers(-scale, scale + 1, (20, 8))
        block = V.Block(exact, np.zeros(0), [[i] for i in range(300)])
        scores = queries.astype(object) @ exact.T.astype(object)
        exactly = scores.astype(float)
        assert (block.bounds(queries) >= exactly - np.abs(exactly) * 1e-15).all()
        best = V.block_best(block, queries, np.full(20, -1), 10, step=4)
        want = [(q, i, s) for q in range(20) for s, i in sorted(((scores[q][i], i) for i in range(300)), key=lambda t: (-t[0], t[1]))[:10]]
        assert best == want


def test_large_components_are_not_clamped(spark):
    rows = [(0, [1.0]), (1, [300_000.0]), (2, [400_000.0]), (3, [-400_000.0]), (4, [2.0**40])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = sorted(tuple(r) for r in V.top_k(df, df.where("vec_id = 0")).collect())
    assert found == [(0, 1, 4, 2**60), (0, 2, 2, 419_430_400_000), (0, 3, 1, 314_572_800_000), (0, 4, 3, -419_430_400_000)]
    # What does not fit 64 bits is an error, not a wrong number.
    for bad in ("vec_id = 4", "vec_id = 9"):
        more = df.union(spark.createDataFrame([(9, [1e30])], df.schema)) if bad == "vec_id = 9" else df
        with pytest.raises(Exception, match="2\\^61|64 bits"):
            V.top_k(more, more.where("vec_id = 4")).collect()


def test_exact_scores_beyond_64_bits_of_the_sum_of_sizes():
    rows = np.array([[2**31, -(2**31)], [2**31, 2**30]], np.int64)
    assert V._exact_scores(rows, np.array([2**31, 2**31], np.int64)) == [0, 2**62 + 2**61]
    with pytest.raises(OverflowError):
        V._exact_scores(np.array([[2**40]]), np.array([2**40]))


def test_odd_rows(spark):
    found = V.top_k(odd_vectors(spark), odd_vectors(spark).where("vec_id % 100 = 0"))
    rows = [tuple(r) for r in found.collect()]
    taking = {0, 1, 2, 3, 5, 9, 10, 100}
    assert {r[0] for r in rows} == {0, 100} and {r[2] for r in rows} == taking
    assert all(r[0] != r[2] for r in rows)
    assert sum(r[2] == 1 and r[0] == 0 for r in rows) == 2
    nothing = odd_vectors(spark).where("vec_id > 1000")
    assert V.top_k(nothing, nothing).collect() == []
    assert V.top_k(odd_vectors(spark), nothing).collect() == []
