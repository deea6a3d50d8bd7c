import numpy as np
import pyarrow.parquet as pq
import pytest

from pagetrace.llm import embedding_dedup as D
from pagetrace.llm.registry import registered
from tests.llm.fixtures import odd_vectors

SCHEMA = "vec_id bigint, embedding array<double>, v int, cid string, list int"


def brute(ids, x, cosine=0.95):
    """Rows as the operator returns them, by all pairs and merging of sets."""
    units = x / np.linalg.norm(x, axis=1)[:, None]
    linked = units @ units.T >= cosine
    np.fill_diagonal(linked, False)
    label = np.array(ids)
    while True:
        least = np.minimum(label, np.where(linked, label[None], np.iinfo(np.int64).max).min(1))
        if (least == label).all():
            break
        label = least
    return sorted((i, int(n), int(c), i == c) for i, n, c in zip(ids, linked.sum(1), label.tolist(), strict=True))


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.1"
    table = pq.read_table(f"{folder}/embeddings.parquet").to_pylist()
    want = brute([r["vec_id"] for r in table], np.array([r["embedding"] for r in table], float))
    assert found(registered()["op8_embedding_near_dedup"][0](spark, folder)) == want


@pytest.mark.parametrize("lists", [1, 8, 64])
def test_recall_on_groups_of_near_copies(spark, lists, monkeypatch):
    monkeypatch.setattr(D, "TILE", 100)
    monkeypatch.setattr(D, "GROUP", 150)
    random = np.random.default_rng(lists)
    centres = random.normal(size=(300, 32))
    near = [c + random.normal(size=32) * s * np.linalg.norm(c) / 32**0.5 for c in centres[:60] for s in (0.05, 0.15, 0.22, 0.3)]
    hot = [centres[0] + random.normal(size=32) * 0.1 for _ in range(400)]
    x = np.array([*centres, *near, *hot, *[centres[1]] * 200])
    rows = [(i, v.tolist(), 1, "c", 0) for i, v in enumerate(x)]
    result = found(D.near_duplicates(spark.createDataFrame(rows, SCHEMA), lists=lists, sample=256))
    want = brute(list(range(len(x))), x)
    links, reached = sum(r[1] for r in want), sum(r[1] for r in result)
    # No link below the threshold, and all but a few of those above it.
    assert all(a[1] <= b[1] for a, b in zip(result, want, strict=True))
    assert reached >= 0.99 * links
    assert sum(a[2] == b[2] for a, b in zip(result, want, strict=True)) >= 0.99 * len(x)


def test_each_length_and_any_size_of_numbers(spark):
    """Vectors meet those of their own length, be it frequent or not, and squares may leave the doubles."""
    rows = [(0, [1.0, 2.0, 3.0]), (1, [3.0, 2.0, 1.0]), (2, [1.0, 2.0, 3.01]), (3, [1.0, 2.0]), (4, [1.0, 2.0]), (5, [2.0, 4.001]), (6, [7.0])]
    rows += [(7, [1e200, 2e200, 3e200]), (8, [1e-200, 2e-200, 3e-200]), (9, [-1e300, 0.0, 1e10])]
    df = spark.createDataFrame([(i, v, 1, "c", 0) for i, v in rows], SCHEMA)
    want = [(0, 3, 0, True), (1, 0, 1, True), (2, 3, 0, False), (3, 2, 3, True), (4, 2, 3, False), (5, 2, 3, False), (6, 0, 6, True)]
    assert found(D.near_duplicates(df)) == [*want, (7, 3, 0, False), (8, 3, 0, False), (9, 0, 9, True)]


def test_odd_rows(spark):
    rows = {}
    for r in D.near_duplicates(odd_vectors(spark)).collect():
        rows.setdefault(r["vec_id"], []).append(tuple(r)[1:])
    assert rows[0] == [(4, 0, True)] and rows[1] == [(4, 0, False)] * 2
    assert rows[2] == [(4, 0, False)] and rows[100] == [(4, 0, False)]
    assert rows[None] == [(0, None, False)]
    for alone in (3, 4, 5, 6, 7, 8, 9, 10):
        assert rows[alone] == [(0, alone, True)]
    assert D.near_duplicates(odd_vectors(spark).where("vec_id > 1000")).collect() == []
    assert found(D.near_duplicates(odd_vectors(spark).where("vec_id IN (4, 5)"))) == [(4, 0, 4, True), (5, 0, 5, True)]
    assert found(D.near_duplicates(odd_vectors(spark).where("vec_id = 3"))) == [(3, 0, 3, True)]
