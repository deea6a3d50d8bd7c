import re

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

from pagetrace.llm import simhash as S
from pagetrace.llm.registry import registered
from tests.llm.fixtures import documents, none, odd_documents

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text, shingle=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = _WORD.findall(lowered)
    shingles = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius):
    """From {id: fingerprint}: smallest id reachable, by repeated merging of sets."""
    groups = [{i} for i in prints]
    for a in prints:
        near = [g for g in groups if any((prints[a] ^ prints[b]).bit_count() <= radius for b in g)]
        groups = [g for g in groups if g not in near] + [set().union(*near)]
    return {i: min(g) for g in groups for i in g}


def rows(df):
    return {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in df.collect()}


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    found = rows(registered()["op4_simhash_near_dedup"][0](spark, folder))
    table = pq.read_table(f"{folder}/documents.parquet").to_pylist()
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in table}
    groups = plain_components(prints, 2)
    assert found == {i: (format(p, "016x"), groups[i]) for i, p in prints.items()}


@pytest.mark.parametrize(("radius", "tile"), [(2, 3), (2, 16384), (4, 5), (10, 7), (24, 4)])
def test_links_of_any_radius_and_tile_size(spark, radius, tile):
    random = np.random.default_rng(radius)
    values = [int(v) for v in random.integers(0, 2**63, 12)]
    for v in values[:6]:
        for _ in range(6):
            flips = random.choice(64, int(random.integers(1, radius + 3)), replace=False)
            values.append(int(np.bitwise_xor.reduce([v, *(1 << int(f) for f in flips)], dtype=np.uint64)))
    values = sorted(set(values))
    signed = [int(np.uint64(v).astype(np.int64)) for v in values]
    from pagetrace.llm.graph import components

    distinct = spark.createDataFrame([(s,) for s in signed], "w0 bigint")
    found = {r["node"]: r["component"] for r in components(S.links(distinct, radius, tile=tile)).collect()}
    want = plain_components({format(v, "016x"): v for v in values}, radius)
    assert {n: found.get(n, n) for n in want} == want


def test_odd_rows(spark):
    found = S.near_duplicates(odd_documents(spark)).collect()
    assert len(found) == 10
    zero = [r for r in found if r["fingerprint"] == "0" * 16]
    assert len(zero) == 3 and {r["component_id"] for r in zero} == {1}
    assert {r["component_id"] for r in found if r["fingerprint"] == format(plain_fingerprint("Same text here"), "016x")} == {3}
    assert [r["component_id"] for r in found if r["doc_id"] is None and r["fingerprint"] != "0" * 16] == [None]
    assert S.near_duplicates(none(spark)).collect() == []


def test_hot_group_of_copies_and_near_copies(spark):
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base)] * 200 + [" ".join(base[:i] + ["changed"] + base[i + 1 :]) for i in range(0, 400, 4)]
    texts += [" ".join(f"{k}v{i}" for i in range(50)) for k in range(100)]
    found = rows(S.near_duplicates(documents(spark, texts)))
    prints = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    groups = plain_components(prints, 2)
    assert found == {i: (format(p, "016x"), groups[i]) for i, p in prints.items()}


def test_lenient_fingerprints_keep_short_texts_apart():
    assert S.fingerprint(b"", strict=False) != [0]
    assert S.fingerprint(b"a b c d", strict=False) == S.fingerprint(b"a b c", strict=False)
    assert S.fingerprint(b"a b c d e", 3, 2)[0] == S.fingerprint(b"a b c d e", 3, 1)[0]


def test_a_tile_of_near_copies_is_closed_quickly():
    """A step for each row and not for each pair: this many pairs, one by one, would take minutes."""
    import time

    random_ = np.random.default_rng(4)
    near = np.full((16_384, 2), 0x0F0F_3333_5555_00FF, np.uint64) ^ (np.uint64(1) << random_.integers(0, 63, (16_384, 2)).astype(np.uint64))
    start = time.perf_counter()
    a, b = S._forest(near, near, True, 24)
    assert time.perf_counter() - start < 30
    assert len(a) == len(near) - 1 and len(set(a.tolist()) | set(b.tolist())) == len(near)


def test_forests_span_the_components_of_all_pairs():
    random_ = np.random.default_rng(9)
    centres = random_.integers(0, 2**63, (6, 2)).astype(np.uint64)
    rows = centres[random_.integers(0, 6, 700)] ^ (np.uint64(1) << random_.integers(0, 63, (700, 2)).astype(np.uint64))

    def groups(n, pairs):
        label = list(range(n))
        for x, y in pairs:
            old, new = max(label[x], label[y]), min(label[x], label[y])
            label = [new if k == old else k for k in label]
        return label

    for radius in (1, 2, 3, 40):
        distance = np.bitwise_count(rows[:, None] ^ rows[None]).sum(2)
        a, b = S._forest(rows, rows, True, radius)
        assert groups(700, zip(*np.nonzero(np.triu(distance <= radius, 1)), strict=True)) == groups(700, zip(a, b, strict=True))
        left, right = rows[:300], rows[300:]
        a, b = S._forest(left, right, False, radius)
        across = [(x, 300 + y) for x, y in zip(*np.nonzero(distance[:300, 300:] <= radius), strict=True)]
        assert groups(700, across) == groups(700, zip(a, 300 + b, strict=True))
        assert all(distance[x, 300 + y] <= radius for x, y in zip(a, b, strict=True))
