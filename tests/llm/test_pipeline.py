import hashlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa

import corpus_pipeline as C
from pagetrace.llm import byte_bpe, mixing, personal_data, quality, simhash
from pagetrace.llm.common import ARROW_BYTES, small_batches, stored
from tests.llm.fixtures import none, odd_documents
from tests.llm.test_personal_data import base_spans

FOLDER = "/root/testdata/sf0.001"


def rows(df):
    return [r.asDict() for r in df.select(*C.COLUMNS).collect()]


def test_every_stage_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    given = rows(docs)
    stages = dict(C.STAGES)

    kept = stored(stages["quality"](spark, docs, FOLDER), "test-pipeline")
    model = quality.fit(docs, quality.graded(labels))
    tails = model.tails(np.array([model.score(r["text"]) for r in given]))[:, 0]
    first = [r for r, t in zip(given, tails, strict=True) if t >= quality.KEEP]
    assert sorted(rows(kept), key=str) == sorted(first, key=str) and 0 < len(first) < len(given)

    unique = stored(stages["near_duplicates"](spark, kept, FOLDER), "test-pipeline")
    prints = {r["doc_id"]: np.array(simhash.fingerprint(r["text"].encode(), C.SHINGLE, C.WORDS, False), np.int64).view(np.uint64) for r in first}
    group = {i: i for i in prints}
    moved = True
    while moved:
        least = {i: min(group[j] for j in prints if np.bitwise_count(prints[i] ^ prints[j]).sum() <= C.RADIUS) for i in prints}
        moved, group = least != group, least
    second = [r for r in first if group[r["doc_id"]] == r["doc_id"]]
    assert sorted(rows(unique), key=str) == sorted(second, key=str) and len(second) < len(first)

    clean = stored(stages["personal_data"](spark, unique, FOLDER), "test-pipeline")
    third = {r["doc_id"]: r for r in rows(clean)}
    spans = {r["doc_id"]: r["_spans"] for r in personal_data.find(unique).collect()}
    assert len(third) == len(second)
    for r in second:
        own = spans[r["doc_id"]]
        assert set(base_spans(r["text"])) <= {f"{s['kind']}:{s['start']}:{s['end']}" for s in own}
        text, at = "", 0
        for s in own:
            if s["start"] >= at:
                text += r["text"][at : s["start"]] + f"[{s['kind'].upper()}]"
            at = max(at, s["end"])
        text += r["text"][at:]
        assert third[r["doc_id"]]["text"] == text and third[r["doc_id"]]["n_chars"] == (len(text) if own else r["n_chars"])

    mixed = stored(stages["mixing"](spark, clean, FOLDER), "test-pipeline")
    con = duckdb.connect()
    con.register("documents", pa.Table.from_pylist(list(third.values())))
    want = Counter({i: taken // size for i, size, taken in con.execute(f"SELECT doc_id, size, taken FROM ({mixing.SQL}) WHERE taken > 0").fetchall()})
    assert Counter(r["doc_id"] for r in rows(mixed)) == want
    assert all(r == third[r["doc_id"]] for r in rows(mixed))

    encoded = stages["byte_bpe"](spark, mixed, FOLDER).collect()
    codec = byte_bpe.codec(public_tokenizers.path(byte_bpe.RANKS), public_tokenizers.PATTERN)
    assert Counter(r["doc_id"] for r in encoded) == want
    for r in encoded:
        text = third[r["doc_id"]]["text"]
        assert bytes(r["ids"]) == codec.encode(text) and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()

    assert sorted(map(str, encoded)) == sorted(map(str, C.run(spark, FOLDER).collect()))


def test_stages_bear_odd_and_no_rows(spark):
    for docs, least in ((odd_documents(spark), 1), (none(spark), 0)):
        for name, stage in C.STAGES:
            docs = stored(stage(spark, docs, FOLDER), "test-pipeline")
            assert docs.count() >= least, name
            if name != C.STAGES[-1][0]:
                assert docs.columns == C.COLUMNS


def test_near_duplicates_leave_one_of_each_group(spark):
    base = [f"word{i}" for i in range(300)]
    texts = [" ".join(base), " ".join([*base[:150], "new", *base[150:]]), " ".join(base), " ".join(f"other{i}" for i in range(300)), "short one", "short two", "", None]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate([*texts, texts[0]])], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    found = C.drop_near_duplicates(spark, docs.union(docs.where("doc_id = 3")), FOLDER).collect()
    assert sorted(r["doc_id"] for r in found) == [0, 3, 4, 5, 6]


def test_short_texts_with_a_common_opening_all_stay(spark):
    texts = [f"a b c d e {x}" for x in "xyzvw"] + ["a b c d e"] + [f"k l m n o p q {x}" for x in "rst"]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate([*texts, texts[0]])], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    found = C.drop_near_duplicates(spark, docs, FOLDER).collect()
    assert sorted(r["doc_id"] for r in found) == list(range(len(texts)))


def test_links_need_their_jaccard_in_tiles_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SETS", 3)
    own = np.random.default_rng(5)
    texts = [f"k l m n o p q {x}" for x in "rst"] + [" ".join(["x"] * 200) + f" {k} end" for k in range(9)]
    texts += [" ".join(["x"] * 400 + [f"{k}y{i}" for i in range(100)]) for k in range(3)]
    for size in (30, 120, 120, 40):
        base = [f"w{int(v)}" for v in own.integers(0, 10**6, size)]
        for n in (0, 1, 1, 2, 3, 4, 6):
            at = own.choice(size, n, replace=False)
            texts.append(" ".join("new" + w if i in at else w for i, w in enumerate(base)))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    prints = [np.array(simhash.fingerprint(t.encode(), 5, 2, False), np.int64).view(np.uint64) for t in texts]

    def linked(i, j):
        floor = 0.8 if min(len(sets[i]), len(sets[j])) < 64 else 0.5
        return np.bitwise_count(prints[i] ^ prints[j]).sum() <= 24 and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= floor

    near = [[j for j in range(len(texts)) if linked(i, j)] for i in range(len(texts))]
    group, moved = list(range(len(texts))), True
    while moved:
        least = [min(group[j] for j in js) for js in near]
        moved, group = least != group, least
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r["doc_id"]: r["component_id"] for r in simhash.alike(docs, 24, 5, 2).collect()}
    assert found == dict(enumerate(group)) and 4 < len(set(group)) < len(texts)
    assert [group[i] for i in range(12, 15)] == [12, 13, 14] and max(len(js) for js in near) > 3


def test_stages_with_python_take_small_arrow_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    for name in ("quality", "near_duplicates", "byte_bpe"):
        session = spark.newSession()
        dict(C.STAGES)[name](session, session.read.parquet(f"{FOLDER}/documents.parquet").limit(5), FOLDER)
        long = session.range(0, 9000, 1, 1).selectExpr("repeat('x', 2000) text")
        found = [r.n for r in long.mapInArrow(sizes, "n bigint").collect()]
        assert sum(found) > 9000 * 2000 and max(found) < 5 << 20
        session.conf.set(ARROW_BYTES, "1m")
        small_batches(session)
        assert session.conf.get(ARROW_BYTES) == "1m"
