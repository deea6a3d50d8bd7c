import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq

from pagetrace.llm import byte_bpe as B
from pagetrace.llm.registry import registered
from tests.llm.fixtures import none, odd_documents

CODEC = B.codec(public_tokenizers.path(B.RANKS), public_tokenizers.PATTERN)
BITS = ["a", "bc", " ", "  ", "\n", "\t\n", "'re", "'", "'l", "l", "1", "23", "é", "ö!", "...", "日本", "x" * 40, " " * 30, " ", "\U0001f600", "'s "]


def expected(text):
    ids = np.array(CODEC.library.encode_ordinary(text or ""), "<u4").tobytes()
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_stitched_chunks_equal_the_whole():
    own = random.Random(1)
    for _ in range(800):
        text = "".join(own.choice(BITS) for _ in range(own.randint(1, 120)))
        size, overlap = own.choice([20, 30, 50]), own.choice([4, 8, 15])
        step = size - overlap
        n = max(1, -(-(len(text) - overlap) // step))
        cuts = [text[k * step : k * step + size] for k in range(n)]
        chunks = [(k * step, c, B.boundaries(CODEC.pattern, c, k == n - 1)) for k, c in enumerate(cuts)]
        ends = B.stitched(CODEC.pattern, chunks)
        assert ends.tolist() == [m.end() for m in CODEC.pattern.finditer(text)]
        pieces = B.pieces(chunks, ends)
        assert "".join(p for p, _ in pieces) == text
        ids = b"".join(CODEC.encode_pieces(*p) for p in pieces)
        assert ids == CODEC.encode(text) and CODEC.decode(ids) == text.encode()


def test_query_equals_the_library(spark):
    folder = "/root/testdata/sf0.001"
    found = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in registered()["op5_byte_bpe"][0](spark, folder).collect()}
    assert found == {r["doc_id"]: expected(r["text"]) for r in pq.read_table(f"{folder}/documents.parquet").to_pylist()}


def test_odd_rows_whole_and_in_chunks(spark):
    docs = odd_documents(spark)
    want = sorted(((r["doc_id"], *expected(r["text"])) for r in docs.collect()), key=str)
    for size, overlap in ((B.CHUNK, B.OVERLAP), (10, 4), (1000, 50)):
        # In one task, and dealt to several.
        for spread in ({}, {"spread": size, "spread_overlap": overlap}):
            found = [tuple(r) for r in B.encoded(docs, chunk=size, overlap=overlap, **spread).collect()]
            assert sorted(found, key=str) == want
    assert B.encoded(none(spark)).collect() == []


def test_ids_are_kept_on_request(spark):
    for size in (B.CHUNK, 300):
        for row in B.encoded(odd_documents(spark), chunk=size, overlap=20, keep_ids=True, spread=size, spread_overlap=20).collect():
            assert hashlib.sha256(row["ids"]).hexdigest() == row["ids_sha256"] and len(row["ids"]) == 4 * row["n_tokens"]
