import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest

from pagetrace.llm import token_store as T
from pagetrace.llm.common import shared_folder
from pagetrace.llm.registry import registered
from tokenizers import Tokenizer

from tests.llm.fixtures import none, odd_documents

PATH = public_tokenizers.path(T.TOKENIZER)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("n", [0, 1, 2, 5, 255, 256, 257, 5000])
@pytest.mark.parametrize("top", [0, 1, 10, 10**6, 2**40])
def test_elias_fano_gives_every_value_back(n, top):
    values = np.sort(np.random.default_rng(n).integers(0, top + 1, n))
    own = T.EliasFano.of(values)
    assert (own.values() == values).all()
    assert all(own.select(i) == values[i] for i in range(0, n, max(1, n // 50)))


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(1).integers(0, 2000, 100_000))
    own = T.EliasFano.of(values)
    bits = 8 * (len(own.low) + len(own.upper) + own.samples.nbytes)
    assert bits / len(values) < np.log2(values[-1] / len(values)) + 2.5


def test_query_equals_the_library(spark):
    folder = "/root/testdata/sf0.001"
    found = sorted(tuple(r) for r in registered()["op2_token_store"][0](spark, folder).collect())
    library = Tokenizer.from_file(PATH)
    want, start = [], 0
    for row in sorted(pq.read_table(f"{folder}/documents.parquet").to_pylist(), key=lambda r: r["doc_id"]):
        ids = [*library.encode(row["text"] or "", add_special_tokens=False).ids, T.END_ID]
        want.append((row["doc_id"], start, len(ids), crc(ids)))
        start += len(ids)
    assert found == want


def test_special_tokens_in_a_text_are_what_the_library_makes_of_them():
    library, own = Tokenizer.from_file(PATH), T.WordEncoder(PATH, separable=True)
    texts = ["a<|startoftext|>b", "<|endoftext|>", "x <|endoftext|>. y<|ENDOFTEXT|> <|startoftext|><|endoftext|>1", "<|endoftext", "a<|StartOfText|>b|>"]
    for text in texts:
        ids = list(np.frombuffer(own.encode([text])[0], "<u4"))
        assert ids == library.encode(text, add_special_tokens=False).ids


def test_words_together_equal_whole_texts():
    own, random_ = T.WordEncoder(PATH, separable=True), random.Random(3)
    bits = ["A", "Σ", "ΑΣ", " ", "  ", "\n", "\t", "\xa0", "'re", "'", "l", "1", "23", "é", "é", "́", "ö!", "...", "日本", "<|endoftext|>", "\U0001f600", "\x1c", "\x85", "ß", "İ", ",", "?!", "J̌"]
    texts = ["".join(random_.choice(bits) for _ in range(random_.randint(0, 30))) for _ in range(4000)]
    assert own.encode(texts) == own._encode(texts)


def test_odd_rows(spark):
    path = shared_folder(spark, "test-tokens")
    docs = odd_documents(spark)
    T.write_tokens(docs, path, PATH, T.END_ID, per_file=8)
    found = T.read_tokens(spark, path).orderBy("start").collect()
    library = Tokenizer.from_file(PATH)
    want = sorted((str(r["doc_id"]), crc([*library.encode(r["text"] or "", add_special_tokens=False).ids, T.END_ID])) for r in docs.collect())
    assert sorted((str(r["doc_id"]), r["ids_crc32"]) for r in found) == want
    ids = [r["doc_id"] for r in found]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert [r["start"] for r in found] == [sum(r["n_tokens"] for r in found[:k]) for k in range(len(found))]
    T.write_tokens(none(spark), path + "-none", PATH, T.END_ID)
    assert T.read_tokens(spark, path + "-none").collect() == []


def test_documents_by_select():
    ids = [np.arange(n, dtype=np.uint32) for n in (3, 1, 0, 700)]
    data = T.pack([None, -5, 7, 7], np.array([len(i) for i in ids]), np.concatenate(ids)) + T.MAGIC[-1:]
    own = T.TokenFile(data)
    assert [own.document(i).tolist() for i in range(4)] == [i.tolist() for i in ids]
    assert own.doc_ids() == [None, -5, 7, 7]
    wide = T.pack([1], np.array([1]), np.array([70_000])) + T.MAGIC[-1:]
    assert T.TokenFile(wide).document(0).tolist() == [70_000]


def test_a_full_cache_keeps_what_is_in_use(monkeypatch):
    monkeypatch.setattr(T, "CACHE", 4)
    own = T.WordEncoder(PATH, separable=True)
    for texts in (["one two", "\xc9t\xe9, two"], ["two six \xdcBER!!", "one"], ["two 12 ten. ten"]):
        assert own.encode(texts) == own._encode(texts)
    assert "two" in own.known and "six" not in own.known
    learnt = []
    monkeypatch.setattr(own, "_learn", learnt.extend)
    own.encode(["two two ten."])
    assert learnt == []
