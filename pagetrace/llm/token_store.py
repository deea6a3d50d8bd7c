"""Token ids of documents in files whose document boundaries are Elias-Fano encoded.

A file holds the ids of consecutive documents as one array, two bytes an id where the
vocabulary allows, else four, and two non-decreasing sequences in Elias-Fano form: where each
document ends in the array, and the document ids. A sequence of n values up to u takes n low
parts of about log2(u / n) bits and 2n + O(1) upper bits, against 64n of an offset table; select
samples, one per 256 set bits, find the i-th value without a scan. Offsets over all files are a
file's own plus the ids in the files before it, so no table of offsets over the corpus exists.

File, little-endian: ids | ends | doc_ids | select samples | directory | 8-byte length of the
directory, "EFTK" and a line end. The directory is JSON: counts and the sections' places.

Documents are in ascending doc_id order, null ids first, rows of one id by a hash of the text;
null and empty texts hold only the end id. Repeated rows are all kept. An empty table gives
no file. Extra columns are ignored. A task holds one file's ids.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from pagetrace.llm.common import ArrowBatches, shared_folder, stored, table

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
MAGIC = b"EFTK\n"
#: Set bits per select sample.
SAMPLE = 256
#: Ids in a file; a reader holds one file.
PER_FILE = 2_000_000
#: Words whose ids a worker keeps.
CACHE = 400_000
#: Marks that may follow a word.
MARKS = ",.;:!?%&*#$|()[]{}-_=+~/\"<>"
#: A run of letters below the first whose lower case is not one letter, and the marks behind.
_RUN = re.compile(rf"([A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u012f]+)([{re.escape(MARKS)}]*)")
_ASCII_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


class EliasFano:
    """A non-decreasing sequence of non-negative integers: low bits packed, high parts in unary."""

    def __init__(self, count: int, low_bits: int, low: np.ndarray, upper: np.ndarray, samples: np.ndarray) -> None:
        self.count, self.low_bits, self.low, self.upper, self.samples = count, low_bits, low, upper, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        bits[places] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), places[::SAMPLE].astype(np.uint32))

    def _low(self, start: int, stop: int) -> np.ndarray:
        first, last = start * self.low_bits, stop * self.low_bits
        bits = np.unpackbits(self.low[first // 8 : -(-last // 8)], bitorder="little")[first % 8 :][: last - first]
        bits = bits.reshape(stop - start, self.low_bits).astype(np.uint64)
        return (bits << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def select(self, i: int) -> int:
        """The i-th value, from the sample before it on."""
        place, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = place // 8
        window = np.unpackbits(self.upper[byte : byte + 1], bitorder="little")[place % 8 :]
        at = place
        while True:
            set_bits = np.flatnonzero(window)
            if left < len(set_bits):
                high = at + int(set_bits[left]) - i
                return (high << self.low_bits) | int(self._low(i, i + 1)[0])
            left -= len(set_bits)
            at += len(window)
            window = np.unpackbits(self.upper[at // 8 : at // 8 + 64], bitorder="little")

    def values(self) -> np.ndarray:
        """All values."""
        if not self.count:
            return np.zeros(0, np.int64)
        high = np.flatnonzero(np.unpackbits(self.upper, bitorder="little"))[: self.count] - np.arange(self.count)
        return (high.astype(np.int64) << self.low_bits) | self._low(0, self.count).astype(np.int64)


def pack(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A file of documents in order, without its last byte (the writer's line end)."""
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    base = int(known[0]) if len(known) else 0
    # Wraps where ids span more than 63 bits; reading wraps back.
    sequences = {"ends": EliasFano.of(np.cumsum(lengths)), "docs": EliasFano.of((known - base).view(np.uint64))}
    width = 2 if not len(ids) or int(ids.max()) < 65536 else 4
    parts = [ids.astype(f"<u{width}").tobytes()]
    head: dict = {"documents": len(doc_ids), "ids": len(ids), "width": width, "base": base, "nulls": len(doc_ids) - len(known)}
    at = len(parts[0])
    for name, sequence in sequences.items():
        sections = [sequence.low.tobytes(), sequence.upper.tobytes(), sequence.samples.astype("<u4").tobytes()]
        head[name] = [sequence.count, sequence.low_bits, at, *map(len, sections)]
        parts += sections
        at += sum(map(len, sections))
    directory = json.dumps(head).encode()
    return b"".join([*parts, directory, len(directory).to_bytes(8, "little"), MAGIC[:-1]])


class TokenFile:
    """A file's content, read in place."""

    def __init__(self, data: bytes) -> None:
        if data[-len(MAGIC) :] != MAGIC:
            raise ValueError("not a token file")
        stop = len(data) - len(MAGIC) - 8
        size = int.from_bytes(data[stop : stop + 8], "little")
        self.head = json.loads(data[stop - size : stop])
        self.ids = np.frombuffer(data, f"<u{self.head['width']}", self.head["ids"])
        self.ends, self.docs = (self._sequence(data, *self.head[n]) for n in ("ends", "docs"))

    @staticmethod
    def _sequence(data: bytes, count: int, low_bits: int, at: int, low: int, upper: int, samples: int) -> EliasFano:
        lows = np.frombuffer(data, np.uint8, low, at)
        return EliasFano(count, low_bits, lows, np.frombuffer(data, np.uint8, upper, at + low), np.frombuffer(data, "<u4", samples // 4, at + low + upper))

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, by two selects."""
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]

    def doc_ids(self) -> list[int | None]:
        with np.errstate(over="ignore"):
            return [None] * self.head["nulls"] + (self.docs.values() + np.int64(self.head["base"])).tolist()


class WordEncoder:
    """Encodes texts by a tokenizers file, each distinct word once.

    ``separable``: the tokenizer lower-cases, splits a text into runs of letters, single digits
    and runs of other marks, discards white space, and ends each such part's last token with its
    end-of-word suffix. Then the ids of a text are those of its words in a row, and new words are
    encoded many at a time and told apart by the suffix. Else whole texts go through the library.
    """

    def __init__(self, path: str, separable: bool) -> None:
        # A task has one core; the library's own threads would each keep memory of their own.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        self.library = Tokenizer.from_file(path)
        self.separable = separable
        self.known: dict[str, bytes] = {"": b""}
        self.special = [t.content.lower() for t in self.library.get_added_tokens_decoder().values()]
        if separable:
            suffix = json.loads(self.library.to_str())["model"]["end_of_word_suffix"]
            vocabulary = self.library.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
            self.marks: dict[str, bytes] = {}
            # Such runs in lower case are what normalizer and splitter would leave of them.
            self.runs = Tokenizer.from_file(path)
            self.runs.normalizer = normalizers.Sequence([])
            byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.runs.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), byte_level])

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Ids of new words: runs of Latin letters together, others one by one; a run of marks behind letters is a part of its own."""
        known, marked, other = self.known, [], []
        wanted: set[str] = set()
        for word in new:
            if (found := _RUN.fullmatch(word)) is None:
                other.append(word)
                continue
            run, marks = found.groups()
            if marks:
                marked.append((word, run, marks))
            if not marks or run not in known:
                wanted.add(run)
        letters = list(wanted)
        groups = [letters[at : at + 512] for at in range(0, len(letters), 512)]
        encoded = self.runs.encode_batch_fast([" ".join(g).lower() for g in groups], add_special_tokens=False)
        for group, one in zip(groups, encoded, strict=True):
            values = np.array(one.ids, "<u4")
            ids, stops = values.tobytes(), ((np.flatnonzero(self.ends[values]) + 1) * 4).tolist()
            if len(stops) != len(group):
                known.update(zip(group, self._encode(group), strict=True))
                continue
            known.update(zip(group, map(ids.__getitem__, map(slice, [0, *stops[:-1]], stops)), strict=True))
        known.update(zip(other, self._encode(other), strict=True))
        for word, run, marks in marked:
            if marks not in self.marks:
                self.marks[marks] = self._encode([marks])[0]
            known[word] = known[run] + self.marks[marks]

    def _lowered(self, text: str) -> str:
        """Special tokens count as written only, so a text that seems to hold one keeps its case."""
        found = _lower(text)
        return text if any(s in found for s in self.special) else found

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.separable:
            return self._encode(texts)
        rows = [self._lowered(t).replace("\n", " ").split(" ") for t in texts]
        words = set().union(*rows)
        new = words.difference(self.known)
        if len(self.known) + len(new) > CACHE:
            # What the texts at hand use is likely to be used again.
            self.known, self.marks = {"": b""} | {w: self.known[w] for w in words.intersection(self.known)}, {}
        self._learn(list(new))
        known = self.known.__getitem__
        return [b"".join(map(known, row)) for row in rows]


def _lower(text: str) -> str:
    """A-Z lower-cased where nothing in the text could combine with them."""
    try:
        return text.encode("latin-1").translate(_ASCII_LOWER).decode("latin-1")
    except UnicodeEncodeError:
        return text


@lru_cache(maxsize=2)
def encoder(path: str, separable: bool) -> WordEncoder:
    return WordEncoder(path, separable)


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, separable: bool = False, per_file: int = PER_FILE
) -> None:
    """Files of (doc_id, text) in ``path``, numbered as doc_ids ascend, of about ``per_file`` ids or one longer document."""
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    placed = keyed.repartitionByRange(F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "text")
    end = np.array([end_id], "<u4").tobytes()

    def write(given: ArrowBatches) -> ArrowBatches:
        own, doc_ids, lengths, ids, held = encoder(tokenizer, separable), [], [], [], 0
        for batch in given:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [f + end for f in own.encode([t or "" for t in part.column(1).to_pylist()])]
                for doc_id, one in zip(part.column(0).to_pylist(), found, strict=True):
                    if held and held + len(one) // 4 > per_file:
                        yield _file(doc_ids, lengths, ids)
                        doc_ids, lengths, ids, held = [], [], [], 0
                    doc_ids.append(doc_id)
                    lengths.append(len(one) // 4)
                    ids.append(one)
                    held += len(one) // 4
        if doc_ids:
            yield _file(doc_ids, lengths, ids)

    files = placed.mapInArrow(write, "value binary").select(F.col("value").cast("string").alias("value"))
    files.write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(path)


def _file(doc_ids: list[int | None], lengths: list[int], ids: list[bytes]) -> pa.RecordBatch:
    value = pack(doc_ids, np.array(lengths, np.int64), np.frombuffer(b"".join(ids), "<u4"))
    return pa.RecordBatch.from_arrays([pa.array([value], pa.binary())], ["value"])


def _documents(name: str, content: bytes) -> Iterator[pa.RecordBatch]:
    if not content:
        return
    own = TokenFile(content)
    ends = own.ends.values()
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    sums = [crc32(own.ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    columns = [
        pa.array([name] * len(ends)),
        pa.array(np.arange(len(ends))),
        pa.array(own.doc_ids(), pa.int64()),
        pa.array(starts),
        pa.array(ends - starts),
        pa.array(sums, pa.int64()),
    ]
    yield pa.RecordBatch.from_arrays(columns, ["file", "number", "doc_id", "at", "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, doc_id, start, n_tokens, ids_crc32) per document, from the files alone."""

    def read(given: ArrowBatches) -> ArrowBatches:
        for batch in given:
            for row in range(batch.num_rows):
                name = batch.column(0)[row].as_py().rsplit("/", 1)[-1]
                yield from _documents(name, batch.column(1)[row].as_py())

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    found = files.mapInArrow(read, "file string, number bigint, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint")
    found = stored(found, "tokens-read")
    # One row a file: the ids in the files before it.
    sums = found.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    # Names hold the number of the range and of the file in it.
    number = lambda pattern: F.regexp_extract("file", pattern, 1).cast("bigint")
    order = W.orderBy(number(r"^part-(\d+)-"), number(r"-c(\d+)\."))
    before = F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1))
    bases = sums.select("file", F.coalesce(before, F.lit(0)).alias("base"))
    return found.join(bases, "file").select("file", "number", "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op2_token_store(spark, sf_dir):
    path = shared_folder(spark, "token-store")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    write_tokens(docs, path, public_tokenizers.path(TOKENIZER), END_ID, separable=True)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES = {"op2_token_store": (op2_token_store, None)}
