"""Byte-level BPE by overlapping chunks: pre-tokenise chunks in parallel, stitch, encode, decode.

A text longer than a chunk is cut into chunks that overlap; each is pre-tokenised where it lies.
A chunk starts anywhere, so its first pre-tokens may be wrong, but the pattern never looks back:
from the first boundary that it shares with the text before it, both give the same pre-tokens,
and there they are stitched. Boundaries next to a chunk's end are not sure, as a match there
might have gone on. Where an overlap holds no shared boundary (a pre-token longer than the
overlap), matching goes on from the last sure boundary until it meets one of the chunk's own,
so every text gets the pre-tokens that it would get as a whole. The pieces between stitches are
then encoded and put together by text. Every text goes this way; of texts longer than ``SPREAD`` the
chunks and pieces are dealt to several tasks, those of other texts stay in the task that reads them.

Each pre-token is encoded separately by the ranks, without special tokens. Decoding concatenates
the raw bytes of the ids. Null and empty texts have no id. Equal rows give equal rows, null keys
stay null, an empty table gives no row, extra columns are ignored. A task holds an Arrow batch,
or the chunks and ids of one long text, whose digest is one value of the result.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrace.llm.common import ArrowBatches, table

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Code points of a chunk, and of its overlap with the next.
CHUNK = 4096
OVERLAP = 256
#: The same for texts whose chunks are dealt to several tasks, and the length from which they are.
SPREAD = 65536
SPREAD_OVERLAP = 1024
#: The pattern decides on a boundary by at most so many characters behind it.
AHEAD = 3
#: Pre-tokens whose ids a worker keeps.
CACHE = 200_000


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.raw = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.raw[rank] = token
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, as little-endian unsigned 32-bit integers."""
        return np.array(self.library.encode_ordinary(text), "<u4").tobytes()

    def encode_pieces(self, text: str, ends: np.ndarray) -> bytes:
        """The ids of a text whose pre-tokens end at ``ends``; each is encoded by itself."""
        found, start = [], 0
        for end in ends.tolist():
            piece = text[start:end]
            ids = self.known.get(piece)
            if ids is None:
                if len(self.known) >= CACHE:
                    self.known.clear()
                ids = self.known[piece] = np.array(self.library._encode_single_piece(piece), "<u4").tobytes()
            found.append(ids)
            start = end
        return b"".join(found)

    def encode_chunked(self, text: str, chunk: int, overlap: int) -> bytes:
        """The ids of a text, from its chunks."""
        step = chunk - overlap
        count = max(1, -(-(len(text) - overlap) // step))
        cuts = [(k * step, text[k * step : k * step + chunk]) for k in range(count)]
        chunks = [(at, part, boundaries(self.pattern, part, k == count - 1)) for k, (at, part) in enumerate(cuts)]
        return b"".join(self.encode_pieces(*piece) for piece in pieces(chunks, stitched(self.pattern, chunks)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(ranks_path: str, pattern: str) -> Codec:
    return Codec(ranks_path, pattern)


def boundaries(pattern: regex.Pattern, text: str, last: bool) -> np.ndarray:
    """Sure ends of pre-tokens; the last chunk's own end is the text's."""
    ends = np.array([m.end() for m in pattern.finditer(text)], np.int64)
    return ends if last else ends[ends <= len(text) - AHEAD]


def _between(chunks: list[tuple[int, str, np.ndarray]], number: int, start: int) -> str:
    """The text from ``start`` to the end of chunk ``number``."""
    first = next(i for i in range(number, -1, -1) if chunks[i][0] <= start)
    parts, at = [], start
    for offset, text, _ in chunks[first : number + 1]:
        parts.append(text[at - offset :])
        at = offset + len(text)
    return "".join(parts)


def stitched(pattern: regex.Pattern, chunks: list[tuple[int, str, np.ndarray]]) -> np.ndarray:
    """Ends of the pre-tokens of a text from (offset, text, sure boundaries in it) of its chunks, in order."""
    parts = [chunks[0][2]]
    reached = int(parts[0][-1]) if len(parts[0]) else 0
    for number, (offset, text, own) in enumerate(chunks[1:], 1):
        last = number == len(chunks) - 1
        own = own + offset
        if not len(own):
            continue  # inside one long pre-token
        before = parts[-1]
        shared = np.intersect1d(before[before >= offset], np.concatenate([[offset], own]))
        if len(shared):
            at = int(shared[0])
            parts[-1] = before[before <= at]
        else:
            known, going, at = set(own.tolist()), [], None
            rest = _between(chunks, number, reached)
            for match in pattern.finditer(rest):
                end = reached + match.end()
                if not last and end > offset + len(text) - AHEAD:
                    break
                going.append(end)
                if end in known:
                    at = end
                    break
            parts.append(np.array(going, np.int64))
        if at is not None:
            parts.append(own[own > at])
        reached = max([reached, *(int(p[-1]) for p in parts[-2:] if len(p))])
        # The part that the next chunk is compared with.
        parts[-2:] = [np.concatenate(parts[-2:])]
    return np.concatenate(parts)


def pieces(chunks: list[tuple[int, str, np.ndarray]], ends: np.ndarray) -> list[tuple[str, np.ndarray]]:
    """(text, ends in it): the text cut at true boundaries, about a chunk each."""
    found, start, index = [], 0, 0
    for number, (offset, text, _) in enumerate(chunks):
        stop = len(ends) if number == len(chunks) - 1 else int(np.searchsorted(ends, offset + len(text), "right"))
        if stop == index:
            continue
        own = ends[index:stop]
        found.append((_between(chunks, number, start)[: int(own[-1]) - start], own - start))
        start, index = int(own[-1]), stop
    return found


def _digest(ids: bytes, decoded: bytes) -> tuple[int, str, str]:
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()


def encoded(
    docs: DataFrame,
    ranks_path: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
    key: str = "doc_id",
    keep_ids: bool = False,
    spread: int = SPREAD,
    spread_overlap: int = SPREAD_OVERLAP,
) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256[, ids]) of every text; ids as little-endian unsigned 32-bit integers."""
    path = ranks_path or public_tokenizers.path(RANKS)
    kind = dict(docs.select(key).dtypes)[key]
    names = [key, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * keep_ids]
    schema = f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids

    def whole(given: ArrowBatches) -> ArrowBatches:
        own = codec(path, pattern)
        for batch in given:
            ids = [own.encode_chunked(t, chunk, overlap) if t else b"" for t in batch.column(1).to_pylist()]
            digests = list(zip(*(_digest(i, own.decode(i)) for i in ids), strict=True)) or [[], [], []]
            columns = [batch.column(0), *map(pa.array, digests), *[pa.array(ids, pa.binary())] * keep_ids]
            yield pa.RecordBatch.from_arrays(columns, names)

    length = F.coalesce(F.length("text"), F.lit(0))
    short = docs.where(length <= spread).select(key, "text").mapInArrow(whole, schema)

    step = spread - spread_overlap
    count = F.ceil((F.length("text") - spread_overlap) / step)
    cut = F.transform(
        F.sequence(F.lit(0), count.cast("int") - 1),
        lambda k: F.struct(k.alias("k"), (k == count - 1).alias("last"), F.substring(F.col("text"), k * step + 1, F.lit(spread)).alias("text")),
    )
    # The row number is given before the cut: chunks of one text share it.
    long = docs.where(length > spread).select(F.col(key).alias("key"), "text", F.monotonically_increasing_id().alias("row"))
    long = long.select("key", "row", F.explode(cut).alias("c")).select("key", "row", "c.k", "c.last", "c.text").repartition("row", "k")

    def pre_tokenise(given: ArrowBatches) -> ArrowBatches:
        own = codec(path, pattern)
        for batch in given:
            texts, lasts = batch.column("text").to_pylist(), batch.column("last").to_pylist()
            ends = [boundaries(own.pattern, t, z).astype("<i8").tobytes() for t, z in zip(texts, lasts, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("key", "row", "k", "text")), pa.array(ends, pa.binary())], ["key", "row", "k", "text", "ends"])

    def stitch(group: pd.DataFrame) -> pd.DataFrame:
        own = codec(path, pattern)
        group = group.sort_values("k")
        chunks = [(int(k) * step, t, np.frombuffer(e, "<i8")) for k, t, e in zip(group["k"], group["text"], group["ends"], strict=True)]
        found = pieces(chunks, stitched(own.pattern, chunks))
        return pd.DataFrame(
            {
                "key": [group["key"].iloc[0]] * len(found),
                "row": [group["row"].iloc[0]] * len(found),
                "k": range(len(found)),
                "text": [t for t, _ in found],
                "ends": [e.astype("<i8").tobytes() for _, e in found],
            }
        )

    def encode(given: ArrowBatches) -> ArrowBatches:
        own = codec(path, pattern)
        for batch in given:
            rows = zip(batch.column("text").to_pylist(), batch.column("ends").to_pylist(), strict=True)
            ids = [own.encode_pieces(t, np.frombuffer(e, "<i8")) for t, e in rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("key", "row", "k")), pa.array(ids, pa.binary())], ["key", "row", "k", "ids"])

    def join(group: pd.DataFrame) -> pd.DataFrame:
        ids = b"".join(group.sort_values("k")["ids"])
        row = [group["key"].iloc[0], *_digest(ids, codec(path, pattern).decode(ids)), *[ids] * keep_ids]
        return pd.DataFrame([row], columns=names)

    sure = long.mapInArrow(pre_tokenise, f"key {kind}, row bigint, k int, text string, ends binary")
    cut_anew = sure.groupBy("row").applyInPandas(stitch, f"key {kind}, row bigint, k int, text string, ends binary")
    ids = cut_anew.repartition("row", "k").mapInArrow(encode, f"key {kind}, row bigint, k int, ids binary")
    return short.union(ids.groupBy("row").applyInPandas(join, schema))


def op5_byte_bpe(spark, sf_dir):
    return encoded(table(spark, sf_dir, "documents"))


QUERIES = {"op5_byte_bpe": (op5_byte_bpe, None)}
