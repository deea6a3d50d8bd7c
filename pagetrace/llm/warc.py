"""WARC archives: a writer with one gzip member a record, and a salvage reader.

The reader checks each record: version line, header lines, lengths, the blank lines behind the
block, block and payload digests, and the checksum of its member. Where one fails it searches
for the next member or version line from which a valid record follows, goes on there, and logs
the bytes in between as a gap with the reason. Plain and compressed archives, and mixtures, are
read alike; damage costs the records it touches and no other. Inside a member the content is
searched in the same way, as far as it inflates: its records and gaps have the offset of the member,
gaps the length 0. Of a member of several records that is itself damaged, which is a gap too, only
records with a block digest that holds are taken, with the length 0; one alone in a damaged member is lost.

Writing: of records with equal payloads that with the largest page_id is the response, others
are revisits without payload that refer to it; payloads shorter than ``least`` bytes are all
responses. Null html is an empty payload. Rows tied at the largest page_id (repeated rows, or
all ids null) are all responses. Null ids leave the number out of the record's id, null urls their header; line ends in urls are
percent-encoded. An empty table writes no record. Extra columns are ignored.

Archives are written by Spark's text writer, so any store that Spark writes to will do: a gzip
member ends in the highest byte of its record's length, zero below 16 MiB (longer records are
followed by an empty member, which ends so too), and that byte is the line separator. An archive
is read as one value; the writer's are one shuffle partition or ``per_file`` records long.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrace.llm.common import ArrowBatches, record_batch, shared_folder, table

# Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP = b"\x1f\x8b\x08"
ID = "urn:page:"

_VERSION_LINE = re.compile(rb"WARC/[0-9]+\.[0-9]+\r\n")
_START = re.compile(rb"\x1f\x8b\x08|WARC/[0-9]")
_FED = 1 << 16


class Damaged(ValueError):
    """A record that fails a check; the message is the reason in the gap log."""


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def http_split(self) -> int:
        if not self.headers.get("content-type", "").startswith("application/http"):
            return 0
        at = self.block.find(b"\r\n\r\n")
        return at + 4 if at >= 0 else len(self.block)

    @property
    def payload(self) -> bytes:
        return self.block[self.http_split :]

    def payload_bytes(self) -> int:
        """Of the full payload: a revisit has it in its HTTP header."""
        if self.headers.get("warc-type") == "revisit":
            found = re.search(rb"(?im)^content-length: *([0-9]+) *\r$", self.block[: self.http_split])
            return int(found[1]) if found else 0
        return len(self.payload)


def build(page_id: int | None, url: str | None, payload: bytes, sha1: str, length: int, refers_to: int | None) -> bytes:
    """The bytes of a record; with ``refers_to`` a revisit, whose payload is left out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [VERSION.decode(), f"WARC-Type: {'response' if refers_to is None else 'revisit'}", "WARC-Date: 1970-01-01T00:00:00Z"]
    lines.append(f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>")
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{ID}{refers_to}>"]
    lines += [
        f"WARC-Payload-Digest: sha1:{sha1}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes, level: int = 6) -> bytes:
    """A gzip member whose last byte is zero."""
    squeeze = zlib.compressobj(level, wbits=31)
    found = squeeze.compress(record) + squeeze.flush()
    return found if found[-1] == 0 else found + zlib.compressobj(level, wbits=31).flush()


def parse(data: bytes, start: int = 0) -> tuple[Record, int]:
    """The record at ``start`` and the offset behind it."""
    line = _VERSION_LINE.match(data, start)
    if not line:
        raise Damaged("no version line")
    end = data.find(b"\r\n\r\n", line.end() - 2)
    if end < 0:
        raise Damaged("header not ended")
    headers = {}
    for row in data[line.end() : end].split(b"\r\n"):
        name, colon, value = row.partition(b":")
        if row and (not colon or not name.strip()):
            raise Damaged("bad header line")
        if row:
            headers[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    if not headers.get("content-length", "").isascii() or not headers.get("content-length", "").isdigit():
        raise Damaged("no length")
    if not all(headers.get(name) for name in ("warc-type", "warc-record-id", "warc-date")):
        raise Damaged("named field missing")
    begin = end + 4
    stop = begin + int(headers["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("block not ended")
    record = Record(headers, data[begin:stop])
    for name, part in (("warc-block-digest", record.block), ("warc-payload-digest", record.payload)):
        value = headers.get(name, "")
        if value.startswith("sha1:") and not (name == "warc-payload-digest" and headers["warc-type"] == "revisit"):
            if value[5:].upper() != digest(part):
                raise Damaged(name.removeprefix("warc-").replace("-", " ") + " differs")
    return record, stop + 4


def unpack(data: memoryview, start: int) -> tuple[bytes, int, str]:
    """The content of the member at ``start`` as far as it inflates, the offset behind that, and what is wrong with it."""
    inflate, parts, at = zlib.decompressobj(31), [], start
    while not inflate.eof and at < len(data):
        before = inflate.copy()
        try:
            parts.append(inflate.decompress(data[at : at + _FED]))
        except zlib.error:
            # What precedes the error in this piece, byte by byte.
            try:
                for at in range(at, min(at + _FED, len(data))):
                    parts.append(before.decompress(data[at : at + 1]))
            except zlib.error:
                pass
            return b"".join(parts), at, "member damaged"
        at = min(at + _FED, len(data))
    return b"".join(parts), at - len(inflate.unused_data), "" if inflate.eof else "member not ended"


def inside(content: bytes, trusted: bool) -> Iterator[tuple[bytes, Record | str]]:
    """(bytes, record) of each valid record of a member's content and (bytes, reason) of each gap, in order."""
    at, gap, reason = 0, None, ""
    while at < len(content):
        try:
            record, stop = parse(content, at)
            if not trusted and not record.headers.get("warc-block-digest", "").startswith("sha1:"):
                raise Damaged("member damaged")
        except Damaged as error:
            if gap is None:
                gap, reason = at, str(error)
            following = _VERSION_LINE.search(content, at + 1)
            at = following.start() if following else len(content)
            continue
        if gap is not None:
            yield content[gap:at], reason
            gap = None
        yield content[at:stop], record
        at = stop
    if gap is not None:
        yield content[gap:], reason


def salvage(data: bytes) -> Iterator[tuple[int, int, Record | str]]:
    """(offset, length, record) of each valid record and (offset, length, reason) of each gap, in order."""
    at, gap, reason = 0, None, ""
    # Records taken out of a damaged member, which may lie in its bytes up to ``upto`` as they are.
    taken, upto = Counter(), 0
    while at < len(data):
        found = []
        try:
            if data.startswith(GZIP, at):
                content, stop, wrong = unpack(memoryview(data), at)
                found = list(inside(content, not wrong))
                if wrong:
                    raise Damaged(wrong)
                if found and all(isinstance(what, str) for _, what in found):
                    raise Damaged(found[0][1])
            else:
                record, stop = parse(data, at)
                found = [(data[at:stop], record)]
        except Damaged as error:
            valid = [(raw, what) for raw, what in found if not isinstance(what, str) and not (at < upto and taken[raw])]
            if valid:
                if gap is not None and gap < at:
                    yield gap, at - gap, reason
                gap, reason = at, str(error)
                # The damaged member stays a gap; its records begin with it.
                for raw, what in valid:
                    yield at, 0, what
                    taken[raw] += 1
                upto = max(upto, stop)
            elif gap is None:
                gap, reason = at, str(error)
            following = _START.search(data, at + 1)
            at = following.start() if following else len(data)
            continue
        if at < upto:
            again = [raw for raw, what in found if not isinstance(what, str) and taken[raw]]
            taken.subtract(again)
            found = [(raw, what) for raw, what in found if isinstance(what, str) or raw not in again]
            if again and not found:
                if gap is None:
                    gap, reason = at, "read before"
                at = stop
                continue
        if gap is not None:
            yield gap, at - gap, reason
            gap = None
        for _, what in found:
            yield at, 0 if isinstance(what, str) else stop - at, what
        at = stop
    if gap is not None:
        yield gap, len(data) - gap, reason


#: Rows handled at once inside a batch.
_ROWS = 500
_PAGE = ["page_id", "url", "length", "sha1"]


def _base32(sha1: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1)).decode()


def write_archives(pages: DataFrame, path: str, least: int = 0, per_file: int = 20_000, level: int = 6) -> None:
    """A record per row of pages (page_id, url, html) to archives in ``path``."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    size, sha1 = F.octet_length(payload).alias("length"), F.sha1(payload).alias("sha1")
    # Only payloads that occur twice have revisits; the sum of a hot one is combined before the shuffle.
    first = pages.select("page_id", size, sha1).where(F.col("length") >= least)
    first = first.groupBy("sha1", "length").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")

    def respond(given: ArrowBatches) -> ArrowBatches:
        """Every page as a response, so that only compressed bytes are shuffled."""
        for batch in given:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                found = []
                for row in part.to_pylist():
                    body = row["payload"]
                    found.append(member(build(row["page_id"], row["url"], body, _base32(row["sha1"]), len(body), None), level)[:-1])
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in _PAGE), pa.array(found, pa.binary())], [*_PAGE, "value"])

    def refer(given: ArrowBatches) -> ArrowBatches:
        for batch in given:
            found = [
                member(build(r["page_id"], r["url"], b"", _base32(r["sha1"]), r["length"], r["refers_to"]), level)[:-1]
                if r["refers_to"] is not None
                else r["value"]
                for r in batch.to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["value"])

    responses = pages.select("page_id", "url", size, sha1, payload.alias("payload"))
    responses = responses.mapInArrow(respond, "page_id bigint, url string, length int, sha1 string, value binary")
    met = responses.join(first.select("sha1", "length", "first"), ["sha1", "length"], "left")
    refers = F.when(F.col("page_id").eqNullSafe(F.col("first")), F.lit(None)).otherwise(F.col("first"))
    met = met.select(*_PAGE, refers.alias("refers_to"), F.when(refers.isNull(), F.col("value")).alias("value"))
    lines = met.mapInArrow(refer, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", "\0").option("maxRecordsPerFile", per_file).text(path)


_READ = [
    ("file", pa.string()),
    ("offset", pa.int64()),
    ("length", pa.int64()),
    ("gap", pa.string()),
    ("record_id", pa.string()),
    ("record_type", pa.string()),
    ("target_uri", pa.string()),
    ("refers_to", pa.string()),
    ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()),
    ("payload", pa.binary()),
]
READ_SCHEMA = (
    "file string, offset bigint, length bigint, gap string, record_id string, record_type string, target_uri string, "
    "refers_to string, payload_bytes bigint, payload_digest string, payload binary"
)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Rows of READ_SCHEMA: records, and gaps (``gap`` holds the reason, the record columns are null)."""

    def plain(value: str | None) -> str | None:
        return value.strip("<>") if value else None

    def read(given: ArrowBatches) -> ArrowBatches:
        for batch in given:
            for number in range(batch.num_rows):
                file, rows = batch.column(0)[number].as_py(), []
                for offset, length, what in salvage(batch.column(1)[number].as_py()):
                    if isinstance(what, str):
                        rows.append((file, offset, length, what, *[None] * 7))
                    else:
                        head, body = what.headers, what.payload
                        kind = head["warc-type"]
                        known = head.get("warc-payload-digest", "").removeprefix("sha1:") if kind == "revisit" else digest(body)
                        names = (plain(head.get("warc-record-id")), kind, head.get("warc-target-uri"), plain(head.get("warc-refers-to")))
                        rows.append((file, offset, length, None, *names, what.payload_bytes(), known, body if payloads else None))
                    if len(rows) == _ROWS:
                        yield record_batch(dict(zip((n for n, _ in _READ), zip(*rows, strict=True), strict=True)), _READ)
                        rows = []
                if rows:
                    yield record_batch(dict(zip((n for n, _ in _READ), zip(*rows, strict=True), strict=True)), _READ)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, READ_SCHEMA)


def records(read: DataFrame) -> DataFrame:
    return read.where("gap IS NULL").drop("gap")


def quarantined(read: DataFrame) -> DataFrame:
    """The log of byte gaps: file, offset, length, reason."""
    return read.where("gap IS NOT NULL").select("file", "offset", "length", F.col("gap").alias("reason"))


def op1_warc_salvage(spark, sf_dir):
    path = shared_folder(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    page = lambda name: F.substring(name, len(ID) + 1, 40).try_cast("bigint")
    return records(read_archives(spark, path, payloads=False)).select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to")
    )


QUERIES = {"op1_warc_salvage": (op1_warc_salvage, None)}
