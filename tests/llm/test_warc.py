import base64
import gzip
import hashlib
import random

import pyarrow.parquet as pq
import pytest

from pagetrace.llm import warc as A
from pagetrace.llm.common import shared_folder
from pagetrace.llm.registry import registered


def base32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def expected(pages):
    last = {}
    for i, html in pages:
        last.setdefault(html or "", []).append(i)
    best = {h: max((i for i in ids if i is not None), default=None) for h, ids in last.items()}
    out = []
    for i, html in pages:
        body, first = (html or "").encode(), best[html or ""]
        own = i == first
        out.append((i, len(body), base32(body), "response" if own else "revisit", None if own else first))
    return sorted(out, key=str)


def written(spark, rows, **options):
    path = shared_folder(spark, "test-warc")
    A.write_archives(spark.createDataFrame(rows, "page_id bigint, url string, html string, sha1 string, first int"), path, **options)
    return path


def found(spark, path):
    read = A.records(A.read_archives(spark, path))
    number = lambda v: int(v[len(A.ID) :]) if v and v != A.ID else None
    return sorted(((number(r["record_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], number(r["refers_to"])) for r in read.collect()), key=str)


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = sorted((tuple(r) for r in registered()["op1_warc_salvage"][0](spark, folder).collect()), key=str)
    assert rows == expected([(r["page_id"], r["html"]) for r in pq.read_table(f"{folder}/pages.parquet").to_pylist()])


def test_odd_rows(spark):
    pages = [(1, "<p>a</p>"), (2, None), (3, ""), (4, "<p>a</p>"), (5, "é\r\n\r\nWARC/1.1\r\n\0" * 50), (6, "x" * 300_000), (7, "<p>a</p>"), (None, "<p>a</p>"), (None, "alone")]
    path = written(spark, [(i, f"http://e/{i}\r\nX: y" if i != 2 else None, h, "z", 9) for i, h in pages])
    assert found(spark, path) == expected(pages)
    assert A.quarantined(A.read_archives(spark, path)).count() == 0
    assert all("\r" not in (r["target_uri"] or "") for r in A.read_archives(spark, path).collect())
    assert found(spark, written(spark, [])) == []


def test_repeated_rows_at_the_largest_id_are_all_responses(spark):
    path = written(spark, [(1, "u", "same", "z", 0), (2, "u", "same", "z", 0), (2, "u", "same", "z", 0)])
    assert [r[3] for r in found(spark, path)] == ["revisit", "response", "response"]


def test_payloads_under_the_bound_are_all_responses(spark):
    path = written(spark, [(1, "u", "ab", "z", 0), (2, "u", "ab", "z", 0), (3, "u", "abc", "z", 0), (4, "u", "abc", "z", 0)], least=3)
    assert [r[3] for r in found(spark, path)] == ["response", "response", "revisit", "response"]


def archive(n, compressed):
    records = [A.build(i, f"http://e/{i}", f"payload {i} WARC/1.1\r\n".encode() * 20, base32(f"payload {i} WARC/1.1\r\n".encode() * 20), 0, None) for i in range(n)]
    return [A.member(r) if compressed else r for r in records]


def test_members_end_in_zero_and_are_plain_gzip():
    for size in (10, 1 << 24, (1 << 24) + 7):
        data = A.member(b"a" * size, 1)
        assert data[-1] == 0 and gzip.decompress(data) == b"a" * size


@pytest.mark.parametrize("compressed", [True, False])
def test_salvage_recovers_all_but_the_damaged(compressed):
    own = random.Random(3)
    for _ in range(60):
        parts = archive(12, compressed)
        hurt = set(own.sample(range(12), own.randint(0, 4)))
        pieces = []
        for i, part in enumerate(parts):
            if i in hurt:
                kind = own.choice(["flip", "cut", "lost", "noise"])
                at = own.randrange(20, len(part) - 20)
                if kind == "flip":
                    part = part[:at] + bytes([part[at] ^ 0x55]) + part[at + 1 :]
                elif kind == "cut":
                    part = part[:at]
                elif kind == "lost":
                    part = part[at:]
                else:
                    part = own.randbytes(30) + part[40:]
            pieces.append(part)
        data = b"".join(pieces)
        result = list(A.salvage(data))
        ids = [r.headers["warc-record-id"] for _, _, r in result if not isinstance(r, str)]
        assert {f"<{A.ID}{i}>" for i in range(12) if i not in hurt} <= set(ids)
        # Records and gaps tile the archive in order; records out of a damaged member lie in its gap.
        at = 0
        for offset, length, what in result:
            assert offset == at and (length > 0 or not isinstance(what, str))
            at += length
        assert at == len(data)


def test_reasons():
    plain = archive(3, False)
    bad = plain[1].replace(b"payload 1 WARC", b"payload 1 wARC", 1)
    gap = [r for r in A.salvage(plain[0] + bad + plain[2]) if isinstance(r[2], str)]
    assert gap == [(len(plain[0]), len(bad), "block digest differs")]
    assert [r[2] for r in A.salvage(b"noise")] == ["no version line"]
    assert list(A.salvage(b"")) == []
    packed = archive(2, True)
    cut = packed[0] + packed[1][:-9]
    assert [r[2] for r in A.salvage(cut) if isinstance(r[2], str)] == ["member not ended"]


def test_a_damaged_member_gives_its_proven_records_be_they_one_or_more():
    def hurt(numbers):
        data = bytearray(A.member(b"".join(archive(3, False)[i] for i in numbers), 6))
        data[-6] ^= 0x55  # the checksum; the records' own digests hold
        return bytes(data)

    for numbers in ([0], [0, 1], [0, 1, 2]):
        ids, gaps = ids_and_gaps(hurt(numbers))
        assert ids == numbers and [g[2] for g in gaps] == ["member damaged"]
    # Several such members in a row lose nothing, and none is read twice.
    ids, gaps = ids_and_gaps(hurt([0]) + hurt([1]) + archive(3, True)[2])
    assert ids == [0, 1, 2] and len(gaps) >= 1


def test_gaps_are_logged_by_the_reader(spark, tmp_path):
    parts = archive(4, True)
    (tmp_path / "a.warc.gz").write_bytes(parts[0] + b"\x1f\x8b\x08broken" + parts[1])
    (tmp_path / "b.warc").write_bytes(b"".join(archive(2, False)) + b"tail")
    read = A.read_archives(spark, str(tmp_path))
    assert A.records(read).count() == 4
    gaps = {(r["file"].rsplit("/", 1)[-1], r["offset"], r["length"]) for r in A.quarantined(read).collect()}
    assert gaps == {("a.warc.gz", len(parts[0]), 9), ("b.warc", sum(map(len, archive(2, False))), 4)}


def ids_and_gaps(data):
    result = list(A.salvage(data))
    ids = [int(r.headers["warc-record-id"][len(A.ID) + 1 : -1]) for _, _, r in result if not isinstance(r, str)]
    return ids, [r for r in result if isinstance(r[2], str)]


@pytest.mark.parametrize("level", [0, 6])
def test_members_of_many_records_lose_only_what_is_damaged(level):
    plain = archive(9, False)
    after = archive(10, True)[9]
    pack = lambda parts: A.member(b"".join(parts), level)
    bad = [*plain[:4], plain[4].replace(b"payload 4", b"payload x", 1), *plain[5:]]
    whole = pack(bad)
    assert ids_and_gaps(whole + after) == ([0, 1, 2, 3, 5, 6, 7, 8, 9], [(0, 0, "block digest differs")])
    # A wrong checksum and a lost end cost no record before them, and none is read twice.
    whole = bytearray(pack(plain))
    end = len(whole) - 1 if level else whole.rindex(b"payload 8") + 3
    whole[end - 4 - 8 if level else end] ^= 0x55
    ids, gaps = ids_and_gaps(bytes(whole) + after)
    assert set(range(8)) | {9} <= set(ids) and len(ids) == len(set(ids)) and gaps
    cut = pack([*plain, b"\r\n" * 9])
    ids, gaps = ids_and_gaps(cut[: len(cut) - 12] + after)
    assert set(range(8)) | {9} <= set(ids) and len(ids) == len(set(ids)) and gaps
    ids, gaps = ids_and_gaps(cut[: len(cut) - 12])
    assert set(range(8)) <= set(ids) and len(ids) == len(set(ids)) and gaps[-1][2] == "member not ended"


def test_unproven_records_of_a_damaged_member_are_not_taken():
    bare = [r.replace(b"WARC-Block-Digest", b"X-Block-Digest") for r in archive(3, False)]
    whole = A.member(b"".join(bare))
    assert ids_and_gaps(whole)[0] == [0, 1, 2]
    assert ids_and_gaps(whole[:-10])[0] == []
