"""Archives and exact search."""

import gzip
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kemptable.llm.topk import top_matches
from kemptable.llm.warc import archived_pages, parse_record, read_archives, salvage, write_archives


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)


def record(payload, kind="resource", digest=True):
    extra = f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}\r\n" if digest else ""
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\n{extra}Content-Length: {len(payload)}\r\n\r\n".encode() + payload + b"\r\n\r\n"


def test_round_trip(spark, folder):
    long_ = "é" * 60
    rows = [
        (1, "http://a/\r\nWARC/1.0", long_), (2, None, long_), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"),
        (7, "u", "x" * 200_000), (8, "u", "WARC/1.0\r\nContent-Length: 0\r\n\r\n\r\n\r\n" * 9), (None, "u", long_), (9, "u", "y" * 100),
        (9, "u", "y" * 100), (10, "u", "y" * 100), (None, "u", "z" * 100), (None, "u", "z" * 100), (11, "u", "\r\n\r\n" * 30),
    ]
    write_archives(pages(spark, rows), f"{folder}/w", file_bytes=4 << 16)
    read = read_archives(spark, f"{folder}/w")
    assert read.filter("gap is not null").count() == 0
    got = sorted((tuple(r) for r in archived_pages(read).collect()), key=repr)
    want = []
    for page, _, html in rows:
        body = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == body and p is not None]
        first = min(same) if len(body) >= 100 and same else None
        revisit = first is not None and page != first
        want.append((page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=repr)
    payloads = {r["id"]: r["payload"] for r in read.select(F.col("headers")["x-page-id"].alias("id"), "payload", F.col("headers")["warc-type"].alias("t")).filter("t = 'response'").collect()}
    assert bytes(payloads["8"]).decode() == rows[7][2]
    write_archives(pages(spark, []), f"{folder}/empty")
    assert read_archives(spark, f"{folder}/empty").count() == 0


def test_archive_files_are_cut_by_bytes(spark, folder):
    """Pages of very unlike sizes: no file outgrows its bound, but for a record that does so alone."""
    draw, most = random.Random(8), 1 << 20
    sizes = [draw.randrange(3000) for _ in range(200)] + [draw.randrange(60_000, 300_000) for _ in range(40)] + [3 << 20, 5 << 20]
    rows = [(i, "\x01" * 20 + "u", "".join(draw.choices("abcdef", k=n))) for i, n in enumerate(sizes)]
    write_archives(pages(spark, rows), f"{folder}/sized", file_bytes=most)
    files = sorted((p.stat().st_size for p in (folder / "sized").glob("part-*")), reverse=True)
    assert files[1] > most > files[2] and len(files) < 60
    read = archived_pages(read_archives(spark, f"{folder}/sized"), gaps=False)
    assert sorted((r["page_id"], r["payload_bytes"]) for r in read.collect()) == list(enumerate(sizes))


def test_a_gap_where_none_may_be_is_an_error(spark, folder):
    write_archives(pages(spark, [(i, "u", "x" * 500 + str(i)) for i in range(4)]).coalesce(1), f"{folder}/torn")
    part = next(p for p in (folder / "torn").glob("part-*") if p.stat().st_size)
    (folder / "hurt").mkdir()
    (folder / "hurt" / "a.warc").write_bytes(part.read_bytes().replace(b"xxxx2", b"xxxy2"))
    read = read_archives(spark, f"{folder}/hurt")
    assert archived_pages(read).count() == 3
    with pytest.raises(Exception, match="gap in"):
        archived_pages(read, gaps=False).collect()


@pytest.mark.parametrize("packed", [False, True])
def test_salvage_recovers_later_records(packed):
    bodies = [f"body {i} ".encode() * (i + 1) for i in range(12)]
    members = [gzip.compress(record(b), mtime=0) if packed else record(b) for b in bodies]
    data = bytearray(b"".join(members))
    starts = np.cumsum([0, *map(len, members)])
    for broken in (2, 3, 7):  # bytes in the middle of the payload or stream, and of a header
        at = starts[broken] + (len(members[broken]) // 2 if broken != 7 else 2)
        data[at] ^= 0xFF
    cut = bytes(data[:starts[11] + len(members[11]) // 2])  # the last record is torn off
    parts = list(salvage(cut))
    assert [p[1] for _, _, _, records in parts for p in records] == [b for i, b in enumerate(bodies) if i not in (2, 3, 7, 11)]
    gaps = [(a, b) for a, b, reason, _ in parts if reason]
    assert gaps == [(starts[2], starts[4]), (starts[7], starts[8]), (starts[11], len(cut))]
    assert [a for a, *_ in parts[1:]] == [b for _, b, *_ in parts[:-1]]  # nothing is skipped unsaid


def test_salvage_inside_a_member():
    """Many records in one member: a bad digest, a broken header, a torn and a corrupt member."""
    draw = random.Random(4)
    bodies = [f"body {i} ".encode() + draw.randbytes(3000) for i in range(40)]
    whole = [record(b) for b in bodies]
    bad = [*whole[:10], whole[10].replace(b"body 10", b"BODY 10"), *whole[11:20], whole[20].replace(b"Content-Length", b"Content Length"), *whole[21:]]

    def read(data):
        parts = list(salvage(data))
        return [p for _, _, _, found in parts for _, p in found], [(a, b, r) for a, b, r, _ in parts if r]

    member = gzip.compress(b"".join(bad), mtime=0)
    got, gaps = read(member)
    assert got == [b for i, b in enumerate(bodies) if i not in (10, 20)]
    assert gaps == [(0, len(member), "warc-payload-digest differs"), (0, len(member), "no content length")]

    member = gzip.compress(b"".join(whole), mtime=0)
    torn = member[:len(member) // 2]
    got, gaps = read(torn)
    assert got == bodies[:len(got)] and 15 <= len(got) <= 20
    assert gaps == [(0, len(torn), "gzip member without end")]

    for level in (0, 6):  # stored records are visible in the bytes of a member
        first = gzip.compress(b"".join(whole[:30]), level, mtime=0)
        later = b"".join(gzip.compress(r, mtime=0) for r in whole[30:])
        got, gaps = read(first[:len(first) // 2] + later)  # torn, then other members
        assert got[-10:] == bodies[30:] and got[:-10] == bodies[:len(got) - 10] and len(got) >= 20
        assert gaps and gaps[0][0] == 0


def test_salvage_of_noise():
    draw = random.Random(1)
    for _ in range(200):
        pieces = [record(b"abc"), gzip.compress(record(b"de")), b"WARC/1.", b"\x1f\x8b\x08", draw.randbytes(9), b"", record(b"x", digest=False)[:-2]]
        chosen = [draw.randrange(len(pieces)) for _ in range(8)]
        data = b"".join(pieces[i] for i in chosen)
        parts = list(salvage(data))
        assert sum(b - a for a, b, *_ in parts) == len(data)
        whole = sum(len(records) for *_, records in parts)
        assert whole == sum(i in (0, 1) for i in chosen) or 6 in chosen or 2 in chosen
    assert list(salvage(b"")) == []
    assert parse_record(record(b"q"), 0)[1] == b"q"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, score long").repartition(3)


def plain_top(rows, k, divisor):
    whole = [
        (i, np.floor(1024 * np.array(v, np.float32).astype(np.float64)).astype(np.int64))
        for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for key, q in {(i, tuple(v)): None for i, v in whole if i % divisor == 0}:
        scored = sorted((-int(np.dot(q, v)), j) for j, v in whole if j != key and len(v) == len(q))
        out += [(key, rank + 1, j, -s) for rank, (s, j) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_top_matches_as_all_pairs(spark, seed):
    draw = np.random.default_rng(seed)
    rows = [(int(i), draw.normal(0, 0.2, 16).astype(np.float32).tolist()) for i in draw.permutation(700)]
    rows += [(1000 + i, rows[0][1]) for i in range(120)]  # one common vector, and ties
    rows += [(2000, [0.0] * 16), (2100, [0.5, 0.5]), (2101, [1.0, -1.0]), (2200, None), (2300, [None] * 16), (2400, [float("nan")] * 16), (None, [1.0] * 16)]
    rows += [(2500, []), (2600, [float("inf")] + [0.0] * 15), rows[3]]
    found = top_matches(vectors(spark, rows), F.col("vec_id") % 50 == 0, k=10, query_rows=9, block_rows=256)
    assert sorted(map(tuple, found.collect())) == plain_top(rows, 10, 50)


def test_search_of_empty_and_tiny_tables(spark):
    assert top_matches(vectors(spark, []), F.col("vec_id") % 100 == 0).count() == 0
    assert top_matches(vectors(spark, [(100, [1.0])]), F.col("vec_id") % 100 == 0).count() == 0
    two = top_matches(vectors(spark, [(100, [1.0]), (3, [0.5])]), F.col("vec_id") % 100 == 0).collect()
    assert [tuple(r) for r in two] == [(100, 1, 3, 1024 * 512)]
