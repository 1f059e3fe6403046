"""WARC archives: a writer with revisit records and a reader that salvages damaged files.

Archives are written by Spark's text writer: a record is one value and the two
line breaks that end a record are the separator, so tasks that run again leave
no half-written files. The reader checks every record. Where a check fails it
looks for the next gzip member or version line that passes, goes on from there
and reports the bytes in between as a gap.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut_lineage

# Fixed values of the format.
VERSION_MARK = b"WARC/1."
GZIP_MARK = b"\x1f\x8b\x08"
RECORD_END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

# Payloads below this many bytes are always written in full.
LEAST_REVISIT = 100
# Bytes that an archive file may have, so that the reader can hold a file. A longer record has a file of its own.
FILE_BYTES = 256 << 20
# Bytes beside the html that a record is taken to have: headers, and a url of ordinary length.
HEAD_BYTES = 4 << 10
# Why a gzip member stops short.
CORRUPT, TORN = "broken gzip member", "gzip member without end"
# Bytes of a damaged gzip member that are unpacked at once.
UNPACK_BYTES = 1 << 10
# Payload bytes the reader hands on at once.
BATCH_BYTES = 8 << 20


def _record_id(page_id: Column) -> Column:
    """A uuid made from the page id."""
    digest = F.md5(F.concat(F.lit("page "), F.coalesce(page_id.cast("string"), F.lit(""))).cast("binary"))
    parts = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def write_archives(
    pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", file_bytes: int = FILE_BYTES
) -> None:
    """Write one record per row of ``pages`` (page_id, url, html) into the folder ``path``.

    The payload is the html in UTF-8, empty for null. Of the rows with equal
    payloads of at least 100 bytes those with the smallest page_id are responses
    (repeated rows all of them), the others revisit it. Rows without id revisit
    a page that has one; without such a page they are responses. Control
    characters in a url are written percent-encoded, a null url is left out.
    Other columns are not read; an empty table makes an empty archive.

    Only (digest, page_id) is grouped. The pages themselves move only if the
    table of repeated payloads is too large to broadcast. Files are cut by
    records, so records are written by classes of size, each a power of sixteen:
    as many to a file as fit into ``file_bytes`` if all are the largest of their
    class. Most tables have one class or two; each is one more reading of the pages.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(
        "page_id", "url", html.alias("html"), F.octet_length(html).alias("bytes"),
        F.sha2(html.cast("binary"), 256).alias("digest"),
    )
    repeated = cut_lineage(
        rows.filter(F.col("bytes") >= LEAST_REVISIT)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 and first is not null")
        .select("digest", "first")
    )
    rows = rows.join(repeated, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("bytes").cast("string"), F.lit("\r\n\r\n"),
    )
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    url = F.col("url")
    for code in (*range(32), 127):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    record = F.concat(
        F.lit("WARC/1.0\r\n"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _record_id(F.col("page_id"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", url),
        _line("X-Page-ID", F.col("page_id")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(
            revisit,
            F.concat(
                _line("WARC-Profile", F.lit(REVISIT_PROFILE)),
                _line("WARC-Refers-To", _record_id(F.col("first"))),
                _line("X-Refers-To-Page-ID", F.col("first")),
                _line("X-Payload-Length", F.col("bytes")),
            ),
        ).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _line("Content-Length", F.octet_length(block)),
        F.lit("\r\n"),
        block,
    )
    # Class c holds records of up to HEAD_BYTES * 16 ** (c + 1) bytes.
    whole = F.col("bytes") + 3 * F.coalesce(F.octet_length("url"), F.lit(0)) + HEAD_BYTES
    size_class = F.greatest(F.ceil(F.log(16.0, whole / HEAD_BYTES)) - 1, F.lit(0)).cast("int")
    written = rows.select(record.alias("value"), size_class.alias("class"))
    sizes = pages.select(
        "url", F.coalesce(F.octet_length("html"), F.lit(0)).alias("bytes")
    ).select(size_class.alias("class")).distinct()
    for i, c in enumerate(sorted(r["class"] for r in sizes.collect()) or [0]):
        records = max(1, file_bytes // (HEAD_BYTES * 16 ** (c + 1)))
        written.filter(F.col("class") == c).select("value").write.mode("append" if i else "errorifexists").option(
            "lineSep", RECORD_END
        ).option("maxRecordsPerFile", records).text(path)


class Damaged(Exception):
    """A record that fails a check; ``end`` is set where its frame is whole all the same."""

    def __init__(self, reason: str, end: int | None = None):
        super().__init__(reason)
        self.reason, self.end = reason, end


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers (names in lower case), payload and end of the record that begins at ``at``."""
    head_end = data.find(b"\r\n\r\n", at)
    if not data.startswith(VERSION_MARK, at) or head_end < 0:
        raise Damaged("no version line" if head_end >= 0 else "no end of headers")
    lines = data[at:head_end].split(b"\r\n")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise Damaged("broken header line")
        headers[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise Damaged("no content length")
    start = head_end + 4
    end = start + int(length)
    if data[end:end + 4] != b"\r\n\r\n":
        raise Damaged("record does not end where its length says")
    block, end = data[start:end], end + 4
    payload = block
    if headers.get("content-type", "").startswith("application/http"):
        payload = block.partition(b"\r\n\r\n")[2]
    checks = [("warc-block-digest", block)]
    if headers.get("warc-type") != "revisit":
        checks.append(("warc-payload-digest", payload))
    for name, body in checks:
        kind, _, digest = headers.get(name, "").partition(":")
        if kind == "sha256" and hashlib.sha256(body).hexdigest() != digest:
            raise Damaged(f"{name} differs", end)
    return headers, payload, end


def _unpack(data: bytes, at: int) -> tuple[bytes, str | None, list[tuple[int, int]], int]:
    """What comes out of the gzip member at ``at``, why it stops short, and its end.

    A damaged member gives all that comes out before the damage; for those the
    list has (bytes read, bytes out) on the way.
    """
    unpack = zlib.decompressobj(wbits=31)
    try:
        plain = unpack.decompress(memoryview(data)[at:])
        if unpack.eof:
            return plain, None, [], len(data) - len(unpack.unused_data)
        return plain, TORN, [(len(data) - at, len(plain))], len(data)
    except zlib.error:
        pass
    # Once more in short steps, the last one byte by byte.
    unpack, out, n, steps = zlib.decompressobj(wbits=31), [], 0, []
    for begin in range(at, len(data), UNPACK_BYTES):
        before = unpack.copy()
        try:
            out.append(unpack.decompress(data[begin:begin + UNPACK_BYTES]))
        except zlib.error:
            try:
                for place in range(begin, len(data)):
                    out.append(before.decompress(data[place:place + 1]))
                    n += len(out[-1])
                    steps.append((place + 1 - at, n))
            except zlib.error:
                break
        n += len(out[-1])
        steps.append((begin + UNPACK_BYTES - at, n))
    return b"".join(out), CORRUPT, steps, len(data)


def _digests(headers: dict[str, str]) -> list[str]:
    """The digests that parse_record holds against the bytes of a record."""
    names = ["warc-block-digest", *(["warc-payload-digest"] if headers.get("warc-type") != "revisit" else [])]
    return [headers.get(name, "") for name in names]


def _frames(data: bytes) -> Iterator[tuple[int, int, str | None, list[tuple[dict[str, str], bytes]]]]:
    """(start, end, reason, records) of plain records and the gaps between them."""
    at, gap, reason = 0, None, None
    while at < len(data):
        try:
            headers, payload, end = parse_record(data, at)
        except Damaged as problem:
            if gap is None:
                gap, reason = at, problem.reason
            at = data.find(VERSION_MARK, problem.end or at + 1)
            at = len(data) if at < 0 else at
            continue
        if gap is not None:
            yield gap, at, reason, []
            gap = None
        yield at, end, None, [(headers, payload)]
        at = end
    if gap is not None:
        yield gap, len(data), reason, []


def _parse_member(data: bytes, at: int) -> tuple[list[tuple[dict[str, str], bytes]], list[str], int]:
    """Records of the gzip member that begins at ``at``, first failed checks of the gaps in it, and its end.

    The end of a damaged member is not known; it is that of its last whole
    record, as far as that can be told, and the search goes on from there.
    """
    plain, broken, steps, end = _unpack(data, at)
    records, gaps, until = [], [], 0
    for _, stop, reason, found in _frames(plain):
        # In a corrupt stream wrong bytes may come out long before the error, so a digest must vouch for a record.
        if found and broken == CORRUPT and not any(d.startswith("sha256:") for d in _digests(found[0][0])):
            reason, found = "no digest in a broken gzip member", []
        records += found
        if reason is None:
            until = stop
        elif not (broken and stop == len(plain)):
            gaps.append(reason)
    if not records:
        raise Damaged(broken or (gaps[0] if gaps else "empty gzip member"), None if broken else end)
    if broken:
        end = max((at + read for read, out in steps if out <= until), default=at + 1)
    return records, [*gaps, *([broken] if broken else [])], end


def salvage(data: bytes) -> Iterator[tuple[int, int, str | None, list[tuple[dict[str, str], bytes]]]]:
    """(start, end, reason, records): whole records, and gaps, which have a reason and no records.

    Gaps inside a gzip member have the place of the member.
    """
    at, gap, reason = 0, None, None
    while at < len(data):
        inside: list[str] = []
        try:
            if data.startswith(GZIP_MARK, at):
                records, inside, end = _parse_member(data, at)
                if inside and inside[-1] in (CORRUPT, TORN):
                    marks = [m for m in (data.find(VERSION_MARK, end), data.find(GZIP_MARK, end)) if m >= 0]
                    end = min(marks, default=len(data))
            else:
                headers, payload, end = parse_record(data, at)
                records = [(headers, payload)]
        except Damaged as problem:
            if gap is None:
                gap, reason = at, problem.reason
            after = problem.end or at + 1
            marks = [m for m in (data.find(VERSION_MARK, after), data.find(GZIP_MARK, after)) if m >= 0]
            at = min(marks, default=len(data))
            continue
        if gap is not None:
            yield gap, at, reason, []
            gap = None
        yield at, end, None, records
        for problem in inside:
            yield at, end, problem, []
        at = end
    if gap is not None:
        yield gap, len(data), reason, []


_COLUMNS = {
    "path": pa.string(), "start": pa.int64(), "end": pa.int64(), "gap": pa.string(),
    "headers": pa.map_(pa.string(), pa.string()), "payload": pa.large_binary(),
}


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            for start, end, reason, records in salvage(content.as_py()):
                for headers, payload in records or [(None, None)]:
                    rows.append((path.as_py(), start, end, reason, headers and list(headers.items()), payload))
                    held += len(payload or b"") + 500
                if held >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _COLUMNS.values(), strict=True)]
    columns[-1] = columns[-1].cast(pa.binary())
    return pa.RecordBatch.from_arrays(columns, list(_COLUMNS))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """path, start, end, gap, headers, payload: records and quarantined byte gaps of archive files.

    Files may hold plain records, gzip members or both. A record has headers
    (names in lower case) and its payload without HTTP headers; ``start`` and
    ``end`` are its bytes, those of its member where compressed. Inside a member
    the search is the same, also in what comes out before a member breaks off;
    its gaps have the bytes of the member; from a corrupt one only records with
    a digest are taken. A gap has the
    first failed check as ``gap`` and no headers. Where a record's frame is
    whole but a digest differs, the gap is that record; else the search goes on
    at the next byte. Empty files give no rows. A task holds one file at a
    time, so archives should be split below a quarter of an executor's memory;
    2 GB is Spark's limit.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(
        _read, "path string, start long, end long, gap string, headers map<string,string>, payload binary"
    )


def archived_pages(records: DataFrame, id_type: str = "long", gaps: bool = True) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record read.

    A response's length and digest are those of the payload that was read, a
    revisit's those its headers carry. Gaps give no rows; without ``gaps`` one
    is an error, as it should be where the archive was just written.
    """
    if not gaps:
        place = F.concat_ws(" ", F.lit("gap in"), "path", F.col("start").cast("string"), "gap")
        records = records.withColumn("gap", F.when(F.col("gap").isNotNull(), F.raise_error(place).cast("string")))
    revisit = F.col("headers")["warc-type"] == "revisit"
    own = F.sha2("payload", 256)
    return records.filter("gap is null").select(
        F.col("headers")["x-page-id"].cast(id_type).alias("page_id"),
        F.when(revisit, F.col("headers")["x-payload-length"].cast("long"))
        .otherwise(F.length("payload").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.substring_index(F.col("headers")["warc-payload-digest"], ":", -1)).otherwise(own)
        .alias("payload_digest"),
        F.col("headers")["warc-type"].alias("record_type"),
        F.col("headers")["x-refers-to-page-id"].cast(id_type).alias("refers_to"),
    )
