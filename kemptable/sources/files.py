"""File corpora as tables: inventory, image manifest, encodings, archives."""

from __future__ import annotations

import posixpath
import zipfile
from collections.abc import Sequence
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.columns import EmptyData
from ..functions.names import best_reading
from ..functions.values import extension, file_name, parent_name
from .storage import normalize_uri, open_seekable

# Image extensions, table extensions in order of preference, and
# files that only describe a data set.
IMAGE_EXTENSIONS = ["bmp", "jpeg", "jpg", "png", "tif", "tiff"]
TABLE_PRIORITY = {
    "parquet": 0, "arrow": 1, "feather": 2, "csv": 3, "tsv": 4, "xlsx": 5, "xls": 6, "json": 7,
}
DESCRIPTION_FILES = ["dataset_info.json", "state.json"]
# Text extensions whose encoding is worth a check, and the codecs
# tried on text that is not UTF-8, in order.
TEXT_EXTENSIONS = ["csv", "tsv", "json"]
CODECS = ["cp949", "euc-kr", "latin-1"]

# Archive members are handed on in batches of about this many bytes.
MEMBER_BATCH_BYTES = 16 * 1024 * 1024


def _listing(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """Paths, sizes and times below a folder; no content is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(normalize_uri(root)).select("path", "length", F.col("modificationTime").alias("modified"))


def priority(ext: Column) -> Column:
    pairs = [F.lit(x) for item in TABLE_PRIORITY.items() for x in item]
    return F.element_at(F.create_map(*pairs), ext)


def file_catalog(spark: SparkSession, root: str) -> DataFrame:
    """Every file below a folder with extension, size, kind and preference.

    Spark lists the files; it leaves out empty and hidden ones (``.x``, ``_x``).
    """
    ext = extension(F.col("path"))
    return _listing(spark, root).filter(~file_name(F.col("path")).isin(DESCRIPTION_FILES)).select(
        "path",
        ext.alias("ext"),
        "length",
        "modified",
        ext.isin(IMAGE_EXTENSIONS).alias("is_image"),
        priority(ext).alias("priority"),
    )


def catalog_totals(catalog: DataFrame) -> DataFrame:
    """Files and bytes per extension."""
    return catalog.groupBy("ext").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("length").alias("bytes"),
        F.bool_or("is_image").alias("is_image"),
        F.bool_or(F.col("priority").isNotNull()).alias("is_table"),
    )


def pick_dataset(catalog: DataFrame) -> DataFrame:
    """The best table file: by format, below a ``data`` folder, nearest the root."""
    parts = F.split("path", "/")
    return (
        catalog.filter("priority is not null")
        .orderBy(
            "priority",
            F.when(F.array_contains(parts, "data"), 0).otherwise(1),
            F.size(parts),
            "path",
        )
        .limit(1)
    )


def image_manifest(spark: SparkSession, root: str, extensions: Sequence[str] | None = None) -> DataFrame:
    """(filepath, filename, label) of the images; the label is the folder name."""
    wanted = sorted({e.lower().lstrip(".") for e in (extensions or IMAGE_EXTENSIONS)})
    any_case = ["".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in wanted]
    found = _listing(spark, root, "*.{" + ",".join(any_case) + "}")
    path = F.regexp_replace("path", "^file:/+", "/")
    return found.filter(~F.col("path").contains("/__MACOSX/")).select(
        path.alias("filepath"), file_name(path).alias("filename"), parent_name(path).alias("label")
    )


def require_images(manifest: DataFrame) -> DataFrame:
    """The manifest, or an error when it is empty."""
    if manifest.isEmpty():
        raise EmptyData("no image files found")
    return manifest


def label_counts(manifest: DataFrame) -> DataFrame:
    """Images per label."""
    return manifest.groupBy("label").agg(F.count(F.lit(1)).alias("images"))


def _byte_class(values: Sequence[int]) -> str:
    """A pattern class of bytes that were read as Latin-1 characters, as ranges."""
    ranges: list[list[int]] = []
    for v in values:
        if ranges and v == ranges[-1][1] + 1:
            ranges[-1][1] = v
        else:
            ranges.append([v, v])
    return "[" + "".join(f"\\x{{{x:02x}}}-\\x{{{y:02x}}}" for x, y in ranges) + "]"


def _decodes(codec: str, raw: bytes) -> bool:
    try:
        return len(raw.decode(codec)) == 1
    except UnicodeDecodeError:
        return False


@cache
def valid_bytes(codec: str) -> str:
    """A pattern of the whole texts that are valid in a codec of one- and two-byte characters.

    Made from the codec itself: which bytes stand alone, and which second bytes
    may follow which first ones. It never goes back, since a byte is either.
    """
    alone = [b for b in range(256) if _decodes(codec, bytes([b]))]
    leads: dict[tuple[int, ...], list[int]] = {}
    for lead in range(256):
        seconds = tuple(s for s in range(256) if lead not in alone and _decodes(codec, bytes([lead, s])))
        if seconds:
            leads.setdefault(seconds, []).append(lead)
    pairs = [_byte_class(lead) + _byte_class(seconds) for seconds, lead in leads.items()]
    return "^(?:" + "|".join([_byte_class(alone) + "++", *pairs]) + ")*+\\z"


def encoding_audit(spark: SparkSession, path: str | Sequence[str], glob: str | None = None) -> DataFrame:
    """(path, encoding, has_bom, n_bytes) of whole text files.

    Files are read as lines, so a huge file is split over many tasks: a line
    break never falls inside a character of these encodings, and a file is
    valid in one when every line is, also those that are UTF-8 by themselves.
    Lines that are not plain ASCII are tested by patterns over their bytes. The line reader drops a byte order mark; the three bytes missing
    from the total give it away. Empty files are not listed by Spark.
    """
    roots = [path] if isinstance(path, str) else list(path)
    roots = [normalize_uri(p) for p in roots]
    glob = glob or "*.{" + ",".join(TEXT_EXTENSIONS) + "}"
    lines = (
        spark.read.option("lineSep", "\n")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .text(roots)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_size").alias("n_bytes"),
            F.octet_length("value").alias("size"),
            F.is_valid_utf8("value").alias("utf8"),
            # Null for plain ASCII, which is valid in all of them.
            F.when(
                ~(F.is_valid_utf8("value") & (F.octet_length("value") == F.length("value"))),
                F.decode(F.col("value").cast("binary"), "ISO-8859-1"),
            ).alias("bytes"),
        )
    )
    # Every byte is a character of Latin-1.
    tests = [F.lit(True) if c == "latin-1" else F.coalesce(F.col("bytes").rlike(valid_bytes(c)), F.lit(True)) for c in CODECS]
    files = (
        lines.groupBy("path", "n_bytes")
        .agg(
            F.count(F.lit(1)).alias("lines"),
            F.sum("size").alias("bytes"),
            F.bool_and("utf8").alias("utf8"),
            *[F.bool_and(test).alias(f"ok{i}") for i, test in enumerate(tests)],
        )
    )
    # One separator per line, except after a last line without one.
    has_bom = F.col("n_bytes") - F.col("bytes") - F.col("lines") >= 2
    guess = F.when(F.col("utf8"), F.when(has_bom, "utf-8-sig").otherwise("utf-8"))
    for i, codec in enumerate(CODECS):
        guess = guess.when(F.col(f"ok{i}"), codec)
    return files.select("path", guess.otherwise("unknown").alias("encoding"), has_bom.alias("has_bom"), "n_bytes")


def encoding_totals(audit: DataFrame) -> DataFrame:
    """Files and bytes per encoding."""
    return audit.groupBy("encoding").agg(F.count(F.lit(1)).alias("files"), F.sum("n_bytes").alias("n_bytes"))


def zip_files(spark: SparkSession, root: str) -> DataFrame:
    """Paths of the archives below a folder, or of one archive."""
    return _listing(spark, root, "*.[zZ][iI][pP]").select("path")


def is_safe_member(name: str) -> bool:
    """Whether a member stays inside the folder it is unpacked into."""
    place = posixpath.normpath(name.replace("\\", "/"))
    return not (place.startswith(("/", "../")) or place == ".." or place[1:2] == ":")


def zip_members(archives: DataFrame) -> DataFrame:
    """(archive, entry, member, is_safe, n_bytes) of a table with a ``path`` column.

    Only the directory at the end of each archive is read. Names are repaired
    and composed. A broken archive gives one unsafe row without a member.
    """

    def look(batches):
        for batch in batches:
            for path in batch["path"]:
                try:
                    with open_seekable(path) as file, zipfile.ZipFile(file) as archive:
                        rows = [
                            (path, entry, name, is_safe_member(name), info.file_size)
                            for entry, info in enumerate(archive.infolist())
                            if (name := best_reading(info.filename)) and not info.is_dir()
                        ]
                except (zipfile.BadZipFile, OSError):
                    rows = [(path, None, None, False, None)]
                if rows:
                    yield pd.DataFrame(rows, columns=["archive", "entry", "member", "is_safe", "n_bytes"])

    return archives.select("path").mapInPandas(
        look, "archive string, entry long, member string, is_safe boolean, n_bytes long"
    )


def expand_zip(archives: DataFrame, tasks: int | None = None) -> DataFrame:
    """(archive, member, is_safe, n_bytes, content) of a table with a ``path`` column.

    Members are spread over ``tasks``, so one big archive is read by many of
    them, each seeking to its own members. Unsafe members come without content
    and nothing is written anywhere.
    """
    tasks = tasks or int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fields = ["archive", "member", "is_safe", "n_bytes", "content"]

    def unpack(batches):
        for batch in batches:
            for path, members in batch.groupby("archive", sort=False):
                rows, held = [], 0
                wanted = members[members["is_safe"]]
                for m in members[~members["is_safe"]].itertuples():
                    rows.append((path, m.member, False, m.n_bytes, None))
                if len(wanted):
                    with open_seekable(path) as file, zipfile.ZipFile(file) as archive:
                        listing = archive.infolist()
                        for m in wanted.itertuples():
                            body = archive.read(listing[int(m.entry)])
                            rows.append((path, m.member, True, m.n_bytes, body))
                            held += len(body)
                            if held >= MEMBER_BATCH_BYTES:
                                yield pd.DataFrame(rows, columns=fields)
                                rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=fields)

    return (
        zip_members(archives)
        .repartition(tasks, "archive", "entry")
        .mapInPandas(unpack, "archive string, member string, is_safe boolean, n_bytes long, content binary")
    )
