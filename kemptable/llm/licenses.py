"""Licence scan by canonical digests: texts that say the same get the same digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .license_texts import known_texts

# Lines that name a copyright holder or reserve rights, in lower-case text.
# A wrapped line that merely begins with the word copyright is kept.
COPYRIGHT_LINE = (
    r"^[^\p{L}\p{N}(©]*(portions )?((copyright( by)?:?\s*)?(\(c\)|©).*|copyright( by)?:?\s*[0-9<\[{].*|all rights reserved[^\p{L}\p{N}]*)$"
)
# What is no letter and no digit, ends of words included.
GAPS = r"[^\p{L}\p{N}]+"
# Spellings with the same meaning: pattern and replacement, on words in lower case.
SPELLINGS = [
    (r"\blicenc(e|es|ed|ee|ees|er|ers|ing)\b", "licens{1}"),
    (r"\bsub licens(e|es|ed|ing|able)\b", "sublicens{1}"),
    (r"\b(acknowled|jud)gement(s?)\b", "{1}gment{2}"),
    (r"\b(author|custom|general|initial|organ|recogn|util|real|minim|optim|character)is(e|es|ed|er|ers|ing|ation|ations)\b",
     "{1}iz{2}"),
    (r"\b(anal)ys(e|ed|ing)\b", "{1}yz{2}"),
    (r"\b(behavi|col|fav|hon|endeav)our(s|ed|ing|able)?\b", "{1}or{2}"),
    (r"\b(fulfil|enrol)(s|ment)\b", "{1}l{2}"),
    (r"\bnon (commercial|infringement|exclusive)\b", "non{1}"),
    (r"\bper cent\b", "percent"),
    (r"\bhttps\b", "http"),
    (r"\bcopyright (owner|owners)\b", "copyright holder"),
    (r"\bcopyright holders\b", "copyright holder"),
]
# What a text must hold for any of the spellings to be there, in their order.
SIGNS = [
    "licenc", "sub licens", "dgement",
    *(f"{stem}is" for stem in "author custom general initial organ recogn util real minim optim character".split()),
    "analys", "behaviour", "colour", "favour", "honour", "endeavour", "fulfil", "enrol",
    "non commercial", "non infringement", "non exclusive", "per cent", "https", "copyright owner", "copyright holders",
]


def canonical_line(line: Column) -> Column:
    """Words of a line in lower case, one space apart; nothing of a copyright line."""
    line = F.regexp_replace(F.lower(line), COPYRIGHT_LINE, "")
    return F.trim(F.regexp_replace(line, GAPS, " "))


def same_spelling(text: Column) -> Column:
    """One of the equivalent spellings throughout; the patterns run only on texts that hold a sign of one."""

    def spelled(t: Column) -> Column:
        found, put = F.lit(False), t
        for sign in SIGNS:
            found = found | t.contains(sign)
        for pattern, replacement in SPELLINGS:
            put = F.regexp_replace(put, pattern, replacement.replace("{1}", "$1").replace("{2}", "$2"))
        return F.when(found, put).otherwise(t)

    # A lambda names the text, so that it is made once however often it is read.
    return F.element_at(F.transform(F.array(text), spelled), 1)


def _canonical_lines(text: Column) -> Column:
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "[\r\n]+"), canonical_line)
    return F.filter(lines, lambda line: line != "")


def canonical_digest(text: Column) -> Column:
    """SHA-256 of the canonical text."""
    return _digest(F.array_join(_canonical_lines(text), " "))


def _digest(text: Column) -> Column:
    return F.sha2(same_spelling(text).cast("binary"), 256)


def license_catalogue(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """known_digest, license, length of the canonical text; the first of the texts with equal digests counts."""
    rows = [(i, name, text) for i, (name, text) in enumerate(texts or known_texts())]
    table = spark.createDataFrame(rows, "place int, license string, text string").coalesce(1)
    spelled = table.select("place", "license", same_spelling(F.array_join(_canonical_lines(F.col("text")), " ")).alias("t"))
    return (
        spelled.groupBy(F.sha2(F.col("t").cast("binary"), 256).alias("known_digest"))
        .agg(F.min_by("license", "place").alias("license"), F.max(F.length("t")).alias("length"))
    )


def _line_digest(line: Column, lengths: list[int]) -> Column:
    """SHA-256 of a canonical line, null if no known text is as long."""
    return F.element_at(F.transform(F.array(same_spelling(line)), lambda t: F.when(
        F.length(t).isin(lengths), F.sha2(t.cast("binary"), 256)
    )), 1)


def license_scan(documents: DataFrame, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, text_digest, license, n_notices, notices for every row of ``documents``.

    ``text_digest`` is that of the whole canonical text and ``license`` the
    licence with the same digest, if any. Lines are looked up whole as well:
    ``n_notices`` lines are known texts, ``notices`` names their licences,
    sorted and comma-joined. Null and empty texts have the digest of the empty
    text, which is no licence. Repeated rows are scanned each; an empty table
    gives no rows; other columns are not read.

    The catalogue is a fixed list that the caller gives, so it is broadcast;
    lines are joined with it and summed up per document before they move. A
    line is hashed only if a known text has its canonical length.
    """
    catalogue = license_catalogue(documents.sparkSession, texts).collect()  # a few hundred rows
    lengths = sorted({r["length"] for r in catalogue})
    known = documents.sparkSession.createDataFrame(
        [(r["known_digest"], r["license"]) for r in catalogue], "known_digest string, license string"
    )
    known = F.broadcast(known)
    rows = documents.select("doc_id", _canonical_lines(F.col("text")).alias("lines"))
    rows = rows.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        _digest(F.array_join("lines", " ")).alias("text_digest"),
        F.filter(F.transform("lines", lambda line: _line_digest(line, lengths)), lambda x: x.isNotNull()).alias("lines"),
    )
    whole = rows.join(known, F.col("text_digest") == F.col("known_digest"), "left").drop("known_digest")
    lines = whole.withColumn("line", F.explode_outer("lines")).drop("lines")
    notices = known.withColumnRenamed("license", "notice")
    found = lines.join(notices, F.col("line") == F.col("known_digest"), "left")
    return (
        found.groupBy("row")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.first("text_digest").alias("text_digest"),
            F.first("license").alias("license"),
            F.count("notice").alias("n_notices"),
            F.array_join(F.array_sort(F.collect_set("notice")), ",").alias("notices"),
        )
        .drop("row")
    )
