"""Sanitising personal data, and the terms that would give it away.

Patterns find the protected entities. Masking them is not enough where a word
of the same document keeps their company: who reads the word knows the entity.
How much a term discloses is estimated from the whole corpus as the pointwise
mutual information of term and entity over the information content of the
entity, 0 for an independent term and 1 for one that never occurs without it.
Single values are rare, so the same is asked of the entity's family (the domain
of an address, the network, the issuer, the area) and of its kind. Counts are
smoothed: of k different passages that hold the term beside such an entity, one
counts for nothing, so a single passage and its copies prove nothing. In the
documents that hold the entity, terms above one threshold are generalised and
above a second one removed, wherever in the document they stand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.values import ref
from ..session import cut_lineage
from .spans import MARKED, described, marked_spans, match_spans, merged, n_of, replaced

# Shares of an entity's information at which a term is generalised and removed.
GENERALISED_AT = 0.90
REMOVED_AT = 0.97
# Words on either side of a term that make its passage.
PASSAGE = 8


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _is_ip(match: Column) -> Column:
    return F.forall(F.split(match, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))


def _is_card(match: Column) -> Column:
    digits = _digits(match)
    return F.length(digits).between(12, 19) & F.coalesce(F.call_function("luhn_check", digits), F.lit(False))


def _is_phone(match: Column) -> Column:
    return F.length(_digits(match)).between(9, 15)


def _any(match: Column) -> Column:
    return F.lit(True)


# The patterns take the same matches as the plain ones and never go back: runs
# are taken whole, and a match begins where a run begins or the last match ended.
KINDS: list[tuple[str, str, Callable[[Column], Column], str]] = [
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", _any, "@"),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _is_ip, "."),
    ("card", r"(?<![0-9])[0-9](?:[ -]?[0-9])++", _is_card, ""),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]", _is_phone, "+"),
]
NAMES = [name for name, *_ in KINDS]


def base_spans(text: Column) -> Column:
    """Sorted spans of the protected entities in a text that is not null."""
    digits = F.translate(text, "0123456789", "") != text
    found = []
    for order, (name, pattern, keep, sign) in enumerate(KINDS):
        may = (F.contains(text, F.lit(sign)) if sign else F.lit(True)) & (F.lit(True) if name == "email" else digits)
        found.append(marked_spans(text, name, order, pattern, keep, may))
    return F.array_sort(F.concat(*found))


def _units(span: Column) -> Column:
    """An entity, however it is written, its family and its kind, by name."""
    kind, digits, lower = span["kind"], _digits(span["match"]), F.lower(span["match"])
    plain = F.when(kind.isin("card", "phone"), digits).otherwise(lower)
    family = (
        F.when(kind == "email", F.substring_index(lower, "@", -1))
        .when(kind == "ip", F.substring_index(lower, ".", 3))
        .otherwise(F.substring(digits, 1, 6))
    )
    return F.array(F.concat_ws("=", kind, plain), F.concat_ws("~", kind, family), kind)


def _blanked(text: Column, spans: Column) -> Column:
    """The text with as many blanks in place of each entity, so positions stay."""
    return replaced(text, merged(spans), lambda s: F.repeat(F.lit(" "), s["end"] - s["start"]))


def _all_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _words(text: Column) -> Column:
    return F.array_distinct(F.filter(_all_words(text), lambda w: F.length(w) >= 2))


def _passages(words: Column) -> Column:
    """(term, passage) of each place of a term."""
    def near(word: Column, i: Column) -> Column:
        begin = F.greatest(i - PASSAGE, F.lit(0))
        passage = F.slice(words, begin + 1, i - begin + 1 + PASSAGE)
        return F.struct(word.alias("term"), F.xxhash64(passage).alias("passage"))

    return F.filter(F.transform(words, near), lambda p: F.length(p["term"]) >= 2)


def disclosing_terms(
    base: DataFrame, texts: DataFrame, generalised_at: float, removed_at: float
) -> tuple[DataFrame, DataFrame]:
    """Pairs (row, unit, term) of the documents, and the (unit, term, ratio) that disclose.

    ``base`` has row, text and spans of the documents with entities; ``texts``
    the text of all documents. A unit is an entity, a family or a kind. Units of
    one document and terms that cannot reach the lower threshold with any unit
    are left out before pairs are made, which changes no ratio that counts.
    """
    least = min(generalised_at, removed_at)
    held = base.filter(F.size("spans") > 0)
    units = cut_lineage(
        held.select("row", F.explode(F.array_distinct(F.flatten(F.transform("spans", _units)))).alias("unit"))
    )
    n_units = units.groupBy("unit").agg(F.count(F.lit(1)).alias("n_unit")).filter("n_unit > 1")
    words = held.select("row", _all_words(_blanked(F.col("text"), F.col("spans"))).alias("words"))
    terms = cut_lineage(
        words.select("row", F.explode(_passages(F.col("words"))).alias("p"))
        .groupBy("row", "p.term").agg(F.min("p.passage").alias("passage"))
    )
    # Words inside entities are no terms, so they are taken off the counts of whole texts.
    inside = held.select(F.explode(_words(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_raw"))
    counts = texts.select(F.explode(_words(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_all"))
    n_texts = texts.count()
    total = F.lit(float(n_texts))
    among = terms.groupBy("term").agg(
        F.count(F.lit(1)).alias("n_any"), F.min("passage").alias("least"), F.max("passage").alias("greatest")
    ).filter(F.col("least") != F.col("greatest"))
    share = float(max(n_texts, 1)) ** (least - 1.0)
    n_terms = cut_lineage(
        among.join(counts, "term", "left").join(inside, "term", "left")
        .withColumn("n_term", F.coalesce("n_all", F.lit(0)) - F.coalesce("n_raw", F.lit(0)) + F.col("n_any"))
        .filter(F.col("n_any") >= F.col("n_term") * share * (1 - 1e-9))
        .select("term", "n_term")
    )
    kept_units = cut_lineage(units.join(n_units, "unit"))
    pairs = cut_lineage(
        terms.join(n_terms, "term").join(kept_units, "row").select("row", "unit", "n_unit", "term", "n_term", "passage")
    )
    # Two steps, so that the passages of a very common pair are spread.
    both = (
        pairs.groupBy("unit", "term", "passage")
        .agg(F.count(F.lit(1)).alias("n"), F.first("n_unit").alias("n_unit"), F.first("n_term").alias("n_term"))
        .groupBy("unit", "term")
        .agg(
            F.sum("n").alias("n_both"), F.count(F.lit(1)).alias("k"),
            F.first("n_unit").alias("n_unit"), F.first("n_term").alias("n_term"),
        )
        .filter("k > 1")
    )
    prior = F.col("n_unit") / total
    given = (F.col("n_both") / F.col("n_term") * (F.col("k") - 1) + prior) / F.col("k")
    ratio = F.when(prior < 1, F.log2(given / prior) / -F.log2(prior)).otherwise(0.0)
    found = both.select("unit", "term", ratio.alias("ratio"))
    return pairs.select("row", "unit", "term"), found.filter(F.col("ratio") >= least)


def personal_spans(
    documents: DataFrame,
    keep: tuple[str, ...] = ("doc_id",),
    keep_text: bool = False,
    generalised_at: float = GENERALISED_AT,
    removed_at: float = REMOVED_AT,
) -> DataFrame:
    """row, text, base, spans for every row of ``documents``.

    ``row`` is a struct of the columns ``keep``, so their names clash with none.
    ``base`` are the sorted spans of the protected entities; ``spans`` adds the
    terms that disclose an entity of the same document, as ``generalised`` or
    ``removed``. Null texts are empty and hold nothing. Counts run over all rows,
    repeated ones too, but a term needs two different passages. Documents without
    entities are never touched; ``text`` is null for them unless ``keep_text``.
    An empty table gives no rows; other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    found = documents.select(F.struct(*[ref(c).alias(c) for c in keep]).alias("kept"), "text")
    found = found.withColumn("spans", base_spans(text))
    if not keep_text:
        found = found.withColumn("text", F.when(F.size("spans") > 0, F.col("text")))
    base = cut_lineage(found.withColumn("row", F.monotonically_increasing_id()))
    pairs, disclosing = disclosing_terms(
        base, documents.select(text.alias("text")), generalised_at, removed_at
    )
    terms = cut_lineage(
        pairs.join(disclosing, ["unit", "term"])
        .groupBy("row", "term").agg(F.max("ratio").alias("ratio"))
        .groupBy("row")
        .agg(
            F.array_sort(F.collect_set(F.when(F.col("ratio") < removed_at, F.col("term")))).alias("generalised"),
            F.array_sort(F.collect_set(F.when(F.col("ratio") >= removed_at, F.col("term")))).alias("removed"),
        )
    )
    joined = base.join(terms, "row", "left")
    none = F.array().cast(f"array<{MARKED}>")

    def term_spans(kind: str, order: int) -> Column:
        pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(kind, "|"), F.lit(r")(?![\p{L}\p{N}])"))
        spans = F.transform(
            match_spans(_blanked(F.col("text"), F.col("base")), pattern),
            lambda s: F.struct(
                s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"),
                F.lit(kind).alias("kind"), s["match"].alias("match"),
            ),
        )
        return F.when(F.coalesce(F.size(kind), F.lit(0)) > 0, spans).otherwise(none)

    joined = joined.withColumnRenamed("spans", "base")
    spans = F.array_sort(F.concat("base", term_spans("generalised", len(KINDS)), term_spans("removed", len(KINDS) + 1)))
    return joined.select(F.col("kept").alias("row"), "text", "base", spans.alias("spans"))


def sanitised(text: Column, spans: Column) -> Column:
    """The text with entities and generalised terms replaced by their kind, and removed terms left out."""
    def put(span: Column) -> Column:
        named = F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]"))
        return F.when(span["kind"] == "removed", "").when(span["kind"] == "generalised", "[TERM]").otherwise(named)

    return replaced(text, merged(spans), put)


def personal_digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans of each row of ``personal_spans``."""
    return found.select(
        "row.doc_id",
        *[n_of(F.col("base"), name).alias(f"n_{name}") for name in NAMES],
        F.sha2(described(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        described(F.col("spans")).alias("spans"),
    )
