"""Mixing sources to target weights by weighted sampling without replacement.

Every document gets an exponential key, -ln(u) divided by its quality weight;
the smallest keys of a source come first. A source whose target exceeds its
size gives whole epochs of all its documents first; what is left of the target
is filled in key order. The place where a source's budget ends is found by
summing sizes over key ranges, twice, so that only the documents of one narrow
range of keys are ever sorted, however large a source is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.values import ref
from ..session import cut_lineage
from .common import n_words

# Weights of the sources in order of their names, repeating.
WEIGHTS = (3, 1, 2)
# Key ranges per source in each of the two rounds of sums.
RANGES = 1024


def unit_draw(*parts: Column) -> Column:
    """A number in (0, 1] that depends on the values alone."""
    text = F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    draw = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double")
    return (draw + 1) / F.lit(float(1 << 52))


def source_targets(sources: DataFrame, share: float = 1.5, most: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """Add ``target`` to (source, source_size), one row per source.

    Names are ordered by code point, null last. Sources above ``most`` times
    their size are held there and the excess is shared again by weight, until
    none is above. Only two sums of each round reach the driver.
    """
    # Names are numbered by the count of smaller names, piece by piece of a range partitioning.
    placed = sources.withColumn("last", F.col("source").isNull()).withColumn("cap", F.lit(most) * F.col("source_size"))
    placed = placed.repartitionByRange(F.col("last"), F.col("source")).withColumn("piece", F.spark_partition_id())
    placed = cut_lineage(placed)
    pieces = placed.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    before = pieces.select("piece", (F.sum("n").over(Window.orderBy("piece")) - F.col("n")).alias("before"))
    order = Window.partitionBy("piece").orderBy("last", "source")
    number = F.col("before") + F.row_number().over(order) - 1
    listed = F.array(*[F.lit(float(w)) for w in weights])
    weighed = cut_lineage(
        placed.join(before, "piece")
        .withColumn("weight", F.element_at(listed, (number % len(weights) + 1).cast("int")))
        .select("source", "source_size", "cap", "weight")
    )
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level, budget = 0.0, share * total
    while total:
        # Levels only rise, so a source held at its cap stays there.
        held = F.col("cap") <= F.col("weight") * level
        row = weighed.agg(
            F.coalesce(F.sum(F.when(held, F.col("cap"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~held, F.col("weight"))), F.lit(0.0)),
        ).first()
        if row[1] == 0:
            break
        risen = (budget - row[0]) / row[1]
        if risen <= level:
            break
        level = risen
    target = F.least("cap", F.col("weight") * F.lit(level))
    return weighed.select("source", "source_size", F.round(target, 6).alias("target"))


def _source_key() -> Column:
    """The source as a join key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))


def _budget_end(rows: DataFrame, cuts: DataFrame, part: str) -> DataFrame:
    """The range in which each source's budget ends, and the words left for it.

    ``rows`` has source_key, size and the number of each row's range; ``cuts``
    has ``rest``, the words to be taken from a source's rows.
    """
    sums = rows.groupBy("source_key", part).agg(F.sum("size").alias("words"))
    running = Window.partitionBy("source_key").orderBy(part)
    before = F.col("until") - F.col("words")
    return (
        sums.withColumn("until", F.sum("words").over(running))
        .join(cuts.select("source_key", "rest"), "source_key")
        .filter((before < F.col("rest")) & (F.col("until") >= F.col("rest")))
        .select("source_key", part, (F.col("rest") - before).alias("rest"))
    )


def mixed_sources(
    documents: DataFrame,
    quality: DataFrame | None = None,
    share: float = 1.5,
    most: float = 2.0,
    weights=WEIGHTS,
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """row, size, source_size, target, taken for every row of ``documents``.

    ``row`` is a struct of the columns ``keep``, so their names clash with none.
    ``quality`` (doc_id, quality) gives document weights above 0; documents that
    it lacks weigh 0.5, the largest weight of an id counts. Null texts have size
    0 and are never taken; a null source is a source of its own, ordered last.
    Repeated rows are documents of their own; among equal keys and sizes it does
    not matter which is taken. Whole documents are taken: the one in which the
    budget ends counts if at least half of it fits. A table without words gets
    targets of 0. Other columns are not read. Same input, same answer.
    """
    row = F.struct(*[ref(c).alias(c) for c in keep]).alias("row")
    size, digest = n_words(F.col("text")).alias("size"), F.md5("text").alias("digest")
    # Rows are numbered once, where they are written; only their numbers and sizes take part in the joins below.
    rows = cut_lineage(
        documents.select(row, "doc_id", "source", size, digest, F.monotonically_increasing_id().alias("place"))
    )
    docs = rows.drop("row")
    if quality is None:
        docs = docs.withColumn("weight", F.lit(0.5))
    else:
        best = quality.groupBy("doc_id").agg(F.max("quality").alias("weight"))
        docs = docs.join(best, "doc_id", "left").fillna({"weight": 0.5})
    # Keys run from 1 (first) down to 0: the exponential of minus the exponential key.
    key = -F.log(unit_draw(F.col("doc_id"), F.col("digest"))) / F.col("weight")
    docs = docs.withColumn("key", key).withColumn("source_key", _source_key())
    place = (F.lit(1.0) - F.exp(-F.col("key"))) * RANGES
    docs = docs.withColumn("range_1", F.least(F.floor(place), F.lit(RANGES - 1)))
    docs = docs.withColumn("range_2", F.least(F.floor((place - F.col("range_1")) * RANGES), F.lit(RANGES - 1)))
    docs = cut_lineage(docs.select("place", "source", "source_key", "size", "key", "digest", "range_1", "range_2"))

    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    epochs = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0))
    targets = cut_lineage(
        source_targets(sizes, share, most, weights)
        .withColumn("source_key", _source_key())
        .withColumn("epochs", epochs)
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
        .drop("source")
    )
    first = _budget_end(docs, targets.filter("rest > 0"), "range_1")
    inside = docs.join(first.withColumnRenamed("range_1", "edge"), "source_key").filter("range_1 = edge")
    second = _budget_end(inside.drop("rest", "edge"), first, "range_2")
    cuts = cut_lineage(
        targets.drop("rest")
        .join(first.select("source_key", F.col("range_1").alias("edge_1")), "source_key", "left")
        .join(second.select("source_key", F.col("range_2").alias("edge_2"), "rest"), "source_key", "left")
    )

    placed = docs.join(cuts, "source_key")
    at_edge = F.coalesce((F.col("range_1") == F.col("edge_1")) & (F.col("range_2") == F.col("edge_2")), F.lit(False))
    before = (F.col("range_1") < F.col("edge_1")) | (
        (F.col("range_1") == F.col("edge_1")) & (F.col("range_2") < F.col("edge_2"))
    )
    clear = placed.filter(~at_edge).withColumn("more", F.coalesce(before, F.lit(False)))
    order = Window.partitionBy("source_key").orderBy("key", "size", "digest")
    until = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    edge = placed.filter(at_edge).withColumn("more", until - F.col("size") / 2 <= F.col("rest"))
    taken = F.col("size") * (F.col("epochs") + F.col("more").cast("long"))
    mixed = clear.unionByName(edge).select("place", "size", "source_size", "target", taken.alias("taken"))
    return rows.select("place", "row").join(mixed, "place").drop("place")
