"""Near-duplicates by HyperMinHash sketches, with links confirmed on whole shingle sets.

1. Each document's set of word shingles gets a key and a sketch. Documents with
   equal sets are one class from here on.
2. Bands of sketch registers are compared. In every band each class is compared
   with the first one by the corrected estimate; where some are unlike the
   first, all classes of the band are compared.
3. Classes connected by estimates form groups. Within a group, links are
   confirmed on the sets, read anew from one document of each class. A bit
   array of fixed size tells most other documents apart, so texts never move.
4. Confirmed links give the components.

Bands and groups that are too large for one task are cut into blocks, and every
pair of blocks is a task of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.values import ref
from ..session import cut_lineage
from .common import short_batches, text_bytes, text_chunks
from .components import components
from .hyperminhash import (
    REGISTERS,
    band_keys,
    band_places,
    estimate,
    forest,
    may_be_similar,
    set_keys,
    shingle_sets,
    similar_components,
    sketches,
)

# Classes of one band, and shingles of one group, that a task takes at once.
BAND_BLOCK = 4096
GROUP_BLOCK = 1 << 20
# Text bytes sketched at once.
SKETCH_BYTES = 1 << 20
# Bits (as a power of two) of the array that marks the documents to be read
# again: 8 MB. Where very many are marked, more others pass and are dropped later.
MARK_BITS = 26


def _sketch(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = band_places(percent / 100)
        for batch in batches:
            for first, texts in text_chunks(text_bytes(batch.column("text")), SKETCH_BYTES):
                sets = shingle_sets(texts, width)
                registers = sketches(sets)
                keys, bands = set_keys(sets), band_keys(registers, places)
                some = [len(s) > 0 for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, len(texts)),
                        batch.column("text_key").slice(first, len(texts)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([k.tobytes() if ok else None for k, ok in zip(keys, some, strict=True)], pa.binary()),
                        pa.array([r.tobytes() if ok else None for r, ok in zip(registers, some, strict=True)], pa.binary()),
                        pa.array([b.view(np.int64) if ok else [] for b, ok in zip(bands, some, strict=True)], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "text_key", "n_shingles", "key", "registers", "bands"],
                )

    return run


def _marks(keys: DataFrame) -> np.ndarray:
    """Bit array of the values ``mark``; its words are gathered, whose number is fixed."""
    placed = keys.select(F.pmod("mark", F.lit(1 << MARK_BITS)).alias("place"))
    bits = F.expr("bit_or(shiftleft(1L, cast(place % 64 as int)))").alias("bits")
    words = placed.groupBy(F.expr("place div 64").alias("word")).agg(bits).collect()
    marks = np.zeros(1 << (MARK_BITS - 6), np.int64)
    for row in words:
        marks[row["word"]] = row["bits"]
    return marks.view(np.uint64)


def _sets(width: int, sent):
    """doc_id, text_key and shingles of the documents that are marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = sent.value
        for batch in batches:
            place = batch.column("mark").to_numpy() % (1 << MARK_BITS)
            marked = marks[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1) == 1
            rows = batch.filter(pa.array(marked))
            for first, texts in text_chunks(text_bytes(rows.column("text")), SKETCH_BYTES):
                sets = shingle_sets(texts, width)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id").slice(first, len(texts)),
                        rows.column("text_key").slice(first, len(texts)),
                        pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "text_key", "shingles"],
                )

    return run


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _compare_pairs(least: float):
    """Whether each pair may be similar, from its sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [batch.column(c).to_numpy() for c in ("a_size", "b_size")]
            similar = may_be_similar(
                *estimate(_registers(batch.column("a_registers")), _registers(batch.column("b_registers")), *sizes), least
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(similar, pa.bool_())], ["a", "b", "similar"]
            )

    return run


def _by_unit(connect: Callable[[pa.Table], np.ndarray]):
    """Links (a, b) between the nodes of each unit: runs of equal ``unit`` in sorted rows."""

    def links(rows: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        table = pa.Table.from_batches(rows)
        root = connect(table)
        away = np.flatnonzero(root != np.arange(len(root)))
        if not len(away):
            return None
        nodes = table.column("node").combine_chunks()
        return pa.RecordBatch.from_arrays([nodes.take(pa.array(away)), nodes.take(pa.array(root[away]))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, unit = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            units = batch.column("unit").to_pylist()
            cuts = [0, *[i for i in range(1, len(units)) if units[i] != units[i - 1]], len(units)]
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                if held and units[begin] != unit:
                    found = links(held)
                    if found is not None:
                        yield found
                    held = []
                unit = units[begin]
                held.append(batch.slice(begin, end - begin))
        found = links(held) if held else None
        if found is not None:
            yield found

    return run


def _connect_sketches(percent: int):
    def connect(table: pa.Table) -> np.ndarray:
        registers = _registers(table.column("registers").combine_chunks())
        sizes = table.column("n_shingles").to_numpy()

        def linked(x: int, others: np.ndarray) -> np.ndarray:
            found = 100 * np.minimum(sizes[x], sizes[others]) >= percent * np.maximum(sizes[x], sizes[others])
            close = others[found]
            same = np.broadcast_to(registers[x], (len(close), REGISTERS))
            found[found] = may_be_similar(*estimate(same, registers[close], sizes[x], sizes[close]), percent / 100)
            return found

        return forest(len(sizes), linked)

    return connect


def _connect_sets(percent: int):
    def connect(table: pa.Table) -> np.ndarray:
        shingles = table.column("shingles").combine_chunks()
        offsets, values = shingles.offsets.to_numpy(), shingles.values.to_numpy().view(np.uint64)
        sets = [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return similar_components(sets, percent)

    return connect


def _in_units(rows: DataFrame, key: str, blocks: Column, connect) -> DataFrame:
    """Links within each key; a key with several blocks is compared by pairs of blocks."""
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    pairs = F.transform(others, lambda o: F.struct(F.least(F.col("mine"), o).alias("i"), F.greatest(F.col("mine"), o).alias("j")))
    units = (
        rows.withColumn("blocks", blocks.cast("int"))
        .withColumn("mine", mine)
        .withColumn("pair", F.explode(pairs))
        .withColumn("unit", F.concat_ws(":", key, "pair.i", "pair.j"))
        .drop("blocks", "mine", "pair", key)
    )
    return units.repartition("unit").sortWithinPartitions("unit").mapInArrow(_by_unit(connect), "a long, b long")


def _candidate_links(nodes: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect all classes of which a band and the estimate say that they may be similar."""
    least = percent / 100
    banded = nodes.select("node", "n_shingles", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), F.min("node").alias("first"), F.min_by("n_shingles", "node").alias("first_size")
    )
    members = cut_lineage(banded.join(shared.filter("n > 1"), "band"))
    # Sets of too different sizes cannot be similar, whatever they hold.
    smaller, larger = F.least("n_shingles", "first_size"), F.greatest("n_shingles", "first_size")
    away, close = F.col("node") != F.col("first"), 100 * smaller >= percent * larger
    pairs = members.filter(away & close).select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()

    def side(name: str) -> DataFrame:
        return nodes.select(
            F.col("node").alias(name), F.col("registers").alias(f"{name}_registers"), F.col("n_shingles").alias(f"{name}_size")
        )

    compared = pairs.join(side("b"), "b").join(side("a"), "a")
    compared = cut_lineage(compared.mapInArrow(_compare_pairs(least), "a long, b long, similar boolean"))
    # Bands in which a class is unlike the first one: its likeness to the others is open.
    unlike = compared.filter(~F.col("similar")).select(F.col("a").alias("first"), F.col("b").alias("node"))
    mixed_bands = members.filter("n > 2").join(unlike, ["first", "node"], "left_semi").select("band")
    mixed_bands = mixed_bands.unionByName(members.filter((F.col("n") > 2) & away & ~close).select("band")).distinct()
    rest = members.filter("n > 2").join(mixed_bands, "band", "left_semi").select("band", "n", "node")
    rest = rest.join(nodes.select("node", "registers", "n_shingles"), "node")
    inner = _in_units(rest, "band", F.ceil(F.col("n") / BAND_BLOCK), _connect_sketches(percent)).distinct()
    return compared.filter("similar").select("a", "b").unionByName(inner.select("a", "b"))


def _resolved(documents: DataFrame, percent: int, width: int) -> DataFrame:
    """doc_id, text_key, n_shingles, root (of the component), component_id, kept for every row."""
    short_batches(documents.sparkSession)
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    found = cut_lineage(rows.mapInArrow(
        _sketch(width, percent),
        f"doc_id {kind}, text_key long, n_shingles long, key binary, registers binary, bands array<long>",
    ))
    # Copies are summed up before they move. Classes are numbered once, where they are written.
    nodes = cut_lineage(
        found.filter("key is not null")
        .groupBy("key")
        .agg(
            F.min("doc_id").alias("least_id"),
            F.min(F.struct("doc_id", "text_key")).alias("example"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("registers").alias("registers"),
            F.first("bands").alias("bands"),
        )
        .withColumn("node", F.monotonically_increasing_id())
    )
    groups = components(_candidate_links(nodes, percent)).withColumnRenamed("root", "group")
    wanted = nodes.select("node", "n_shingles", "example").join(groups, "node")
    sizes = wanted.groupBy("group").agg(F.sum("n_shingles").alias("weight"))
    examples = cut_lineage(wanted.join(sizes, "group").select("node", "group", "weight", "example.*"))
    mark = F.xxhash64("doc_id", "text_key").alias("mark")
    sent = documents.sparkSession.sparkContext.broadcast(_marks(examples.select(mark)))
    sets = rows.select("doc_id", "text_key", mark, "text").mapInArrow(
        _sets(width, sent), f"doc_id {kind}, text_key long, shingles array<long>"
    )
    # Rows that repeat id and text give the same set; unmarked ones find no class.
    sets = sets.withColumnsRenamed({"doc_id": "id", "text_key": "same_text"}).join(
        examples, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("same_text") == F.col("text_key"))
    )
    sets = sets.groupBy("node").agg(
        F.first("group").alias("group"), F.first("weight").alias("weight"), F.first("shingles").alias("shingles")
    )
    links = _in_units(sets, "group", F.ceil(F.col("weight") / GROUP_BLOCK), _connect_sets(percent))
    roots = components(links)

    placed = nodes.select("key", "node", "least_id").join(roots, "node", "left")
    placed = placed.withColumn("root", F.coalesce("root", "node"))
    ids = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = placed.join(ids, "root").select("key", "root", "component_id")
    known = found.select("doc_id", "text_key", "n_shingles", "key").join(classes, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    kept = F.col("doc_id").eqNullSafe(component).alias("kept")
    return known.select("doc_id", "text_key", "n_shingles", "root", component.alias("component_id"), kept)


def near_duplicates(documents: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``documents``.

    Two documents are linked if 100 * intersection >= percent * union of their
    sets of distinct ``width``-word shingles (ASCII lower case, words between
    white space; with fewer words the whole sequence is one shingle). Null,
    empty and wordless texts have no shingles and no links. ``component_id`` is
    the least doc_id that links reach, null ids aside; ``kept`` is true where it
    is the row's own. A row without id gets its component's id, and null (then
    it is kept) where no row of the component has one. Rows that repeat an id
    are documents of their own. An empty table gives no rows; other columns are
    not read.

    A link is missed only if no band of the sketches agrees, which happens to
    about one in 50,000 pairs that are just similar enough. Groups of near
    copies are not expanded into pairs.
    """
    return _resolved(documents, percent, width).select("doc_id", "n_shingles", "component_id", "kept")


def distinct_documents(documents: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """The rows of ``documents`` that are kept: one of each component, all its columns as they are.

    Of rows that repeat the component's id one stays.
    """
    def id_key(name: str) -> Column:
        return F.coalesce(F.concat(F.lit("i"), F.col(name).cast("string")), F.lit("n"))

    chosen = _resolved(documents, percent, width).filter("kept")
    chosen = chosen.groupBy("doc_id", "root").agg(F.min("text_key").alias("text_key"))
    chosen = chosen.select(id_key("doc_id").alias("id_key"), F.coalesce("text_key", F.lit(0)).alias("text_key")).distinct()
    row = F.struct(*[ref(c).alias(c) for c in documents.columns]).alias("row")
    rows = documents.select(
        id_key("doc_id").alias("id_key"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_key"), row
    )
    return rows.join(chosen, ["id_key", "text_key"], "left_semi").dropDuplicates(["id_key", "text_key"]).select("row.*")
