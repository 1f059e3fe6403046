"""Phrase collocations by vertical partitioning of the word suffixes of a corpus.

Every position of the text starts a suffix, cut after five words. Suffixes are
dealt into groups by their first words, so that a group fits a memory budget:
prefixes that are more frequent than the budget are extended by a word until
they fit, the others are packed together. Each group sorts its suffixes, which
is the tree they form, and reads the count of every phrase from the sum of the
leaves below it. Only suffixes that can hold a frequent phrase are dealt: those
whose words, and runs of two and three words, are frequent themselves. These
short runs are counted whole to know that, so suffixes are of four words or more.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.joins import fits_broadcast
from ..session import cut_lineage
from .common import mixed, short_batches, text_bytes

# Words of a phrase at most, and its occurrences at least.
LONGEST, LEAST = 5, 100
# Words of the longest runs that are counted whole; longer phrases are counted in trees of suffixes.
WHOLE = 3
# Phrases returned for each language.
FIRST = 2000
# Memory budget of a group: suffixes that its prefixes start (about 100 bytes each while they are sorted).
LEAVES = 1 << 20
# The budget grows so that there are at most so many groups, and so many heavy prefixes to send to the tasks.
MOST_GROUPS = 1 << 18
# Ranges of prefix hashes that are packed into groups, at most.
RANGES = 1 << 20
# Bits of an array that marks frequent words or runs of words: 16 for each, between these bounds (128 KB and 32 MB).
FEWEST_BITS, MOST_BITS, SLICE_BITS = 20, 28, 20
# Text and words that a task holds at once.
CHUNK_BYTES, HELD_WORDS = 8 << 20, 500_000

NO_LANGUAGE = "und"
# Bytes that end a piece, and the byte that stands for all of them, which no word can hold.
PIECE_ENDS, END = b".,;:!?\x0a\x0b\x0c\x0d", b"."
_TABLE = bytes.maketrans(
    bytes(range(65, 91)) + b"\t" + PIECE_ENDS, bytes(range(97, 123)) + b" " + END * len(PIECE_ENDS)
)


def words_and_ends(texts: Iterable[bytes]) -> list[bytes]:
    """Words of the texts in order, lower-cased, with END behind every piece."""
    return END.join([*texts, b""]).translate(_TABLE).replace(END, b" . ").split()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """(language, words and ends) of whole texts, each chunk of one language and of limited size."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for language, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
            held.setdefault(language, []).append(text)
            size += len(text)
            if size >= CHUNK_BYTES:
                for name, texts in held.items():
                    yield name, words_and_ends(texts)
                held, size = {}, 0
    for name, texts in held.items():
        yield name, words_and_ends(texts)


class Marks:
    """A set of 64-bit numbers as bits; it may hold some others too."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 8 - 1)

    def has_one(self, number: int) -> bool:
        place = number & (len(self.bits) * 8 - 1)
        return self.bits.item(place >> 3) >> (place & 7) & 1 == 1

    def has(self, numbers: np.ndarray) -> np.ndarray:
        place = numbers.astype(np.uint64) & self.mask
        return (self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def marks_of(numbers: DataFrame, column: str, count: int) -> Marks:
    """Marks of a long column. Tasks set the bits, slice by slice; the size follows ``count`` within fixed bounds."""
    bits = min(MOST_BITS, max(FEWEST_BITS, math.ceil(math.log2(16 * max(count, 1)))))
    slice_bits = 1 << SLICE_BITS
    place = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))

    def fill(table: pa.Table) -> pa.Table:
        where = table.column("place").to_numpy() % slice_bits
        found = np.zeros(slice_bits, bool)
        found[where] = True
        part = np.packbits(found, bitorder="little").tobytes()
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int64()), "bits": pa.array([part], pa.binary())})

    # A slice has as many different places at most as it has bits.
    parts = numbers.select(place.alias("place")).distinct().withColumn("part", F.shiftright("place", SLICE_BITS))
    whole = np.zeros((1 << bits) // 8, np.uint8)
    for row in parts.groupBy("part").applyInArrow(fill, "part long, bits binary").collect():
        whole[row["part"] * slice_bits // 8:][: slice_bits // 8] = np.frombuffer(row["bits"], np.uint8)
    return Marks(whole)


class WordIds(dict):
    """Numbers of a language's words: a 64-bit hash, or 0 for piece ends and words without a mark."""

    def __init__(self, language: str, seed: int, marks: Marks | None = None):
        super().__init__({END: 0})
        self.head, self.seed, self.marks = language.encode() + b"\0", seed, marks

    def __missing__(self, word: bytes) -> int:
        number = xxhash.xxh3_64_intdigest(self.head + word, self.seed) or 1
        if self.marks is not None and not self.marks.has_one(number):
            number = 0
        self[word] = number
        return number

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > 2 * HELD_WORDS:
            self.clear()
            self[END] = 0
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _extended(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of prefixes with one more word."""
    return mixed(prefix * np.uint64(0x9E3779B97F4A7C15) + word)


def _later(values: np.ndarray, by: int) -> np.ndarray:
    """Values moved towards the beginning, zeros behind."""
    return np.concatenate([values[by:], np.zeros(min(by, len(values)), values.dtype)])


def word_counts(texts: DataFrame, seed: int) -> DataFrame:
    """(language, id, word, n) of all words; the row with id 0 has the language's number of words.

    ``word`` and ``other`` are the first and the last word with that id: where
    they differ, two words share a hash.
    """
    schema = "language string, id long, word string, n long"
    arrow = pa.schema([("language", pa.string()), ("id", pa.int64()), ("word", pa.string()), ("n", pa.int64())])

    def table(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for language, counts in held.items():
            ids, words = WordIds(language, seed), list(counts)
            numbers = np.concatenate([ids.of(words).view(np.int64), [0]])
            totals = [*counts.values(), counts.total()]
            names = pa.array([*words, None], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([language] * len(totals)), pa.array(numbers), names, pa.array(totals, pa.int64())], schema=arrow
            )

    def count(batches):
        held: dict[str, Counter] = {}
        for language, words in _chunks(batches):
            counts = held.setdefault(language, Counter())
            counts.update(words)
            counts.pop(END, None)
            if sum(map(len, held.values())) > HELD_WORDS:
                yield from table(held)
                held = {}
        yield from table(held)

    return texts.mapInArrow(count, schema).groupBy("language", "id").agg(
        F.sum("n").alias("n"), F.min("word").alias("word"), F.max("word").alias("other")
    )


def frequent_words(texts: DataFrame, least: int) -> tuple[DataFrame, int]:
    """Frequent words and the languages' totals (id 0), and the seed under which no two words of the corpus share an id."""
    seed = 0
    while True:
        shared = ~F.col("word").eqNullSafe(F.col("other"))
        words = cut_lineage(word_counts(texts, seed).filter((F.col("id") == 0) | (F.col("n") >= least) | shared))
        if not words.filter(shared).limit(1).count():
            return words.drop("other"), seed
        seed += 1


class Suffixes:
    """What a task needs to cut suffixes out of texts.

    ``runs`` marks the frequent runs of two words, of three and so on, as far as
    they are known; ``heavy`` holds, from ``WHOLE`` words on, the sorted prefixes to extend.
    """

    def __init__(self, seed: int, words: Marks, runs: tuple[Marks, ...] = (), heavy: tuple[np.ndarray, ...] = ()):
        self.seed, self.words, self.runs, self.heavy = seed, words, runs, heavy

    def follows(self, batches) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per chunk: word ids, and where a run begins that is one word longer than the known ones and made of frequent ones."""
        known: dict[str, WordIds] = {}
        for language, words in _chunks(batches):
            if language not in known:
                known[language] = WordIds(language, self.seed, self.words)
            ids = known[language].of(words)
            run, follows = ids, ids != 0
            for d, marks in enumerate(self.runs, 1):
                run = _extended(run, _later(ids, d))
                follows = follows & _later(follows, 1) & marks.has(run)
            yield ids, follows & _later(follows, 1)

    def columns(self, batches) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per chunk, of the positions that start a suffix: word ids (row per depth, 0 behind the end), prefix hash, prefix depth.

        The prefix is the shortest that is not heavy. That of a suffix that
        ends with a heavy prefix counts as one word longer, for its parts lie
        in several groups.
        """
        for ids, follows in self.follows(batches):
            start, alive = np.flatnonzero(follows), follows[follows]
            if not len(start):
                continue
            table = [_later(ids, d)[start] for d in range(WHOLE)]
            prefix = table[0]
            for word in table[1:]:
                prefix = _extended(prefix, word)
            depth = np.full(len(start), WHOLE, np.int8)
            for d in range(WHOLE, LONGEST):
                alive = alive & _later(follows, d - WHOLE)[start]
                word = np.where(alive, _later(ids, d)[start], np.uint64(0))
                table.append(word)
                if d - WHOLE < len(self.heavy):
                    extend = (depth == d) & np.isin(prefix, self.heavy[d - WHOLE])
                    prefix = np.where(extend & alive, _extended(prefix, word), prefix)
                    depth[extend] = d + 1
            yield np.vstack(table), prefix, depth


def run_counts(texts: DataFrame, cutter, depth: int) -> DataFrame:
    """(w0, w1, w2, n): the runs of ``depth`` words, two or three, that are made of frequent ones, and their occurrences.

    The third word of two is 0.
    """
    names = [f"w{d}" for d in range(WHOLE)]

    def count(batches):
        held, size = [], 0

        def table():
            columns, n = merged_rows(np.hstack(held), np.ones(size, np.int64))
            columns = [pa.array(np.ascontiguousarray(row).view(np.int64)) for row in columns]
            columns += [pa.array(np.zeros(len(n), np.int64))] * (WHOLE - depth)
            return pa.RecordBatch.from_arrays([*columns, pa.array(n)], names=[*names, "n"])

        for ids, follows in cutter.value.follows(batches):
            held.append(np.vstack([_later(ids, d)[follows] for d in range(depth)]))
            size += held[-1].shape[1]
            if size > 8 * HELD_WORDS:
                yield table()
                held, size = [], 0
        if size:
            yield table()

    schema = f"{', '.join(f'{x} long' for x in names)}, n long"
    return texts.mapInArrow(count, schema).groupBy(*names).agg(F.sum("n").alias("n"))


def hashed(runs: DataFrame, depth: int) -> DataFrame:
    """(prefix, n): hashes of counted runs of ``depth`` words."""

    def hashes(batches):
        for batch in batches:
            prefix, *later = [batch.column(d).to_numpy().view(np.uint64) for d in range(depth)]
            for word in later:
                prefix = _extended(prefix, word)
            yield pa.RecordBatch.from_arrays([pa.array(prefix.view(np.int64)), batch.column("n")], names=["prefix", "n"])

    return runs.mapInArrow(hashes, "prefix long, n long")


def prefix_counts(texts: DataFrame, cutter, depth: int) -> DataFrame:
    """(prefix, n): hashes of the prefixes of ``depth`` words and how many suffixes they start."""

    def count(batches):
        held, size = [], 0

        def table():
            prefixes, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(prefixes.view(np.int64)), pa.array(n)], names=["prefix", "n"])

        for _, prefix, depths in cutter.value.columns(batches):
            held.append(prefix[depths == depth])
            size += len(held[-1])
            if size > 8 * HELD_WORDS:
                yield table()
                held, size = [], 0
        if held:
            yield table()

    return texts.mapInArrow(count, "prefix long, n long").groupBy("prefix").agg(F.sum("n").alias("n"))


def merged_rows(columns: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One of each set of equal rows and the sum of their ``n``; ``columns`` has an array per column."""
    order = np.lexsort(columns)
    columns = columns[:, order]
    new = np.ones(len(n), bool)
    new[1:] = (columns[:, 1:] != columns[:, :-1]).any(axis=0)
    first = np.flatnonzero(new)
    return columns[:, first], np.add.reduceat(n[order], first)


def subtree(columns: np.ndarray, depth: np.ndarray, n: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words, phrases, totals) of the tree of a group's suffixes, by depth from two words on.

    Sorted suffixes are the leaves in order; a phrase is a run of leaves that
    begin alike, and its count is their total. Phrases below ``least`` are left
    out, but for those shorter than the prefix of their leaves, which other
    groups may count too.
    """
    order = np.lexsort(columns[::-1])
    columns, depth, n = columns[:, order], depth[order], n[order]
    new = np.zeros(len(n), bool)
    new[:1] = True
    for d in range(1, LONGEST + 1):
        new[1:] |= columns[d - 1][1:] != columns[d - 1][:-1]
        if d < 2:
            continue
        first = np.flatnonzero(new)
        totals, partial = np.add.reduceat(n, first), np.maximum.reduceat(depth, first) > d
        kept = (columns[d - 1][first] != 0) & (partial | (totals >= least))
        yield d, columns[:d, first[kept]], totals[kept]


def _group_of_range(prefixes: list[DataFrame], bits: int, budget: int) -> np.ndarray:
    """Group of every range of prefix hashes: neighbours are packed until the budget is reached."""
    place = F.shiftrightunsigned("prefix", 64 - bits)
    sizes = np.zeros(1 << bits, np.int64)
    for table in prefixes:
        found = table.groupBy(place.alias("place")).agg(F.sum("n").alias("n")).toArrow()
        np.add.at(sizes, found.column("place").to_numpy(), found.column("n").to_numpy())
    return ((np.cumsum(sizes) - sizes) // budget).astype(np.int32)


def frequent_phrases(
    texts: DataFrame, words: DataFrame, seed: int, least: int, leaves: int = LEAVES
) -> DataFrame:
    """(ids, a): phrases of two to five words, as ids, with their occurrences if these are ``least`` or more."""
    spark = texts.sparkSession
    send = spark.sparkContext.broadcast
    frequent = words.filter("id <> 0")
    known = marks_of(frequent, "id", frequent.count())
    whole, runs = [], ()
    for depth in range(2, WHOLE + 1):
        counted = run_counts(texts, send(Suffixes(seed, known, runs)), depth)
        counted = cut_lineage(counted.filter(F.col("n") >= least))
        whole.append(counted.select(F.array(*counted.columns[:depth]).alias("ids"), F.col("n").alias("a")))
        prefixes = cut_lineage(hashed(counted, depth))
        size = prefixes.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
        runs += (marks_of(prefixes, "prefix", size["rows"]),)
    budget = max(leaves, size["n"] // MOST_GROUPS)
    levels, heavy = [prefixes], []
    while len(heavy) < LONGEST - WHOLE:
        above = levels[-1].filter(F.col("n") > budget).select("prefix").toArrow().column("prefix")
        if not len(above):
            break
        heavy.append(np.sort(above.to_numpy().view(np.uint64)))
        cutter = send(Suffixes(seed, known, runs, tuple(heavy)))
        levels.append(cut_lineage(prefix_counts(texts, cutter, len(heavy) + WHOLE)))
    light = [level.filter(F.col("n") <= budget) for level in levels]
    bits = max(1, min(int(math.log2(RANGES)), math.ceil(math.log2(8 * size["n"] / budget + 2))))
    groups = send(_group_of_range(light, bits, budget))
    cutter = send(Suffixes(seed, known, runs, tuple(heavy)))
    names = [f"w{d}" for d in range(LONGEST)]
    schema = f"group int, depth byte, {', '.join(f'{x} long' for x in names)}, n long"

    def deal(batches):
        held, counts, size = [], [], 0

        def table(columns, n):
            group, depth, *rest = columns
            return pa.RecordBatch.from_arrays(
                [pa.array(group.astype(np.int32)), pa.array(depth.astype(np.int8)),
                 *[pa.array(np.ascontiguousarray(row).view(np.int64)) for row in rest], pa.array(n)],
                names=["group", "depth", *names, "n"],
            )

        for suffixes, prefix, depth in cutter.value.columns(batches):
            group = groups.value[prefix >> np.uint64(64 - bits)]
            rows = np.vstack([group.astype(np.uint64), depth.astype(np.uint64), suffixes])
            rows, n = merged_rows(rows, np.ones(rows.shape[1], np.int64))
            held.append(rows)
            counts.append(n)
            size += len(n)
            if size > 4 * HELD_WORDS:
                rows, n = merged_rows(np.hstack(held), np.concatenate(counts))
                held, counts, size = [rows], [n], len(n)
                if size > 2 * HELD_WORDS:
                    yield table(rows, n)
                    held, counts, size = [], [], 0
        if held:
            yield table(*merged_rows(np.hstack(held), np.concatenate(counts)))

    def count(table: pa.Table) -> pa.Table:
        columns = np.vstack([table.column(x).to_numpy() for x in names])
        ids, totals = [], []
        for d, phrases, found in subtree(columns, table.column("depth").to_numpy(), table.column("n").to_numpy(), least):
            if d <= WHOLE:
                continue
            flat = pa.array(np.ascontiguousarray(phrases.T).ravel())
            ids.append(pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * d), flat))
            totals.append(pa.array(found))
        return pa.table({"ids": pa.chunked_array(ids, pa.list_(pa.int64())), "a": pa.chunked_array(totals, pa.int64())})

    dealt = texts.mapInArrow(deal, schema).groupBy("group").applyInArrow(count, "ids array<long>, a long")
    longer = dealt.groupBy("ids").agg(F.sum("a").alias("a")).filter(F.col("a") >= least)
    return reduce(DataFrame.unionByName, [*whole, longer])


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """(language, ids, a, l, r, n, score): each phrase at its lowest-scoring cut, the first on a tie.

    The score is floor(1000 * a * n / (l * r)) in decimals of 38 digits, exact
    up to 10^38 in the product, which is 10^17 words.
    """
    parts = phrases.select("ids", F.col("a").alias("part_n"), F.lit(None).cast("string").alias("language")).unionByName(
        words.filter("id <> 0").select(F.array("id").alias("ids"), F.col("n").alias("part_n"), "language")
    )
    cuts = phrases.select("ids", "a", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.withColumn("head", F.slice("ids", F.lit(1), F.col("k")))
    cuts = cuts.withColumn("rest", F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k")))
    head = parts.select(F.col("ids").alias("head"), F.col("part_n").alias("l"), "language")
    rest = parts.select(F.col("ids").alias("rest"), F.col("part_n").alias("r"))
    cut = F.struct("k", "l", "r")
    # The head of one word knows the language.
    found = cuts.join(head, "head").join(rest, "rest").groupBy("ids", "a").agg(
        F.max("language").alias("language"), F.collect_list(cut).alias("cuts")  # four at most
    )
    totals = words.filter("id = 0").select("language", F.col("n").alias("n"))
    if fits_broadcast(totals):
        totals = F.broadcast(totals)

    def wide(column: Column) -> Column:
        return column.cast("decimal(38,0)")

    def product(x: Column, y: Column) -> Column:
        return wide(wide(x) * wide(y))

    value = F.transform("cuts", lambda c: F.struct(
        F.call_function("div", product(product(F.lit(1000), F.col("a")), F.col("n")), product(c["l"], c["r"])).alias("score"),
        c["k"].alias("k"), c["l"].alias("l"), c["r"].alias("r"),
    ))
    best = found.join(totals, "language").withColumn("best", F.array_min(value))
    return best.select("language", "ids", "a", "best.l", "best.r", "n", "best.score")


def maximal(phrases: DataFrame) -> DataFrame:
    """Phrases that no longer one with as many occurrences holds.

    If any longer phrase holds one as often, so does one that is a single word
    longer, since those between them occur no less often.
    """
    longer = phrases.filter(F.size("ids") > 2)
    inner = F.array(F.slice("ids", F.lit(1), F.size("ids") - 1), F.slice("ids", F.lit(2), F.size("ids") - 1))
    held = longer.select(F.explode(inner).alias("ids"), "a").groupBy("ids").agg(F.max("a").alias("held"))
    return phrases.join(held, "ids", "left").filter(F.col("held").isNull() | (F.col("held") < F.col("a"))).select("ids", "a")


def collocations(
    documents: DataFrame, text: str = "text", language: str = "lang", least: int = LEAST, first: int = FIRST,
    leaves: int = LEAVES,
) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Null texts are empty, a null language is ``und``; other columns and row ids
    are not looked at, and equal rows count as often as they are there. Pieces
    end at ``. , ; : ! ?`` and line breaks, words at blanks and tabs. Without
    frequent phrases the result is empty. ``least`` must be 1 or more.
    """
    spark: SparkSession = documents.sparkSession
    short_batches(spark)
    name = F.coalesce(F.col(f"`{language}`").cast("string"), F.lit(NO_LANGUAGE))
    texts = documents.select(name.alias("language"), F.col(f"`{text}`").cast("string").alias("text"))
    words, seed = frequent_words(texts, least)
    phrases = cut_lineage(frequent_phrases(texts, words, seed, least, leaves))
    found = scored(phrases, words).join(maximal(phrases).select("ids"), "ids", "left_semi")
    level = Window.partitionBy("language").orderBy(F.desc("score"), F.desc("a"))
    top = cut_lineage(found.withColumn("place", F.rank().over(level)).filter(F.col("place") <= first).drop("place"))
    spelled = (
        top.select("ids", F.posexplode("ids").alias("at", "id"))
        .join(words.filter("id <> 0").select("id", "word"), "id")
        .groupBy("ids")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    )
    last = Window.partitionBy("language").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = top.join(spelled, "ids").withColumn("rank", F.row_number().over(last).cast("long"))
    return ranked.filter(F.col("rank") <= first).select(
        F.col("language").alias("lang"), "rank", "phrase", "a", "l", "r", "n", "score"
    )
