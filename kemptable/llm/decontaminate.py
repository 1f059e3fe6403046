"""Benchmark decontamination: test phrases are looked up in an FM-index per training shard.

A task cuts its documents into shards of whole documents. Words are numbered by
the vocabulary of the test phrases; any other word ends a run, and runs shorter
than the shortest phrase cannot hold one and are left out. The index of what
remains answers all phrases by backward search; the rows found are traced to
their places, and overlapping or touching places become removal spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.values import ref
from .common import short_batches, text_bytes, text_chunks
from .fmindex import FMIndex

# Text bytes in a shard. A document longer than this is a shard of its own.
SHARD_BYTES = 16 << 20
# Test text sent to the tasks at once; a larger benchmark goes in several passes.
PHRASE_BYTES = 8 << 20
# Places traced at once.
TRACED = 1 << 20

# Bytes that are part of a word, in lower case; all others become a space. Every
# byte of a character beyond ASCII is part of a word.
_WORD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD).split()


class Phrases:
    """Windows of the test items as rows of word numbers, by their length."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        rows: dict[int, dict[tuple[int, ...], set]] = {}
        for item, text in items:
            number = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            length = min(window, len(number))
            for start in range(len(number) - length + 1 if length else 0):
                rows.setdefault(length, {}).setdefault(tuple(number[start:start + length]), set()).add(item)
        self.by_length = [
            (length, np.array(list(found), np.int64), [sorted(i for i in owners if i is not None) for owners in found.values()])
            for length, found in sorted(rows.items())
        ]

    def shortest(self) -> int:
        return self.by_length[0][0] if self.by_length else 0


class Shard:
    """Word runs of some documents that test phrases could lie in."""

    def __init__(self, phrases: Phrases):
        self.phrases, self.counts, self.symbols, self.size = phrases, [], [], 0
        self.run_document, self.run_word, self.run_length = [], [], []

    def add(self, texts: list[bytes]) -> None:
        """Take in a chunk of documents."""
        get, pieces, first = self.phrases.vocabulary.get, [], len(self.counts)
        for text in texts:
            words = words_of(text)
            self.counts.append(len(words))
            pieces.append(np.fromiter(map(get, words, repeat(0)), np.int32, len(words)))
            pieces.append(np.zeros(1, np.int32))
        symbols = np.concatenate(pieces)
        sizes = np.array(self.counts[first:], np.int64) + 1
        starts = np.cumsum(sizes) - sizes
        edges = np.diff((symbols > 0).astype(np.int8), prepend=0)  # every document ends with 0
        begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        long = end - begin >= max(self.phrases.shortest(), 1)
        begin, end = begin[long], end[long]
        document = np.searchsorted(starts, begin, side="right") - 1
        keep = np.zeros(len(symbols) + 1, np.int32)
        np.add.at(keep, begin, 1)
        np.add.at(keep, end + 1, -1)  # with the 0 behind the run
        self.symbols.append(symbols[np.cumsum(keep[:-1]) > 0])
        self.run_document.append(document + first)
        self.run_word.append(begin - starts[document])
        self.run_length.append(end - begin)
        self.size += sum(map(len, texts))

    def hits(self) -> tuple[list[int], list[list[str]], list[list[tuple[int, int]]]]:
        """Words of each document, the items found in it, and its removal spans (first word, last word + 1)."""
        n = len(self.counts)
        items: list[set] = [set() for _ in range(n)]
        spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        text = np.concatenate(self.symbols) if self.symbols else np.zeros(0, np.int32)
        if len(text) and self.phrases.by_length:
            self._search(text, items, spans)
        return self.counts, [sorted(i) for i in items], spans

    def _search(self, text: np.ndarray, items: list[set], spans: list[list[tuple[int, int]]]) -> None:
        length = np.concatenate(self.run_length)
        document, word = np.concatenate(self.run_document), np.concatenate(self.run_word)
        run_at = np.cumsum(length + 1) - (length + 1)
        index = FMIndex(text, len(self.phrases.vocabulary) + 1)
        covered = np.zeros(len(text) + 1, np.int64)
        for size, patterns, owners in self.phrases.by_length:
            low, high = index.search(patterns)
            found = np.flatnonzero(high > low)
            if not len(found):
                continue
            for first in _slices(high[found] - low[found], TRACED):
                part = found[first]
                counts = high[part] - low[part]
                offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                places = index.locate(np.repeat(low[part], counts) + offset)
                np.add.at(covered, places, 1)
                np.add.at(covered, places + size, -1)
                at = document[np.searchsorted(run_at, places, side="right") - 1]
                pairs = np.unique(np.stack([at, np.repeat(part, counts)]), axis=1)
                for doc, pattern in pairs.T.tolist():
                    items[doc].update(owners[pattern])
        hit = np.cumsum(covered[:-1]) > 0
        edges = np.diff(hit.astype(np.int8), prepend=0, append=0)
        for begin, end in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True):
            run = int(np.searchsorted(run_at, begin, side="right")) - 1
            shift = int(word[run] - run_at[run])
            spans[document[run]].append((begin + shift, end + shift))


def _slices(counts: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Runs of places whose counts add up to about ``most``."""
    group = (np.cumsum(counts) - counts) // most
    for g in np.unique(group):
        yield np.flatnonzero(group == g)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))


def _look_up(sent, shard_bytes: int, columns: list[str]):
    """Adds what this block of test items hits to the items and spans of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = sent.value
        held: list[pa.RecordBatch] = []
        shard = Shard(phrases)
        for batch in batches:
            done = 0
            for first, texts in text_chunks(text_bytes(batch.column("text"))):
                shard.add(texts)
                if shard.size >= shard_bytes:
                    upto = first + len(texts)
                    yield _answer([*held, batch.slice(done, upto - done)], shard, columns)
                    held, done, shard = [], upto, Shard(phrases)
            if done < batch.num_rows:
                held.append(batch.slice(done))
        if held:
            yield _answer(held, shard, columns)

    return run


def _answer(held: list[pa.RecordBatch], shard: Shard, columns: list[str]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(held)
    counts, items, spans = shard.hits()
    old_items, old_spans = rows.column("items").to_pylist(), rows.column("spans").to_pylist()
    items = [sorted({*a, *b}) if a else b for a, b in zip(old_items, items, strict=True)]
    spans = [
        _merged([(s["first"], s["end"]) for s in a] + b) if a else b for a, b in zip(old_spans, spans, strict=True)
    ]
    found = [[{"first": a, "end": b} for a, b in s] for s in spans]
    made = {
        "n_words": pa.array(counts, pa.int64()),
        "items": pa.array(items, pa.list_(pa.string())),
        "spans": pa.array(found, SPANS),
    }
    table = pa.table([made[c] if c in made else rows.column(c) for c in columns], names=columns)
    return table.combine_chunks().to_batches()[0]


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    shard_bytes: int = SHARD_BYTES,
    phrase_bytes: int = PHRASE_BYTES,
    keep: tuple[str, ...] = ("doc_id",),
    keep_text: bool = False,
) -> DataFrame:
    """row, n_words, items (item ids as strings), spans (first word, end) for every row of ``documents``.

    ``row`` is a struct of the columns ``keep``, so their names clash with none;
    ``keep_text`` adds the text. Phrases are the runs of ``window`` words of each
    row of ``benchmark`` (item_id, text); a shorter item is one phrase, an item
    without words none. Null texts have no words. Rows of one item id are one
    item in ``items``; rows without id hit words but are not listed. Repeated
    documents are judged each. An empty benchmark hits nothing, an empty table
    gives no rows; other columns are not read. The benchmark goes to the tasks
    in blocks of about ``phrase_bytes`` of text, one pass each; a task holds one
    shard's index at a time.
    """
    short_batches(documents.sparkSession)
    rows = documents.select(
        F.struct(*[ref(c).alias(c) for c in keep]).alias("row"),
        "text",
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<string>").alias("items"),
        F.array().cast("array<struct<first:bigint,end:bigint>>").alias("spans"),
    )
    phrases = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text"))
    phrases = phrases.filter("text is not null").distinct()
    blocks = max(1, -(-(phrases.agg(F.sum(F.length("text"))).first()[0] or 0) // phrase_bytes))
    context, last = documents.sparkSession.sparkContext, blocks - 1
    for block in range(blocks):
        part = phrases.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).collect()
        sent = context.broadcast(Phrases([(r["item"], bytes(r["text"])) for r in part], window))
        columns = [c for c in rows.columns if c != "text" or keep_text or block < last]
        rows = rows.mapInArrow(_look_up(sent, shard_bytes, columns), rows.select(columns).schema)
    return rows


def contamination_digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row of ``contamination``."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return found.select(
        "row.doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )
