"""Token counts by rank-synchronous merging of arrays.

A text is cut at white space and each distinct piece is counted once per task.
The pieces' pre-tokens are held as one flat array of symbols with their
sequence numbers. In each round every sequence applies its own lowest-rank pair
at all its places at once; what is left when no pair has a rank is counted.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import short_batches, text_bytes, text_chunks

# Distinct pieces a task remembers; beyond that it forgets them and goes on.
REMEMBERED = 500_000
# White space for the vocabulary's patterns (Unicode's White_Space).
SPACE = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
# What str.split() takes for white space and the vocabulary does not.
SEPARATORS = regex.compile(r"[\x1c-\x1f]")


class RankMerger:
    """Symbol counts of pre-tokens under the merges of a vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        model = spec["model"]
        vocab, merges = model["vocab"], model["merges"]
        self.vocab, self.suffix = vocab, model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.width = np.int64(max(vocab.values()) + 1)
        keys = left * self.width + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def symbols(self, pre_token: str) -> list[int]:
        """First symbols of a pre-token: its characters, the last one with the end mark."""
        return [self.vocab[c] for c in pre_token[:-1]] + [self.vocab[pre_token[-1] + self.suffix]]

    def counts(self, pre_tokens: list[str]) -> np.ndarray:
        """Symbols left of each pre-token."""
        if not pre_tokens:
            return np.zeros(0, np.int64)
        rows = [self.symbols(t) for t in pre_tokens]
        sizes = np.array([len(r) for r in rows], np.int64)
        symbol = np.fromiter((s for r in rows for s in r), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(rows)), sizes)
        left = sizes.copy()
        while len(symbol) > 1:
            key = symbol[:-1] * self.width + symbol[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ranked = (self.keys[at] == key) & (owner[:-1] == owner[1:])
            if not ranked.any():
                break
            none = np.int64(len(self.keys))
            rank = np.append(np.where(ranked, self.rank[at], none), none)
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lowest = np.minimum.reduceat(rank, starts)
            lowest = np.repeat(lowest, np.diff(np.append(starts, len(owner))))
            hit = (rank == lowest) & (rank < none)
            # Overlapping places (a a a) are taken from the left, every second one.
            run_start = hit & ~np.append(False, hit[:-1])
            place = np.arange(len(hit))
            since = place - np.maximum.accumulate(np.where(run_start, place, 0))
            hit &= since % 2 == 0
            symbol[hit] = self.made[rank[hit]]
            keep = ~np.append(False, hit[:-1])
            # Sequences without any pair left are done and leave the arrays.
            alive = keep & (lowest < none)
            left -= np.bincount(owner[~keep], minlength=len(rows))
            symbol, owner = symbol[alive], owner[alive]
        return left

    def piece_counts(self, pieces: list[str]) -> np.ndarray:
        """Tokens of each piece; a special string counts one token."""
        owner, tokens, special = [], [], np.zeros(len(pieces), np.int64)
        for i, piece in enumerate(pieces):
            parts = [piece]
            if self.special is not None and self.special.search(piece):
                parts = self.special.split(piece)
                special[i] = len(parts) - 1
            for part in parts:
                if part:
                    for token, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(part)):
                        tokens.append(token)
                        owner.append(i)
        left = self.counts(tokens)
        return special + np.bincount(np.array(owner, np.int64), left, len(pieces)).astype(np.int64)


def _pieces(text: str) -> list[str]:
    return [p for p in SPACE.split(text) if p] if SEPARATORS.search(text) else text.split()


def _text_totals(merger: RankMerger, texts: list[str], known: dict[str, int]) -> list[int]:
    """Tokens of each text; ``known`` learns the pieces that are new, all in one batch."""
    cut = [_pieces(t) for t in texts]
    if len(known) > REMEMBERED:
        known.clear()
    new = list(set().union(*cut).difference(known))
    known.update(zip(new, merger.piece_counts(new).tolist(), strict=True))
    return [sum(map(known.__getitem__, pieces)) for pieces in cut]


def _count_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger, known = RankMerger(path), {}
        for batch in batches:
            texts, totals = batch.column("text"), []
            for _, held in text_chunks(text_bytes(texts)):
                totals += _text_totals(merger, [h.decode("utf-8", "replace") for h in held], known)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(totals, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    return run


def token_counts(documents: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``documents``.

    ``vocabulary`` is the path of a tokenizers file (byte-level BPE with white
    space dropped) that every executor has. Counts are those of the library
    without begin and end tokens; special strings inside a text count one token
    each. Null and empty texts have no bytes and no tokens. Rows are counted one
    by one, so repeated rows, null ids and an empty table need no care; other
    columns are not read. A text is held whole, its distinct pieces once.
    """
    short_batches(documents.sparkSession)
    kind = documents.schema["doc_id"].dataType.simpleString()
    bytes_ = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return (
        documents.select("doc_id", "text", bytes_.alias("n_bytes"))
        .mapInArrow(_count_batches(vocabulary), f"doc_id {kind}, n_bytes long, n_tokens long")
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
