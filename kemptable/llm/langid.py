"""Language identification in two steps: the family, then the language within it.

A text is described by the shares of its hashed character bigrams and trigrams.
Linear support vector machines (Spark ML) separate the families one against one
and, within each family, its languages one against one. They are fitted on a
bounded sample of labelled rows; a prediction reads the text alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.values import ref
from ..session import cut_lineage
from .common import short_batches, text_bytes, text_chunks

# Families of closely related languages; a language that is not named here is a
# family of its own. Fixed values.
FAMILIES = {
    "germanic": ("de", "en", "nl", "af", "sv", "da", "no", "nb", "nn", "is", "fy", "lb"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "bg", "mk", "sr", "hr", "bs", "sl", "sk", "cs", "pl"),
    "baltic": ("lt", "lv"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tt"),
    "indic": ("hi", "mr", "ne", "bn", "gu", "pa", "ur"),
    "semitic": ("ar", "he", "mt", "am"),
}
# Rows per language that the machines are fitted on, about (chosen by a hash of doc_id).
SAMPLE_ROWS = 1500
# Rounds of the fit, and the tasks that share it: the sample is small, so the
# time goes into starting tasks.
ROUNDS, FIT_TASKS = 12, 4
# Text bytes described at once; its grams take about 40 times as much memory.
GRAM_BYTES = 1 << 20
# Hashed features: 2 ** BITS.
BITS = 14
UNKNOWN = "und"


class Machine(NamedTuple):
    """A fitted separation: features' weights, and which side is which."""

    weights: np.ndarray
    offset: float
    positive: str
    negative: str


class Model(NamedTuple):
    families: dict[str, list[str]]
    between: list[Machine]
    within: dict[str, list[Machine]]


def family_of(language: str) -> str:
    root = re.split(r"[-_]", language.lower())[0]
    return next((name for name, members in FAMILIES.items() if root in members), f"only {language}")


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers of all texts in a row, where each text begins, and how many it has."""
    # Two spaces in front of each text keep its grams apart from the text before it.
    flat = np.frombuffer("".join(f"  {t}" for t in texts).lower().encode("utf-32-le", "replace"), np.uint32)
    sizes = np.array([len(t.lower()) if not t.isascii() else len(t) for t in texts], np.int64) + 2
    codes = np.where((flat < 128) & ~(((flat >= 97) & (flat <= 122)) | (flat == 39)), np.uint32(32), flat)
    codes = np.append(codes, np.full(2, 32, np.uint32))
    pair = codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1] * np.uint32(0x85EBCA77)
    triple = (pair ^ (pair >> np.uint32(15))) * np.uint32(0xC2B2AE3D) + codes[2:] * np.uint32(0x27D4EB2F)
    triple ^= triple >> np.uint32(13)
    shift = np.uint32(32 - BITS)
    number = np.empty(2 * len(flat), np.int32)
    number[0::2] = (pair * np.uint32(0x165667B1)) >> shift
    number[1::2] = (triple * np.uint32(0x9E3779B1)) >> shift
    return number, 2 * (np.cumsum(sizes) - sizes), 2 * sizes


def _texts(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    for first, held in text_chunks(text_bytes(column), GRAM_BYTES):
        yield first, [h.decode("utf-8", "replace") for h in held]


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang and the feature shares of each text: the features that occur, and their shares."""
    for batch in batches:
        for first, texts in _texts(batch.column("text")):
            number, starts, sizes = grams(texts)
            found = [np.unique(number[a:a + n], return_counts=True) for a, n in zip(starts, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("lang").slice(first, len(texts)),
                    pa.array([f for f, _ in found], pa.list_(pa.int32())),
                    pa.array([c / n for (_, c), n in zip(found, sizes, strict=True)], pa.list_(pa.float64())),
                ],
                ["lang", "feature", "share"],
            )


@F.udf(VectorUDT())
def _vector(feature: list[int], share: list[float]):
    return Vectors.sparse(1 << BITS, feature, share)


def fit(labelled: DataFrame, key: Column, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Machines learned from (text, lang) rows; rows without language or letters are left out.

    At most about ``sample_rows`` rows of each language are used, chosen by a
    hash of ``key``; the language counts are the only thing the driver gathers
    besides the fitted weights.
    """
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    families: dict[str, list[str]] = {}
    for language in sorted(counts):
        families.setdefault(family_of(language), []).append(language)
    if len(counts) < 2:
        return Model(families, [], {})
    draw = F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    share = F.lit(0.0)
    for language, n in counts.items():
        share = F.when(F.col("lang") == language, min(1.0, sample_rows / n)).otherwise(share)
    sample = rows.filter(draw < share).select("text", "lang")
    sample = sample.mapInArrow(_shares, "lang string, feature array<int>, share array<double>")
    sample = cut_lineage(sample.select("lang", _vector("feature", "share").alias("features"))).coalesce(FIT_TASKS)

    def separate(positive: Iterable[str], negative: Iterable[str], a: str, b: str) -> Machine:
        sides = sample.filter(F.col("lang").isin(*positive, *negative))
        sides = sides.withColumn("label", F.col("lang").isin(*positive).cast("double"))
        fitted = LinearSVC(maxIter=ROUNDS, regParam=1e-3).fit(sides)
        return Machine(fitted.coefficients.toArray().astype(np.float32), float(fitted.intercept), a, b)

    between = [separate(families[a], families[b], a, b) for a, b in combinations(sorted(families), 2)]
    within = {
        name: [separate([a], [b], a, b) for a, b in combinations(members, 2)] for name, members in families.items()
    }
    return Model(families, between, within)


def _duel(machines: list[Machine], names: list[str], margins: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The name with most wins for each text (then the larger margin), and how sure that is (0.5 to 1)."""
    wins = np.zeros((len(names), n))
    for machine, margin in zip(machines, margins, strict=True):
        for name, sign in ((machine.positive, 1), (machine.negative, -1)):
            # The margin breaks ties between equal numbers of wins.
            wins[names.index(name)] += (sign * margin > 0) + 1e-3 * np.tanh(sign * margin)
    best = wins.argmax(axis=0)
    sure = np.ones(n)
    for machine, margin in zip(machines, margins, strict=True):
        chance = 1 / (1 + np.exp(np.clip(-2 * margin, -50, 50)))
        for name, value in ((machine.positive, chance), (machine.negative, 1 - chance)):
            at = best == names.index(name)
            sure[at] = np.minimum(sure[at], value[at])
    return best, sure


def predict(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    names = sorted(model.families)
    lettered = np.array([any(map(str.isalpha, t)) for t in texts], bool)  # numerals are no letters
    if not names or not lettered.any():
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    number, starts, sizes = grams(texts)

    def margins(machines: list[Machine]) -> list[np.ndarray]:
        return [np.add.reduceat(m.weights[number], starts) / sizes + m.offset for m in machines]

    family, score = _duel(model.between, names, margins(model.between), len(texts))
    found = np.empty(len(texts), object)
    for place, name in enumerate(names):
        members, machines = model.families[name], model.within.get(name, [])
        here = family == place
        if here.any():
            best, sure = _duel(machines, members, margins(machines), len(texts))
            found[here] = np.array(members, object)[best[here]]
            score[here] *= sure[here]
    found[~lettered], score[~lettered] = UNKNOWN, 0.0
    return found.tolist(), score


def _label(sent, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            languages, scores = [], []
            for _, texts in _texts(batch.column("text")):
                found, score = predict(model, texts)
                languages += found
                scores += score.tolist()
            made = [pa.array(languages, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in columns], *made], [*columns, "lang_pred", "score"]
            )

    return run


def held_out(key: str = "doc_id") -> Column:
    """Whether a row is kept from learning: crc32 of its id as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learned(documents: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of the rows that have an id and a language and are not held out."""
    rows = documents.filter(F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "text", "lang")
    return fit(rows, F.col("doc_id").cast("string"), sample_rows)


def languages(
    documents: DataFrame, model: Model | None = None, keep: tuple[str, ...] = ("doc_id",), keep_text: bool = False
) -> DataFrame:
    """row, lang_pred, score for every row of ``documents``.

    ``row`` is a struct of the columns ``keep``, so their names clash with none;
    ``keep_text`` adds the text. Without a ``model`` one is learned from the
    table. Null texts and texts without a letter are ``und`` with score 0, and
    so is everything where nothing could be learned; with one language all other
    texts are of it. Whole texts are read, repeated rows each; an empty table
    gives no rows; other columns are not read.
    """
    short_batches(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(learned(documents) if model is None else model)
    rows = documents.select(F.struct(*[ref(c).alias(c) for c in keep]).alias("row"), "text")
    columns = ["row", *(["text"] if keep_text else [])]
    schema = rows.select(*columns, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return rows.mapInArrow(_label(sent, columns), schema)


def language_digest(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; a row without id is not held out, nor learned from."""
    rows = documents.withColumn("_held_out", held_out())
    found = languages(rows, learned(documents), ("doc_id", "_held_out"))
    return found.select("row.doc_id", F.col("row._held_out").alias("held_out"), "lang_pred", "score")
