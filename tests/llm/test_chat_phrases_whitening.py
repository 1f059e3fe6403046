"""Chat examples, collocations and whitening against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kemptable.llm.chat import chat_digest, chat_examples, read_turns
from kemptable.llm.collocations import (
    Marks, collocations, frequent_words, marks_of, merged_rows, subtree, words_and_ends,
)
from kemptable.llm.whitening import Centre, shifted_factor, solved, whitened_vectors

SAID = ["", "plain", "\\### Assistant: </turn> ok", "#### #\\h\\b\\\\l</turn", "</turn>\n### user: x </turn>\n", "é 😀 " * 9, " ", "\\", ":\n\r"]
ROLES = ["user", "assistant", "system", "a:b### c", None, "", "Assistant"]


def conversations(spark, rows):
    schema = "conv_id long, turn long, role string, text string, position int, `x.y` string"
    return spark.createDataFrame([(*r, 7, "z") for r in rows], schema).repartition(3)


def brute_chat(rows):
    def ordered(r):
        return [(x is not None, x if x is not None else 0) for x in (r[1], r[2] or "", r[3] or "")]

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    found = {}
    for row in sorted(rows, key=ordered):
        found.setdefault(row[0], []).append((row[2] or "", row[3] or ""))
    return {
        c: (len(t), sha("".join(f"{a}\n{b}\n" for a, b in t)), len(s := "".join(b for a, b in t if a == "assistant")), sha(s))
        for c, t in found.items()
    }


def test_chat_round_trip(spark):
    random.seed(3)
    rows = [(i, j, random.choice(ROLES), random.choice([*SAID, None])) for i in range(40) for j in range(random.randint(1, 9))]
    rows += [(50, None, "user", "a"), (50, 1, "assistant", "b"), (50, 1, "assistant", "b"), (50, 1, "user", "tie"), (None, 1, "assistant", "c")]
    rows += [(60, 1, "user", "x" * 300_000), (60, 2, "assistant", "### " * 50_000)]
    rows += [(70, j, ("user", "assistant")[j % 2], f"turn {j}") for j in range(1500)]
    examples = chat_examples(conversations(spark, rows)).persist()
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat_digest(examples).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256").collect()}
    assert got == brute_chat(rows)
    # Every reply has one example, which ends with it and holds the turns before it.
    replies = Counter(r[0] for r in rows if r[2] == "assistant")
    masked = examples.filter("loss_start is not null").groupBy("conv_id").count().collect()
    assert {r["conv_id"]: r["count"] for r in masked} == dict(replies)
    one = examples.filter("conv_id = 70 and example = 3").select(read_turns(F.col("text")).alias("t"), "text", "loss_start", "loss_end").first()
    assert [t["text"] for t in one["t"]] == [f"turn {j}" for j in range(6)]
    assert one["text"][one["loss_start"]:one["loss_end"]] == "turn 5" and one["text"].endswith("turn 5 </turn>\n")


def test_chat_without_rows_and_without_python(spark):
    assert chat_digest(chat_examples(conversations(spark, []))).collect() == []
    plan = chat_digest(chat_examples(conversations(spark, [(1, 1, "user", "a")])))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def brute_phrases(rows, least, first):
    table = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    counts, totals = {}, Counter()
    for language, text in rows:
        language = language or "und"
        own = counts.setdefault(language, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").encode().translate(table).decode()):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[language] += len(words)
            for m in range(1, 6):
                own.update(tuple(words[i:i + m]) for i in range(len(words) - m + 1))
    out = []
    for language, own in counts.items():
        found, n = [], totals[language]
        many = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        held = Counter()
        for p, a in many.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    held[p[i:i + m]] = max(held[p[i:i + m]], a)
        for p, a in many.items():
            if held[p] < a:
                score, k = min((1000 * a * n // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]], n))
        for rank, (s, a, p, l, r, n) in enumerate(sorted(found)[:first], 1):
            out.append((language, rank, p.decode(), -a, l, r, n, -s))
    return sorted(out)


def texts(spark, rows):
    return spark.createDataFrame([(i, t, l, 1, 2) for i, (l, t) in enumerate(rows)], "doc_id long, text string, lang string, id int, `a.b` int").repartition(4)


def corpus():
    random.seed(5)
    vocabulary = ["The", "of", "new", "york", "é", "city", "a" * 40, "x-y", "日本", "\x0bq", " "]
    rows = [
        (random.choice(["en", "de", None, "und"]), " ".join(random.choices(vocabulary, [9, 7, 3, 3, 2, 2, 1, 1, 1, 1, 1], k=random.randint(0, 60))) + random.choice(["", ". ", "\n", ",,"]) )
        for _ in range(300)
    ]
    rows += [("en", "in new york city today; " * 40)] * 5 + [("en", None), (None, ""), ("fr", "a a a a a a a a a\t \ta"), ("en", "go " * 30_000)]
    return rows


@pytest.mark.parametrize(("least", "first", "leaves"), [(5, 2000, 1 << 20), (2, 2000, 200), (20, 7, 50), (1, 2000, 5000), (10**9, 5, 10)])
def test_collocations_equal_brute_force(spark, least, first, leaves):
    """Small budgets extend the frequent prefixes up to five words and make many groups."""
    rows = corpus() if least > 1 else corpus()[:40] + corpus()[-4:-1]
    got = sorted(tuple(r) for r in collocations(texts(spark, rows), least=least, first=first, leaves=leaves).collect())
    assert got == brute_phrases(rows, least, first)


def test_suffixes_are_dealt_only_where_runs_of_three_are_frequent(spark, monkeypatch):
    """Every pair below is frequent, but of longer runs only those of one sentence; r03 F1."""
    random.seed(7)
    rows = [("en", " ".join(random.choices("abcdefgh", k=40))) for _ in range(100)] + [("en", "v w x y z")] * 40
    kind, made = type(spark.range(1)), []
    true = kind.mapInArrow

    def noted(self, *args, **more):
        made.append(true(self, *args, **more))
        return made[-1]

    monkeypatch.setattr(kind, "mapInArrow", noted)
    got = sorted(tuple(r) for r in collocations(texts(spark, rows), least=30).collect())
    assert got == brute_phrases(rows, 30, 2000) and any(r[2] == "v w x y z" for r in got)
    (dealt,) = [table for table in made if "group" in table.columns]
    # The two suffixes of four words or more in the sentence, once in each of four tasks.
    assert dealt.count() <= 8


def test_collocations_of_nothing(spark):
    assert collocations(texts(spark, [])).collect() == []
    assert collocations(texts(spark, [("en", None), (None, " .. ")]), least=1).collect() == []


def test_scores_beyond_64_bits(spark):
    from kemptable.llm.collocations import scored

    words = spark.createDataFrame([("en", 1, "a", 10**13), ("en", 2, "b", 3 * 10**12), ("en", 0, None, 7 * 10**13)], "language string, id long, word string, n long")
    phrases = spark.createDataFrame([([1, 2], 2 * 10**12 + 1)], "ids array<long>, a long")
    assert scored(phrases, words).first()["score"] == 1000 * (2 * 10**12 + 1) * 7 * 10**13 // (3 * 10**25)


def test_words_of_one_hash_ask_for_another_seed(spark, monkeypatch):
    import kemptable.llm.collocations as module

    true = module.word_counts
    seeds = []

    def clash(table, seed):
        seeds.append(seed)
        counted = true(table, seed)
        return counted.withColumn("other", F.concat("word", F.lit("x"))) if seed == 0 else counted

    monkeypatch.setattr(module, "word_counts", clash)
    table = texts(spark, [("en", "a b a b")]).select(F.col("lang").alias("language"), "text")
    words, seed = frequent_words(table, 1)
    assert seeds == [0, 1] and seed == 1 and {r["word"]: r["n"] for r in words.collect()} == {"a": 2, "b": 2, None: 4}


def test_marks_and_subtrees(spark):
    numbers = [0, -1, 5, 2**62, -(2**63)]
    marks = marks_of(spark.createDataFrame([(x,) for x in numbers], "v long"), "v", 5)
    assert marks.has(np.array(numbers, np.int64).view(np.uint64)).all()
    assert marks.has(np.arange(6, 1000, dtype=np.uint64)).sum() == 0
    assert not Marks(np.zeros(8, np.uint8)).has(np.arange(64, dtype=np.uint64)).any()
    rows = np.array([[1, 2, 0, 0, 0], [1, 2, 3, 0, 0], [1, 2, 0, 0, 0], [4, 4, 4, 4, 4]]).T
    merged, n = merged_rows(rows, np.ones(4, np.int64))
    assert sorted(zip(merged[0].tolist(), merged[2].tolist(), n.tolist())) == [(1, 0, 2), (1, 3, 1), (4, 4, 1)]
    found = {tuple(p): int(t) for _, ps, ts in subtree(merged, np.full(3, 2), n, 2) for p, t in zip(ps.T.tolist(), ts)}
    assert found == {(1, 2): 3}
    assert words_and_ends([b"A b.c", b"d"]) == [b"a", b"b", b".", b"c", b".", b"d", b"."]


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 3, "n") for r in rows], "vec_id long, embedding array<float>, component int, `n.n` string").repartition(3)


def check_whitening(got, rows, d, most=32):
    kept = [(i, v) for i, v in rows if v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in kept], object)
    n, sums = len(kept), x.sum(axis=0)
    centred = ((x * n - sums) / n).astype(float)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(most, int((values > 1e-9 * values[0]).sum()))
    assert len(got) == n * k
    deviation = Counter(((i, int(s)) for (i, _), s in zip(kept, ((x * n - sums) ** 2).sum(axis=1))))
    assert Counter((r["vec_id"], r["deviation"]) for r in got if r["component"] == 1) == deviation
    want = centred @ axes[:, :k] / np.sqrt(values[:k])
    by = {(r["vec_id"], r["component"]): r["whitened"] for r in got}
    for c in range(k):
        mine = np.array([by[i, c + 1] for i, _ in kept])
        assert np.allclose(mine, want[:, c], atol=1e-6) or np.allclose(mine, -want[:, c], atol=1e-6)
        assert math.isclose(next(r["explained"] for r in got if r["component"] == c + 1), values[c] / values.sum(), rel_tol=1e-8)
    assert got[0]["n"] == n and 0 <= got[0]["identity_error"] < 1e-8


def test_whitening_equals_eigenvectors(spark):
    random.seed(9)
    scales = [10 ** (2 - j / 2) for j in range(7)]
    rows = [(i, [random.gauss(3, s) for s in scales]) for i in range(400)]
    rows += [(1000, None), (1001, [None] * 7), (1002, [math.nan] * 7), (1003, [math.inf] * 7), (1004, [1.0]), (1005, []), (1006, rows[0][1])]
    rows += [(2000 + i, rows[5][1]) for i in range(300)]
    check_whitening(whitened_vectors(vectors(spark, rows)).collect(), rows, 7)
    few = whitened_vectors(vectors(spark, rows), most=2).collect()
    check_whitening(few, rows, 7, 2)


def test_whitening_without_full_rank(spark):
    """A constant, a repeated and a summed dimension; fewer vectors than dimensions."""
    random.seed(2)
    rows = [(i, [a := float(random.randint(-9, 9)), b := float(random.randint(-50, 50)), a, 4.0, a + b, 0.5 * b]) for i in range(90)]
    check_whitening(whitened_vectors(vectors(spark, rows)).collect(), rows, 6)
    short = [(i, [random.gauss(0, 1) * 20 for _ in range(12)]) for i in range(5)]
    check_whitening(whitened_vectors(vectors(spark, short)).collect(), short, 12)


def test_whitening_of_little(spark):
    assert whitened_vectors(vectors(spark, [])).collect() == []
    assert whitened_vectors(vectors(spark, [(1, None), (2, [])])).collect() == []
    assert whitened_vectors(vectors(spark, [(1, [1.0, 2.0])] * 3)).collect() == []
    huge = whitened_vectors(vectors(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 5.0])])).collect()
    # Sums of squares that pass 64 bits are null; beside such entries the other direction has no variance that doubles can tell.
    assert len(huge) == 3 and {r["deviation"] for r in huge} == {None, 2_000_000**2 + (3 * 1_000_320 - 3_000_384) ** 2} and huge[0]["identity_error"] < 1e-6


def test_exact_deviations_and_factors():
    whole = np.array([[2**50, 7], [-(2**50), 9], [3, 2**40]], np.int64)
    centre = Centre(3, tuple(int(s) for s in whole.astype(object).sum(axis=0)))
    assert (centre.deviations(whole) == whole.astype(object) * 3 - np.array(centre.sums, object)).all()
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(50, 6)) @ np.diag([1e6, 1e3, 1, 1, 1e-2, 1e-3])
    factor = shifted_factor(rows.T @ rows)
    assert np.allclose(np.tril(factor, -1), 0) and np.allclose(solved(rows, factor) @ factor, rows)
