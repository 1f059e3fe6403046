"""Language, near-duplicates, licences, mixing, decontamination and token counts on awkward and random tables."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from brute import awkward_texts, documents, noise
from conftest import SMALL
from kemptable.llm import decontaminate, fmindex, hyperminhash, langid, licenses, mixing, neardup, tokens
from kemptable.llm.components import components
from kemptable.llm.queries import queries, table

VOCABULARY = "word_bpe_49k.json"


def test_held_out_languages(spark):
    found = queries()["op1_languages"](spark, SMALL)
    truth = table(spark, SMALL, "documents").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").filter("held_out").collect()
    assert len(rows) > 20 and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_languages_of_awkward_texts(spark):
    odd = [*awkward_texts(), "½ ² ③ Ⅷ", "12 ١٢ 五½"]
    texts = odd + ["the house and the street"] * 20 + ["das haus und die straße"] * 20
    langs = [None] * len(odd) + ["en"] * 20 + ["de"] * 20
    docs = documents(spark, texts, langs=langs)
    rows = {r["doc_id"]: r for r in langid.language_digest(docs).collect()}
    for i, text in enumerate(texts):
        unknown = not any(c.isalpha() for c in text or "")
        assert (rows[i]["lang_pred"] == "und") == unknown
        if i >= len(odd):
            assert rows[i]["lang_pred"] == langs[i]
    assert langid.language_digest(docs.limit(0)).count() == 0
    unlabelled = langid.language_digest(documents(spark, ["some text"], langs=[None])).first()
    assert (unlabelled["lang_pred"], unlabelled["score"]) == ("und", 0.0)
    one = langid.language_digest(documents(spark, ["some text"] * 9, langs=["en"] * 9)).collect()
    assert {r["lang_pred"] for r in one} == {"en"}


def test_languages_within_a_family(spark):
    """Three languages of one family and one of its own."""
    draw = random.Random(3)
    words = {"fr": "le la et est une dans", "es": "el la y es una en", "it": "il la e è una nel", "xx": "zq wv kx qz vw xk"}
    langs = [draw.choice(list(words)) for _ in range(300)]
    texts = [" ".join(draw.choice(words[k].split()) for _ in range(30)) for k in langs]
    rows = langid.language_digest(documents(spark, texts, langs=langs)).filter("held_out").collect()
    assert sum(langs[r["doc_id"]] == r["lang_pred"] for r in rows) / len(rows) > 0.95


def near(spark, texts, ids=None, percent=85, width=3):
    found = neardup.near_duplicates(documents(spark, texts, ids=ids), percent, width).collect()
    return sorted(tuple(r) for r in found)


def variants(seed, n=60, words=120):
    """Chains and stars of near copies around similarity 0.85."""
    draw, texts = random.Random(seed), []
    for _ in range(4):
        base = [f"w{draw.randrange(400)}" for _ in range(words)]
        for _ in range(n // 4):
            text = list(draw.choice(texts).split()) if texts and draw.random() < 0.4 else list(base)
            for _ in range(draw.randrange(6)):
                text[draw.randrange(len(text))] = f"v{draw.randrange(10_000)}"
            texts.append(" ".join(text))
    return texts


@pytest.mark.parametrize("seed", range(3))
def test_near_duplicates_as_all_pairs(spark, seed, monkeypatch):
    if seed == 2:  # bands and groups over several blocks
        monkeypatch.setattr(neardup, "BAND_BLOCK", 4)
        monkeypatch.setattr(neardup, "GROUP_BLOCK", 1500)
    texts = awkward_texts() + variants(seed) + noise(["a ", "b ", "c ", "d "], 60, 9, seed)
    ids = list(range(len(texts)))
    random.Random(seed).shuffle(ids)
    assert near(spark, texts, ids) == brute.near_duplicates(ids, texts)
    if seed == 1:
        assert near(spark, texts, ids, 80, 5) == brute.near_duplicates(ids, texts, 80, 5)


def test_near_duplicates_of_repeated_and_missing_ids(spark):
    texts = ["a b c d", "a b c d", "a b c d", None, "e f g", "e f g"]
    found = neardup.near_duplicates(documents(spark, texts, ids=[7, 7, 9, 3, None, None]), 85, 3)
    rows = sorted((tuple(r) for r in found.collect()), key=repr)
    assert rows == sorted([(7, 2, 7, True), (7, 2, 7, True), (9, 2, 7, False), (3, 0, 3, True), (None, 1, None, True), (None, 1, None, True)], key=repr)
    assert neardup.near_duplicates(documents(spark, [])).count() == 0
    kept = neardup.distinct_documents(documents(spark, texts[:4], ids=[7, 7, 9, 3]))
    assert kept.columns == documents(spark, []).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 7]


def test_sketches_estimate_similarity():
    draw = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.85, 0.95):
        errors = []
        for _ in range(60):
            union = draw.integers(0, 1 << 63, 2000).astype(np.uint64)
            n = int(2000 * share)
            a, b = union[:n + (2000 - n) // 2], np.concatenate([union[:n], union[n + (2000 - n) // 2:]])
            sketch = hyperminhash.sketches([np.unique(a), np.unique(b)])
            value, _ = hyperminhash.estimate(sketch[:1], sketch[1:], np.array([len(a)]), np.array([len(b)]))
            errors.append(value[0] - share)
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_components(spark):
    draw = random.Random(4)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)]
    links += [(5000, 5000 + i) for i in range(1, 50)] + [(7, 7)]
    root = {n: n for link in links for n in link}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = components(spark.createDataFrame(links, "a int, b int"))
    assert sorted(map(tuple, got.collect())) == sorted((n, find(n)) for n in root)
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_components_join_each_link_a_few_times(spark, monkeypatch):
    """A group with many links for each node, as bands of near copies give, and chains whose ids go up and down."""
    n = 400
    links = [(max(0, i - 1 - 9 * k), i) for i in range(1, n) for k in range(20)]
    chain = random.Random(6).sample(range(1000, 1200), 200)
    links += zip(chain[:-1], chain[1:], strict=True)
    table = spark.createDataFrame(links, "a int, b int").repartition(3)
    sizes, joined = [], type(table).join

    def counted(self, *args, **named):
        found = joined(self, *args, **named)
        sizes.append(found.count())
        return found

    monkeypatch.setattr(type(table), "join", counted)
    got = {r["node"]: r["root"] for r in components(table).collect()}
    monkeypatch.undo()
    assert got == {i: 0 for i in range(n)} | {1000 + i: 1000 for i in range(200)}
    assert sum(sizes) <= 4 * len(links), (sum(sizes), len(links))


def test_fm_index_as_plain_search():
    draw = np.random.default_rng(0)
    for _ in range(150):
        sigma = int(draw.integers(2, 9))
        text = np.append(draw.integers(0, sigma, draw.integers(1, 200)), 0).astype(np.int32)
        index = fmindex.FMIndex(text, sigma, sample=int(draw.integers(1, 9)))
        for length in (1, 2, 3, 5):
            patterns = draw.integers(1, sigma, (20, length))
            for pattern, low, high in zip(patterns, *index.search(patterns), strict=True):
                want = [i for i in range(len(text) - length + 1) if (text[i:i + length] == pattern).all()]
                assert sorted(index.locate(np.arange(low, high)).tolist()) == want


@pytest.mark.parametrize("blocks", [1, 3])
def test_contamination_as_plain_windows(spark, blocks):
    texts = awkward_texts() + noise(["a ", "b ", "C ", "é-", "7."], 200, 40, 6)
    items = [(1, "a b c a b c a b c a b c"), (2, "one TWO three"), (3, None), (4, ""), (None, "é é é"), (2, "a a a"), (10, "7 7 a b")]
    items += [(20 + i, t) for i, t in enumerate(noise(["a ", "b ", "c "], 20, 30, 7))]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, row string")
    size = sum(len((t or "").encode()) for _, t in set(items))
    found = decontaminate.contamination(documents(spark, texts), bench, shard_bytes=400, phrase_bytes=-(-size // blocks))
    rows = {r["doc_id"]: r for r in decontaminate.contamination_digest(found).collect()}
    for i, (n, hit, ids) in enumerate(brute.contamination(texts, items)):
        digest = hashlib.sha256(",".join(ids).encode()).hexdigest()
        assert tuple(rows[i])[1:] == (n, hit, len(ids), digest, hit > 0), texts[i]
    for row in found.collect():
        ends = [s["end"] for s in row["spans"]]
        assert all(s["first"] > e for s, e in zip(row["spans"][1:], ends, strict=False))


def test_contamination_of_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    rows = decontaminate.contamination_digest(decontaminate.contamination(documents(spark, ["a b"]), bench)).collect()
    assert [tuple(r)[1:4] for r in rows] == [(2, 0, 0)]
    assert decontaminate.contamination_digest(decontaminate.contamination(documents(spark, []), bench)).count() == 0


def test_licences(spark):
    mit = dict(licenses.known_texts())["MIT"]
    worn = "Copyright (c) 2020 Someone\n\n  " + mit.replace("sublicense", "sub-licence").upper().replace(", ", " ,\t")
    texts = awkward_texts() + [mit, worn, mit + " but", "text\nReleased under the MIT Licence!\nmore", "SPDX-License-Identifier: Apache-2.0"]
    rows = {r["doc_id"]: r for r in licenses.license_scan(documents(spark, texts)).collect()}
    n = len(awkward_texts())
    assert len(rows) == len(texts)
    assert [rows[n + i]["license"] for i in range(5)] == ["MIT", "MIT", None, None, "Apache-2.0"]
    assert rows[n]["text_digest"] == rows[n + 1]["text_digest"]
    assert (rows[n + 3]["n_notices"], rows[n + 3]["notices"]) == (1, "MIT")
    assert rows[0]["text_digest"] == rows[1]["text_digest"] == rows[2]["text_digest"] == hashlib.sha256(b"").hexdigest()
    assert all(rows[i]["license"] is None for i in range(n))
    assert licenses.license_scan(documents(spark, [])).count() == 0


def test_whole_licences_and_headers(spark):
    known = dict(reversed(licenses.known_texts()))
    names = ["Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"]
    assert all(len(known[name]) > 5000 for name in names)
    line = 'Licensed under the Apache License, Version 2.0 (the "License");'
    texts = [known[name].replace("\n", "\r\n  ").upper() for name in names]
    texts += [known["GPL-3.0"] + " but", f"/* Copyright 2020 Someone\n * {line}\n * you may not use this file */"]
    rows = {r["doc_id"]: r for r in licenses.license_scan(documents(spark, texts)).collect()}
    assert [rows[i]["license"] for i in range(len(texts))] == [*names, None, None]
    assert (rows[len(texts) - 1]["n_notices"], rows[len(texts) - 1]["notices"]) == (1, "Apache-2.0")


def test_mixing(spark):
    draw = random.Random(8)
    texts = awkward_texts() + [" ".join(["w"] * draw.randrange(1, 60)) for _ in range(600)]
    sources = [draw.choice(["a", "a", "a", "b", "c", "é", None]) for _ in texts]
    docs = documents(spark, texts, sources)
    quality = spark.createDataFrame([(i, 0.5 + i % 3) for i in range(0, 500, 2)] + [(2, 9.0)], "doc_id long, quality double")
    run = lambda: sorted(map(tuple, mixing.mixed_sources(docs, quality).select("row.doc_id", "size", "source_size", "target", "taken").collect()))
    rows = run()
    assert rows == run() and [r[0] for r in rows] == list(range(len(texts)))
    sizes = [len(brute.SPACED.findall(t or "")) for t in texts]
    assert [r[1] for r in rows] == sizes
    total = sum(sizes)
    assert abs(sum({sources[r[0]]: r[3] for r in rows}.values()) - 1.5 * total) < 1e-3
    for source in {*sources}:
        mine = [r for r in rows if sources[r[0]] == source]
        assert {r[2] for r in mine} == {sum(r[1] for r in mine)}
        assert mine[0][3] <= 2 * mine[0][2]
        assert abs(sum(r[4] for r in mine) - mine[0][3]) <= max(r[1] for r in mine) / 2 + 1
    assert all(r[4] in (0, r[1], 2 * r[1]) for r in rows)
    # Twice as heavy documents are drawn first more often: all weights act within one source.
    assert mixing.mixed_sources(documents(spark, [])).count() == 0
    assert mixing.mixed_sources(documents(spark, [None, ""])).select("target").distinct().collect()[0][0] == 0.0


def test_heavier_documents_come_first(spark):
    texts, n = ["w w w w"] * 2000, 2000
    sources = ["a"] * n
    quality = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, 4.0).otherwise(1.0).alias("quality"))
    rows = mixing.mixed_sources(documents(spark, texts, sources), quality, share=0.3).filter("taken > 0").select("row.doc_id").collect()
    heavy = sum(r["doc_id"] % 2 == 0 for r in rows) / len(rows)
    assert 0.70 < heavy < 0.82 and abs(len(rows) - 600) <= 1


def test_target_levels(spark):
    sources = spark.createDataFrame([(c, s) for c, s in zip("abcdef", [10, 1000, 50, 0, 7, 400], strict=True)] + [(None, 30)], "source string, source_size long")
    rows = {r["source"]: (r["source_size"], r["target"]) for r in mixing.source_targets(sources).collect()}
    weights = dict(zip([*"abcdef", None], [3, 1, 2, 3, 1, 2, 3], strict=True))
    held = {s for s, (size, target) in rows.items() if target >= 2 * size - 1e-6}
    level = (1.5 * 1497 - sum(2 * rows[s][0] for s in held)) / sum(w for s, w in weights.items() if s not in held)
    for s, (size, target) in rows.items():
        assert target == pytest.approx(2 * size if s in held else weights[s] * level)
        assert s in held or weights[s] * level <= 2 * size
    assert sum(t for _, t in rows.values()) == pytest.approx(1.5 * 1497)


def test_token_counts_as_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    pieces = [
        "aaa", "b", "'s", "'ll", "don't ", "1", "²½", "Σσς", "İI", "ñ", "é", "\x1c", " ", "　", " ", "\n", "<|endoftext|>",
        "<|startoftext|>", "<|", "|>", "日本", "рус", "\U0001F44D\U0001F3FD", "‍", "﻿", "\x00", "ﬁ", "Ǆ", "İ", "\x85",
    ]
    texts = awkward_texts() + noise(pieces, 1500, 30, 12) + ["ab" * 20_000]
    path = public_tokenizers.path(VOCABULARY)
    library = Tokenizer.from_file(path)
    rows = {r["doc_id"]: r for r in tokens.token_counts(documents(spark, texts), path).collect()}
    for i, text in enumerate(texts):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert tuple(rows[i])[1:] == (len((text or "").encode()), n, n > 2048), text
    assert tokens.token_counts(documents(spark, []), path).count() == 0
