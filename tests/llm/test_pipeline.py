"""Each stage of the pipeline against plain code on its own input, and the run as a whole."""

import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from conftest import SMALL
from kemptable.llm.queries import queries, table
from kemptable.session import cut_lineage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """Name -> (input, output) of each stage over the smallest tables."""
    docs, out = table(spark, SMALL, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        kept = cut_lineage(stage(spark, docs, SMALL))
        out[name] = (docs, kept)
        docs = kept
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_stage_names_and_columns(stages):
    assert list(stages) == ["language_id", "near_duplicates", "decontamination", "personal_data", "mix"]
    for _, kept in list(stages.values())[:-1]:
        assert kept.columns == COLUMNS
    assert stages["mix"][1].columns == [*COLUMNS, "size", "source_size", "target", "taken"]


def test_language_stage_keeps_all_texts_with_letters(stages):
    before, after = map(texts, stages["language_id"])
    assert after == {i: t for i, t in before.items() if any(c.isalpha() for c in t or "")}


def test_language_stage_overrules_wrong_labels(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents").filter("n_chars >= 300")
    wrong = (F.col("doc_id") % 200 == 3) & F.col("lang").isin("en", "de")
    other = F.when(F.col("lang") == "en", "de").otherwise("en")
    planted = docs.withColumn("lang", F.when(wrong, other).otherwise(F.col("lang")))
    before, mixed, after = (
        {r["doc_id"]: r["lang"] for r in d.select("doc_id", "lang").collect()}
        for d in (docs, planted, corpus_pipeline.language(spark, planted, SMALL))
    )
    moved = [i for i in before if mixed[i] != before[i]]
    clean = [i for i in before if mixed[i] == before[i]]
    assert len(moved) >= 15 and sum(after.get(i) == before[i] for i in moved) / len(moved) >= 0.8
    assert sum(after.get(i) == before[i] for i in clean) / len(clean) >= 0.999


def test_duplicate_stage_keeps_one_of_each_group(stages):
    before, after = map(texts, stages["near_duplicates"])
    kept = [doc for doc, _, _, keep in brute.near_duplicates(list(before), list(before.values()), 80, 5) if keep]
    assert after == {i: before[i] for i in kept}


def test_benchmark_stage_drops_what_holds_a_passage(spark, stages):
    before, after = map(texts, stages["decontamination"])
    items = [(r["item_id"], r["text"]) for r in table(spark, SMALL, "benchmark").collect()]
    found = brute.contamination(list(before.values()), items)
    assert after == {i: t for (i, t), (_, hit, _) in zip(before.items(), found, strict=True) if not hit}


def test_personal_data_stage_leaves_nothing_and_clean_texts_alone(stages):
    before, after = map(texts, stages["personal_data"])
    assert before.keys() == after.keys()
    touched = 0
    for i, text in before.items():
        counts, _, told = brute.spans(text, brute.PERSONAL)
        if not told:
            assert after[i] == text
        else:
            touched += 1
            assert brute.spans(after[i], brute.PERSONAL)[0] == [0] * len(counts)
    assert touched
    lengths = {r["doc_id"]: r["n_chars"] for r in stages["personal_data"][1].collect()}
    assert all(lengths[i] == len(t) for i, t in after.items())


def test_mix_stage_meets_its_targets(stages):
    before, kept = stages["mix"]
    sizes = {i: len(brute.SPACED.findall(t)) for i, t in texts(before).items()}
    rows = kept.collect()
    assert all(0 < r["taken"] <= 2 * sizes[r["doc_id"]] and r["size"] == sizes[r["doc_id"]] for r in rows)
    for source in {r["source"] for r in rows}:
        mine = [r for r in rows if r["source"] == source]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= max(sizes.values()) / 2 + 1


def test_run_is_the_stages_in_order(spark, stages):
    got = sorted((r["doc_id"], r["text"], r["taken"]) for r in corpus_pipeline.run(spark, SMALL).collect())
    assert got == sorted((r["doc_id"], r["text"], r["taken"]) for r in stages["mix"][1].collect())


def test_stages_take_awkward_and_empty_tables(spark):
    docs = brute.documents(spark, [*brute.awkward_texts(), "mail a@b.cc now", "a b c d e f g h i j k l"])
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, docs, SMALL)
        assert stage(spark, docs.limit(0), SMALL).count() == 0
        rows = kept.collect()
        assert rows and set(kept.columns) >= set(COLUMNS), name
        if name == "personal_data":
            assert {r["text"] for r in rows} >= {None, "", "mail [EMAIL] now"}
        if name != "mix":
            assert kept.columns == docs.columns


def test_every_operator_has_its_query():
    names = list(queries())
    for number in range(1, 11):
        assert sum(n.startswith(f"op{number}_") for n in names) == 1


def test_no_python_in_native_queries(spark):
    for name in ("op4_personal_data", "op5_license_digests", "op9_secrets"):
        plan = queries()[name](spark, SMALL)._jdf.queryExecution().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow")), name


def test_token_counts_of_the_tables(spark):
    found = queries()["op10_token_counts"](spark, SMALL)
    assert found.filter((F.col("n_tokens") > 2048) != F.col("over_limit")).count() == 0
