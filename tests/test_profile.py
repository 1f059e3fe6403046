import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL, rows
from kemptable.functions.columns import EmptyData, InvalidArgs, MissingColumn
from kemptable.operators import counts, numeric, profile


@pytest.fixture(scope="module")
def orders(spark):
    return spark.read.parquet(f"{SMALL}/orders.parquet")


def table(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


def test_ties_are_ordered_by_value(spark):
    df = table(spark, ["b", "a", "b", "a", "c", None])
    assert [tuple(r) for r in counts.value_counts_topk(df, "v").collect()] == [
        ("a", 2, 0.4), ("b", 2, 0.4), ("c", 1, 0.2)
    ]
    assert [r["value"] for r in counts.rare_values(df, "v").collect()] == ["c", "a", "b"]


@pytest.mark.parametrize("k, size", [(2, 2), (0, 3), (-1, 3), ("x", 3), (None, 3), ("1", 1)])
def test_top_k_argument(spark, k, size):
    assert counts.value_counts_topk(table(spark, ["a", "b", "c"]), "v", k).count() == size


def test_unique_values_cut(spark):
    df = table(spark, ["c", "a", "b", "a"])
    assert [r[0] for r in counts.unique_values(df, "v").collect()] == ["a", "b", "c"]
    assert [r[0] for r in counts.unique_values(df, "v", max_values_return=2).collect()] == ["a", "b"]


def test_missing_column_and_empty_keys(spark):
    df = table(spark, ["a"])
    with pytest.raises(MissingColumn):
        counts.unique_values(df, "w")
    with pytest.raises(InvalidArgs):
        counts.mapping_coverage(df, "v", [])
    with pytest.raises(EmptyData):
        numeric.summary_stats(df)


def test_coverage(spark):
    df = table(spark, [1, 2, None, 2], "int")
    assert rows(counts.mapping_coverage(df, "v", [2, 3])) == [("1", "missing"), ("2", "ok"), ("3", "extra")]
    assert rows(counts.mapping_coverage_counts(df, "v", [2, 3])) == [(2, 2, 1, 1)]


def test_containers_can_be_counted(spark):
    df = table(spark, [[1], [2], [1, 2]], "array<int>")
    assert rows(counts.value_counts(df, "v")) == [("<list len=1>", 2), ("<list len=2>", 1)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "s string, n double")
    assert rows(counts.value_counts_topk(df, "s")) == []
    assert rows(profile.missing_report(df)) == []
    assert rows(profile.column_profile(df).select("column_name", "total", "missing", "missing_rate")) == [
        ("n", 0, 0, 0.0), ("s", 0, 0, 0.0)
    ]
    assert rows(numeric.summary_stats(df)) == [("n", 0, 0, *[None] * 9)]
    assert rows(profile.parseability(df, "s")) == [("s", 0, 0.0, 0.0, 0.0)]
    assert rows(counts.unique_count(df, "s")) == [(0, 0, 0)]


def test_summary_of_few_values(spark):
    df = table(spark, [3.0, float("nan"), None], "double")
    got = numeric.summary_stats(df).first()
    assert (got["cnt"], got["missing"], got["mean"], got["std"]) == (1, 2, 3.0, None)
    assert (got["q1"], got["median"], got["q3"]) == (3.0, 3.0, 3.0)


def test_invariants(orders):
    total = orders.count()
    counted = counts.value_counts(orders, "o_custkey")
    assert counted.agg(F.sum("cnt")).first()[0] == total
    assert counted.count() == counts.unique_count(orders, "o_custkey").first()["unique_count"]
    for row in numeric.summary_stats(orders).collect():
        assert row["cnt"] + row["missing"] == total


def test_counts_of_a_union_are_sums(orders):
    left, right = orders.filter("o_orderkey < 700"), orders.filter("o_orderkey >= 700")
    both = counts.value_counts(left, "o_orderstatus").union(counts.value_counts(right, "o_orderstatus"))
    merged = both.groupBy("value").agg(F.sum("cnt").alias("cnt"))
    assert rows(merged) == rows(counts.value_counts(orders, "o_orderstatus"))


@pytest.mark.parametrize("shape", ["uniform", "ties", "hot", "outlier", "negative"])
def test_bracketed_quantiles_are_exact(spark, shape):
    rng = random.Random(7)
    values = {
        "uniform": [rng.random() * 1000 for _ in range(20000)],
        "ties": [float(rng.randint(0, 9)) for _ in range(20000)],
        "hot": [5.0 if rng.random() < 0.4 else rng.random() * 10 for _ in range(20000)],
        "outlier": [rng.random() for _ in range(19999)] + [1e300],
        "negative": [-math.exp(rng.random() * 20) for _ in range(20000)],
    }[shape]
    df = table(spark, values, "double")
    points = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    want = {("v", p): pytest.approx(float(np.quantile(values, p)), rel=1e-12) for p in points}
    assert numeric.quantiles(df, {"v": points}, piece_values=3) == want
    assert numeric.quantiles(df, {"v": points}) == want


def test_a_bracket_that_misses_its_rank_is_widened(spark):
    values = [float(i) for i in range(1000)]
    df = table(spark, values, "double")
    known = numeric.moments(df, ["v"])
    known["v"]["cuts"] = [10.0, 20.0]  # nowhere near the median
    assert numeric.quantiles(df, {"v": [0.5]}, known=known) == {("v", 0.5): 499.5}


def test_big_summaries_read_the_data_twice(spark):
    seen = spark.sparkContext.accumulator(0)

    def count_rows(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(5000).select((F.col("id") * 1.5).alias("a"), F.rand(3).alias("b"))
    watched = df.mapInArrow(count_rows, df.schema)
    numeric.summary_stats(watched).collect()
    assert seen.value == 2 * 5000


def test_profile_samples_are_the_smallest_values(spark):
    values = [f"{i:05d}" for i in range(5000, 0, -1)] + [None] * 10
    got = profile.column_profile(table(spark, values), samples=3).first()
    assert got["samples"] == ["00001", "00002", "00003"]
    assert (got["total"], got["missing"]) == (5010, 10)


def test_profile_shuffles_only_small_values(spark):
    df = spark.range(100_000).select(F.format_string("%06d", "id").alias("v"))
    ceilings = counts.smallest_ceilings(df, ["v"], 20)
    counted = counts.value_counts_many(df, ["v"], keep_missing=True, ceilings=ceilings)
    assert counted.count() < 1000
    assert counted.agg(F.sum("cnt")).first()[0] == 100_000


def test_parse_rates(spark):
    df = table(spark, ["2024-01-15", "2024-01-16", "01/15/2024", "2024-13-45", None])
    got = profile.parseability(df, "v").first()
    assert got["n_values"] == 4
    assert got["datetime_rate"] == 0.5  # the best layout, not the sum of layouts
    assert got["numeric_rate"] == 0.0


@pytest.mark.parametrize("text", [
    "2024-01-15", "2024-01-15 10:20:30", "2024-01-15T10:20:30", "2024-01-15 10:20", "2024-01-15 10:20:30.123456",
    "2024-01-15 10:20:30.5", "2024-01-15T10:20:30Z", "2024-01-15T10:20:30+09:00", "2024-01", "2024/01/15", "20240115",
    "12/31/2024", "31/12/2024", "31-12-2024", "12/31/2024 10:20:30",
])
def test_date_layouts(spark, text):
    assert profile.parseability(table(spark, [text]), "v", ["datetime"]).first()["datetime_rate"] == 1.0


def test_parsers_can_be_chosen(spark):
    df = table(spark, ["1", "x"])
    got = profile.parseability(df, "v", ["NUMERIC"]).first()
    assert (got["numeric_rate"], got["bool_rate"], got["datetime_rate"]) == (0.5, None, None)
    with pytest.raises(InvalidArgs):
        profile.parseability(df, "v", [])
    assert profile.parseability(df, "v", max_samples=1).first()["n_values"] == 1
    assert profile.parse_samples(df, "v").count() == 2


def test_quality_metrics(spark):
    df = spark.createDataFrame([("a", 1.0), ("", None), (" ", float("nan")), (None, 2.0), ("n/a", 3.0)], "s string, x double")
    got = rows(profile.column_quality_metrics(df, ["s", "x"], {"s": ["n/a"]}))
    assert got == [
        ("s", "empty", 2.0), ("s", "missing", 1.0), ("s", "placeholder", 1.0),
        ("x", "empty", 0.0), ("x", "missing", 2.0),
    ]


PROFILES = {
    "topk": lambda df: counts.value_counts_topk(df, "o_orderpriority"),
    "categorical": lambda df: counts.categorical_summary(df),
    "profile": lambda df: profile.column_profile(df),
    "counts": lambda df: profile.column_profile(df, samples=0),
    "parse": lambda df: profile.parseability(df, "o_orderstatus"),
    "missing": lambda df: profile.missing_report(df),
    "quality": lambda df: profile.column_quality_metrics(df, df.columns),
}


@pytest.mark.parametrize("name", sorted(PROFILES))
def test_profiles_run_in_the_jvm(orders, name):
    plan = PROFILES[name](orders)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan


@pytest.mark.parametrize("name", sorted(PROFILES))
def test_profiles_read_the_table_once(spark, orders, name):
    seen = spark.sparkContext.accumulator(0)

    def count_rows(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    total = orders.count()
    PROFILES[name](orders.mapInArrow(count_rows, orders.schema)).collect()
    # Samples first look at a few rows, which here are all there are.
    assert seen.value == (2 * total if name == "profile" else total)
