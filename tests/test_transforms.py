import pytest
from pyspark.sql import functions as F

from conftest import SMALL, rows
from kemptable.functions.columns import InvalidArgs
from kemptable.operators import joins, transforms as X
from kemptable.plans.recipe import STEPS, run_recipe
from kemptable.workload.cleaning import RECIPE


def test_fill_rules(spark):
    df = spark.createDataFrame([(1.0, "a", None), (None, "b", 2.0), (3.0, None, float("nan")), (8.0, "b", 4.0)], "m double, s string, d double")
    filled = X.fill_missing(df, {"m": "mean", "s": "mode", "d": "median"})
    assert rows(filled) == [(1.0, "a", 3.0), (3.0, "b", 3.0), (4.0, "b", 2.0), (8.0, "b", 4.0)]
    assert rows(X.fill_missing(df, {"d": ("const", 0.0)}).select("d")) == [(0.0,), (0.0,), (2.0,), (4.0,)]
    with pytest.raises(InvalidArgs):
        X.fill_missing(df, {"m": "magic"})


def test_mode_tie_takes_the_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "s string")
    assert X.most_frequent(df, "s") == "a"


def test_fill_of_an_empty_column_leaves_it(spark):
    df = spark.createDataFrame([(None,)], "m double")
    assert rows(X.fill_missing(df, {"m": "mean"})) == [(None,)]


def test_outliers(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)] + [(None,), (float("nan"),)], "v double")
    kept = X.remove_outliers(df, "v", 0.99)
    assert kept.count() == 100
    assert kept.agg(F.max("v")).first()[0] == 99.0
    clipped = X.remove_outliers(df, "v", 0.9, 0.1, clip=True)
    assert clipped.count() == 103
    assert tuple(clipped.agg(F.min("v"), F.max("v")).first()) == (10.0, 90.0)


def test_outlier_limit_equal_to_a_hot_value(spark):
    df = spark.createDataFrame([(0.1,)] * 50 + [(0.3,)] * 50, "v double")
    assert X.remove_outliers(df, "v", 0.99).count() == 100


def test_outlier_filter_reaches_the_files(spark, folder):
    spark.range(1000).select(F.col("id").cast("double").alias("v")).write.parquet(f"{folder}/t")
    plan = X.remove_outliers(spark.read.parquet(f"{folder}/t"), "v")._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(v,989.01)" in plan


def test_one_hot(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "s string")
    assert X.one_hot(df, "s").columns == ["s", "s_a", "s_b"]
    assert rows(X.one_hot(df, "s", keep=False)) == [(0, 0), (0, 1), (1, 0)]
    with pytest.raises(InvalidArgs):
        X.one_hot(df, "s", max_categories=1)


@pytest.mark.parametrize("options", [{}, {"pieces": 1}, {"pieces": 7}])
def test_ordinal(spark, options):
    df = spark.range(500).select(F.format_string("k%03d", F.col("id") % 100).alias("s")).unionByName(
        spark.createDataFrame([(None,)], "s string")
    )
    got = X.ordinal_encode(df, "s", **options)
    assert got.filter("s is null").first()["s_code"] is None
    wrong = got.filter("s is not null").filter(F.substring("s", 2, 3).cast("long") != F.col("s_code"))
    assert wrong.count() == 0 and got.count() == 501


def test_cast(spark):
    df = spark.createDataFrame([("1", "2024-01-02", "1.5d"), ("x", "02/01/2024", "2.5"), (None, None, None)], "i string, d string, f string")
    spec = {"i": "long", "d": "timestamp:yyyy-MM-dd", "f": "double"}
    cast = X.cast_types(df, spec)
    assert [r["i"] for r in cast.collect()] == [1, None, None]
    assert [r["f"] for r in cast.collect()] == [None, 2.5, None]
    assert rows(X.cast_failures(df, spec)) == [
        ("d", "cast_failed", 1.0), ("f", "cast_failed", 1.0), ("i", "cast_failed", 1.0)
    ]


def test_scaling(spark):
    df = spark.createDataFrame([(0.0, 5.0), (10.0, 5.0), (None, None)], "a double, b double")
    assert rows(X.scale(df, ["a", "b"], "minmax")) == [(0.0, 0.0), (1.0, 0.0), (None, None)]
    standard = rows(X.scale(df, ["a"], "standard").select(F.round("a", 6)))
    assert standard == [(-0.707107,), (0.707107,), (None,)]
    assert X.scale(df, ["a"], suffix="_z").columns == ["a", "b", "a_z"]


def test_mapping_must_be_complete(spark):
    df = spark.createDataFrame([("F",), ("P",), (None,)], "s string")
    with pytest.raises(X.UnmappedValues, match="P"):
        X.apply_mapping(df, "s", {"F": "done"})
    assert rows(X.apply_mapping(df, "s", {"F": "done"}, strict=False)) == [("F", "done"), ("P", None), (None, None)]
    assert rows(X.mapping_gap_metrics(df, "s", {"F": "done"})) == [("s", "missing_mapping_count", 1.0)]
    assert X.apply_mapping(df, "s", {"F": 1, "P": 2}, output="s").columns == ["s"]


def test_hot_keys_are_salted(spark):
    """A key with most rows spreads over partitions and each row comes once."""
    left = spark.range(20000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    table = spark.createDataFrame([("hot", "H"), ("3", "T"), ("unused", "U")], "k string, mapped string")
    joined = joins.lookup_join(left, table, "k", broadcast_rows=1, hot_rows=1000)
    assert joined.count() == 20000
    assert joined.filter("mapped = 'H'").count() == left.filter("k = 'hot'").count()
    assert joined.filter("mapped = 'T'").count() == 1
    assert "_salt" not in joined.columns
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan


def test_broadcast_needs_a_small_table(spark):
    table = spark.range(100).select(F.col("id").cast("string").alias("k"), F.lit("x" * 100).alias("mapped"))
    assert joins.fits_broadcast(table)
    assert not joins.fits_broadcast(table, rows=99)
    assert not joins.fits_broadcast(table, size=1000)


def test_image_columns(spark):
    df = spark.createDataFrame([(("a.jpg", b"x"), b"y")], "image struct<path: string, bytes: binary>, raw binary")
    assert rows(X.image_column_to_path(df, "image").select("image")) == [("a.jpg",)]
    assert X.image_column_to_path(df, "raw").columns == ["image"]


def by_hand(df, steps):
    for step in steps:
        df = STEPS[step["op"]](df, **step["args"])
    return df


RECIPES = [
    [("rename", {"columns": {"a": "p"}}), ("fill_missing", {"rules": {"b": "mean", "s": "mode"}}), ("remove_outliers", {"column": "p", "upper_quantile": 0.9}), ("one_hot", {"column": "c"}), ("date_parts", {"column": "d"})],
    [("fill_missing", {"rules": {"a": "median", "b": ("const", 1.5)}}), ("scale", {"columns": ["a", "b"]}), ("scale", {"columns": ["e"], "how": "minmax", "suffix": "_x"})],
    [("remove_outliers", {"column": "a", "upper_quantile": 0.8, "lower_quantile": 0.1}), ("one_hot", {"column": "c"}), ("fill_missing", {"rules": {"b": "mean"}})],
    [("remove_outliers", {"column": "a", "upper_quantile": None, "lower_quantile": 0.6}), ("one_hot", {"column": "c", "keep": False}), ("scale", {"columns": ["b"]})],
    [("remove_outliers", {"column": "t", "upper_quantile": 0.7}), ("one_hot", {"column": "s"}), ("drop_missing_rows", {"columns": ["b"]}), ("scale", {"columns": ["b"]})],
    [("remove_outliers", {"column": "a", "clip": True}), ("scale", {"columns": ["a"]}), ("one_hot", {"column": "c"}), ("ordinal_encode", {"column": "c"}), ("fill_missing", {"rules": {"c_c0": "mean", "b": "mean"}})],
    [("fill_missing", {"rules": {"e": "mode"}}), ("null_tokens", {"columns": ["s"]}), ("fill_missing", {"rules": {"s": "mode", "e": "mean"}}), ("select", {"columns": ["e", "s", "b"]}), ("scale", {"columns": [" 'b' "]})],
    [("safe_strings", {"columns": [" 's' "]}), ("one_hot", {"column": "s"}), ("cast_types", {"spec": {"t": "double"}}), ("scale", {"columns": ["t", "e"]})],
]


@pytest.mark.parametrize("number", range(len(RECIPES)))
def test_recipes_with_shared_statistics_equal_the_steps_one_by_one(spark, number):
    made = spark.range(400).select(
        F.when(F.col("id") % 13 > 0, F.col("id") * 7919 % 400).alias("a"), F.when(F.col("id") % 5 > 0, (F.col("id") % 97) / 3).alias("b"),
        F.when(F.col("id") * 7919 % 400 > 385, "rare").when(F.col("id") % 13 == 0, "gone").otherwise(F.concat(F.lit("c"), F.col("id") % 3)).alias("c"),
        F.date_add(F.lit("2024-01-30").cast("date"), (F.col("id") % 90).cast("int")).alias("d"), (F.col("id") % 11).alias("e"),
        F.when(F.col("id") % 7 > 3, "NA").when(F.col("id") % 7 > 1, "x").when(F.col("id") % 7 > 0, "y").alias("s"), F.format_string("%d.5", F.col("id") % 50).alias("t"),
    )
    steps = [{"op": op, "args": args} for op, args in RECIPES[number]]
    got, _ = run_recipe(made, steps)
    want = by_hand(made, steps)
    assert got.columns == want.columns
    rounded = [F.round(f"`{c}`", 9).alias(c) if k == "double" else F.col(f"`{c}`") for c, k in want.dtypes]
    assert rows(got.select(*rounded)) == rows(want.select(*rounded))


def test_a_recipe_reads_its_table_three_times(spark):
    """Moments; quantiles with the values beside them; the result."""
    lineitem, seen = spark.read.parquet(f"{SMALL}/lineitem.parquet"), spark.sparkContext.accumulator(0)
    total = lineitem.count()

    def count_rows(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    cleaned, _ = run_recipe(lineitem.mapInArrow(count_rows, lineitem.schema), RECIPE)
    assert 0 < cleaned.count() <= total and seen.value == 3 * total


def test_recipe_follows_renames(spark):
    df = spark.createDataFrame([(" 1", "x"), ("bad", None)], [' "n" ', "s"])
    cleaned, metrics = run_recipe(df, [
        {"op": "normalize_columns"},
        {"op": "rename", "args": {"columns": {"n": "number"}}},
        {"op": "cast_types", "args": {"spec": {"number": "double"}}},
        {"op": "fill_missing", "args": {"rules": {"s": ["const", "none"]}}},
    ], check=[' "n" ', "s"], placeholders={"s": ["none"]})
    assert rows(cleaned) == [(1.0, "x"), (None, "none")]
    assert rows(metrics) == [
        ("number", "cast_failed", 1.0), ("number", "empty", 0.0), ("number", "missing", 1.0),
        ("s", "empty", 0.0), ("s", "missing", 0.0), ("s", "placeholder", 1.0),
    ]
    with pytest.raises(InvalidArgs):
        run_recipe(df, [{"op": "no_such_step"}])
