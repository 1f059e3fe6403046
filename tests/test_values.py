import datetime
import decimal

import pytest
from pyspark.sql import functions as F, types as T

from conftest import rows
from kemptable.functions import columns as C, names as N, values as V


def texts(spark, values, dtype):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], T.StructType([
        T.StructField("i", T.LongType()), T.StructField("v", dtype)
    ]))
    return [r[0] for r in df.orderBy("i").select(V.canonical_col(df, "v")).collect()]


def test_float_text_is_that_of_python(spark):
    values = [1e7, 12345678.9, 1e15, 1e16, 1.5e300, 0.001, 0.0001, 0.00012345, 1e-5, -3.25e-7, 0.5, 0.0, -2.0,
              123456789012345.6, 0.1 + 0.2, float("inf"), float("-inf")]
    assert texts(spark, values, T.DoubleType()) == [str(v) for v in values]


def test_missing_values_have_no_text(spark):
    assert texts(spark, [None, float("nan"), 1.0], T.DoubleType()) == [None, None, "1.0"]


def test_text_of_other_types(spark):
    assert texts(spark, [True, False, None], T.BooleanType()) == ["True", "False", None]
    assert texts(spark, [b"abc", None], T.BinaryType()) == ["<bytes len=3>", None]
    assert texts(spark, [[1, 2], [], None], T.ArrayType(T.LongType())) == ["<list len=2>", "<list len=0>", None]
    keys = {k: 1 for k in "abcdefg"}
    assert texts(spark, [{"a": 1}, keys, None], T.MapType(T.StringType(), T.LongType())) == [
        "<dict keys=[a]>", "<dict keys=[a, b, c, d, e, …(+2)]>", None
    ]
    pair = T.StructType([T.StructField("x", T.LongType()), T.StructField("y", T.LongType())])
    assert texts(spark, [(1, 2), None], pair) == ["<dict keys=[x, y]>", None]
    assert texts(spark, [decimal.Decimal("1.50")], T.DecimalType(5, 2)) == ["1.50"]
    assert texts(spark, [datetime.date(2024, 1, 2)], T.DateType()) == ["2024-01-02"]
    moments = [datetime.datetime(2024, 1, 2), datetime.datetime(2024, 1, 2, 3, 4, 5, 500000)]
    assert texts(spark, moments, T.TimestampNTZType()) == [str(m) for m in moments]


def test_long_text_is_whole_but_cut_where_it_is_shown(spark):
    long = ["x" * 200, "가" * 201, ""]
    assert texts(spark, long, T.StringType()) == long
    shown = spark.createDataFrame([(t,) for t in long], "v string").select(V.shown_value(F.col("v")))
    assert [r[0] for r in shown.collect()] == ["x" * 200, "가" * 200 + "…", ""]


@pytest.mark.parametrize("text, number", [
    ("42", 42.0), (" 42 ", 42.0), ("1e5", 1e5), (".5", 0.5), ("5.", 5.0), ("-1.5E-3", -0.0015), ("+7", 7.0),
    ("inf", float("inf")), ("-Infinity", float("-inf")),
    ("1.5d", None), ("1f", None), ("abc", None), ("", None), ("1_000", None), ("0x10", None), ("nan", None), (None, None),
])
def test_numbers(spark, text, number):
    df = spark.createDataFrame([(text,)], "v string")
    assert df.select(V.to_number(F.col("v"))).first()[0] == number


def test_verdicts(spark):
    given = ["true", " PASS ", "ok", "no", "Failed", "0.0", "2", "maybe", "", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(given)], "i int, v string")
    got = [r[0] for r in df.orderBy("i").select(V.to_verdict(F.col("v"))).collect()]
    assert got == [True, True, True, False, False, False, True, None, None, None]


def test_text_list(spark):
    given = ['["a", " b ", "\'c\'", "a"]', " bare ", "'quoted'", "[broken", "[]", "", None, '["x", 1]']
    df = spark.createDataFrame([(i, v) for i, v in enumerate(given)], "i int, v string")
    got = [r[0] for r in df.orderBy("i").select(V.text_list(F.col("v"))).collect()]
    assert got == [["a", "b", "c"], ["bare"], ["quoted"], ["[broken"], [], [], [], ["x", "1"]]


def test_path_pieces(spark):
    df = spark.createDataFrame([("s3a://b/d/File.CSV?x=1",), ("plain",), ("/a/.hidden",)], "p string")
    got = df.select(V.extension(F.col("p")), V.file_name(F.col("p")), V.parent_name(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("csv", "File.CSV", "d"), ("", "plain", ""), ("", ".hidden", "a")]


def test_column_names(spark):
    df = spark.createDataFrame([(1, 2)], [' "a" ', "'b"])
    assert C.normalize_columns(df).columns == ["a", "b"]
    with pytest.raises(C.InvalidArgs):
        C.normalize_columns(spark.createDataFrame([(1, 2)], ["a", " a"]))
    with pytest.raises(C.MissingColumn):
        C.require_columns(df, ["zz"])


def test_flatten(spark):
    df = spark.createDataFrame([((1, (2, [3])), 4)], "a struct<b: int, c: struct<d: int, e: array<int>>>, f int")
    flat = C.flatten_struct(df)
    assert flat.columns == ["a.b", "a.c.d", "a.c.e", "f"]
    assert rows(flat) == [(1, 2, [3], 4)]


def test_names_with_dots_are_usable(spark):
    from kemptable.operators import counts, profile

    flat = C.flatten_struct(spark.createDataFrame([((1, "x"),)], "a struct<b: int, c: string>"))
    assert rows(counts.value_counts(flat, "a.c")) == [("x", 1)]
    assert profile.column_profile(flat).count() == 2


def test_repair_and_sanitize(spark):
    wrong = ["한글.csv".encode("utf-8").decode("latin-1"), "한글.csv".encode("cp949").decode("cp437"), "plain.csv", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(wrong)], "i int, v string")
    got = [r[0] for r in df.orderBy("i").select(N.repair_mojibake("v")).collect()]
    assert got == ["한글.csv", "한글.csv", "plain.csv", None]
    named = spark.createDataFrame([("up/나라 이름(1).csv",), ("..//a b.txt",)], "v string")
    assert [r[0] for r in named.select(N.sanitize_filename(F.col("v"))).collect()] == ["나라_이름_1_.csv", "a_b.txt"]
    path = spark.createDataFrame([("../a b/./c?.txt",)], "v string")
    assert path.select(N.sanitize_path(F.col("v"))).first()[0] == "a_b/c_.txt"
