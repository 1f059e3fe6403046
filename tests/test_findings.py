"""Cases that once went wrong."""

import pyarrow as pa
import pyarrow.ipc as ipc
import pytest
from pyspark.sql import functions as F

from conftest import rows
from kemptable.functions.columns import InvalidArgs
from kemptable.functions.names import best_reading
from kemptable.operators import counts, joins, ordered, profile, quality, transforms as X
from kemptable.sources import sniff
from kemptable.sources.arrow import read_arrow
from kemptable.sources.tables import preview, read_table
from kemptable.sources.text import rejected_lines

LONG = "x" * 200


def test_values_that_share_a_long_prefix_are_different(spark):
    df = spark.createDataFrame([(LONG + "1",), (LONG + "2",), (LONG + "2",)], "k string")
    mapped = X.apply_mapping(df, "k", {LONG + "1": "one", LONG + "2": "two"})
    assert sorted(r["k_mapped"] for r in mapped.collect()) == ["one", "two", "two"]
    assert len(X.one_hot(df, "k").columns) == 3
    assert counts.unique_count(df, "k").first()["unique_count"] == 2
    assert rows(counts.value_counts_topk(df, "k").select("cnt")) == [(1,), (2,)]
    assert rows(counts.value_counts_topk(df, "k", limit=200).select("cnt")) == [(3,)]


def test_a_key_with_two_values_raises(spark):
    df = spark.createDataFrame([("a",)], "k string")
    twice = spark.createDataFrame([("a", "one"), ("a", "two")], "k string, v string")
    with pytest.raises(InvalidArgs):
        X.apply_mapping(df, "k", twice)
    same = spark.createDataFrame([("a", "one"), ("a", "one")], "k string, v string")
    assert rows(X.apply_mapping(df, "k", same)) == [("a", "one")]


def test_outliers_of_text(spark):
    df = spark.createDataFrame([(str(i),) for i in range(101)] + [("abc",), (None,)], "v string")
    assert X.remove_outliers(df, "v", upper_quantile=0.9).count() == 91
    assert X.remove_outliers(df, "v", upper_quantile=0.9, lower_quantile=0.1).count() == 81


def test_nan_has_no_code(spark):
    df = spark.createDataFrame([(2.0,), (float("nan"),), (1.0,), (None,)], "v double")
    coded = X.ordinal_encode(df, "v").collect()
    assert sorted(r["v_code"] for r in coded if r["v_code"] is not None) == [0, 1]


def test_reports_and_previews_hold_all_columns(spark):
    wide = spark.range(3).select(*[F.lit(None).cast("string").alias(f"c{i}") for i in range(30)])
    assert profile.missing_report(wide).count() == 30
    assert len(preview(wide).columns) == 30
    assert counts.categorical_summary(wide.fillna("a")).count() == 30


@pytest.mark.parametrize("keys", [["a"] * 900 + ["b"] * 50 + [None] * 50, [None] * 1000])
def test_hot_and_missing_keys_keep_every_row(spark, keys):
    df = spark.createDataFrame(list(enumerate(keys)), "id int, k string")
    table = spark.createDataFrame([("a", 1), ("c", 3)], "k string, v int")
    joined = joins.lookup_join(df, table, "k", broadcast_rows=0, hot_rows=100)
    want = sorted((i, k, 1 if k == "a" else None) for i, k in enumerate(keys))
    assert sorted((r["id"], r["k"], r["v"]) for r in joined.collect()) == want


def test_many_segments(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), "id", (F.col("id") % 7).alias("v"))
    one = rows(ordered.with_previous(df, ["k"], ["id"], ["v"]).select("k", "id", "step", "prev.v"))
    many = rows(ordered.with_previous(df, ["k"], ["id"], ["v"], pieces=5).select("k", "id", "step", "prev.v"))
    assert one == many and len(one) == 500


def test_listed_unmapped_values_fail_the_gate(spark):
    reports = spark.createDataFrame(
        [(1, '{"city_missing_mapping": ["Oslo", "Bern"], "rows": 5}'), (2, '{"city_missing_mapping": [], "rows": 5}')],
        "run_id int, metrics string",
    )
    metrics = quality.metrics_from_json(reports)
    said = spark.createDataFrame([(1, True, "ok", "none"), (2, True, "ok", "none")], "run_id int, has_report boolean, ok string, issues string")
    verdict = {r["run_id"]: (r["ok"], r["failed_stage"], r["detail"]) for r in quality.quality_verdict(said, metrics).collect()}
    assert verdict == {1: (False, "missing_mapping", "1: city_missing_mapping_count"), 2: (True, None, None)}


@pytest.mark.parametrize("text", ["1/5/2024|12/31/2023", "2024-01-15T10:00:00.123Z", "2024-01-15T10:00:00.123", "15 Jan 2024", "march 3, 2024"])
def test_usual_dates(spark, text):
    df = spark.createDataFrame([(t,) for t in text.split("|")] + [("nothing",)], "v string")
    n = len(text.split("|"))
    assert profile.parseability(df, "v").first()["datetime_rate"] == round(n / (n + 1), 4)


def test_no_date(spark):
    df = spark.createDataFrame([(t,) for t in ["13/32/2024", "mayor", "1/2/3", "9" * 100, "2024-13-01"]], "v string")
    assert profile.parseability(df, "v").first()["datetime_rate"] == 0.0


def test_names_are_repaired_only_on_proof():
    assert best_reading("naïve café") == "naïve café"
    assert best_reading("ÀÈÌ") == "ÀÈÌ"
    for name in ("한글 이름.csv", "ünïcode"):
        assert best_reading(name.encode("utf-8").decode("latin-1")) == name
        assert best_reading(name.encode("utf-8").decode("cp437")) == name
    assert best_reading("데이터.csv".encode("cp949").decode("latin-1")) == "데이터.csv"


def test_separators():
    assert sniff.sniff_head(b'a,b\n"1\t2",3\n4,5\n') == ("csv", ",")
    assert sniff.sniff_head(b"a\tb\n1,5\t2\n3,4\t5\n") == ("tsv", "\t")
    assert sniff.sniff_head(b"plain\ntext\n") == ("csv", ",")
    assert sniff.guess_separator(b"a;b;c\n") == ";"


def test_folders_of_files_with_other_columns(spark, folder):
    (folder / "csv").mkdir()
    (folder / "csv" / "a.csv").write_text("id,name\n1,x\n2,y\n")
    (folder / "csv" / "b.csv").write_text("name,id,more\nz,3,m\n")
    (folder / "csv" / "c.csv").write_text("")
    got = read_table(spark, str(folder / "csv"))
    assert sorted((r["id"], r["name"], r["more"]) for r in got.collect()) == [(1, "x", None), (2, "y", None), (3, "z", "m")]
    (folder / "arrow").mkdir()
    for name, table in (("a", {"a": [1], "b": [2]}), ("b", {"a": [3], "c": [4]})):
        with ipc.new_file(folder / "arrow" / f"{name}.arrow", (t := pa.table(table)).schema) as sink:
            sink.write_table(t)
    assert sorted(tuple(r) for r in read_arrow(spark, str(folder / "arrow"), ["a", "b"]).collect()) == [(1, 2), (3, None)]


def test_rejected_lines(spark, folder):
    path = folder / "bad.csv"
    path.write_text('a,b\n1,2\n3,4,5\n6\n"7,8",9,10,11\n')
    assert sorted(r["line"] for r in rejected_lines(spark, str(path)).collect()) == ['"7,8",9,10,11', "3,4,5"]
    assert read_table(spark, str(path)).count() == 2
