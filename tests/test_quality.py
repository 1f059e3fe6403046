import pytest
from pyspark.sql import Window, functions as F

from conftest import rows
from kemptable.operators import quality as Q, runs as R
from kemptable.operators.ordered import changes_only, number_steps, segments, verdict_transitions, with_previous

METRICS = [
    ("Cabin", "missing", 12.0), ("Cabin", "empty", 0.0), ("Age", "missing", 3.0), ("Age", "placeholder", 5.0),
    ("Fare", "missing", 0.0), ("Fare", "empty", 2.0), ("Name", "missing", 0.0),
]


@pytest.fixture
def metrics(spark):
    return spark.createDataFrame(METRICS, "column_name string, metric string, value double")


@pytest.fixture
def policy(spark):
    return Q.quality_policy(spark, ["Cabin"], {"Age": 10, "Fare": 1}, "Fare", None)


def test_flags(metrics, policy):
    assert rows(Q.quality_flags(metrics, policy)) == [("Fare", "empty", 2.0)]
    assert len(rows(Q.quality_flags(metrics))) == 4


def test_optional_placeholders_silence_a_column(spark, metrics):
    policy = Q.quality_policy(spark, placeholder_optional='["Age", "Cabin"]')
    assert rows(Q.quality_flags(metrics, policy)) == [("Fare", "empty", 2.0)]


def test_information_metrics_do_not_count(spark):
    given = [("a", "missing_before", 3.0), ("a", "raw_empty", 1.0), ("withdrawal", "missing", 2.0), ("", "missing_rows", 1.0)]
    df = spark.createDataFrame(given, "column_name string, metric string, value double")
    assert rows(Q.quality_flags(df)) == [("", "missing_rows", 1.0), ("withdrawal", "missing", 2.0)]
    assert rows(Q.quality_flags(df, legacy_names=True)) == [("", "missing_rows", 1.0)]


def test_placeholder_coverage(spark, metrics, policy):
    assert rows(Q.placeholder_coverage(metrics)) == [("Cabin",), ("Fare",), ("Name",)]
    assert rows(Q.placeholder_coverage(metrics, policy)) == [("Fare",)]
    optional = Q.quality_policy(spark, ["Cabin"], placeholder_optional=["Name"])
    assert rows(Q.placeholder_coverage(metrics, optional)) == [("Fare",)]


def test_metric_names_split(spark):
    given = [("Age_missing", "3"), ("Age_missing_mapping_count", "2"), ("rows", "9"), ("x_y_empty", "1.5"), ("bad", "text")]
    df = spark.createDataFrame(given, "name string, value string")
    got = Q.metrics_from_names(df)
    assert rows(got) == [
        ("", "rows", 9.0), ("Age", "missing", 3.0), ("Age", "missing_mapping_count", 2.0), ("x_y", "empty", 1.5)
    ]
    assert rows(Q.mapping_gaps(got)) == [("Age", "missing_mapping_count", 2.0)]


def test_requirements(spark):
    required = spark.createDataFrame([("REQ-1", "must"), ("REQ-2", "must"), ("REQ-3", "should"), ("REQ-4", "must")], "id string, severity string")
    reported = spark.createDataFrame([("REQ-1", "pass"), ("REQ-3", "no"), ("REQ-4", "?")], "id string, ok_raw string")
    assert rows(Q.requirement_verdict(required, reported)) == [
        ("REQ-1", "pass"), ("REQ-2", "missing"), ("REQ-3", "fail"), ("REQ-4", "fail")
    ]


def test_verdict_stages_in_order(spark):
    reports = spark.createDataFrame([
        (0, False, None, None), (1, True, None, "x"), (2, True, "yes", "x"), (3, True, "yes", "x"),
        (4, True, "yes", "x"), (5, True, "yes", "x"), (6, True, "yes", "x"), (7, True, "no", "x"), (8, True, "yes", "x"),
        (9, True, "yes", "x"),
    ], "run_id int, has_report boolean, ok string, issues string")
    metrics = spark.createDataFrame([
        (3, "a", "missing", 0.0), (3, "a", "placeholder", 0.0),
        (4, "a", "missing", 0.0),
        (5, "a", "missing_mapping_count", 2.0),
        (6, "a", "missing", 4.0), (6, "a", "placeholder", 0.0),
        (7, "a", "missing", 0.0), (7, "a", "placeholder", 0.0),
        (8, "a", "missing", 0.0), (8, "a", "placeholder", 0.0),
        (9, "a", "missing", 0.0), (9, "a", "placeholder", 0.0),
    ], "run_id int, column_name string, metric string, value double")
    required = spark.createDataFrame([(3, "R1"), (8, "R1"), (9, "R1")], "run_id int, id string")
    reported = spark.createDataFrame([(3, "R1", "fail"), (8, "R1", "ok")], "run_id int, id string, ok_raw string")
    got = {r["run_id"]: (r["ok"], r["failed_stage"], r["detail"]) for r in Q.quality_verdict(
        reports, metrics, None, required, reported
    ).collect()}
    assert {k: v[1] for k, v in got.items()} == {
        0: "missing_report", 1: "missing_ok_issues", 2: "missing_metrics", 3: "requirements", 4: "placeholder_metrics",
        5: "missing_mapping", 6: "silent_miss", 7: "silent_miss", 8: None, 9: "missing_requirements",
    }
    assert got[3][2] == "1: R1=fail" and got[6][2] == "1: a_missing" and got[8][0] is True
    loose = Q.quality_verdict(reports, metrics, strict=False)
    assert {r["run_id"] for r in loose.filter("ok").collect()} == {2, 3, 4, 5, 6, 8, 9}


def test_strict_can_come_from_the_report(spark):
    df = spark.createDataFrame([({"strict_validation": "false"},), ({"enforce_metrics": "yes"},), ({},)], "e map<string,string>")
    assert [r[0] for r in df.select(Q.strict_from_reports(F.col("e"))).collect()] == [False, True, True]


def test_quarantine_keeps_every_row(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (3, None)], "n int, s string")
    good, bad = Q.quarantine(df, {"n": F.col("n") > 0, "s": F.col("s").isNotNull()})
    assert rows(good) == [(1, "a")]
    assert rows(bad) == [(3, None, ["s"]), (None, "b", ["n"])]


def test_observed_metrics_come_with_the_write(spark, folder):
    df = spark.createDataFrame([("a",), ("",), (None,)], "s string")
    watched, observation = Q.observe_quality(df, ["s"])
    watched.write.parquet(f"{folder}/out")
    assert observation.get == {"rows": 3, "s_missing": 1, "s_empty": 1}


def test_requests_are_deduplicated(spark):
    given = [(1, "t", '{"a":1,"b":2}'), (2, "t", '{"b":2,"a":1}'), (3, "u", '{"a":1}'), (4, "u", None), (5, "t", "not json")]
    df = spark.createDataFrame(given, "request_id long, name string, args_json string")
    assert [r[0] for r in rows(R.dedupe_requests(df), "request_id")] == [1, 3, 4, 5]
    earlier = spark.createDataFrame([("t", '{"b":2, "a":1}')], "name string, args_json string")
    assert [r[0] for r in rows(R.dedupe_requests(df, earlier), "request_id")] == [3, 4, 5]


def feed(spark, n=3000):
    """One key with most rows, two small ones, null keys and null values."""
    return spark.range(n).select(
        F.col("id"),
        (F.col("id") * 37 % n).alias("t"),
        F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 < 9, F.col("id").cast("string").substr(1, 1)).alias("k"),
        F.when(F.col("id") % 11 > 0, F.floor(F.col("id") / 3) % 3).alias("v"),
    )


@pytest.mark.parametrize("order", ["t", "name", "at"])
def test_segments_give_the_same_answer(spark, order):
    df = feed(spark).withColumn("name", F.format_string("%08d", "t")).withColumn("at", F.timestamp_seconds("t"))
    plain = with_previous(df, ["k"], [order, "id"], ["v"])
    cut = with_previous(df, ["k"], [order, "id"], ["v"], pieces=9)
    window = Window.partitionBy("k").orderBy(order, "id")
    want = df.select("id", F.row_number().over(window).alias("step"), F.lag("v").over(window).alias("p"))
    assert rows(cut.select("id", "step", F.col("prev.v").alias("p"))) == rows(want)
    columns = ["id", "step", F.col("prev.v").alias("p"), F.col("prev").isNull().alias("none")]
    assert rows(cut.select(*columns)) == rows(plain.select(*columns))
    assert sorted(cut.columns) == sorted(plain.columns)


def test_one_key_with_one_first_value_is_cut_evenly(spark):
    """Neither the key nor the first order column can tell the rows apart."""
    df = spark.range(60_000).select(F.lit("k").alias("k"), F.lit(7).alias("day"), (F.col("id") * 7919 % 60_000).alias("id"), (F.col("id") % 5).alias("v"))
    sizes = sorted(r["count"] for r in segments(df, ["k"], ["day", "id"], 12).groupBy("_segment").count().collect())
    assert len(sizes) == 12 and sizes[-1] <= 2 * sizes[6]
    window = Window.partitionBy("k").orderBy("day", "id")
    want = df.select("id", F.row_number().over(window).alias("step"), F.lag("v").over(window).alias("p"))
    got = with_previous(df, ["k"], ["day", "id"], ["v"], pieces=12).select("id", "step", F.col("prev.v").alias("p"))
    assert rows(got) == rows(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(k#" not in plan and "Exchange hashpartitioning(_segment#" not in plan.split("Window", 1)[1].split("BroadcastExchange")[0]


def test_changes_and_transitions(spark):
    given = [("r", 1, True), ("r", 2, True), ("r", 3, False), ("r", 4, None), ("s", 1, None), ("s", 2, False)]
    df = spark.createDataFrame(given, "run_id string, i int, ok boolean")
    assert rows(changes_only(df, ["run_id"], ["i"], "ok"), "run_id", "i") == [("r", 1), ("r", 3), ("r", 4), ("s", 2)]
    assert rows(verdict_transitions(df, "run_id", ["i"])) == [
        ("r", 3, 3, True, False), ("r", 4, 4, False, None), ("s", 2, 2, None, False)
    ]
    assert rows(number_steps(df, ["run_id"], ["i"]), "step") == [(1,), (1,), (2,), (2,), (3,), (4,)]


def test_expiry(spark):
    registry = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:40:00")], "run_id int, at string")
    registry = registry.select("run_id", F.col("at").cast("timestamp").alias("created_at"))
    gone = R.expire_runs(registry, F.lit("2024-01-01 01:00:00").cast("timestamp"))
    assert rows(gone, "run_id") == [(1,)]
    files = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "run_id int, file string")
    assert rows(R.expired_files(files, gone), "file") == [("a",), ("b",)]
