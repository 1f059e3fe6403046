import datetime
import json

import pytest
from pyspark.sql import functions as F

from conftest import SMALL, rows
from kemptable.functions.columns import InvalidArgs
from kemptable.operators import counts, ordered, profile
from kemptable.operators.numeric import summary_stats
from kemptable.operators.profile import parseability
from kemptable.operators.quality import quality_flags, quality_policy
from kemptable.plans.profile_plan import PROFILERS, plan_requests, plan_summary, profile as run_profile, profile_plan
from kemptable.streaming import operators as S
from kemptable.workload.profiling import TEN_REQUESTS
from kemptable.workload.streams import drained, finished


@pytest.fixture(scope="module")
def lineitem(spark):
    return spark.read.parquet(f"{SMALL}/lineitem.parquet")


def test_requests_are_cleaned_and_checked(lineitem):
    planned = plan_requests(lineitem, [
        {"name": "collect_unique_values", "args": {"column": " 'l_returnflag' ", "max_rows": 5, "path": "x"}},
        {"name": "unique_values", "args": {"column": " 'l_returnflag' "}},
        {"name": "no_such_tool"},
        {"name": "value_counts_topk", "args": {}},
        {"name": "mapping_coverage", "args": {"column": "l_returnflag", "mapping_keys": []}},
        {"name": "parseability", "args": {"column": "l_returnflag", "parsers": [1]}},
    ])
    assert [r.name for r in planned] == ["unique_values", "no_such_tool", "value_counts_topk", "mapping_coverage", "parseability"]
    assert planned[0].columns == ["l_returnflag"] and planned[0].args == {"column": " 'l_returnflag' "}
    assert [r.error.split(":")[0] if r.error else None for r in planned] == [None] + ["InvalidArgs"] * 4


def test_report(spark, lineitem):
    report = profile_plan(lineitem, TEN_REQUESTS)
    by_request = {}
    for r in report.collect():
        by_request.setdefault(r["request_id"], []).append(r)
    assert set(by_request) == {1, 2, 3, 5, 6, 7, 8, 9, 10, 11}  # 4 repeats 3
    assert by_request[11][0]["error"].startswith("MissingColumn")
    top = [json.loads(r["value"]) for r in by_request[3] if r["metric"] == "top_value"]
    want = counts.value_counts_topk(lineitem, "l_shipdate", 5).collect()
    assert sorted((t["value"], t["cnt"], t["ratio"]) for t in top) == sorted(tuple(r) for r in want)
    unique = {r["value"] for r in by_request[1] if r["metric"] == "value"}
    assert unique == {"A", "N", "R"}
    coverage = {r["metric"]: r["value"] for r in by_request[5]}
    assert coverage["extra_mapping_key"] == "X" and coverage["missing_in_mapping_count"] == "0"
    samples = {r["metric"]: r["value"] for r in by_request[8]}
    assert json.loads(samples["l_linestatus.samples"]) == ["F", "O"]


def test_a_plan_gives_the_numbers_of_the_single_operator(lineitem):
    columns = ["l_quantity", "l_extendedprice"]
    report = profile_plan(lineitem, [{"name": "summary_stats", "args": {"columns": columns}}])
    got = {r["metric"]: float(r["value"]) for r in report.collect() if r["metric"] != "rows_scanned"}
    for r in summary_stats(lineitem, columns).collect():
        for metric, column in (("count", "cnt"), ("mean", "mean"), ("q1", "q1"), ("median", "median"), ("max", "max_value")):
            assert got[f"{r['column_name']}.{metric}"] == pytest.approx(float(r[column]))


def test_rates_are_rounded_half_up(spark):
    df = spark.createDataFrame([(x,) for x in ["7"] + ["a"] * 31], "v string")
    report = profile_plan(df, [{"name": "parseability", "args": {"column": "v"}}]).collect()
    rate = next(r["value"] for r in report if r["metric"] == "numeric_rate")
    assert float(rate) == parseability(df, "v").first()["numeric_rate"] == 0.0313


def test_a_bad_request_is_a_row_of_its_own(lineitem, folder):
    report = profile_plan(lineitem, [
        {"name": "rare_values", "args": {"column": "l_returnflag", "rare_threshold": "x"}},
        {"name": "detect_encoding", "args": {"path": f"{folder}/absent"}},
        {"name": "unique_values", "args": {"column": "l_returnflag"}},
    ]).collect()
    assert {r["request_id"] for r in report if r["error"]} == {1, 2}
    assert {r["value"] for r in report if r["metric"] == "value"} == {"A", "N", "R"}


def test_ten_requests_read_the_data_twice(spark, folder):
    """The rows that scans put out, counted by Spark itself."""
    lineitem = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    total, seen = lineitem.count(), spark.sparkContext.accumulator(0)

    def count_rows(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    watched = lineitem.mapInArrow(count_rows, lineitem.schema)
    profile_plan(watched, [r for r in TEN_REQUESTS if r["name"] != "column_profile"]).collect()
    # Counts, moments and sketches; the values and the brackets of the quantiles.
    assert seen.value == 2 * total


def test_a_registered_operator_answers_as_in_a_plan(spark, lineitem, folder):
    (folder / "a.csv").write_text("a,b\n1,2\n")
    requests = [r for r in TEN_REQUESTS if r["args"].get("column") != "no_such_column"] + [{"name": "encoding_audit", "args": {"path": f"{folder}"}}]
    report = profile_plan(lineitem, requests).collect()
    for r in requests:
        assert run_profile(lineitem, r["name"], **r["args"]).count() >= 0
    assert {r["name"] for r in requests} == set(PROFILERS)
    top = run_profile(lineitem, "value_counts_topk", column="l_shipdate", top_k=5).collect()
    assert sorted(json.loads(r["value"])["cnt"] for r in report if r["metric"] == "top_value") == sorted(r["cnt"] for r in top)
    with pytest.raises(InvalidArgs):
        run_profile(lineitem, "unique_values")


def test_reasons_and_totals_of_requests(spark, lineitem):
    report = profile_plan(lineitem, [
        {"name": "summary_stats", "args": {"column": "l_orderkey"}, "reason": "why not"}, {"name": "no_such_tool", "reason": 3},
    ])
    found = {r["name"]: r for r in plan_summary(report).collect()}
    assert found["summary_stats"]["reason"] == "why not" and json.loads(found["summary_stats"]["stats"]) == {"rows_scanned": str(lineitem.count())}
    assert found["no_such_tool"]["reason"] == "3" and found["no_such_tool"]["stats"] is None and found["no_such_tool"]["error"].startswith("InvalidArgs")
    big = spark.createDataFrame([(2**53 + 1,), (2**62 + 3,), (None,)], "k long")
    values = {r["metric"]: r["value"] for r in profile_plan(big, [{"name": "summary_stats", "args": {}}]).collect()}
    assert (values["k.min"], values["k.max"]) == (str(2**53 + 1), str(2**62 + 3))


def test_stream_counts_equal_batch(spark):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    stream = S.read_stream(spark, SMALL, events.schema, "events.parquet")
    assert rows(finished(S.stream_value_counts(stream, "event_type"), "complete")) == rows(
        counts.value_counts(events, "event_type")
    )


def test_stream_profile_equals_batch(spark):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    stream = S.read_stream(spark, SMALL, events.schema, "events.parquet")
    batch = S.stream_profile(events, "ts", ["value"], by=["event_type"])
    shown = ["window_start", "event_type", "rows", "value_min", "value_max", F.round("value_std", 6)]
    live = finished(S.stream_profile(stream, "ts", ["value"], by=["event_type"]), "complete")
    assert rows(live, *shown) == rows(batch, *shown)
    closed = finished(S.stream_profile(stream, "ts", ["value"], by=["event_type"], delay="0 seconds"), "append")
    assert 0 < closed.count() <= batch.count()
    assert set(rows(closed, *shown)) <= set(rows(batch, *shown))


def in_batches(spark, folder, pieces):
    """A folder of parquet files, read one file per micro-batch in order."""
    for i, piece in enumerate(pieces):
        piece.coalesce(1).write.parquet(f"{folder}/in/{i}")
    schema = pieces[0].schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).option(
        "recursiveFileLookup", True
    ).parquet(f"{folder}/in")


def test_changes_are_followed_across_batches(spark, folder):
    events = spark.read.parquet(f"{SMALL}/events.parquet").withColumn(
        "user_id", F.when(F.col("event_id") % 3 > 0, F.lit(7)).when(F.col("user_id") > 9, F.col("user_id"))  # a hot key, null keys
    )
    days = [("2024-01-01", "2024-01-08"), ("2024-01-08", "2024-01-20"), ("2024-01-20", "2025-01-01")]
    stream = in_batches(spark, folder, [events.filter(F.col("ts").between(a, F.expr(f"timestamp_ntz'{b}' - interval 1 microsecond"))) for a, b in days])
    out = f"{folder}/out"
    drained(S.stream_changes_only(stream, ["user_id"], ["ts", "event_id"], "event_type", out, f"{folder}/state"))
    got = spark.read.schema(events.schema).parquet(out)
    want = ordered.changes_only(events, ["user_id"], ["ts", "event_id"], "event_type")
    assert rows(got) == rows(want)


def changed(spark, folder, table, **options):
    """One run of the change feed over all new files; the state rows that each batch wrote."""
    stream = S.read_stream(spark, f"{folder}/in", table.schema, "*.parquet", 1)
    writer = S.stream_changes_only(stream, ["k"], ["at", "i"], "v", f"{folder}/out", f"{folder}/state", **options)
    run = writer.trigger(availableNow=True).start()
    run.awaitTermination()
    return [p["stateOperators"][0]["numRowsUpdated"] for p in run.recentProgress if p["numInputRows"]]


def test_a_restarted_feed_goes_on_and_writes_the_state_of_its_keys_only(spark, folder):
    schema = "i long, at timestamp_ntz, k string, v double, `x.y` decimal(20,2)"
    days = [
        [(i, f"2024-01-0{d} 00:00:{i % 60:02}", None if i % 9 == 0 else f"k{i % 40}", None if i % 7 == 0 else float("nan") if i % 11 == 0 else float(i // (d * 50)), None) for i in range(300)]
        for d in (1, 2)
    ]
    days.append([(2**60 + 1, "2024-01-03 00:00:00", "k1", 99.0, 1), (2**60 + 2, "2024-01-03 00:00:00", "k1", 99.0, 2), (1, None, "new", None, None)])
    tables = [spark.createDataFrame([tuple([*r[:4], r[4]]) for r in day], schema.replace("timestamp_ntz", "string").replace("decimal(20,2)", "int")).withColumn("at", F.col("at").cast("timestamp_ntz")).withColumn("x.y", F.col("`x.y`").cast("decimal(20,2)")) for day in days]
    updated = []
    for day in tables:  # each run starts anew from what the one before left
        day.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        updated += changed(spark, folder, day)
    whole = tables[0].unionByName(tables[1]).unionByName(tables[2])
    want = ordered.changes_only(whole, ["k"], ["at", "i"], "v")
    assert repr(rows(spark.read.schema(whole.schema).parquet(f"{folder}/out"))) == repr(rows(want))
    assert len(updated) == 3 and updated[0] == 41 and updated[2] == 2


def test_a_feed_forgets_keys_behind_the_watermark(spark, folder):
    schema = "i long, at timestamp, k string, v string"
    days = [[(1, 1, "a", "x"), (2, 1, "b", "x")], [(3, 9, "b", "x")], [(4, 10, "c", "x")], [(5, 11, "a", "x"), (6, 11, "b", "x")]]
    for day in days:
        table = spark.createDataFrame([(i, datetime.datetime(2024, 1, d), k, v) for i, d, k, v in day], schema)
        table.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        changed(spark, folder, table, time="at", delay="0 seconds", expire=datetime.timedelta(days=3))
    # Nine days after its first row the watermark has passed a; b was seen in between, too late as well.
    assert [r["i"] for r in spark.read.parquet(f"{folder}/out").orderBy("i").collect()][-2:] in ([4, 5], [5, 6])
    with pytest.raises(InvalidArgs):
        S.stream_changes_only(spark.readStream.schema(schema).parquet(f"{folder}/in"), ["k"], ["i"], "v", "o", expire=datetime.timedelta(1))


def test_gate_splits_every_batch(spark, folder):
    events = spark.read.parquet(f"{SMALL}/events.parquet").withColumn("value", F.when(F.col("event_id") % 7 > 0, F.col("value")))
    stream = in_batches(spark, folder, [events.filter("event_id < 300"), events.filter("event_id >= 300")])
    good, bad, flags = (f"{folder}/{n}" for n in ("good", "bad", "flags"))
    rules = {"known": F.col("value").isNotNull(), "type": F.col("event_type") != "error"}
    policy = quality_policy(spark, missing_thresholds={"value": 50})
    drained(S.stream_quality_gate(stream, rules, good, bad, ["value", "event_type"], policy, flags))
    kept, rejected = spark.read.parquet(good), spark.read.parquet(bad)
    assert kept.count() + rejected.count() == events.count()
    assert kept.filter("value is null or event_type = 'error'").count() == 0
    flagged = spark.read.parquet(flags)
    assert rows(flagged, "batch", "column_name", "metric") == [(1, "value", "missing")]


def test_a_stream_is_watched_while_it_runs(spark, folder):
    events = spark.read.parquet(f"{SMALL}/events.parquet").withColumn("value", F.when(F.col("event_id") % 7 > 0, F.col("value")))
    pieces = [events.filter("event_id < 300"), events.filter("event_id >= 300")]
    stream = in_batches(spark, folder, pieces)
    watched = S.observed_quality(stream, ["value", "event_type"], placeholders={"event_type": ["click"]})
    run = watched.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    run.awaitTermination()
    found = S.observed_metrics(run, stream, ["value", "event_type"], placeholders={"event_type": ["click"]})
    want = [profile.column_quality_metrics(p, ["value", "event_type"], {"event_type": ["click"]}).collect() for p in pieces]
    assert rows(found) == sorted(((b, *tuple(r)) for b, m in enumerate(want) for r in m), key=repr)
    policy = quality_policy(spark, missing_thresholds={"value": 50})
    flagged = quality_flags(found.filter("batch = 1").drop("batch"), policy)
    assert ("value", "missing") in rows(flagged, "column_name", "metric")


def test_profile_of_a_stream_column_matches_batch_metrics(spark):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    assert profile.column_quality_metrics(events, ["value"]).filter("value > 0").count() == 0
