"""Streaming queries over the events file; each runs until its input is used up."""

from pyspark.sql import functions as F

from ..session import scratch_path
from ..streaming import operators as streaming
from .registry import query


def event_stream(t):
    return streaming.read_stream(t.spark, t.folder, t.events.schema, "events.parquet")


def finished(stream, mode: str):
    """Run a stateful stream to its end and read its result, which its last batch holds whole."""
    output, batches = scratch_path(stream.sparkSession, "result"), []

    def write(table, number):
        table.write.mode("overwrite").parquet(f"{output}/{number}")
        batches.append(number)

    run = (
        stream.writeStream.foreachBatch(write).outputMode(mode)
        .option("checkpointLocation", scratch_path(stream.sparkSession, "stream"))
        .trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{output}/{max(batches)}")


def drained(writer) -> None:
    writer.trigger(availableNow=True).start().awaitTermination()


@query("select event_type as value, count(*) as cnt from events group by 1")
def stream_event_counts(t):
    return finished(streaming.stream_value_counts(event_stream(t), "event_type"), "complete")


@query(
    "select cast(date_trunc('day', ts) as timestamp) as day, count(*) as rows, count(value) as value_count, "
    "count(*) - count(value) as value_missing, round(avg(value), 6) as value_mean, round(stddev_samp(value), 6) as value_std, "
    "min(value) as value_min, max(value) as value_max from events group by 1"
)
def stream_daily_profile(t):
    days = finished(streaming.stream_profile(event_stream(t), "ts", ["value"]), "complete")
    return days.select(
        F.col("window_start").cast("timestamp_ntz").alias("day"), "rows", "value_count", "value_missing",
        F.round("value_mean", 6).alias("value_mean"), F.round("value_std", 6).alias("value_std"),
        "value_min", "value_max",
    )


@query(
    "select user_id, event_id, event_type from (select *, lag(event_type) over (partition by user_id order by ts, event_id) "
    "as before from events) where event_type is distinct from before"
)
def stream_changes(t):
    output = scratch_path(t.spark, "changes")
    stream = event_stream(t)
    drained(streaming.stream_changes_only(stream, ["user_id"], ["ts", "event_id"], "event_type", output))
    return t.spark.read.schema(stream.schema).parquet(output).select("user_id", "event_id", "event_type")


@query(
    "select event_id, case when event_type = 'error' and value > 50 then 'type,value' when event_type = 'error' then 'type' "
    "else 'value' end as reasons from events where event_type = 'error' or value > 50"
)
def stream_rejected(t):
    good, rejected = scratch_path(t.spark, "good"), scratch_path(t.spark, "rejected")
    rules = {"type": F.col("event_type") != "error", "value": F.col("value") <= 50}
    drained(streaming.stream_quality_gate(event_stream(t), rules, good, rejected))
    return t.spark.read.parquet(rejected).select("event_id", F.array_join("reasons", ",").alias("reasons"))
