"""Streaming forms of counts, profiles, change feeds and the quality gate.

Counts and profiles use Spark's own stateful aggregates, change feeds keep a
value per key in the state store, and the gate runs per micro-batch with the
batch operators.
"""

from __future__ import annotations

import datetime
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StreamingQuery

from ..functions.columns import InvalidArgs, require_columns
from ..functions.values import canonical_col, number_col, ref
from ..operators.profile import column_quality_metrics, quality_counts
from ..operators.quality import quality_flags, quarantine
from ..session import scratch_path

# Fixed value: the store that keeps state on disk and writes the changed keys of a batch.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(
    spark: SparkSession, path: str, schema: T.StructType, glob: str = "*.parquet", files_per_trigger: int | None = None
) -> DataFrame:
    """New parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def event_time(df: DataFrame, column: str) -> DataFrame:
    """The column as a timestamp with time zone, which watermarks ask for."""
    return df.withColumn(column, ref(column).cast("timestamp"))


def stream_value_counts(stream: DataFrame, column: str) -> DataFrame:
    """Running (value, cnt); use update or complete mode."""
    (name,) = require_columns(stream, [column])
    return (
        stream.select(canonical_col(stream, name).alias("value"))
        .filter("value is not null")
        .groupBy("value")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def stream_profile(
    stream: DataFrame,
    time: str,
    columns: Sequence[str],
    window: str = "1 day",
    delay: str = "1 day",
    by: Sequence[str] = (),
) -> DataFrame:
    """Count, missing, mean, deviation, minimum and maximum per time window.

    Rows later than ``delay`` are dropped once their window is closed. In
    append mode a window comes out when the watermark has passed its end.
    """
    names = require_columns(stream, columns)
    aggregates = [F.count(F.lit(1)).alias("rows")]
    timed = event_time(stream, time)
    for name in names:
        value = number_col(timed, name)
        aggregates += [
            F.count(value).alias(f"{name}_count"),
            F.count_if(value.isNull()).alias(f"{name}_missing"),
            F.avg(value).alias(f"{name}_mean"),
            F.stddev_samp(value).alias(f"{name}_std"),
            F.min(value).alias(f"{name}_min"),
            F.max(value).alias(f"{name}_max"),
        ]
    if timed.isStreaming:
        timed = timed.withWatermark(time, delay)
    return (
        timed.groupBy(F.window(ref(time), window).alias("window"), *[ref(k) for k in by])
        .agg(*aggregates)
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            *[ref(k) for k in by],
            "rows",
            *[f"{n}_{m}" for n in names for m in ("count", "missing", "mean", "std", "min", "max")],
        )
    )


class _Changes(StatefulProcessor):
    """Keeps the last value of every key, and when it may be forgotten."""

    def __init__(self, names: Sequence[str], order: Sequence[str], value: str, state: T.StructType, expire_ms: int | None):
        self.n, self.row, self.state, self.expire_ms = len(names), Row(*names), state, expire_ms
        self.order, self.value = [names.index(c) for c in order], names.index(value)

    def init(self, handle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", self.state)

    def handleInputRows(self, key, rows, timerValues):
        def place(row):
            return [(x is not None, x != x, x) for x in (row[i] for i in self.order)]

        def same(a, b):
            return a == b or (a is not None and a != a and b != b)

        kept = self.last.get()
        value, until = kept if kept is not None else (None, None)
        latest = until
        for row in sorted(rows, key=place):
            if not same(row[self.value], value):
                yield self.row(*row[: self.n])
            value = row[self.value]
            if self.expire_ms is not None and row[self.n] is not None:
                latest = max(latest or 0, row[self.n] + self.expire_ms)
        if latest != until:
            if until is not None:
                self.handle.deleteTimer(until)
            self.handle.registerTimer(latest)
        if kept is None or latest != until or not same(kept[0], value):
            self.last.update((value, latest))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_changes_only(
    stream: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    output: str,
    state: str | None = None,
    time: str | None = None,
    delay: str = "1 day",
    expire: datetime.timedelta | None = None,
) -> DataStreamWriter:
    """Rows whose value differs from the last one of their key, to parquet files.

    The last value of each key is in Spark's state store (RocksDB), in
    ``state`` with the offsets: a batch writes the state of its own keys, and
    only where it changed, and a query that starts again goes on from there.
    The first row of a key comes out unless its value is null. Rows must not
    arrive out of order across batches. A key's rows of one batch are sorted in
    one task, so bound the batches (``files_per_trigger``) as memory asks for.
    With ``expire`` a key is forgotten when the watermark of ``time`` (``delay``
    behind the newest row) is that long past its newest row; rows behind the
    watermark are left out then. Start the returned writer.
    """
    spark, names = stream.sparkSession, list(stream.columns)
    require_columns(stream, [*keys, *order, value])
    if expire is not None and time is None:
        raise InvalidArgs("expire needs a time column")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    kept = T.StructType([T.StructField("value", stream.schema[value].dataType), T.StructField("until", T.LongType())])
    millis = None
    plain = [f"c{i}" for i in range(len(names))]  # the state function takes no names with dots
    short = dict(zip(names, plain))
    rows = stream.toDF(*plain)
    schema = rows.schema
    if expire is not None:
        millis = int(expire.total_seconds() * 1000)
        at = F.col(short[time]).cast("timestamp")
        rows = rows.withColumn("millis", F.unix_millis(at)).withColumn("at", at).withWatermark("at", delay)
    changes = rows.groupBy(*[short[k] for k in keys]).transformWithState(
        _Changes(plain, [short[o] for o in order], short[value], kept, millis), schema, "Append",
        "None" if expire is None else "EventTime",
    )
    return (
        changes.toDF(*names).writeStream.format("parquet").option("path", output).outputMode("append")
        .option("checkpointLocation", f"{state or scratch_path(spark, 'state')}/checkpoint")
    )


def observed_quality(
    stream: DataFrame, columns: Sequence[str], name: str = "quality", placeholders: Mapping[str, Sequence] | None = None
) -> DataFrame:
    """The stream itself; every batch counts missing, empty and placeholder cells while its rows pass by.

    No second pass is made. :func:`observed_metrics` reads the counts of a
    query's batches.
    """
    return stream.observe(name, F.count(F.lit(1)).alias("rows"), *quality_counts(stream, columns, placeholders)[0])


def observed_metrics(
    query: StreamingQuery, stream: DataFrame, columns: Sequence[str], name: str = "quality",
    placeholders: Mapping[str, Sequence] | None = None,
) -> DataFrame:
    """(batch, column_name, metric, value) of the batches that the query still reports on, for the quality gate.

    Spark keeps the progress of the last batches
    (``spark.sql.streaming.numRecentProgressUpdates``). If a task of a batch
    ran again, its rows may be counted twice: these are metrics to watch a
    stream by, and the sinks' own tables are to be published by.
    """
    labels, found = quality_counts(stream, columns, placeholders)[1], []
    for progress in query.recentProgress:
        row = progress["observedMetrics"].get(name)
        if row is not None and progress["numInputRows"]:
            found += [(progress["batchId"], c, m, float(row[label])) for label, (c, m) in labels.items()]
    schema = "batch long, column_name string, metric string, value double"
    return stream.sparkSession.createDataFrame(found, schema)


def stream_quality_gate(
    stream: DataFrame,
    rules: Mapping[str, Column],
    output: str,
    rejected: str,
    checked: Sequence[str] = (),
    policy: DataFrame | None = None,
    flags: str | None = None,
    checkpoint: str | None = None,
) -> DataStreamWriter:
    """Rows that keep every rule to ``output``, the others with reasons to ``rejected``.

    With ``flags`` the quality metrics of the ``checked`` columns are judged by
    the policy for each batch and the flagged ones written there. All sinks are
    written per batch under its number, so a repeated batch replaces itself.
    Give the same ``checkpoint`` to go on after a restart.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # read by up to three writes
        good, bad = quarantine(batch, rules)
        good.write.mode("overwrite").parquet(f"{output}/batch={batch_id}")
        bad.write.mode("overwrite").parquet(f"{rejected}/batch={batch_id}")
        if flags:
            flagged = quality_flags(column_quality_metrics(batch, checked), policy)
            flagged.write.mode("overwrite").parquet(f"{flags}/batch={batch_id}")
        batch.unpersist()

    location = checkpoint or scratch_path(stream.sparkSession, "gate")
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", location)
