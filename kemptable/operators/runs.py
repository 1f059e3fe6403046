"""Tables about runs: requests, traces, expiry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.values import ref
from .ordered import with_previous

DEFAULT_TTL_SECONDS = 1800


def canonical_json(column: Column) -> Column:
    """A JSON object with its keys in order; other text as it is."""
    entries = F.map_entries(F.from_json(column, "map<string,string>"))
    ordered = F.to_json(F.map_from_entries(F.array_sort(entries)))
    return F.coalesce(F.when(F.get_json_object(column, "$").isNotNull(), ordered), column)


def dedupe_requests(requests: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """The first request of each (name, arguments), unless it was made earlier.

    Arguments are compared with their keys in order. The first of many copies
    is found by a combining aggregate, so copies never meet in one task.
    """
    keyed = requests.withColumn("_args", canonical_json(F.col("args_json")))
    others = [c for c in requests.columns if c not in ("name", "request_id")]
    first = (
        keyed.groupBy("name", "_args")
        .agg(F.min_by(F.struct("request_id", *[ref(c) for c in others]), "request_id").alias("first"))
        .select("name", "_args", "first.*")
    )
    if earlier is not None:
        done = earlier.select("name", canonical_json(F.col("args_json")).alias("_args")).distinct()
        first = first.join(done, ["name", "_args"], "left_anti")
    return first.select(*[ref(c) for c in requests.columns])


def trace_report(
    trace: DataFrame,
    run: str = "run_id",
    order: Sequence[str] = ("ts",),
    node: str = "node",
    ok: str = "ok",
    requirements: DataFrame | None = None,
    flags: DataFrame | None = None,
    repeat_node: str = "reflect",
    pieces: int | None = None,
) -> DataFrame:
    """Per run: steps, repeats, verdict changes, first and last time, last verdict.

    ``requirements`` (run, id, status) and ``flags`` (run, …) add the number of
    failed requirements and of flagged metrics.
    """
    marked = with_previous(trace, [run], order, [ok], pieces)
    changed = (F.col("step") > 1) & ~ref(ok).eqNullSafe(F.col("prev").getField(ok))
    report = marked.groupBy(ref(run)).agg(
        F.count(F.lit(1)).alias("steps"),
        F.count_if(ref(node).cast("string") == repeat_node).alias("reflect_count"),
        F.count_if(changed).alias("verdict_changes"),
        F.min(ref(order[0])).alias("first_at"),
        F.max(ref(order[0])).alias("last_at"),
        F.max_by(ref(ok), F.col("step")).alias("last_ok"),
    )
    if requirements is not None:
        failed = requirements.filter(F.col("status") != "pass").groupBy(ref(run))
        report = report.join(failed.agg(F.count(F.lit(1)).alias("failed_requirements")), run, "left")
        report = report.fillna(0, ["failed_requirements"])
    if flags is not None:
        flagged = flags.groupBy(ref(run)).agg(F.count(F.lit(1)).alias("metric_flags"))
        report = report.join(flagged, run, "left").fillna(0, ["metric_flags"])
    return report


def expire_runs(
    registry: DataFrame, now: Column, ttl_seconds: int = DEFAULT_TTL_SECONDS, created: str = "created_at"
) -> DataFrame:
    """Runs older than the time to live; nothing is deleted."""
    return registry.filter(ref(created) < now - F.make_dt_interval(secs=F.lit(ttl_seconds)))


def expired_files(files: DataFrame, expired: DataFrame, run: str = "run_id") -> DataFrame:
    """The output files of expired runs."""
    return files.join(expired.select(ref(run)).distinct(), run, "left_semi")
