"""Queries over run tables; the events stand in for a trace."""

from pyspark.sql import functions as F

from ..operators import ordered, runs
from .registry import query

CHANGES_SQL = (
    "select run_id, event_id, ts, node, ok from (select *, lag(node) over (partition by run_id order by ts, event_id) "
    "as before from trace) where node is distinct from before"
)
STEPS_SQL = (
    "select run_id, event_id, row_number() over (partition by run_id order by ts, event_id) as step from trace"
)


@query(CHANGES_SQL, ("trace",))
def changes_only_events(t):
    return ordered.changes_only(t.trace, ["run_id"], ["ts", "event_id"], "node")


@query(CHANGES_SQL, ("trace",))
def changes_only_segments(t):
    """The same by the path long inputs take: every key cut along time."""
    return ordered.changes_only(t.trace, ["run_id"], ["ts", "event_id"], "node", pieces=60)


@query(STEPS_SQL, ("trace",))
def numbered_steps(t):
    return ordered.number_steps(t.trace, ["run_id"], ["ts", "event_id"]).select("run_id", "event_id", "step")


@query(STEPS_SQL, ("trace",))
def numbered_steps_segments(t):
    steps = ordered.number_steps(t.trace, ["run_id"], ["ts", "event_id"], pieces=60)
    return steps.select("run_id", "event_id", "step")


@query(
    "select run_id, ts, event_id, step, prev_ok, ok from (select *, lag(ok) over w as prev_ok, "
    "row_number() over w as step from trace window w as (partition by run_id order by ts, event_id)) "
    "where step > 1 and ok is distinct from prev_ok",
    ("trace",),
)
def verdict_transitions(t):
    return ordered.verdict_transitions(t.trace, "run_id", ["ts", "event_id"])


@query(
    ", marked as (select *, row_number() over w as step, lag(ok) over w as prev_ok from trace "
    "window w as (partition by run_id order by ts, event_id)) "
    "select run_id, count(*) as steps, count(*) filter (where node = 'click') as reflect_count, "
    "count(*) filter (where step > 1 and ok is distinct from prev_ok) as verdict_changes, "
    "min(ts) as first_at, max(ts) as last_at, arg_max(ok, step) as last_ok, "
    "count(*) filter (where not ok) as failed_requirements, 1 as metric_flags from marked group by run_id",
    ("trace",),
)
def trace_report_events(t):
    trace = t.trace
    requirements = trace.select("run_id", F.col("event_id").alias("id"), F.when(F.col("ok"), "pass").otherwise("fail").alias("status"))
    flags = trace.select("run_id").distinct()
    return runs.trace_report(
        trace, order=("ts", "event_id"), requirements=requirements, flags=flags, repeat_node="click"
    )


@query("select run_id, created_at from registry where created_at < timestamp '1998-01-01 00:00:00'", ("registry",))
def expired_runs(t):
    now = F.lit("1998-01-01 00:30:00").cast("timestamp_ntz")
    return runs.expire_runs(t.registry, now)


@query(
    "select l_orderkey as run_id, l_linenumber from lineitem where l_orderkey in "
    "(select run_id from registry where created_at < timestamp '1998-01-01 00:00:00')",
    ("registry",),
)
def expired_run_files(t):
    now = F.lit("1998-01-01 00:30:00").cast("timestamp_ntz")
    files = t.lineitem.select(F.col("l_orderkey").alias("run_id"), "l_linenumber")
    return runs.expired_files(files, runs.expire_runs(t.registry, now))


REQUESTS = ["event_id as request_id", "event_type as name", "props as args_json", "ts"]


@query(
    "with r as (select event_id as request_id, event_type as name, props as args_json, ts from events where ts >= timestamp '2024-01-03'), "
    "done as (select distinct event_type as name, props as args_json from events where ts < timestamp '2024-01-03') "
    "select min(request_id) as request_id, name, args_json from r where not exists "
    "(select 1 from done d where d.name = r.name and d.args_json = r.args_json) group by name, args_json"
)
def dedupe_requests_events(t):
    """Requests not made before, each once; earlier days are the earlier runs."""
    all_requests = t.events.selectExpr(*REQUESTS)
    split = F.lit("2024-01-03").cast("timestamp_ntz")
    fresh = all_requests.filter(F.col("ts") >= split).drop("ts")
    return runs.dedupe_requests(fresh, all_requests.filter(F.col("ts") < split))
