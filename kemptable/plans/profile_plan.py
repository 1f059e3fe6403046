"""Many profile requests on one table with shared scans.

Two passes answer any number of requests: one aggregation for counts, moments,
parse rates and the brackets of quantiles, one value count table for the values
of all columns and the numbers inside the brackets.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import (
    EmptyData,
    InvalidArgs,
    choose_columns,
    normalize_name,
    numeric_columns,
    other_columns,
    require_columns,
)
from ..functions.values import DATETIME_FORMATS, canonical_col, present_col, rate
from ..operators.counts import (
    categorical_summary,
    mapping_coverage,
    mapping_keys,
    rare_values,
    smallest_ceilings,
    top_k_or_default,
    read_tags,
    tagged_value,
    top_n_per_column,
    unique_values,
    value_counts_topk,
)
from ..operators.numeric import QUARTILES, ValueCounts, moment_aggregates, quantiles, read_moments, summary_stats
from ..operators.profile import (
    DEFAULT_SAMPLES,
    PARSERS,
    column_profile,
    missing_report,
    parse_hits,
    parse_inputs,
    parseability,
    profile_from_counts,
)
from ..sources.files import encoding_audit

REPORT_SCHEMA = (
    "request_id long, name string, args_json string, reason string, metric string, value string, error string"
)
# The totals that a request's summary carries, where it has them.
STATS = (
    "rows_scanned", "time_limited", "row_limited", "truncated", "unique_count", "missing_in_mapping_count",
    "extra_mapping_keys_count", "rare_count", "sample_size", "columns_profiled", "sample_bytes",
)

# The profile operators by name, with the arguments a request may set.
PROFILERS: dict[str, Callable[..., DataFrame]] = {
    "unique_values": unique_values,
    "mapping_coverage": mapping_coverage,
    "rare_values": rare_values,
    "value_counts_topk": value_counts_topk,
    "summary_stats": summary_stats,
    "parseability": parseability,
    "column_profile": column_profile,
    "missing_report": missing_report,
    "categorical_summary": categorical_summary,
    "encoding_audit": encoding_audit,
}
ARGUMENTS = {
    "unique_values": {"column", "max_values_return"},
    "mapping_coverage": {"column", "mapping_keys", "max_values_return"},
    "rare_values": {"column", "rare_threshold", "max_values_return"},
    "value_counts_topk": {"column", "top_k"},
    "summary_stats": {"column", "columns"},
    "parseability": {"column", "parsers"},
    "column_profile": {"columns", "max_columns", "samples"},
    "missing_report": {"columns", "top"},
    "categorical_summary": {"columns", "top"},
    "encoding_audit": {"path"},
}
# Other names under which the operators may be requested.
OTHER_NAMES = {
    "collect_unique_values": "unique_values",
    "mapping_coverage_report": "mapping_coverage",
    "collect_rare_values": "rare_values",
    "detect_parseability": "parseability",
    "detect_encoding": "encoding_audit",
}


@dataclass
class Request:
    request_id: int
    name: str
    args: dict
    error: str | None = None
    reason: str | None = None
    columns: list[str] = field(default_factory=list)

    @property
    def args_json(self) -> str:
        return json.dumps(self.args, sort_keys=True, ensure_ascii=False)


def plan_requests(df: DataFrame, requests: Sequence[Mapping]) -> list[Request]:
    """Requests with known arguments only, without repeats, checked on the schema."""
    planned, seen = [], set()
    for number, raw in enumerate(requests, start=1):
        name = OTHER_NAMES.get(raw.get("name"), raw.get("name"))
        args = {k: v for k, v in (raw.get("args") or {}).items() if k in ARGUMENTS.get(name, ()) and v is not None}
        reason = raw.get("reason")
        request = Request(int(raw.get("request_id", number)), str(name), args, None, None if reason is None else str(reason))
        key = (request.name, request.args_json)
        if key in seen:
            continue
        seen.add(key)
        try:
            request.columns = _columns_of(df, request)
        except ValueError as problem:
            request.error = f"{type(problem).__name__}: {problem}"
        planned.append(request)
    return planned


def _columns_of(df: DataFrame, request: Request) -> list[str]:
    """The columns a request reads; raises when it cannot run."""
    name, args = request.name, request.args
    if name not in PROFILERS:
        raise InvalidArgs(f"unknown profile operator; known: {sorted(PROFILERS)}")
    for key in WHOLE_NUMBERS & set(args):
        try:
            args[key] = int(args[key])
        except (TypeError, ValueError):
            raise InvalidArgs(f"{key} is not a whole number: {args[key]!r}") from None
    if name == "encoding_audit":
        if not args.get("path"):
            raise InvalidArgs("path is needed")
        return []
    if name == "summary_stats":
        asked = args.get("columns") or ([args["column"]] if args.get("column") else None)
        names = require_columns(df, asked) if asked else numeric_columns(df)
        if not names:
            raise EmptyData("the table has no numeric column")
        return names
    if name in ("column_profile", "missing_report"):
        return choose_columns(df, args.get("columns"), args.get("max_columns"))
    if name == "categorical_summary":
        return choose_columns(df, args["columns"]) if args.get("columns") else other_columns(df)
    if not args.get("column"):
        raise InvalidArgs("column is needed")
    if name == "mapping_coverage" and not args.get("mapping_keys"):
        raise InvalidArgs("mapping keys are empty")
    if name == "parseability" and "parsers" in args and not [p for p in args["parsers"] if isinstance(p, str)]:
        raise InvalidArgs("no parser was named")
    return require_columns(df, [normalize_name(args["column"])])


# Arguments that must be whole numbers. An unusable top_k means the default.
WHOLE_NUMBERS = {"rare_threshold", "max_values_return", "max_columns", "samples", "top"}
COUNT_BASED = {"unique_values", "rare_values", "value_counts_topk", "mapping_coverage", "categorical_summary"}


def _needs_counts(request: Request) -> bool:
    if request.name == "column_profile":
        return int(request.args.get("samples", DEFAULT_SAMPLES)) > 0
    return request.name in COUNT_BASED


def profile_plan(df: DataFrame, requests: Sequence[Mapping]) -> DataFrame:
    """Run all requests; one report row per metric, errors as rows of their own.

    The table is read twice; column samples add a look at a few rows.
    """
    planned = plan_requests(df, requests)
    audits = {}
    for request in planned:
        if request.error is None and request.name == "encoding_audit":
            try:
                audits[request.request_id] = encoding_audit(df.sparkSession, request.args["path"])
            except (AnalysisException, OSError, ValueError) as problem:
                request.error = f"{type(problem).__name__}: {str(problem).splitlines()[0]}"
    working = [r for r in planned if r.error is None]
    counting = [r for r in working if _needs_counts(r)]
    values, names = _values_wanted(df, counting)
    facts = _one_pass(df, [r for r in working if r not in counting], values)
    rows = [(r.request_id, r.name, r.args_json, r.reason, None, None, r.error) for r in planned if r.error]
    for request in working:
        if request not in counting and request.name != "encoding_audit":
            for metric, value in _fixed_metrics(request, facts):
                rows.append((
                    request.request_id, request.name, request.args_json, request.reason, metric, _text(value), None
                ))
    parts = [df.sparkSession.createDataFrame(rows, REPORT_SCHEMA)]
    if counting:
        values.count(df)  # unless the quantiles' pass has done it
        counted = read_tags(values.counted.withColumnRenamed("s", "tagged"), names)
        parts += [_label(r, _count_metrics(df, r, counted)) for r in counting]
    parts += [
        _label(r, _long(audits[r.request_id], "path", ["encoding", "has_bom", "n_bytes"]))
        for r in working
        if r.name == "encoding_audit"
    ]
    return reduce(DataFrame.unionByName, parts)


def _values_wanted(df: DataFrame, counting: Sequence[Request]) -> tuple[ValueCounts, list[str]]:
    """The columns whose values the requests need, tagged; of sampled columns only the smallest ones by name."""
    names = sorted({c for r in counting for c in r.columns}, key=df.columns.index)
    in_full = {c for r in counting if r.name in COUNT_BASED for c in r.columns}
    sampled = [c for c in names if c not in in_full]
    most = max([int(r.args.get("samples", DEFAULT_SAMPLES)) for r in counting if r.name == "column_profile"] or [0])
    ceilings = smallest_ceilings(df, sampled, most) if sampled else {}
    return ValueCounts({
        f"c{i}": (tagged_value(canonical_col(df, c), True, ceilings.get(c)), None) for i, c in enumerate(names)
    }), names


def plan_summary(report: DataFrame) -> DataFrame:
    """One row per request of a report: its reason, its totals as JSON (null without any), its error."""
    total = F.when(F.col("metric").isin(*STATS), F.struct(F.col("metric").alias("key"), "value"))
    grouped = report.groupBy("request_id", "name", "args_json", "reason").agg(
        F.count("metric").alias("metrics"), F.collect_list(total).alias("totals"), F.max("error").alias("error")
    )  # a few totals each
    stats = F.when(F.size("totals") > 0, F.to_json(F.map_from_entries(F.array_sort("totals"))))
    return grouped.select("request_id", "name", "args_json", "reason", "metrics", stats.alias("stats"), "error")


def profile(df: DataFrame, name: str, **args) -> DataFrame:
    """One profile operator by its name, as it answers on its own."""
    (request,) = plan_requests(df, [{"name": name, "args": args}])
    if request.error:
        raise InvalidArgs(request.error)
    operator, args = PROFILERS[request.name], dict(request.args)
    if request.name == "summary_stats":
        args = {"columns": request.columns}
    elif request.name == "mapping_coverage":
        args = {"column": args["column"], "keys": args["mapping_keys"]}  # every key and value, with its status
    if request.name == "encoding_audit":
        return operator(df.sparkSession, **args)
    return operator(df, **args)


def _text(value) -> str | None:
    return None if value is None else str(value)


def _label(request: Request, metrics: DataFrame) -> DataFrame:
    return metrics.select(
        F.lit(request.request_id).cast("long").alias("request_id"),
        F.lit(request.name).alias("name"),
        F.lit(request.args_json).alias("args_json"),
        F.lit(request.reason).cast("string").alias("reason"),
        F.col("metric").cast("string").alias("metric"),
        F.col("value").cast("string").alias("value"),
        F.lit(None).cast("string").alias("error"),
    )


# --- everything that has a fixed size: one aggregation ---------------------


def _one_pass(df: DataFrame, requests: Sequence[Request], values: ValueCounts) -> dict:
    """Counts, moments and parse rates of all requests together; the pass for quantiles also counts the values."""
    stats = sorted({c for r in requests if r.name == "summary_stats" for c in r.columns})
    counts = sorted({c for r in requests if r.name in ("missing_report", "column_profile") for c in r.columns})
    parsed = sorted({c for r in requests if r.name == "parseability" for c in r.columns})
    if not (stats or counts or parsed):
        return {}
    inputs: list[Column] = []
    aggregates: list[Column] = [F.count(F.lit(1)).alias("rows")]
    quartiles = {c: QUARTILES for c in stats}
    for made, wanted in zip((inputs, aggregates), moment_aggregates(df, stats, quartiles)):
        made += wanted
    for i, name in enumerate(counts):
        inputs.append(present_col(df, name).isNotNull().alias(f"here{i}"))
        aggregates.append(F.count_if(F.col(f"here{i}")).alias(f"here{i}"))
    for i, name in enumerate(parsed):
        inputs += parse_inputs(df, name, f"_p{i}")
        aggregates += parse_hits(df, name, DATETIME_FORMATS, f"_p{i}")
    row = df.select(*inputs).agg(*aggregates).first()
    facts: dict = {"rows": row["rows"], "types": {c: df.schema[c].dataType.simpleString() for c in df.columns}}
    if stats:
        known = read_moments(df, stats, row)
        cuts = quantiles(df, quartiles, known=known, texts=values if values.columns else None)
        for name in stats:
            facts["stats", name] = known[name]
            facts["quartiles", name] = [cuts[(name, p)] for p in QUARTILES]
    for i, name in enumerate(counts):
        facts["missing", name] = row["rows"] - row[f"here{i}"]
    for i, name in enumerate(parsed):
        facts["parse", name] = {
            k: row[f"{k}_p{i}"] for k in ("n_values", "datetime_hits", "numeric_hits", "bool_hits")
        }
    return facts


def _share(part: int, whole: int, digits: int) -> float:
    """Rounded half up, as the rates of the single operators are."""
    if not whole:
        return 0.0
    return float(Decimal(repr(part / whole)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def _fixed_metrics(request: Request, facts: Mapping):
    if request.name == "summary_stats":
        yield "rows_scanned", facts["rows"]
        for c in request.columns:
            stats, (q1, median, q3) = facts["stats", c], facts["quartiles", c]
            std = None if stats["std"] is None else round(stats["std"], 6)
            yield from {
                f"{c}.count": stats["count"], f"{c}.missing": stats["missing"], f"{c}.mean": stats["mean"],
                f"{c}.std": std, f"{c}.min": stats["min_exact"] or stats["min"], f"{c}.q1": q1, f"{c}.median": median,
                f"{c}.q3": q3, f"{c}.max": stats["max_exact"] or stats["max"],
            }.items()
    elif request.name == "parseability":
        found = facts["parse", request.columns[0]]
        chosen = {p.lower() for p in request.args.get("parsers", PARSERS) if isinstance(p, str)}
        yield "sample_size", found["n_values"]
        for parser in PARSERS:
            if parser in chosen:
                yield f"{parser}_rate", _share(found[f"{parser}_hits"], found["n_values"], 4)
    elif request.name == "missing_report":
        yield "rows_scanned", facts["rows"]
        missing = sorted(((facts["missing", c], c) for c in request.columns), key=lambda x: (-x[0], x[1]))
        for n, c in [x for x in missing if x[0] > 0][: request.args.get("top")]:
            yield f"{c}.missing", n
            yield f"{c}.missing_rate", _share(n, facts["rows"], 6)
    elif request.name == "column_profile":
        yield "rows_scanned", facts["rows"]
        yield "columns_profiled", len(request.columns)
        for c in request.columns:
            n = facts["missing", c]
            yield f"{c}.dtype", facts["types"][c]
            yield f"{c}.total", facts["rows"]
            yield f"{c}.missing", n
            yield f"{c}.missing_rate", _share(n, facts["rows"], 6)


# --- everything about values: from the shared value counts -----------------


def _long(table: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """Rows (metric, value) named ``<label value>.<column>``."""
    entries = F.array(*[
        F.struct(F.concat_ws(".", F.col(label), F.lit(c)).alias("metric"), _cell(table, c).alias("value"))
        for c in columns
    ])
    return table.select(F.explode(entries).alias("e")).select("e.metric", "e.value")


def _cell(table: DataFrame, name: str) -> Column:
    simple = table.schema[name].dataType.simpleString()
    return F.to_json(F.col(name)) if simple.startswith("array") else F.col(name).cast("string")


def _items(table: DataFrame, metric: str, value: Column) -> DataFrame:
    return table.select(F.lit(metric).alias("metric"), value.cast("string").alias("value"))


def _count_metrics(df: DataFrame, request: Request, counted: DataFrame) -> DataFrame:
    args = request.args
    mine = counted.filter(F.col("column_name").isin(request.columns))
    seen = mine.filter("value is not null").drop("listed")
    cut = args.get("max_values_return")
    if request.name == "unique_values":
        totals = mine.agg(F.count("value").alias("unique_count"), F.sum("cnt").alias("rows_scanned"))
        values = seen.orderBy("value").limit(cut) if cut else seen
        return _totals(totals).unionByName(_items(values, "value", F.col("value")))
    if request.name == "rare_values":
        rare = seen.filter(F.col("cnt") <= int(args.get("rare_threshold", 3)))
        totals = rare.agg(F.count(F.lit(1)).alias("rare_count"))
        shown = rare.orderBy("cnt", "value").limit(cut) if cut else rare
        return _totals(totals).unionByName(_items(shown, "rare_value", F.to_json(F.struct("value", "cnt"))))
    if request.name == "value_counts_topk":
        totals = seen.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("total_nonnull"))
        top = seen.orderBy(F.desc("cnt"), "value").limit(top_k_or_default(args.get("top_k", 20)))
        top = top.withColumn("ratio", rate(F.col("cnt"), totals.scalar()))
        return _totals(totals).unionByName(_items(top, "top_value", F.to_json(F.struct("value", "cnt", "ratio"))))
    if request.name == "mapping_coverage":
        keys = mapping_keys(df, args["mapping_keys"]).withColumn("known", F.lit(True))
        met = seen.select("value", "cnt").join(keys, "value", "full_outer")
        missing, extra = met.filter("known is null"), met.filter("cnt is null")
        totals = met.agg(
            F.count("cnt").alias("unique_count"),
            F.count("known").alias("mapping_key_count"),
            F.count_if(F.col("known").isNull()).alias("missing_in_mapping_count"),
            F.count_if(F.col("cnt").isNull()).alias("extra_mapping_keys_count"),
        )
        if cut:
            missing, extra = missing.orderBy("value").limit(cut), extra.orderBy("value").limit(cut)
        return (
            _totals(totals)
            .unionByName(_items(missing, "missing_in_mapping", F.col("value")))
            .unionByName(_items(extra, "extra_mapping_key", F.col("value")))
        )
    if request.name == "categorical_summary":
        distinct = seen.groupBy("column_name").agg(F.count_if(F.col("cnt") > 0).alias("nunique"))
        top = top_n_per_column(seen, int(args.get("top", 3)))
        item = F.to_json(F.struct("value", "cnt", "rank"))
        return _long(distinct, "column_name", ["nunique"]).unionByName(
            top.select(F.concat_ws(".", "column_name", F.lit("top")).alias("metric"), item.alias("value"))
        )
    profile = profile_from_counts(df, request.columns, mine, int(args.get("samples", DEFAULT_SAMPLES)))
    return _long(profile, "column_name", ["dtype", "total", "missing", "missing_rate", "samples"])


def _totals(totals: DataFrame) -> DataFrame:
    """A one-row table of numbers as (metric, value) rows."""
    entries = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in totals.columns])
    return totals.select(F.explode(entries).alias("e")).select("e.metric", "e.value")
