"""The quality gate: metrics, policy and requirements to a verdict.

All inputs are tables. ``by`` names key columns (a run, a source) so that one
job judges many tables at once. Metrics are long rows (column_name, metric,
value); a policy has one row per column.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from ..functions.values import present_col, ref, strip, text_list, text_value, to_number, to_verdict

# Metric name parts that mean data is absent or made up, and name
# parts that mark a metric as information only.
FLAG_PARTS = ["missing", "empty", "placeholder", "fallback"]
INFO_PARTS = ["before", "after", "raw", "input", "original", "orig"]
# Fixed value: metric name ending for the number of unmapped values.
MAPPING_GAP = "missing_mapping_count"
# Fixed value: metric name part of a list of unmapped values.
MAPPING_LIST = "missing_mapping"

# Stages of the verdict, in the order they are checked.
STAGES = [
    "missing_report",
    "missing_ok_issues",
    "missing_metrics",
    "missing_requirements",
    "requirements",
    "placeholder_metrics",
    "missing_mapping",
    "silent_miss",
]

POLICY_FIELDS = "column_name string, allowed boolean, threshold double, ph_required boolean, ph_optional boolean"

# Report entries that hold the policy lists.
ALLOWED_KEYS = ["allowed_missing", "allowed_missing_cols", "missing_allowlist"]
THRESHOLD_KEYS = ["missing_thresholds", "allowed_missing_thresholds"]
REQUIRED_KEYS = ["placeholder_required", "required_placeholder"]
OPTIONAL_KEYS = ["placeholder_optional", "optional_placeholder"]
STRICT_KEYS = ["strict_validation", "validation_strict", "enforce_metrics"]


def _has_part(name: Column, parts: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(name).contains(p) for p in parts])


def _names(value: object) -> set[str]:
    """Names from a list, a JSON list in text, or one bare name."""
    if value is None:
        return set()
    if isinstance(value, str):
        text = value.strip()
        if text.startswith("["):
            try:
                return _names(json.loads(text))
            except ValueError:
                pass
        value = [text]
    return {n for n in (str(v).strip().strip("'\"") for v in value) if n}


def quality_policy(
    spark: SparkSession,
    allowed_missing: object = None,
    missing_thresholds: Mapping[str, float] | None = None,
    placeholder_required: object = None,
    placeholder_optional: object = None,
) -> DataFrame:
    """A policy table from lists of column names and thresholds."""
    allowed, required, optional = map(_names, (allowed_missing, placeholder_required, placeholder_optional))
    limits = {str(k): float(v) for k, v in (missing_thresholds or {}).items()}
    rows = [
        (c, c in allowed, limits.get(c), c in required, c in optional)
        for c in sorted(allowed | required | optional | set(limits))
    ]
    return spark.createDataFrame(rows, POLICY_FIELDS)


def policy_from_reports(reports: DataFrame, entries: str, by: Sequence[str]) -> DataFrame:
    """Policy rows per run from a map column of report entries kept as text."""
    entry = lambda names: F.coalesce(*[F.element_at(ref(entries), F.lit(n)) for n in names])
    every = lambda names: F.array_distinct(F.flatten(F.array(*[
        F.coalesce(text_list(F.element_at(ref(entries), F.lit(n))), F.array().cast("array<string>")) for n in names
    ])))
    keys = [ref(k) for k in by]

    def listed(names, **flags):
        return reports.select(*keys, F.explode(every(names)).alias("column_name")).select(
            *keys,
            "column_name",
            *[F.lit(flags.get(f, False)).alias(f) for f in ("allowed", "ph_required", "ph_optional")],
            F.lit(None).cast("double").alias("threshold"),
        )

    limits = (
        reports.select(*keys, F.explode(F.from_json(entry(THRESHOLD_KEYS), "map<string,string>")))
        .select(
            *keys,
            F.col("key").alias("column_name"),
            *[F.lit(False).alias(f) for f in ("allowed", "ph_required", "ph_optional")],
            to_number(F.col("value")).alias("threshold"),
        )
        .filter("threshold is not null")
    )
    parts = [
        listed(ALLOWED_KEYS, allowed=True),
        listed(REQUIRED_KEYS, ph_required=True),
        listed(OPTIONAL_KEYS, ph_optional=True),
        limits,
    ]
    return (
        reduce(DataFrame.unionByName, parts)
        .groupBy(*keys, "column_name")
        .agg(
            F.bool_or("allowed").alias("allowed"),
            F.max("threshold").alias("threshold"),
            F.bool_or("ph_required").alias("ph_required"),
            F.bool_or("ph_optional").alias("ph_optional"),
        )
    )


def metrics_from_names(named: DataFrame, name: str = "name", value: str = "value", by: Sequence[str] = ()) -> DataFrame:
    """Split flat metric names such as ``Age_missing`` into column and metric.

    The known endings decide; a name without one keeps an empty column name.
    """
    ending = F.regexp_extract(ref(name), "_(missing_mapping_count|missing|empty|placeholder|fallback)$", 1)
    column = F.when(ending != "", F.expr("substr(`{0}`, 1, length(`{0}`) - length(_ending) - 1)".format(name)))
    return (
        named.withColumn("_ending", ending)
        .select(
            *[ref(k) for k in by],
            F.coalesce(column, F.lit("")).alias("column_name"),
            F.when(F.col("_ending") != "", F.col("_ending")).otherwise(ref(name)).alias("metric"),
            to_number(ref(value).cast("string")).alias("value"),
        )
        .filter("value is not null")
    )


def metrics_from_json(reports: DataFrame, column: str = "metrics", by: Sequence[str] = ("run_id",)) -> DataFrame:
    """Long metric rows from a JSON object of metrics; booleans are no metrics.

    A list of unmapped values counts as the number of its entries.
    """
    flat = reports.select(
        *[ref(k) for k in by], F.explode(F.from_json(ref(column), "map<string,string>")).alias("name", "value")
    ).filter(~F.lower("value").isin("true", "false"))
    entries = F.size(F.from_json("value", "array<string>"))
    listed = F.lower("name").contains(MAPPING_LIST) & F.startswith(F.ltrim("value"), F.lit("["))
    counted = F.regexp_replace("name", f"(?i)_?{MAPPING_LIST}.*$", f"_{MAPPING_GAP}")
    flat = flat.select(
        *[ref(k) for k in by],
        F.when(listed, counted).otherwise(F.col("name")).alias("name"),
        F.when(listed, entries.cast("string")).otherwise(F.col("value")).alias("value"),
    )
    return metrics_from_names(flat, by=by)


def _with_policy(metrics: DataFrame, policy: DataFrame | None, by: Sequence[str]) -> DataFrame:
    """Metrics with the policy of their column; no row means the strict default."""
    if policy is None:
        policy = quality_policy(metrics.sparkSession)
    on = [*[k for k in by if k in policy.columns], "column_name"]
    joined = metrics.join(policy, on, "left")
    return joined.withColumns({
        flag: F.coalesce(F.col(flag), F.lit(False)) for flag in ("allowed", "ph_required", "ph_optional")
    })


def quality_flags(
    metrics: DataFrame,
    policy: DataFrame | None = None,
    by: Sequence[str] = (),
    legacy_names: bool = False,
) -> DataFrame:
    """The metrics that count against the data.

    A positive missing, empty, placeholder or fallback metric is flagged unless
    its column may miss values, stays within its threshold (missing and empty
    together), or has optional placeholders. ``legacy_names`` also skips every
    metric whose full name contains a word such as ``raw`` or ``after``.
    """
    keys = [ref(k) for k in by]
    absent = (
        metrics.filter(F.col("metric").isin("missing", "empty"))
        .groupBy(*keys, "column_name")
        .agg(F.sum("value").alias("absent"))
    )
    judged = _with_policy(metrics, policy, by).join(absent, [*by, "column_name"], "left")
    full = F.concat_ws("_", F.nullif(F.col("column_name"), F.lit("")), F.col("metric"))
    named = full if legacy_names else F.col("metric")
    kept = _has_part(named, FLAG_PARTS) & (F.col("value") > 0)
    informative = _has_part(named, INFO_PARTS)
    # The policy speaks of a column's own four metrics, not of other names.
    owned = F.col("metric").isin(FLAG_PARTS) & (F.col("column_name") != "")
    within = F.col("threshold").isNotNull() & (F.coalesce("absent", F.lit(0.0)) <= F.col("threshold"))
    excused = owned & (F.col("allowed") | within | F.col("ph_optional"))
    return judged.filter(kept & ~informative & ~excused).select(*keys, "column_name", "metric", "value")


def placeholder_coverage(
    metrics: DataFrame, policy: DataFrame | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Columns with a missing or empty metric but no placeholder metric.

    Allowed and optional columns are skipped; where a policy requires
    placeholders of some columns, only those are checked.
    """
    keys = [ref(k) for k in by]
    if policy is None:
        policy = quality_policy(metrics.sparkSession)
    per_column = (
        metrics.groupBy(*keys, "column_name")
        .agg(
            F.bool_or(F.col("metric").isin("missing", "empty")).alias("counted"),
            F.bool_or(_has_part(F.col("metric"), ["placeholder", "fallback"])).alias("covered"),
        )
        .filter("counted and not covered and column_name <> ''")
    )
    judged = _with_policy(per_column, policy, by)
    policy_keys = [k for k in by if k in policy.columns]
    if policy_keys:  # a policy per run
        listed = policy.groupBy(*[ref(k) for k in policy_keys]).agg(F.bool_or("ph_required").alias("some_required"))
        judged = judged.join(listed, policy_keys, "left")
        some_required = F.coalesce(F.col("some_required"), F.lit(False))
    else:
        some_required = F.coalesce(policy.agg(F.bool_or("ph_required")).scalar(), F.lit(False))
    wanted = ~F.col("allowed") & ~F.col("ph_optional") & (~some_required | F.col("ph_required"))
    return judged.filter(wanted).select(*keys, "column_name")


def mapping_gaps(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mapping metrics that report values without a mapping."""
    found = F.col("metric").endswith(MAPPING_GAP) & (F.col("value") > 0)
    return metrics.filter(found).select(*[ref(k) for k in by], "column_name", "metric", "value")


def requirement_verdict(required: DataFrame, reported: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Status per required id: pass, fail or missing.

    ``reported`` has (id, ok_raw) with text, number or boolean verdicts; an
    unreadable one fails. An id that is reported twice must pass each time.
    """
    keys = [*by, "id"]
    dtype = reported.schema["ok_raw"].dataType
    ok = to_verdict(text_value("ok_raw", dtype))
    judged = reported.groupBy(*[ref(k) for k in keys]).agg(
        F.bool_and(F.coalesce(ok, F.lit(False))).alias("ok")
    )
    status = F.when(F.col("ok").isNull(), "missing").when(F.col("ok"), "pass").otherwise("fail")
    wanted = required.select(*[ref(k) for k in keys]).distinct()
    return wanted.join(judged, keys, "left").select(*[ref(k) for k in keys], status.alias("status"))


def strict_from_reports(entries: Column, default: bool = True) -> Column:
    """Whether a report asks for the strict gate; its entries are a text map."""
    asked = [F.nullif(F.element_at(entries, F.lit(k)), F.lit("")) for k in STRICT_KEYS]
    return F.coalesce(to_verdict(F.coalesce(*asked)), F.lit(default))


def quality_verdict(
    reports: DataFrame,
    metrics: DataFrame,
    policy: DataFrame | None = None,
    required: DataFrame | None = None,
    reported: DataFrame | None = None,
    strict: bool | str = True,
    by: Sequence[str] = ("run_id",),
) -> DataFrame:
    """One row per run: ok, the first stage that failed, and a short detail.

    ``reports`` has the key columns, ``has_report``, ``ok`` as text and
    ``issues`` (any type, null when absent). ``strict`` may name a boolean
    column of ``reports``. Details are counts and the first name, so a run with
    very many findings stays one small row.
    """
    keys = [ref(k) for k in by]
    gate = ref(strict) if isinstance(strict, str) else F.lit(strict)
    said = F.col("ok") if reports.schema["ok"].dataType.simpleString() == "boolean" else to_verdict(F.col("ok"))
    runs = reports.select(
        *keys,
        F.coalesce("has_report", F.lit(False)).alias("has_report"),
        (F.col("ok").isNotNull() & F.col("issues").isNotNull()).alias("complete"),
        F.coalesce(said, F.lit(False)).alias("said_ok"),
        F.coalesce(gate, F.lit(True)).alias("strict"),
    )

    def tally(found: DataFrame, name: Column, label: str) -> DataFrame:
        return found.groupBy(*keys).agg(
            F.count(F.lit(1)).alias(f"{label}_n"), F.min(name).alias(f"{label}_first")
        )

    per_column = F.concat_ws("_", F.col("column_name"), F.col("metric"))
    parts = [
        metrics.groupBy(*keys).agg(F.count(F.lit(1)).alias("metrics_n")),
        tally(placeholder_coverage(metrics, policy, by), F.col("column_name"), "placeholder"),
        tally(mapping_gaps(metrics, by), per_column, "mapping"),
        tally(quality_flags(metrics, policy, by), per_column, "flag"),
    ]
    if required is not None:
        if reported is None:
            raise ValueError("reported verdicts are needed when requirements are given")
        unmet = requirement_verdict(required, reported, by).filter(F.col("status") != "pass")
        parts.append(tally(unmet, F.concat_ws("=", "id", "status"), "requirement"))
        parts.append(required.groupBy(*keys).agg(F.count(F.lit(1)).alias("required_n")))
        parts.append(reported.groupBy(*keys).agg(F.count(F.lit(1)).alias("reported_n")))
    joined = reduce(lambda left, right: left.join(right, list(by), "left"), parts, runs)

    def some(label: str) -> Column:
        return F.coalesce(F.col(label), F.lit(0)) > 0 if label in joined.columns else F.lit(False)

    def detail(label: str) -> Column:
        if f"{label}_n" not in joined.columns:
            return F.lit("")
        return F.concat(F.col(f"{label}_n").cast("string"), F.lit(": "), F.col(f"{label}_first"))

    strict_on, said_ok = F.col("strict"), F.col("said_ok")
    checks = [
        (~F.col("has_report"), F.lit("")),
        (~F.col("complete"), F.lit("")),
        (strict_on & said_ok & ~some("metrics_n"), F.lit("")),
        (some("required_n") & ~some("reported_n"), F.lit("")),
        (some("requirement_n"), detail("requirement")),
        (strict_on & said_ok & some("placeholder_n"), detail("placeholder")),
        (strict_on & some("mapping_n"), detail("mapping")),
        (~said_ok | (strict_on & some("flag_n")), F.when(strict_on & some("flag_n"), detail("flag")).otherwise("")),
    ]
    stage = F.coalesce(*[F.when(failed, F.lit(name)) for name, (failed, _) in zip(STAGES, checks)])
    why = F.coalesce(*[F.when(failed, text) for failed, text in checks])
    return joined.select(*keys, stage.isNull().alias("ok"), stage.alias("failed_stage"), why.alias("detail"))


def quarantine(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that meet every rule, and the others with the names of broken rules."""
    broken = F.array_compact(F.array(*[
        F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()
    ]))
    judged = df.withColumn("reasons", broken)
    good = judged.filter(F.size("reasons") == 0).drop("reasons")
    return good, judged.filter(F.size("reasons") > 0)


def observe_quality(
    df: DataFrame, columns: Iterable[str], name: str = "quality"
) -> tuple[DataFrame, Observation]:
    """The table with missing and empty counts gathered while it is written.

    After an action ``observation.get`` holds ``<column>_missing`` and so on.
    """
    observation = Observation(name)
    counts = [F.count(F.lit(1)).alias("rows")]
    for column in columns:
        text = text_value(column, df.schema[column].dataType)
        counts.append(F.count_if(present_col(df, column).isNull()).alias(f"{column}_missing"))
        counts.append(F.count_if(F.coalesce(strip(text) == "", F.lit(False))).alias(f"{column}_empty"))
    return df.observe(observation, *counts), observation
