"""Cleaning steps. Statistics come from one bounded aggregate and enter the
plan as literals, so a cleaned table is one scan and filters reach the files."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.columns import InvalidArgs, require_columns
from ..functions.values import (
    canonical_col,
    canonical_value,
    digit_shape,
    is_number_type,
    number_col,
    present_col,
    ref,
    safe_string,
    sql_string,
    strip,
    text_value,
    to_datetime,
    to_number,
)
from .counts import mapping_coverage
from .joins import lookup_join
from .numeric import moments, quantiles
from .ordered import distinct_ranks
from .profile import long_rows

MOST_CATEGORIES = 200
DATE_PARTS = {"year": F.year, "month": F.month, "day": F.dayofmonth}


@dataclass
class Statistics:
    """What steps may be told instead of finding it: by column, by (column, point) for quantiles."""

    moments: dict[str, dict] = field(default_factory=dict)
    quantiles: dict[tuple[str, float], float | None] = field(default_factory=dict)
    modes: dict[str, object] = field(default_factory=dict)
    categories: dict[str, list[str]] = field(default_factory=dict)


class UnmappedValues(ValueError):
    """The column holds values that the mapping does not cover."""


def most_frequent(df: DataFrame, column: str):
    """The most frequent present value, the smallest one on a tie."""
    (name,) = require_columns(df, [column])
    row = (
        df.select(present_col(df, name).alias("value"))
        .filter("value is not null")
        .groupBy("value")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .orderBy(F.desc("cnt"), "value")
        .limit(1)
        .first()
    )
    return None if row is None else row["value"]


def fill_missing(
    df: DataFrame, rules: Mapping[str, object], accuracy: int | None = None, known: Statistics | None = None
) -> DataFrame:
    """Fill missing values: ``mean``, ``median``, ``mode`` or ``("const", v)`` per column."""
    names = dict(zip(require_columns(df, list(rules)), rules.values()))
    averaged = [c for c, rule in names.items() if rule in ("mean", "median")]
    points = {c: [0.5] for c in averaged if names[c] == "median"}
    told = known or Statistics()
    found = {**moments(df, [c for c in averaged if c not in told.moments], points), **told.moments}
    open_points = {c: p for c, p in points.items() if (c, 0.5) not in told.quantiles}
    middles = {**quantiles(df, open_points, known=found, accuracy=accuracy), **told.quantiles}
    fillers: dict[str, object] = {}
    for name, rule in names.items():
        if rule == "mean":
            fillers[name] = found[name]["mean"]
        elif rule == "median":
            fillers[name] = middles[(name, 0.5)]
        elif rule == "mode":
            fillers[name] = told.modes[name] if name in told.modes else most_frequent(df, name)
        elif isinstance(rule, (tuple, list)) and len(rule) == 2 and rule[0] == "const":
            fillers[name] = rule[1]
        else:
            raise InvalidArgs(f"unknown fill rule for {name}: {rule!r}")
    return df.withColumns({
        name: F.coalesce(present_col(df, name), F.lit(value)) for name, value in fillers.items() if value is not None
    })


def drop_missing_rows(df: DataFrame, columns: Sequence[str] | None = None, how: str = "any") -> DataFrame:
    """Drop rows that miss any (or all) of the named columns."""
    names = require_columns(df, columns) if columns else None
    return df.na.drop(how=how, subset=names)


def remove_outliers(
    df: DataFrame,
    column: str,
    upper_quantile: float | None = 0.99,
    lower_quantile: float | None = None,
    clip: bool = False,
    accuracy: int | None = None,
    known: Statistics | None = None,
) -> DataFrame:
    """Drop, or clip, the values beyond the quantiles; rows without a value go.

    Text is compared as a number; what is no number counts as missing. With
    ``clip`` missing values stay missing.
    """
    (name,) = require_columns(df, [column])
    points = [q for q in (lower_quantile, upper_quantile) if q is not None]
    limits = dict(known.quantiles) if known else {}
    if not all((name, q) in limits for q in points):
        limits = quantiles(df, {name: points}, accuracy=accuracy)
    low = limits.get((name, lower_quantile))
    high = limits.get((name, upper_quantile))
    value = present_col(df, name) if is_number_type(df.schema[name].dataType) else number_col(df, name)
    if clip:
        clipped = value
        if low is not None:
            clipped = F.when(value < low, F.lit(low)).otherwise(clipped)
        if high is not None:
            clipped = F.when(value > high, F.lit(high)).otherwise(clipped)
        return df.withColumn(name, clipped)
    if not is_number_type(df.schema[name].dataType):
        kept = df.filter(value.isNotNull())
        kept = kept.filter(value >= low) if low is not None else kept
        return kept.filter(value <= high) if high is not None else kept
    # Plain comparisons of the column reach the files.
    kept = df
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        kept = kept.filter(~F.isnan(ref(name)))
    if low is not None:
        kept = kept.filter(ref(name) >= low)
    if high is not None:
        kept = kept.filter(ref(name) <= high)
    return kept.filter(ref(name).isNotNull())


def one_hot(
    df: DataFrame, column: str, max_categories: int = MOST_CATEGORIES, keep: bool = True,
    known: Statistics | None = None,
) -> DataFrame:
    """One 0/1 column per category, named ``<column>_<value>``.

    Raises when there are more categories than ``max_categories``: a column per
    value would not be a usable table.
    """
    (name,) = require_columns(df, [column])
    text = canonical_col(df, name)
    if known and name in known.categories:
        found = known.categories[name]
    else:
        values = df.select(text.alias("value")).filter("value is not null").distinct()
        found = [row["value"] for row in values.limit(max_categories + 1).collect()]
    if len(found) > max_categories:
        raise InvalidArgs(f"{name} has more than {max_categories} categories")
    flags = [
        F.coalesce((text == F.lit(v)).cast("int"), F.lit(0)).alias(f"{name}_{v}")
        for v in sorted(found)
    ]
    kept = [ref(c) for c in df.columns if keep or c != name]
    return df.select(*kept, *flags)


def ordinal_encode(df: DataFrame, column: str, output: str | None = None, **options) -> DataFrame:
    """The rank of each value among the distinct values, from 0."""
    (name,) = require_columns(df, [column])
    codes = distinct_ranks(df, name, **options)
    codes = codes.select(F.col("value").alias(name), F.col("code").alias(output or f"{name}_code"))
    return lookup_join(df, codes, name).select(*[ref(c) for c in df.columns], ref(output or f"{name}_code"))


def date_parts(df: DataFrame, column: str, parts: Sequence[str] = ("year", "month", "day")) -> DataFrame:
    """Columns ``<column>_year`` and so on."""
    (name,) = require_columns(df, [column])
    return df.withColumns({f"{name}_{p}": DATE_PARTS[p](ref(name)) for p in parts})


def cast_column(df: DataFrame, name: str, target: str) -> Column:
    """The column cast to a type name, null where the value does not fit.

    ``timestamp:<layout>`` reads text in a given date-time layout.
    """
    dtype = df.schema[name].dataType
    if target.startswith("timestamp:"):
        text = text_value(name, dtype)
        return to_datetime(text, target.split(":", 1)[1], digit_shape(text))
    if isinstance(dtype, T.StringType):
        if target in ("double", "float"):
            return to_number(ref(name)).cast(target)
        if target in ("int", "integer", "long", "bigint", "short", "smallint"):
            return F.when(strip(ref(name)).rlike(r"^[+-]?[0-9]+$"), strip(ref(name)).try_cast(target))
        return strip(ref(name)).try_cast(target) if target != "string" else ref(name)
    if target == "string":
        return text_value(name, dtype)
    return ref(name).try_cast(target)


def cast_types(df: DataFrame, spec: Mapping[str, str]) -> DataFrame:
    """Cast columns; values that do not fit become null."""
    names = dict(zip(require_columns(df, list(spec)), spec.values()))
    return df.withColumns({c: cast_column(df, c, target) for c, target in names.items()})


def cast_failures(df: DataFrame, spec: Mapping[str, str]) -> DataFrame:
    """How many present values each cast would lose, as quality metrics."""
    names = dict(zip(require_columns(df, list(spec)), spec.values()))
    lost = [
        F.count_if(present_col(df, c).isNotNull() & cast_column(df, c, target).isNull()).alias(f"n{i}")
        for i, (c, target) in enumerate(names.items())
    ]
    return long_rows(df.agg(*lost), [
        {"column_name": sql_string(c), "metric": "'cast_failed'", "value": f"cast(n{i} as double)"}
        for i, c in enumerate(names)
    ])


def scale(
    df: DataFrame, columns: Sequence[str], how: str = "standard", suffix: str = "", known: Statistics | None = None
) -> DataFrame:
    """Standard (mean 0, sample deviation 1) or min-max scaling.

    A column without spread becomes 0.0. ``suffix`` keeps the original column.
    """
    names = require_columns(df, columns)
    told = known.moments if known else {}
    found = {**moments(df, [c for c in names if c not in told]), **told}
    scaled = {}
    for name in names:
        m = found[name]
        if how == "standard":
            shift, width = m["mean"], m["std"]
        elif how == "minmax":
            shift, width = m["min"], (None if m["count"] == 0 else m["max"] - m["min"])
        else:
            raise InvalidArgs(f"unknown scaling: {how}")
        value = number_col(df, name)
        flat = F.when(value.isNotNull(), F.lit(0.0))
        scaled[f"{name}{suffix}"] = (value - F.lit(shift)) / F.lit(width) if width else flat
    return df.withColumns(scaled)


def safe_strings(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns as text, with the empty string for null."""
    return df.withColumns({c: safe_string(ref(c)) for c in require_columns(df, columns)})


def mapping_table(df: DataFrame, mapping: DataFrame | Mapping) -> DataFrame:
    """(key, mapped) with each key once; a table gives its first two columns.

    A key that is listed with different values raises.
    """
    if isinstance(mapping, DataFrame):
        key, value = mapping.schema.fields[:2]
        table = (
            mapping.select(canonical_value(key.name, key.dataType).alias("key"), ref(value.name).alias("mapped"))
            .filter("key is not null")
            .distinct()
        )
        twice = table.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy("key").limit(5).collect()
        if twice:
            raise InvalidArgs(f"keys with several values: {[r['key'] for r in twice]}")
        return table
    if not mapping:
        raise InvalidArgs("the mapping is empty")
    rows = [("" if k is None else str(k), v) for k, v in mapping.items()]
    table = df.sparkSession.createDataFrame(rows, ["key", "mapped"])
    return table.select(canonical_col(table, "key").alias("key"), "mapped")


def apply_mapping(
    df: DataFrame,
    column: str,
    mapping: DataFrame | Mapping,
    output: str | None = None,
    strict: bool = True,
    **options,
) -> DataFrame:
    """Look each value up; a value without a mapping is an error, never a default.

    With ``strict=False`` unmapped values stay null, to be judged by
    :func:`mapping_gap_metrics`.
    """
    (name,) = require_columns(df, [column])
    table = mapping_table(df, mapping)
    if strict:
        missing = mapping_coverage(df, name, table.select("key")).filter(F.col("status") == "missing")
        shown = [r["value"] for r in missing.orderBy("value").limit(51).collect()]
        if shown:
            more = " …" if len(shown) > 50 else ""
            raise UnmappedValues(f"{name}: no mapping for {shown[:50]}{more}")
    target = output or f"{name}_mapped"
    keyed = df.withColumn("_key", canonical_col(df, name))
    joined = lookup_join(keyed, table.withColumnRenamed("key", "_key"), "_key", **options)
    return joined.select(*[ref(c) for c in df.columns if c != target], F.col("mapped").alias(target))


def mapping_gap_metrics(df: DataFrame, column: str, mapping: DataFrame | Mapping | Iterable) -> DataFrame:
    """The number of distinct values without a mapping, as a quality metric."""
    (name,) = require_columns(df, [column])
    keys = list(mapping) if isinstance(mapping, Mapping) else mapping
    gaps = mapping_coverage(df, name, keys).agg(F.count_if(F.col("status") == "missing").alias("n"))
    return gaps.select(
        F.lit(name).alias("column_name"),
        F.lit("missing_mapping_count").alias("metric"),
        F.col("n").cast("double").alias("value"),
    )


def image_column_to_path(df: DataFrame, column: str) -> DataFrame:
    """Replace an image struct by its path, so no raw bytes are written out."""
    (name,) = require_columns(df, [column])
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.StructType) and "path" in dtype.names:
        return df.withColumn(name, ref(name).getField("path"))
    if isinstance(dtype, T.BinaryType):
        return df.drop(name)
    return df


def summary_table(df: DataFrame, by: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Rows, and count, sum, mean, minimum and maximum of the measures per group."""
    keys, names = require_columns(df, by), require_columns(df, measures)
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for name in names:
        value = number_col(df, name)
        aggregates += [
            F.count(value).alias(f"{name}_count"),
            F.sum(value).alias(f"{name}_sum"),
            F.avg(value).alias(f"{name}_mean"),
            F.min(value).alias(f"{name}_min"),
            F.max(value).alias(f"{name}_max"),
        ]
    return df.groupBy(*[ref(k) for k in keys]).agg(*aggregates)
