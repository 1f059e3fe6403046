"""Column profiles: types, missing rates, parse rates, quality metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.columns import InvalidArgs, choose_columns, require_columns
from ..functions.values import (
    DATETIME_FORMATS,
    digit_shape,
    is_bool_token,
    present_col,
    present_sql,
    rate,
    rate_sql,
    ref,
    sql_string,
    strip_sql,
    text_sql,
    text_value,
    to_datetime,
    to_number,
)
from .counts import categorical_from_counts, smallest_ceilings, smallest_n_per_column, value_counts_many
from .numeric import summary_stats

DEFAULT_SAMPLES = 20
PARSERS = ("datetime", "numeric", "bool")


def long_rows(wide: DataFrame, rows: Sequence[Mapping[str, str]], keys: Sequence[str] = ()) -> DataFrame:
    """Turn each aggregated row into several; ``rows`` holds SQL per column."""
    structs = [
        "named_struct(" + ", ".join(f"{sql_string(n)}, {text}" for n, text in row.items()) + ")" for row in rows
    ]
    return wide.select(*[ref(k) for k in keys], F.expr(f"inline(array({', '.join(structs)}))"))


def _present_counts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row: ``rows`` and the present values ``n0``, ``n1``, … per column."""
    counts = [F.expr(f"count({present_sql(df, c)}) as n{i}") for i, c in enumerate(names)]
    return df.agg(F.expr("count(1) as rows"), *counts)


def missing_report(df: DataFrame, top: int | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns that miss values, most missing first."""
    names = choose_columns(df, columns)
    report = long_rows(_present_counts(df, names), [
        {
            "column_name": sql_string(c),
            "missing": f"rows - n{i}",
            "missing_rate": rate_sql(f"(rows - n{i})", "rows"),
        }
        for i, c in enumerate(names)
    ])
    report = report.filter(F.col("missing") > 0).orderBy(F.desc("missing"), "column_name")
    return report.limit(top) if top else report


def column_profile(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    max_columns: int | None = None,
    samples: int = DEFAULT_SAMPLES,
) -> DataFrame:
    """Type, row count, missing rate and the smallest distinct values per column.

    One scan gives counts and samples. A look at a few rows bounds the smallest
    values first, so only values below the bound are shuffled; the result is
    exact. ``samples=0`` needs no shuffle of values at all.
    """
    names = choose_columns(df, columns, max_columns)
    types = {c: df.schema[c].dataType.simpleString() for c in names}
    if samples <= 0:
        return long_rows(_present_counts(df, names), [
            {
                "column_name": sql_string(c),
                "dtype": sql_string(types[c]),
                "total": "rows",
                "missing": f"rows - n{i}",
                "missing_rate": rate_sql(f"(rows - n{i})", "rows"),
                "samples": "cast(array() as array<string>)",
            }
            for i, c in enumerate(names)
        ])
    counted = value_counts_many(
        df, names, keep_missing=True, ceilings=smallest_ceilings(df, names, samples)
    )
    return profile_from_counts(df, names, counted, samples)


def profile_from_counts(df: DataFrame, names: Sequence[str], counted: DataFrame, samples: int) -> DataFrame:
    """The profile read from value counts that include the missing rows."""
    known = df.sparkSession.createDataFrame(
        [(c, df.schema[c].dataType.simpleString()) for c in names], "column_name string, dtype string"
    )
    absent = F.col("value").isNull() & F.col("listed")
    totals = counted.groupBy("column_name").agg(
        F.sum("cnt").alias("total"), F.sum(F.when(absent, F.col("cnt")).otherwise(0)).alias("missing")
    )
    # Reading ``cnt`` in this filter keeps both branches on one shuffle.
    listed = counted.filter(F.when(F.col("cnt") > 0, F.col("value")).isNotNull())
    smallest = (
        smallest_n_per_column(listed, samples)
        .groupBy("column_name")
        .agg(F.array_sort(F.collect_list("value")).alias("samples"))  # at most ``samples`` each
    )
    total, missing = F.coalesce("total", F.lit(0)), F.coalesce("missing", F.lit(0))
    return (
        known.join(totals, "column_name", "left")
        .join(smallest, "column_name", "left")
        .select(
            "column_name",
            "dtype",
            total.alias("total"),
            missing.alias("missing"),
            rate(missing, total).alias("missing_rate"),
            F.coalesce("samples", F.array().cast("array<string>")).alias("samples"),
        )
    )


def parse_inputs(df: DataFrame, column: str, tag: str = "") -> list[Column]:
    """Text and digit shape of a column, projected once for all parsers."""
    dtype = df.schema[column].dataType
    text = text_value(column, dtype)
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        shape = F.lit(None).cast("string")
    else:
        shape = digit_shape(text)
    return [text.alias(f"text{tag}"), shape.alias(f"shape{tag}")]


def parse_hits(df: DataFrame, column: str, formats: Sequence[str], tag: str = "") -> list[Column]:
    """Aggregates over :func:`parse_inputs`: value count, then hits per parser."""
    text, shape = F.col(f"text{tag}"), F.col(f"shape{tag}")
    if isinstance(df.schema[column].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        parsed = [text] * len(formats)
    else:
        parsed = [to_datetime(text, f, shape) for f in formats]
    return [
        F.count(text).alias(f"n_values{tag}"),
        F.count(to_number(text)).alias(f"numeric_hits{tag}"),
        F.count_if(is_bool_token(text)).alias(f"bool_hits{tag}"),
        F.greatest(F.lit(0), *[F.count(p) for p in parsed]).alias(f"datetime_hits{tag}"),
    ]


def parseability(
    df: DataFrame,
    column: str,
    parsers: Sequence[str] | None = None,
    max_samples: int | None = None,
    formats: Sequence[str] = DATETIME_FORMATS,
) -> DataFrame:
    """Share of the present values that read as date-time, number or boolean.

    The date-time rate is that of the best single layout, so it does not depend
    on the order of the rows. Rates of parsers that were not chosen are null.
    """
    (name,) = require_columns(df, [column])
    chosen = {p.lower() for p in (PARSERS if parsers is None else parsers) if isinstance(p, str)}
    if not chosen:
        raise InvalidArgs("no parser was named")
    if max_samples:
        df = df.filter(present_col(df, name).isNotNull()).select(ref(name)).limit(max_samples)
    wide = df.select(*parse_inputs(df, name)).agg(*parse_hits(df, name, formats))
    best = F.col("datetime_hits")
    none = F.lit(None).cast("double")
    return wide.select(
        F.lit(name).alias("column_name"),
        "n_values",
        (rate(best, F.col("n_values"), 4) if "datetime" in chosen else none).alias("datetime_rate"),
        (rate(F.col("numeric_hits"), F.col("n_values"), 4) if "numeric" in chosen else none).alias("numeric_rate"),
        (rate(F.col("bool_hits"), F.col("n_values"), 4) if "bool" in chosen else none).alias("bool_rate"),
    )


def parse_samples(df: DataFrame, column: str, n: int = 50) -> DataFrame:
    """The first present values, as text."""
    (name,) = require_columns(df, [column])
    text = text_value(name, df.schema[name].dataType)
    return df.select(text.alias("value")).filter(F.col("value").isNotNull()).limit(n)


def column_quality_metrics(
    df: DataFrame,
    columns: Sequence[str],
    placeholders: Mapping[str, Sequence] | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Missing, empty and placeholder counts as (column_name, metric, value).

    ``by`` splits the metrics by key columns; the counts are combined on the
    map side, so a key that holds most rows is no hot spot.
    """
    aggregates, labels = quality_counts(df, columns, placeholders)
    rows = [
        {"column_name": sql_string(c), "metric": sql_string(metric), "value": f"cast({label} as double)"}
        for label, (c, metric) in labels.items()
    ]
    wide = df.groupBy(*[ref(k) for k in by]).agg(*aggregates) if by else df.agg(*aggregates)
    return long_rows(wide, rows, by)


def quality_counts(
    df: DataFrame, columns: Sequence[str], placeholders: Mapping[str, Sequence] | None = None
) -> tuple[list[Column], dict[str, tuple[str, str]]]:
    """The aggregates of :func:`column_quality_metrics`, and (column, metric) by their names."""
    names, placeholders = require_columns(df, columns), placeholders or {}
    aggregates, labels = [], {}
    for i, c in enumerate(names):
        text = text_sql(c, df.schema[c].dataType)
        tests = {"missing": f"({present_sql(df, c)}) is null", "empty": f"coalesce(({strip_sql(text)}) = '', false)"}
        if c in placeholders:
            given = ", ".join(sql_string(str(p)) for p in placeholders[c])
            tests["placeholder"] = f"coalesce(({text}) in ({given}), false)" if given else "false"
        for metric, test in tests.items():
            aggregates.append(F.expr(f"count_if({test}) as {metric}{i}"))
            labels[f"{metric}{i}"] = (c, metric)
    return aggregates, labels


def describe_all(df: DataFrame, max_columns: int | None = None) -> DataFrame:
    """Every column in one table: numbers get moments, others mode and frequency."""
    names = choose_columns(df, None, max_columns)
    numbers = [c for c in names if isinstance(df.schema[c].dataType, T.NumericType)]
    others = [c for c in names if c not in numbers]
    parts = []
    if numbers:
        stats = summary_stats(df, numbers)
        parts.append(
            stats.select(
                "column_name", F.col("cnt").alias("count"), "mean", "std",
                F.col("min_value").alias("min"), F.col("q1").alias("p25"), F.col("median").alias("p50"),
                F.col("q3").alias("p75"), F.col("max_value").alias("max"),
            )
        )
    if others:
        counted = value_counts_many(df, others)
        totals = counted.groupBy("column_name").agg(F.sum("cnt").alias("count"))  # same shuffle
        top = categorical_from_counts(counted, 1)
        parts.append(
            top.join(totals, "column_name").select(
                "column_name", "count", F.col("nunique").alias("unique"),
                F.col("value").alias("top"), F.col("cnt").alias("freq"),
            )
        )
    if not parts:
        raise InvalidArgs("the table has no column")
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part, allowMissingColumns=True)
    return table
