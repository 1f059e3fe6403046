"""Value counts and everything read from them.

A column is reduced to (value, count) first; Spark combines on the map side, so
a value that holds most of the rows costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import InvalidArgs, choose_columns, other_columns, require_columns
from ..functions.values import canonical_col, canonical_value, ref

DEFAULT_TOP_K = 20
DEFAULT_RARE_THRESHOLD = 3

# Tags in front of values while several columns are counted together.
MISSING, LISTED, OTHERS = "0", "1", "2"
# The most cells read to find a bound for the smallest values.
MOST_HEAD_CELLS = 50_000


def value_counts(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """(value, cnt) for the present values of one column."""
    (name,) = require_columns(df, [column])
    return (
        df.select(canonical_col(df, name, limit).alias("value"))
        .filter(F.col("value").isNotNull())
        .groupBy("value")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def value_counts_many(
    df: DataFrame,
    columns: Sequence[str],
    limit: int | None = None,
    keep_missing: bool = False,
    ceilings: Mapping[str, str] | None = None,
) -> DataFrame:
    """(column_name, value, cnt, listed) for several columns from one scan.

    Values are counted before they are shuffled. With ``keep_missing`` the rows
    without a value are counted under a null value. ``ceilings`` gives columns
    of which only the values up to a bound are wanted one by one: all larger
    ones are counted together, as a null value that is not ``listed``, and so
    never shuffled.
    """
    names, ceilings = require_columns(df, columns), ceilings or {}
    # Texts are made in a projection of their own: the tags read them twice.
    texts = df.select(*[canonical_col(df, c, limit).alias(f"c{i}") for i, c in enumerate(names)])
    wide = texts.select(*[
        tagged_value(F.col(f"c{i}"), keep_missing, ceilings.get(c)).alias(f"c{i}") for i, c in enumerate(names)
    ])
    long = wide.unpivot([], wide.columns, "slot", "tagged").filter(F.col("tagged").isNotNull())
    return read_tags(long.groupBy("slot", "tagged").agg(F.count(F.lit(1)).alias("cnt")), names)


def tagged_value(value: Column, keep_missing: bool = False, ceiling: str | None = None) -> Column:
    """A value's text behind a tag that tells it from a missing one and from those above the ceiling."""
    tagged = F.concat(F.lit(LISTED), value)
    if ceiling is not None:
        tagged = F.when(value > F.lit(ceiling), F.lit(OTHERS)).otherwise(tagged)
    return F.coalesce(tagged, F.lit(MISSING)) if keep_missing else tagged


def read_tags(counted: DataFrame, names: Sequence[str]) -> DataFrame:
    """(column_name, value, cnt, listed) from counts of tagged values; slot ``c0`` is the first name."""
    pairs = [x for i, c in enumerate(names) for x in (F.lit(f"c{i}"), F.lit(c))]
    return counted.select(
        F.element_at(F.create_map(*pairs), F.col("slot")).alias("column_name"),
        F.when(F.col("tagged").startswith(LISTED), F.expr("substring(tagged, 2)")).alias("value"),
        "cnt",
        (F.col("tagged") != OTHERS).alias("listed"),
    )


def smallest_ceilings(df: DataFrame, columns: Sequence[str], n: int, limit: int | None = None) -> dict[str, str]:
    """Per column a bound below which its ``n`` smallest values surely lie.

    The n-th smallest value of any few rows is such a bound. The rows read here
    are limited by cells, whatever the size of the table.
    """
    rows = max(4 * n, MOST_HEAD_CELLS // max(1, len(columns)))
    head = df.select(*[canonical_col(df, c, limit).alias(f"c{i}") for i, c in enumerate(columns)]).limit(rows).collect()
    found = {}
    for i, name in enumerate(columns):
        values = sorted({row[i] for row in head if row[i] is not None})
        if len(values) >= n:
            found[name] = values[n - 1]
    return found


def unique_values(
    df: DataFrame,
    column: str,
    max_unique: int | None = None,
    max_values_return: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Distinct present values in ascending order."""
    values = value_counts(df, column, limit).select("value").orderBy("value")
    cuts = [n for n in (max_unique, max_values_return) if n]
    return values.limit(min(cuts)) if cuts else values


def unique_count(
    df: DataFrame, column: str, rsd: float | None = None, limit: int | None = None
) -> DataFrame:
    """One row: rows scanned, distinct values, missing rows.

    ``rsd`` switches to a sketch of fixed size with that relative error.
    """
    (name,) = require_columns(df, [column])
    value = canonical_col(df, name, limit)
    if rsd:
        distinct = F.approx_count_distinct(value, rsd)
        return df.agg(
            F.count(F.lit(1)).alias("rows_scanned"),
            distinct.alias("unique_count"),
            F.count_if(value.isNull()).alias("missing"),
        )
    counted = df.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("cnt"))
    return counted.agg(
        F.coalesce(F.sum("cnt"), F.lit(0)).alias("rows_scanned"),
        F.count("value").alias("unique_count"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("cnt"))), F.lit(0)).alias("missing"),
    )


def rare_values(
    df: DataFrame,
    column: str,
    rare_threshold: int = DEFAULT_RARE_THRESHOLD,
    max_values_return: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Values seen at most ``rare_threshold`` times, rarest first."""
    rare = value_counts(df, column, limit).filter(F.col("cnt") <= rare_threshold).orderBy("cnt", "value")
    return rare.limit(max_values_return) if max_values_return else rare


def top_k_or_default(top_k: object) -> int:
    """The wanted number of values; anything unusable means the default."""
    try:
        number = int(top_k)  # type: ignore[call-overload]
    except (TypeError, ValueError):
        return DEFAULT_TOP_K
    return number if number > 0 else DEFAULT_TOP_K


def value_counts_topk(
    df: DataFrame, column: str, top_k: int = DEFAULT_TOP_K, limit: int | None = None
) -> DataFrame:
    """The most frequent values with their share of the present rows."""
    counted = value_counts(df, column, limit)
    total = counted.agg(F.sum("cnt")).scalar()
    top = counted.orderBy(F.desc("cnt"), "value").limit(top_k_or_default(top_k))
    return top.select("value", "cnt", F.round(F.col("cnt") / total, 6).alias("ratio"))


def top_n_per_column(counted: DataFrame, n: int) -> DataFrame:
    """The ``n`` most frequent values of each column, ranked.

    Spark limits each partition to ``n`` rows per column before the shuffle.
    """
    order = Window.partitionBy("column_name").orderBy(F.desc("cnt"), "value")
    return counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def smallest_n_per_column(counted: DataFrame, n: int) -> DataFrame:
    """The ``n`` smallest values of each column."""
    order = Window.partitionBy("column_name").orderBy("value")
    return counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def categorical_summary(
    df: DataFrame, columns: Sequence[str] | None = None, top: int = 3, max_columns: int | None = None
) -> DataFrame:
    """Distinct count and the most frequent values of the non-numeric columns."""
    names = choose_columns(df, columns) if columns else other_columns(df, max_columns)
    if not names:
        return df.sparkSession.createDataFrame(
            [], "column_name string, nunique long, value string, cnt long, rank int"
        )
    return categorical_from_counts(value_counts_many(df, names), top)


def categorical_from_counts(counted: DataFrame, top: int) -> DataFrame:
    """Distinct count, total and the ranked top values of each counted column.

    Both branches read ``cnt`` and so share one shuffle of the value counts.
    """
    distinct = counted.groupBy("column_name").agg(F.count_if(F.col("cnt") > 0).alias("nunique"))
    return (
        top_n_per_column(counted, top)
        .join(distinct, "column_name")  # one row per column on this side
        .select("column_name", "nunique", "value", "cnt", "rank")
    )


def mapping_keys(df: DataFrame, keys: DataFrame | Iterable) -> DataFrame:
    """Distinct canonical mapping keys as a one-column table ``value``.

    Keys come as a collection or as a table whose first column holds them.
    """
    if isinstance(keys, DataFrame):
        field = keys.schema.fields[0]
        text = canonical_value(field.name, field.dataType)
        return keys.select(text.alias("value")).filter(F.col("value").isNotNull()).distinct()
    listed = list(keys or [])
    if not listed:
        raise InvalidArgs("mapping keys are empty")
    rows = [("" if k is None else str(k),) for k in listed]
    table = df.sparkSession.createDataFrame(rows, "value string")
    return table.select(canonical_col(table, "value").alias("value")).distinct()


def mapping_coverage(df: DataFrame, column: str, keys: DataFrame | Iterable) -> DataFrame:
    """Each distinct value and key with its status: ok, missing or extra.

    ``missing`` values occur in the data only, ``extra`` keys in the mapping
    only. Both sides are distinct before they meet.
    """
    seen = value_counts(df, column).select("value", F.lit(True).alias("in_data"))
    known = mapping_keys(df, keys).select("value", F.lit(True).alias("in_mapping"))
    return seen.join(known, "value", "full_outer").select(
        "value",
        F.when(F.col("in_data") & F.col("in_mapping"), "ok")
        .when(F.col("in_data"), "missing")
        .otherwise("extra")
        .alias("status"),
    )


def mapping_coverage_counts(df: DataFrame, column: str, keys: DataFrame | Iterable) -> DataFrame:
    """One row: distinct values, mapping keys, missing values, extra keys."""
    status = F.col("status")
    return mapping_coverage(df, column, keys).agg(
        F.count_if(status != "extra").alias("unique_count"),
        F.count_if(status != "missing").alias("mapping_key_count"),
        F.count_if(status == "missing").alias("missing_in_mapping_count"),
        F.count_if(status == "extra").alias("extra_mapping_keys_count"),
    )
