"""Numeric summaries: moments in one pass, exact quantiles without one big task.

Spark's ``percentile`` keeps every distinct value of a column in a single task.
Here each quantile is bracketed by a fixed-size sketch taken
along with the moments. A second pass counts the rows outside the brackets and
the values inside; the counts show that a bracket holds its rank, which makes
the answer exact.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row, Window, functions as F, types as T

from ..functions.columns import EmptyData, numeric_columns, require_columns
from ..functions.values import any_of, number_col, ref
from ..session import cut_lineage

# Distinct values inside the brackets that one task sorts, about.
PIECE_VALUES = 1_000_000
# Relative rank error of the sketch is about 1 / SKETCH_ACCURACY; brackets are
# this much wider on either side, and widened further should a check fail.
SKETCH_ACCURACY = 10_000
SLACK = 2.0 / SKETCH_ACCURACY
WIDEN = 16

COLUMN_GROUP = 16

QUARTILES = (0.25, 0.5, 0.75)

SUMMARY_SCHEMA = T.StructType([
    T.StructField("column_name", T.StringType()),
    T.StructField("cnt", T.LongType()),
    T.StructField("missing", T.LongType()),
    T.StructField("mean", T.DoubleType()),
    T.StructField("std", T.DoubleType()),
    T.StructField("min_value", T.DoubleType()),
    T.StructField("q1", T.DoubleType()),
    T.StructField("median", T.DoubleType()),
    T.StructField("q3", T.DoubleType()),
    T.StructField("max_value", T.DoubleType()),
    # Whole numbers and decimals as they are: doubles are not exact beyond 2^53.
    T.StructField("min_exact", T.StringType()),
    T.StructField("max_exact", T.StringType()),
])


def moments(df: DataFrame, columns: Sequence[str], points: Mapping[str, Sequence[float]] | None = None) -> dict[str, dict]:
    """Count, missing, mean, sample deviation, minimum and maximum per column.

    One aggregation over the table; the collected row is as wide as the schema
    and holds nothing that grows with the data. ``points`` adds the brackets of
    these quantiles per column, for :func:`quantiles`.
    """
    if not columns:
        return {}
    inputs, aggregates = moment_aggregates(df, columns, points)
    return read_moments(df, columns, df.select(*inputs).agg(F.count(F.lit(1)).alias("rows"), *aggregates).first())


def _is_exact(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.IntegralType, T.DecimalType))


def moment_aggregates(
    df: DataFrame, columns: Sequence[str], points: Mapping[str, Sequence[float]] | None = None
) -> tuple[list[Column], list[Column]]:
    """Input columns and aggregates of :func:`moments`, which may stand beside others in one pass."""
    inputs, aggregates = [], []
    for i, name in enumerate(columns):
        inputs.append(number_col(df, name).alias(f"v{i}"))
        aggregates += [
            F.expr(f"{function}(v{i}) as {label}{i}")
            for label, function in [("n", "count"), ("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")]
        ]
        if _is_exact(df, name):
            inputs.append(ref(name).alias(f"x{i}"))
            aggregates += [F.expr(f"{f}(x{i}) as exact_{f}{i}") for f in ("min", "max")]
        if points and points.get(name):
            aggregates.append(sketch(F.col(f"v{i}"), points[name]).alias(f"cuts{i}"))
    return inputs, aggregates


def read_moments(df: DataFrame, columns: Sequence[str], row: Row) -> dict[str, dict]:
    """Moments by column from the row of their aggregates and of ``rows``."""
    found = {}
    for i, name in enumerate(columns):
        found[name] = {k: row[f"{k}{i}"] for k in ("mean", "std", "min", "max")} | {
            "count": row[f"n{i}"], "missing": row["rows"] - row[f"n{i}"],
            "cuts": row[f"cuts{i}"] if f"cuts{i}" in row else None,
        }
        limits = [row[f"exact_{f}{i}"] if _is_exact(df, name) else None for f in ("min", "max")]
        found[name]["min_exact"], found[name]["max_exact"] = (None if x is None else str(x) for x in limits)
    return found


def _slot(slot: str, v: Column | None = None, s: Column | None = None, g: Column | None = None) -> Column:
    """A row of the long form: a number, or a text with the number it is kept for."""
    parts = {"slot": F.lit(slot), "v": v, "s": s, "g": g}
    kinds = {"slot": "string", "v": "double", "s": "string", "g": "double"}
    return F.struct(*[(F.lit(None) if c is None else c).cast(kinds[k]).alias(k) for k, c in parts.items()])


class ValueCounts:
    """Values of text columns to be counted in one pass: slot -> (text, number).

    ``counted`` has (slot, s, cnt, least, most): how often each text is there
    and the range of the numbers beside it.
    """

    def __init__(self, columns: Mapping[str, tuple[Column, Column | None]]):
        self.columns, self.counted = dict(columns), None

    def slots(self) -> list[Column]:
        return [_slot(f"={name}", s=text, g=number) for name, (text, number) in self.columns.items()]

    def take(self, counted: DataFrame) -> None:
        """Keep the counts of the texts; their slots differ from those of numbers by the first character."""
        self.counted = counted.withColumn("slot", F.expr("substring(slot, 2)")).select("slot", "s", "cnt", "least", "most")

    def count(self, df: DataFrame) -> None:
        """Count now, where no other pass has done it."""
        if self.counted is None and self.columns:
            long = df.select(F.inline(F.array(*self.slots()))).filter("s is not null")
            self.take(cut_lineage(long.groupBy("slot", "s").agg(
                F.count(F.lit(1)).alias("cnt"), F.min("g").alias("least"), F.max("g").alias("most")
            )))


def sketch(value: Column, points: Sequence[float], slack: float = SLACK) -> Column:
    """The values a little before and after each quantile, by a sketch."""
    around = [min(1.0, max(0.0, x)) for p in points for x in (p - slack, p + slack)]
    return F.percentile_approx(value, around, SKETCH_ACCURACY)


def quantiles(
    df: DataFrame,
    wanted: Mapping[str, Sequence[float]],
    known: Mapping[str, dict] | None = None,
    accuracy: int | None = None,
    piece_values: int = PIECE_VALUES,
    texts: ValueCounts | None = None,
) -> dict[tuple[str, float], float | None]:
    """Quantiles with linear interpolation, exact unless ``accuracy`` is given.

    ``known`` may carry the result of :func:`moments` for the same columns and
    points. The moments and one more pass give the answer; the same pass counts
    the values of ``texts``. With ``accuracy`` the answer is
    ``percentile_approx`` in a single pass.
    """
    columns = [c for c in wanted if wanted[c]]
    if not columns:
        return {}
    if accuracy is not None:
        row = df.agg(*[
            F.percentile_approx(number_col(df, c), list(wanted[c]), accuracy).alias(f"q{i}")
            for i, c in enumerate(columns)
        ]).first()
        return _by_point(wanted, {c: row[f"q{i}"] for i, c in enumerate(columns)})
    known = known or moments(df, columns, wanted)
    ranks = {
        (c, rank)
        for c in columns if known[c]["count"]
        for p in wanted[c]
        for rank in _ranks(known[c]["count"], p)
    }
    found: dict[tuple[str, int], float] = {}
    slack, cuts = SLACK, {c: known[c].get("cuts") for c in columns}
    while ranks - set(found):
        open_columns = sorted({c for c, _ in ranks - set(found)})
        unknown = [c for c in open_columns if not cuts[c]]
        if unknown:
            row = df.agg(*[sketch(number_col(df, c), wanted[c], slack).alias(f"q{i}") for i, c in enumerate(unknown)]).first()
            cuts.update({c: row[f"q{i}"] for i, c in enumerate(unknown)})
        # Groups of columns keep the generated code small; on columnar files each
        # group reads its own columns only.
        for first in range(0, len(open_columns), COLUMN_GROUP):
            brackets = {c: _merge(cuts[c]) for c in open_columns[first : first + COLUMN_GROUP]}
            found.update(_read_ranks(df, brackets, ranks - set(found), piece_values, texts))
            texts = None
        slack, cuts = slack * WIDEN, dict.fromkeys(columns)  # only for ranks a bracket missed
    result: dict[tuple[str, float], float | None] = {}
    for name in columns:
        count = known[name]["count"]
        for p in wanted[name]:
            if not count:
                result[(name, p)] = None
                continue
            low_rank, high_rank = _ranks(count, p)
            low, high = found[(name, low_rank)], found[(name, high_rank)]
            share = p * (count - 1) - low_rank
            result[(name, p)] = low if low == high else low + (high - low) * share
    return result


def _by_point(wanted, answers):
    return {(c, p): (values[i] if values is not None else None) for c, values in answers.items() for i, p in enumerate(wanted[c])}


def _ranks(count: int, p: float) -> tuple[int, int]:
    """Zero-based ranks of the two values the quantile lies between."""
    position = p * (count - 1)
    return math.floor(position), math.ceil(position)


def _merge(cuts: Sequence[float]) -> list[tuple[float, float]]:
    """Brackets in ascending order, overlapping ones as one."""
    merged: list[list[float]] = []
    for low, high in sorted(zip(cuts[::2], cuts[1::2])):
        if merged and low <= merged[-1][1]:
            merged[-1][1] = max(high, merged[-1][1])
        else:
            merged.append([low, high])
    return [(low, high) for low, high in merged]


def _read_ranks(
    df: DataFrame, brackets: Mapping[str, list], ranks: set[tuple[str, int]], piece_values: int,
    texts: ValueCounts | None = None,
) -> dict[tuple[str, int], float]:
    """The values at those ranks that lie inside a bracket; one pass over the data.

    The brackets cut the axis of a column into regions: even ones lie between
    brackets and are only counted, odd ones are brackets and counted by value.
    """
    columns = list(brackets)
    if texts is None:
        wide = df.select(*[number_col(df, c).alias(f"c{i}") for i, c in enumerate(columns)])
        long = wide.unpivot([], wide.columns, "slot", "v").filter("v is not null")
    else:
        numbers = [_slot(f"c{i}", v=number_col(df, c)) for i, c in enumerate(columns)]
        long = df.select(F.inline(F.array(*numbers, *texts.slots()))).filter("v is not null or s is not null")
    region = F.lit(None).cast("int")
    for i, name in enumerate(columns):
        place = F.lit(2 * len(brackets[name]))
        for k, (low, high) in reversed(list(enumerate(brackets[name]))):
            place = F.when(F.col("v") < low, 2 * k).when(F.col("v") <= high, 2 * k + 1).otherwise(place)
        region = F.when(F.col("slot") == f"c{i}", place).otherwise(region)
    inside = F.when(F.col("region") % 2 == 1, F.col("v"))
    placed = long.withColumn("region", region)
    if texts is None:
        counted = cut_lineage(placed.groupBy("slot", "region", inside.alias("v")).agg(F.count(F.lit(1)).alias("cnt")))
    else:
        both = placed.groupBy("slot", "region", inside.alias("v"), "s").agg(
            F.count(F.lit(1)).alias("cnt"), F.min("g").alias("least"), F.max("g").alias("most")
        )
        both = cut_lineage(both)
        texts.take(both.filter("region is null"))
        counted = both.filter("region is not null").select("slot", "region", "v", "cnt")
    totals = {
        (r["slot"], r["region"]): (r["rows"], r["distinct"])
        for r in counted.groupBy("slot", "region")
        .agg(F.sum("cnt").alias("rows"), F.count(F.lit(1)).alias("distinct"))
        .collect()  # one row per region
    }
    found: dict[tuple[str, int], float] = {}
    sought: dict[tuple[str, int], dict[int, tuple[str, int]]] = {}
    for i, name in enumerate(columns):
        start = 0
        for k in range(2 * len(brackets[name]) + 1):
            rows, _ = totals.get((f"c{i}", k), (0, 0))
            for rank in (r for c, r in ranks if c == name and start <= r < start + rows and k % 2 == 1):
                low, high = brackets[name][k // 2]
                if low == high:  # one value fills the bracket
                    found[(name, rank)] = low
                else:
                    sought.setdefault((f"c{i}", k), {})[rank - start] = (name, rank)
            start += rows
    if sought:
        held = sum(totals[key][1] for key in sought)
        found.update(_select(counted, sought, max(1, math.ceil(held / piece_values))))
    return found


def _select(counted: DataFrame, sought: Mapping, pieces: int) -> dict[tuple[str, int], float]:
    """The values at given places of regions, from counts by value.

    The values are range-partitioned first and the sizes of the pieces tell
    which one holds a place, so no task sorts a whole region.
    """
    mine = counted.filter(any_of([(F.col("slot") == s) & (F.col("region") == r) for s, r in sought]))
    before: dict[tuple, int] = {}
    mine = cut_lineage(
        mine.repartitionByRange(pieces, "slot", "region", "v").withColumn("piece", F.spark_partition_id())
    )
    sizes = mine.groupBy("slot", "region", "piece").agg(F.sum("cnt").alias("rows")).collect()  # pieces + regions
    start: dict[tuple, int] = {}
    ends: dict[tuple, int] = {}
    for r in sorted(sizes, key=lambda r: r["piece"]):
        key = (r["slot"], r["region"])
        before[(*key, r["piece"])] = start.get(key, 0)
        start[key] = ends[(*key, r["piece"])] = start.get(key, 0) + r["rows"]
    picks = {
        (slot, region, piece, place - first): target
        for (slot, region, piece), first in before.items()
        for place, target in sought[(slot, region)].items()
        if first <= place < ends[(slot, region, piece)]
    }
    order = Window.partitionBy("slot", "region", "piece").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    wanted = [
        (F.col("slot") == s) & (F.col("region") == r) & (F.col("piece") == p)
        & (F.col("upto") - F.col("cnt") <= place) & (F.col("upto") > place)
        for s, r, p, place in picks
    ]
    pieces_hit = any_of([(F.col("slot") == s) & (F.col("region") == r) & (F.col("piece") == p) for s, r, p, _ in picks])
    rows = (
        mine.filter(pieces_hit)
        .withColumn("upto", F.sum("cnt").over(order))
        .filter(any_of(wanted))
        .collect()  # at most one row per wanted rank
    )
    return {
        target: row["v"]
        for (slot, region, piece, place), target in picks.items()
        for row in rows
        if (row["slot"], row["region"], row["piece"]) == (slot, region, piece)
        and row["upto"] - row["cnt"] <= place < row["upto"]
    }


def summary_stats(df: DataFrame, columns: Sequence[str] | None = None, accuracy: int | None = None) -> DataFrame:
    """One row per numeric column; text columns that are named are coerced."""
    names = require_columns(df, columns) if columns else numeric_columns(df)
    if not names:
        raise EmptyData("the table has no numeric column")
    points = {c: QUARTILES for c in names}
    known = moments(df, names, None if accuracy else points)
    return summary_rows(df, names, known, quantiles(df, points, known=known, accuracy=accuracy))


def summary_rows(df: DataFrame, names: Sequence[str], known: Mapping[str, dict], cuts: Mapping) -> DataFrame:
    """The summary table from moments and quantiles, one row per column."""
    rows = [
        (
            c,
            known[c]["count"],
            known[c]["missing"],
            known[c]["mean"],
            known[c]["std"],
            known[c]["min"],
            cuts[(c, 0.25)],
            cuts[(c, 0.5)],
            cuts[(c, 0.75)],
            known[c]["max"],
            known[c]["min_exact"],
            known[c]["max_exact"],
        )
        for c in names
    ]
    table = df.sparkSession.createDataFrame(rows, SUMMARY_SCHEMA)
    return table.withColumn("std", F.round("std", 6))


def describe_numeric(df: DataFrame) -> DataFrame:
    """Count, mean, deviation and the five-number summary of numeric columns."""
    stats = summary_stats(df)
    return stats.select(
        "column_name",
        F.col("cnt").alias("count"),
        "mean",
        "std",
        F.col("min_value").alias("min"),
        F.col("q1").alias("p25"),
        F.col("median").alias("p50"),
        F.col("q3").alias("p75"),
        F.col("max_value").alias("max"),
    )
