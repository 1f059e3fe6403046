"""Operators that compare a row with the one before it, per key.

A window over a key puts all its rows into one task. Here the rows are
range-partitioned by the key and all order columns, so that the segments are
alike in size whatever the keys and the ties of the first column. Each
segment is numbered on its own. A key that goes on from one segment into the
next is the first key there, so one carry row per segment brings in its last
value and its row count from the segments before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import require_columns
from ..functions.values import present_col, ref
from ..session import cut_lineage


def _partitions(df: DataFrame, pieces: int | None) -> int:
    return pieces or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _carries(cut: DataFrame, key: Column, order: Column, kept: Column) -> DataFrame:
    """(_segment, _first, _offset, _carried): what earlier segments hold of each segment's first key.

    Two rows per segment meet in the window at the end, however many rows or
    keys the table has.
    """
    ends = cut_lineage(
        cut.groupBy("_segment").agg(
            F.min(key).alias("_first"), F.max(key).alias("_last"), F.max_by(kept, F.struct(key, order)).alias("_kept")
        )
    )
    is_last = key.eqNullSafe(F.col("_last"))
    sizes = cut.join(F.broadcast(ends.select("_segment", "_last")), "_segment").filter(is_last)
    sizes = sizes.groupBy("_segment").agg(F.count(F.lit(1)).alias("_n"))
    firsts = ends.select("_segment", F.col("_first").alias("_key"), F.lit(0).alias("_end"))
    lasts = ends.join(sizes, "_segment").select(
        "_segment", F.col("_last").alias("_key"), F.lit(1).alias("_end"), "_n", F.struct("_kept").alias("_kept")
    )
    both = firsts.unionByName(lasts, allowMissingColumns=True)
    before = Window.partitionBy("_key").orderBy("_segment", "_end").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.select(
        "_segment", F.col("_key").alias("_first"), "_end",
        F.sum("_n").over(before).alias("_offset"),
        F.last("_kept", ignorenulls=True).over(before).getField("_kept").alias("_carried"),
    )
    return carried.filter((F.col("_end") == 0) & F.col("_offset").isNotNull()).drop("_end")


def segments(df: DataFrame, keys: Sequence[str], order: Sequence[str], pieces: int | None = None) -> DataFrame:
    """The rows with ``_segment``, the number of their range of (keys, order); written, so that it can not change."""
    names = [ref(c) for c in dict.fromkeys([*keys, *order])]
    return cut_lineage(
        df.repartitionByRange(_partitions(df, pieces), *names).withColumn("_segment", F.spark_partition_id())
    )


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Sequence[str],
    pieces: int | None = None,
) -> DataFrame:
    """Add ``step`` (1, 2, … per key) and ``prev``, a struct of earlier values.

    ``prev`` is null on the first row of a key. ``order`` must be unique within
    a key for the answer to be the same every time. The table is read twice,
    for the bounds of the ``pieces`` segments (as many as shuffle partitions by
    default) and for its rows, which are written once in their segments.
    """
    require_columns(df, [*keys, *order, *values])
    pieces = _partitions(df, pieces)
    kept = F.struct(*[ref(v).alias(v) for v in values])
    key = F.struct(*[ref(k).alias(f"k{i}") for i, k in enumerate(keys)])
    cut = segments(df, keys, order, pieces)
    carries = _carries(cut, key, F.struct(*[ref(o) for o in order]), kept)
    # The rows of a segment stay together, and the window needs no other exchange.
    window = Window.partitionBy("_segment", *[ref(k) for k in keys]).orderBy(*[ref(o) for o in order])
    placed = cut.repartitionById(pieces, F.col("_segment")).select(
        *[ref(c) for c in df.columns], "_segment",
        F.row_number().over(window).alias("_place"), F.lag(kept).over(window).alias("_lag"),
    )
    # One row per segment at most.
    joined = placed.join(F.broadcast(carries), "_segment", "left")
    goes_on = F.col("_offset").isNotNull() & key.eqNullSafe(F.col("_first"))
    return joined.select(
        *[ref(c) for c in df.columns],
        (F.col("_place") + F.when(goes_on, F.col("_offset")).otherwise(0)).cast("long").alias("step"),
        F.when(goes_on & (F.col("_place") == 1), F.col("_carried")).otherwise(F.col("_lag")).alias("prev"),
    )


def number_steps(df: DataFrame, keys: Sequence[str], order: Sequence[str], **options) -> DataFrame:
    """Rows with their position within the key."""
    return with_previous(df, keys, order, [order[0]], **options).drop("prev")


def changes_only(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, **options) -> DataFrame:
    """The rows whose value differs from the previous row of the same key.

    The first row of a key is kept unless its value is null.
    """
    marked = with_previous(df, keys, order, [value], **options)
    # Before the first row nothing was emitted, which compares like a null.
    changed = ~ref(value).eqNullSafe(F.col("prev").getField(value))
    return marked.filter(changed).select(*[ref(c) for c in df.columns])


def verdict_transitions(
    trace: DataFrame, run: str, order: Sequence[str], ok: str = "ok", **options
) -> DataFrame:
    """Consecutive verdicts of a run that differ, with the step number."""
    marked = with_previous(trace, [run], order, [ok], **options)
    before = F.col("prev").getField(ok)
    return marked.filter((F.col("step") > 1) & ~ref(ok).eqNullSafe(before)).select(
        ref(run), *[ref(o) for o in order], "step", before.alias("prev_ok"), ref(ok).alias("ok")
    )


def distinct_ranks(df: DataFrame, column: str, pieces: int | None = None) -> DataFrame:
    """(value, code): the distinct present values numbered from 0 in order.

    The distinct values are range-partitioned and sorted, each is numbered
    within its partition, and the sizes of the partitions before it are added.
    The numbered values are written once, so a number can not change when a
    task runs again.
    """
    (name,) = require_columns(df, [column])
    pieces = _partitions(df, pieces)
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    values = df.select(present_col(df, name).alias("value")).filter("value is not null").distinct()
    placed = cut_lineage(
        values.repartitionByRange(pieces, "value")
        .sortWithinPartitions("value")
        .select("value", F.spark_partition_id().alias("piece"), inside.alias("place"))
    )
    sizes = placed.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))  # one row per partition
    before = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    return placed.join(F.broadcast(shifts), "piece").select(
        "value", (F.col("place") + F.col("shift")).cast("long").alias("code")
    )
