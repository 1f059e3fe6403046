"""Lookup joins that hold up when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.values import ref
from ..session import cut_lineage

# A lookup table is broadcast only up to this many rows and bytes.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 * 1024 * 1024
# Beyond that, the rows of a key are spread over a partition for each so many.
HOT_KEY_ROWS = 1_000_000
# Rows without a key match nothing; they are spread over this many places.
NULL_SALTS = 1 << 20
# A key counts as hot only if it has this share of the rows, so there are at
# most as many hot keys as this share goes into one: a bound for their broadcast.
HOT_SHARE = 1e-5


def fits_broadcast(table: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a table is small, found by reading at most ``rows`` + 1 rows."""
    widths = [F.lit(16 * len(table.columns)).cast("long")]
    for field in table.schema.fields:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            widths.append(F.coalesce(F.octet_length(ref(field.name)), F.lit(0)).cast("long"))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            widths.append(F.coalesce(F.length(F.to_json(F.struct(ref(field.name)))), F.lit(0)).cast("long"))
    width = widths[0]
    for other in widths[1:]:
        width = width + other
    row = table.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(width).alias("bytes")).first()
    return row["n"] <= rows and (row["bytes"] or 0) <= size


def lookup_join(
    df: DataFrame,
    table: DataFrame,
    key: str,
    broadcast_rows: int = BROADCAST_ROWS,
    hot_rows: int = HOT_KEY_ROWS,
) -> DataFrame:
    """Left join on ``key`` with a table that holds each key once.

    A small table is broadcast. Otherwise the rows per key are counted, and a
    key with very many is salted by its own number of rows: its rows go to so
    many partitions and its one lookup row is repeated for each. Rows without a
    key are spread as well.
    """
    if fits_broadcast(table, broadcast_rows):
        return df.join(F.broadcast(table), key, "left")
    counts = df.select(ref(key).alias("k")).filter("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("cnt"))
    counts = cut_lineage(counts.filter(F.col("cnt") >= hot_rows))
    least = max(hot_rows, HOT_SHARE * (counts.agg(F.sum("cnt")).first()[0] or 0))
    salts = F.ceil(F.col("cnt") / F.lit(least)).cast("int")
    hot = F.broadcast(counts.filter(F.col("cnt") >= least).select(F.col("k").alias("_hot"), salts.alias("_salts")))
    # The salt depends on the row and its partition alone, so a task that runs
    # again sends each row to the same place.
    hashable = [ref(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    spread = F.xxhash64(F.spark_partition_id(), *hashable)
    every = F.when(ref(key).isNull(), F.lit(NULL_SALTS)).otherwise(F.coalesce("_salts", F.lit(1)))
    left = df.join(hot, ref(key) == F.col("_hot"), "left").withColumn("_salt", F.pmod(spread, every).cast("int"))
    right = table.join(hot, ref(key) == F.col("_hot"), "left")
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
    joined = left.drop("_hot", "_salts").join(right.drop("_hot", "_salts"), [key, "_salt"], "left")
    return joined.drop("_salt")
