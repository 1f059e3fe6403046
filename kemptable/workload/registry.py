"""How a query is registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()

_QUERIES: dict[str, Callable[["Tables"], DataFrame]] = {}
_SQL: dict[str, str] = {}


class Tables:
    """The tables of one scale folder as attributes, and the views on them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            base, columns = VIEWS[name]
            return getattr(self, base).selectExpr(*columns)
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        raise AttributeError(name)


# View name -> (base table, select list valid in Spark and in ANSI SQL).
VIEWS: dict[str, tuple[str, list[str]]] = {
    "events_nulled": ("events", [
        "event_id", "ts", "user_id",
        "case when event_id % 11 = 0 then null else event_type end as event_type",
        "case when event_id % 7 = 0 then null else value end as value",
        "case when event_id % 13 = 0 then '' when event_id % 13 = 1 then '   ' else props end as props",
    ]),
    "lineitem_dirty": ("lineitem", [
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "case when l_linenumber = 7 then null else l_discount end as l_discount",
        "case when l_returnflag = 'N' then 'unknown' else l_returnflag end as l_returnflag",
        "l_shipdate",
    ]),
    "mixed_text": ("events", [
        "event_id",
        "case event_id % 8 when 0 then 'true' when 1 then ' Yes ' when 2 then '42' when 3 then '2024-01-15' "
        "when 4 then '1e5' when 5 then 'abc' when 6 then null else cast(event_id as string) end as raw",
    ]),
    "na_text": ("events", [
        "event_id",
        "case event_id % 5 when 0 then 'NA' when 1 then 'n/a' when 2 then 'null' when 3 then '' else 'x' end as raw",
    ]),
    "trace": ("events", [
        "user_id as run_id", "event_id", "ts", "event_type as node", "event_type <> 'error' as ok",
    ]),
    "registry": ("orders", ["o_orderkey as run_id", "o_orderdate as created_at"]),
}


def with_views(sql: str, *names: str) -> str:
    """SQL text with the named views in front."""
    views = ", ".join(f"{n} as (select {', '.join(VIEWS[n][1])} from {VIEWS[n][0]})" for n in names)
    return f"with {views} {sql}" if not sql.lstrip().startswith(",") else f"with {views}{sql}"


def query(sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a query under its function name, with its SQL if it has one."""

    def register(function: Callable[[Tables], DataFrame]):
        name = function.__name__
        if name in _QUERIES:
            raise ValueError(f"two queries are named {name}")
        _QUERIES[name] = function
        if sql is not None:
            _SQL[name] = with_views(sql, *views) if views else sql
        return function

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(function):
        return lambda spark, folder: function(Tables(spark, folder))

    return {name: bind(function) for name, function in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
