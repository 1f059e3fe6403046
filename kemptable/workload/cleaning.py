"""Cleaning queries: one per transform, and recipes."""

from pyspark.sql import functions as F

from ..operators import transforms
from ..plans.recipe import run_recipe
from ..sources.text import null_tokens
from .registry import query

STATUS = {"F": "finished", "O": "open"}


@query(
    "select l_orderkey, l_linenumber, round(coalesce(l_discount, (select avg(l_discount) from lineitem_dirty)), 6) "
    "as l_discount from lineitem_dirty",
    ("lineitem_dirty",),
)
def fill_mean_discount(t):
    filled = transforms.fill_missing(t.lineitem_dirty, {"l_discount": "mean"})
    return filled.select("l_orderkey", "l_linenumber", F.round("l_discount", 6).alias("l_discount"))


@query(
    "select event_id, round(coalesce(value, (select quantile_cont(value, 0.5) from events_nulled)), 6) as value, "
    "coalesce(event_type, (select event_type from events_nulled where event_type is not null group by 1 "
    "order by count(*) desc, event_type limit 1)) as event_type, coalesce(props, 'none') as props from events_nulled",
    ("events_nulled",),
)
def fill_median_mode_const(t):
    rules = {"value": "median", "event_type": "mode", "props": ("const", "none")}
    filled = transforms.fill_missing(t.events_nulled, rules)
    return filled.select("event_id", F.round("value", 6).alias("value"), "event_type", "props")


@query("select event_id, event_type, value from events_nulled where event_type is not null and value is not null", ("events_nulled",))
def drop_missing_events(t):
    return transforms.drop_missing_rows(t.events_nulled, ["event_type", "value"]).select("event_id", "event_type", "value")


@query(
    "select l_orderkey, l_linenumber, l_extendedprice from lineitem where l_extendedprice <= "
    "(select quantile_cont(l_extendedprice, 0.99) from lineitem)"
)
def outlier_price_p99(t):
    kept = transforms.remove_outliers(t.lineitem, "l_extendedprice", 0.99)
    return kept.select("l_orderkey", "l_linenumber", "l_extendedprice")


@query(
    "with q as (select quantile_cont(o_totalprice, 0.05) as lo, quantile_cont(o_totalprice, 0.95) as hi from orders) "
    "select o_orderkey, round(least(greatest(o_totalprice, lo), hi), 4) as o_totalprice from orders, q"
)
def clipped_totalprice(t):
    clipped = transforms.remove_outliers(t.orders, "o_totalprice", 0.95, 0.05, clip=True)
    return clipped.select("o_orderkey", F.round("o_totalprice", 4).alias("o_totalprice"))


@query(
    "select l_orderkey, l_linenumber, "
    + ", ".join(f"cast(l_returnflag = '{v}' as int) as \"l_returnflag_{v}\"" for v in "ANR")
    + " from lineitem"
)
def one_hot_returnflag(t):
    return transforms.one_hot(t.lineitem, "l_returnflag").select(
        "l_orderkey", "l_linenumber", *[f"l_returnflag_{v}" for v in "ANR"]
    )


@query(
    "select o_orderkey, o_orderpriority, dense_rank() over (order by o_orderpriority) - 1 as o_orderpriority_code "
    "from orders"
)
def ordinal_priority(t):
    return transforms.ordinal_encode(t.orders, "o_orderpriority").select(
        "o_orderkey", "o_orderpriority", "o_orderpriority_code"
    )


@query("select l_orderkey, l_linenumber, dense_rank() over (order by l_partkey) - 1 as l_partkey_code from lineitem")
def ordinal_partkey_pieces(t):
    """Ranks of many distinct values, in more pieces than there are cores."""
    coded = transforms.ordinal_encode(t.lineitem, "l_partkey", pieces=16)
    return coded.select("l_orderkey", "l_linenumber", "l_partkey_code")


@query(
    "select cast(year(l_shipdate) as int) as l_shipdate_year, cast(month(l_shipdate) as int) as l_shipdate_month, "
    "cast(day(l_shipdate) as int) as l_shipdate_day, count(*) as cnt from lineitem group by 1, 2, 3"
)
def date_parts_shipdate(t):
    parts = [f"l_shipdate_{p}" for p in ("year", "month", "day")]
    return transforms.date_parts(t.lineitem, "l_shipdate").groupBy(*parts).agg(F.count(F.lit(1)).alias("cnt"))


NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


@query(
    f"select event_id, case when regexp_matches(trim(raw), '{NUMBER}') then try_cast(trim(raw) as double) end as raw "
    "from mixed_text",
    ("mixed_text",),
)
def cast_mixed_text(t):
    return transforms.cast_types(t.mixed_text, {"raw": "double"})


@query(
    "select 'raw' as column_name, 'cast_failed' as metric, cast(count(*) filter (where raw is not null and not "
    f"regexp_matches(trim(raw), '{NUMBER}')) as double) as value from mixed_text",
    ("mixed_text",),
)
def cast_failures_text(t):
    return transforms.cast_failures(t.mixed_text, {"raw": "double"})


@query(
    "select o_orderkey, round((o_totalprice - (select avg(o_totalprice) from orders)) / "
    "(select stddev_samp(o_totalprice) from orders), 6) as o_totalprice from orders"
)
def scale_standard_totalprice(t):
    return transforms.scale(t.orders, ["o_totalprice"]).select("o_orderkey", F.round("o_totalprice", 6).alias("o_totalprice"))


@query(
    "select s_suppkey, round((s_acctbal - (select min(s_acctbal) from supplier)) / (select max(s_acctbal) - "
    "min(s_acctbal) from supplier), 6) as s_acctbal_scaled from supplier"
)
def scale_minmax_acctbal(t):
    scaled = transforms.scale(t.supplier, ["s_acctbal"], "minmax", suffix="_scaled")
    return scaled.select("s_suppkey", F.round("s_acctbal_scaled", 6).alias("s_acctbal_scaled"))


@query("select event_id, coalesce(event_type, '') as event_type, cast(user_id as varchar) as user_id from events_nulled", ("events_nulled",))
def safe_event_strings(t):
    return transforms.safe_strings(t.events_nulled, ["event_type", "user_id"]).select("event_id", "event_type", "user_id")


@query(
    "select o_orderkey, o_orderstatus, case o_orderstatus when 'F' then 'finished' when 'O' then 'open' end "
    "as status_name from orders"
)
def apply_mapping_status(t):
    """P has no mapping: it stays null and shows up in the mapping metrics."""
    mapped = transforms.apply_mapping(t.orders, "o_orderstatus", STATUS, output="status_name", strict=False)
    return mapped.select("o_orderkey", "o_orderstatus", "status_name")


@query(
    "select l_orderkey, l_linenumber, p_name as part_name from lineitem left join part on l_partkey = p_partkey"
)
def apply_mapping_parts(t):
    names = t.part.select("p_partkey", "p_name")
    mapped = transforms.apply_mapping(t.lineitem, "l_partkey", names, output="part_name")
    return mapped.select("l_orderkey", "l_linenumber", "part_name")


@query(
    "select l_orderkey, l_linenumber, s_name as supplier_name from lineitem left join supplier on l_suppkey = s_suppkey"
)
def apply_mapping_salted(t):
    """The lookup by the path big mappings take, every key counted as hot."""
    names = t.supplier.select("s_suppkey", "s_name")
    mapped = transforms.apply_mapping(
        t.lineitem, "l_suppkey", names, output="supplier_name", broadcast_rows=1, hot_rows=1
    )
    return mapped.select("l_orderkey", "l_linenumber", "supplier_name")


@query(
    "select 'o_orderstatus' as column_name, 'missing_mapping_count' as metric, "
    "cast(count(distinct o_orderstatus) as double) as value from orders where o_orderstatus not in ('F', 'O')"
)
def mapping_gap_status(t):
    return transforms.mapping_gap_metrics(t.orders, "o_orderstatus", STATUS)


@query(
    "select c_mktsegment, count(*) as rows, count(c_acctbal) as c_acctbal_count, round(sum(c_acctbal), 2) as c_acctbal_sum, "
    "round(avg(c_acctbal), 4) as c_acctbal_mean, min(c_acctbal) as c_acctbal_min, max(c_acctbal) as c_acctbal_max "
    "from customer group by 1"
)
def summary_by_segment(t):
    table = transforms.summary_table(t.customer, ["c_mktsegment"], ["c_acctbal"])
    return table.withColumns({"c_acctbal_sum": F.round("c_acctbal_sum", 2), "c_acctbal_mean": F.round("c_acctbal_mean", 4)})


NA_LIST = (
    "('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', 'N/A', "
    "'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null')"
)


@query(f"select event_id, case when raw not in {NA_LIST} then raw end as raw from na_text", ("na_text",))
def null_tokens_text(t):
    return null_tokens(t.na_text)


RECIPE = [
    {"op": "rename", "args": {"columns": {"l_extendedprice": "price"}}},
    {"op": "fill_missing", "args": {"rules": {"l_discount": "mean"}}},
    {"op": "remove_outliers", "args": {"column": "price", "upper_quantile": 0.99}},
    {"op": "one_hot", "args": {"column": "l_returnflag", "keep": False}},
    {"op": "date_parts", "args": {"column": "l_shipdate"}},
]
RECIPE_SQL = (
    ", filled as (select l_orderkey, l_linenumber, l_quantity, l_extendedprice as price, "
    "coalesce(l_discount, (select avg(l_discount) from lineitem_dirty)) as l_discount, l_returnflag, l_shipdate "
    "from lineitem_dirty), "
    "kept as (select * from filled where price <= (select quantile_cont(price, 0.99) from filled)) "
)


@query(
    RECIPE_SQL
    + "select l_orderkey, l_linenumber, l_quantity, price, round(l_discount, 6) as l_discount, l_shipdate, "
    + ", ".join(f"cast(l_returnflag = '{v}' as int) as \"l_returnflag_{v}\"" for v in ("A", "R", "unknown"))
    + ", cast(year(l_shipdate) as int) as l_shipdate_year, cast(month(l_shipdate) as int) as l_shipdate_month, "
    "cast(day(l_shipdate) as int) as l_shipdate_day from kept",
    ("lineitem_dirty",),
)
def recipe_clean_lineitem(t):
    cleaned, _ = run_recipe(t.lineitem_dirty, RECIPE)
    return cleaned.withColumn("l_discount", F.round("l_discount", 6))


RECIPE_GAPS = [
    {"op": "null_tokens", "args": {"columns": ["raw"]}},
    {"op": "apply_mapping", "args": {"column": "raw", "mapping": {"42": 1.0}, "output": "code", "strict": False}},
    {"op": "cast_types", "args": {"spec": {"raw": "double"}}},
]


@query(
    f", n as (select event_id, raw, case when regexp_matches(trim(raw), '{NUMBER}') then try_cast(trim(raw) as double) end as num "
    "from mixed_text) "
    "select 'raw' as column_name, 'missing_mapping_count' as metric, cast(count(distinct raw) as double) as value from n where raw <> '42' "
    "union all select 'raw', 'cast_failed', cast(count(raw) - count(num) as double) from n "
    "union all select 'raw', 'missing', cast(count(*) - count(num) as double) from n "
    "union all select 'raw', 'empty', 0.0 "
    "union all select 'raw', 'placeholder', cast(count(*) filter (where num = 42) as double) from n",
    ("mixed_text",),
)
def recipe_metrics_text(t):
    _, metrics = run_recipe(t.mixed_text, RECIPE_GAPS, check=["raw"], placeholders={"raw": ["42.0"]})
    return metrics
