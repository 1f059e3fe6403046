"""Profile queries: values, numbers, parse rates, shared plans."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import flatten_struct, normalize_columns
from ..functions.values import (
    canonical_col,
    extension,
    file_name,
    parent_name,
    shown_value,
    text_list,
    to_number,
    to_verdict,
    truncate_text,
)
from ..operators import counts, numeric, profile
from ..plans.profile_plan import plan_summary, profile_plan
from ..sources.tables import preview, preview_text, sample_head
from .registry import query

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
CUT = "case when length({0}) > 200 then substr({0}, 1, 200) || '…' else {0} end"


def topk_sql(column: str, table: str, k: int) -> str:
    return (
        f"with c as (select cast({column} as varchar) as value, count(*) as cnt from {table} "
        f"where {column} is not null group by 1) "
        f"select value, cnt, round(cnt / cast((select sum(cnt) from c) as double), 6) as ratio "
        f"from c order by cnt desc, value limit {k}"
    )


@query(topk_sql("o_orderpriority", "orders", 20))
def topk_order_priority(t):
    return counts.value_counts_topk(t.orders, "o_orderpriority")


@query(topk_sql("user_id", "events", 10))
def topk_user_id(t):
    return counts.value_counts_topk(t.events, "user_id", top_k=10)


@query("select distinct event_type as value from events_nulled where event_type is not null", ("events_nulled",))
def unique_event_type(t):
    return counts.unique_values(t.events_nulled, "event_type")


@query(f"select {CUT.format('text')} as value from (select distinct text from documents where text is not null)")
def unique_text_values(t):
    """Distinct whole texts, cut where they are shown."""
    return counts.unique_values(t.documents, "text").select(shown_value(F.col("value")).alias("value"))


@query("select distinct text as value from documents where text is not null")
def unique_text_whole(t):
    """The same, uncut."""
    return counts.unique_values(t.documents, "text")


TEXT_COUNTS = "(select text as value, count(*) as cnt from documents where text is not null group by 1)"


@query(f"select value, cnt from {TEXT_COUNTS} where cnt <= 3")
def rare_texts(t):
    return counts.rare_values(t.documents, "text").select("value", "cnt")


@query(
    f"select value, cnt, round(cnt / cast((select sum(cnt) from {TEXT_COUNTS}) as double), 6) as ratio "
    f"from {TEXT_COUNTS} order by cnt desc, value limit 20"
)
def topk_texts(t):
    return counts.value_counts_topk(t.documents, "text")


@query(
    "with d as (select distinct repeat('x', 200) || text as value from documents where text is not null), "
    "b as (select distinct repeat('x', 200) || text as value from documents where doc_id % 2 = 0 and text is not null) "
    "select value, case when value in (select value from b) then 'ok' else 'missing' end as status from d"
)
def mapping_coverage_long_keys(t):
    """Keys that share their first 200 characters are still keys of their own."""
    long = t.documents.select("doc_id", F.concat(F.repeat(F.lit("x"), F.lit(200)), "text").alias("value"))
    return counts.mapping_coverage(long, "value", long.filter("doc_id % 2 = 0").select("value"))


@query(
    "select count(*) as rows_scanned, count(distinct event_type) as unique_count, "
    "count(*) - count(event_type) as missing from events_nulled",
    ("events_nulled",),
)
def unique_count_event_type(t):
    return counts.unique_count(t.events_nulled, "event_type")


@query("select p_name as value, count(*) as cnt from part group by 1 having count(*) <= 25")
def rare_part_names(t):
    return counts.rare_values(t.part, "p_name", rare_threshold=25)


@query("select cast(c_acctbal as varchar) as value, count(*) as cnt from customer group by 1 having count(*) <= 3")
def rare_account_balances(t):
    return counts.rare_values(t.customer, "c_acctbal")


@query(
    "select '<list len=' || len(embedding) || '>' as value, count(*) as cnt, 1.0::double as ratio "
    "from embeddings group by 1"
)
def topk_list_placeholder(t):
    return counts.value_counts_topk(t.embeddings, "embedding")


def summary_sql(columns, source: str, value: str = "{0}") -> str:
    parts = []
    for c in columns:
        v = value.format(c)
        parts.append(
            f"select '{c}' as column_name, count({v}) as cnt, count(*) - count({v}) as missing, "
            f"round(avg({v}), 6) as mean, round(stddev_samp({v}), 6) as std, "
            f"cast(min({v}) as double) as min_value, "
            f"round(quantile_cont(cast({v} as double), 0.25), 6) as q1, "
            f"round(quantile_cont(cast({v} as double), 0.5), 6) as median, "
            f"round(quantile_cont(cast({v} as double), 0.75), 6) as q3, "
            f"cast(max({v}) as double) as max_value from {source}"
        )
    return " union all ".join(parts)


def rounded(table, columns):
    return table.withColumns({c: F.round(c, 6) for c in columns}).drop("min_exact", "max_exact")


BIG = 2**53


@query(
    f"select k as column_name, min_exact, max_exact from (select cast(min(o_orderkey + {BIG}) as varchar) as min_exact, "
    f"cast(max(o_orderkey + {BIG}) as varchar) as max_exact, 'key' as k from orders union all "
    "select cast(min(cast(o_totalprice as decimal(20, 4)) * -1) as varchar), "
    "cast(max(cast(o_totalprice as decimal(20, 4)) * -1) as varchar), 'owed' from orders)"
)
def summary_exact_limits(t):
    """Limits of whole numbers that doubles cannot hold, and of decimals."""
    owed = (F.col("o_totalprice").cast("decimal(20,4)") * -1).cast("decimal(20,4)").alias("owed")
    stats = numeric.summary_stats(t.orders.select((F.col("o_orderkey") + BIG).alias("key"), owed))
    return stats.select("column_name", "min_exact", "max_exact")


@query(summary_sql(LINE_NUMBERS, "lineitem"))
def summary_lineitem(t):
    return rounded(numeric.summary_stats(t.lineitem, LINE_NUMBERS), ["mean", "q1", "median", "q3"])


@query(summary_sql(LINE_NUMBERS, "lineitem"))
def summary_lineitem_brackets(t):
    """The same numbers with moments and brackets taken one after the other."""
    known = numeric.moments(t.lineitem, LINE_NUMBERS)
    cuts = numeric.quantiles(t.lineitem, dict.fromkeys(LINE_NUMBERS, numeric.QUARTILES), known=known, piece_values=1000)
    table = numeric.summary_rows(t.lineitem, LINE_NUMBERS, known, cuts)
    return rounded(table, ["mean", "q1", "median", "q3"])


NUMBER_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


@query(
    summary_sql(
        ["raw"], "mixed_text",
        f"(case when regexp_matches(trim(raw), '{NUMBER_TEXT}') then try_cast(trim(raw) as double) end)",
    ),
    ("mixed_text",),
)
def summary_coerced_text(t):
    return rounded(numeric.summary_stats(t.mixed_text, ["raw"]), ["mean", "q1", "median", "q3"])


def describe_sql(columns, source: str) -> str:
    parts = [
        f"select '{c}' as column_name, count({c}) as count, round(avg({c}), 6) as mean, "
        f"round(stddev_samp({c}), 6) as std, cast(min({c}) as double) as min, "
        f"round(quantile_cont(cast({c} as double), 0.25), 6) as p25, "
        f"round(quantile_cont(cast({c} as double), 0.5), 6) as p50, "
        f"round(quantile_cont(cast({c} as double), 0.75), 6) as p75, "
        f"cast(max({c}) as double) as max from {source}"
        for c in columns
    ]
    return " union all ".join(parts)


@query(describe_sql(["p_partkey", "p_size", "p_retailprice"], "part"))
def describe_numeric_part(t):
    return rounded(numeric.describe_numeric(t.part), ["mean", "p25", "p50", "p75"])


def top_one_sql(column: str, source: str) -> str:
    return (
        f"select '{column}' as column_name, (select count({column}) from {source}) as count, "
        f"null::double as mean, null::double as std, null::double as min, null::double as p25, "
        f"null::double as p50, null::double as p75, null::double as max, "
        f"(select count(distinct {column}) from {source}) as \"unique\", value as top, cnt as freq "
        f"from (select cast({column} as varchar) as value, count(*) as cnt from {source} group by 1 "
        f"order by cnt desc, value limit 1)"
    )


@query(
    f"select *, null::bigint as \"unique\", null::varchar as top, null::bigint as freq from "
    f"({describe_sql(['p_partkey', 'p_size', 'p_retailprice'], 'part')}) union all "
    + " union all ".join(top_one_sql(c, "part") for c in ["p_name", "p_brand", "p_type"])
)
def describe_all_part(t):
    return rounded(profile.describe_all(t.part), ["mean", "p25", "p50", "p75"])


def profile_sql(columns_types: dict[str, str], source: str, samples: int) -> str:
    parts = []
    for c, dtype in columns_types.items():
        values = (
            f"(select coalesce(string_agg(value, '|' order by value), '') from (select distinct "
            f"{CUT.format(f'cast({c} as varchar)')} as value from {source} where {c} is not null "
            f"order by value limit {samples}))" if samples else "''"
        )
        parts.append(
            f"select '{c}' as column_name, '{dtype}' as dtype, count(*) as total, count(*) - count({c}) as missing, "
            f"round((count(*) - count({c})) / cast(count(*) as double), 6) as missing_rate, {values} as samples "
            f"from {source}"
        )
    return " union all ".join(parts)


ORDER_TYPES = dict(zip(ORDER_COLUMNS, ["bigint", "bigint", "string", "double", "timestamp_ntz", "string"]))
EVENT_TYPES = {
    "event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string", "value": "double",
    "props": "string",
}


def joined_samples(table):
    return table.withColumn("samples", F.array_join("samples", "|"))


@query(profile_sql(ORDER_TYPES, "orders", 20))
def profile_orders(t):
    return joined_samples(profile.column_profile(t.orders))


@query(profile_sql(EVENT_TYPES, "events_nulled", 0), ("events_nulled",))
def profile_events_counts(t):
    return joined_samples(profile.column_profile(t.events_nulled, samples=0))


@query(
    "select * from ("
    + " union all ".join(
        f"select '{c}' as column_name, count(*) - count({c}) as missing, "
        f"round((count(*) - count({c})) / cast(count(*) as double), 6) as missing_rate from events_nulled"
        for c in EVENT_TYPES
    )
    + ") where missing > 0",
    ("events_nulled",),
)
def missing_report_events(t):
    return profile.missing_report(t.events_nulled)


@query(
    "with long as ("
    + " union all ".join(
        f"select '{c}' as column_name, {c} as value, count(*) as cnt from part group by 2"
        for c in ["p_name", "p_brand", "p_type"]
    )
    + ") select column_name, nunique, value, cnt, rank from (select *, count(*) over (partition by column_name) "
    "as nunique, row_number() over (partition by column_name order by cnt desc, value) as rank from long) "
    "where rank <= 3"
)
def categorical_top3_part(t):
    return counts.categorical_summary(t.part)


@query(
    "select 'l_returnflag' as column_name, l_returnflag as value, count(*) as cnt from lineitem group by 2 "
    "union all select 'l_linestatus', l_linestatus, count(*) from lineitem group by 2"
)
def value_counts_flags(t):
    return counts.value_counts_many(t.lineitem, ["l_returnflag", "l_linestatus"]).drop("listed")


BOOL_LIST = "('true', 'false', 't', 'f', '1', '0', 'yes', 'no', 'y', 'n')"


@query(
    "select 'raw' as column_name, count(raw) as n_values, "
    f"round(sum(case when regexp_matches(trim(raw), '{NUMBER_TEXT}') then 1 else 0 end) / cast(count(raw) as double), 4) "
    "as numeric_rate, "
    f"round(sum(case when lower(trim(raw)) in {BOOL_LIST} then 1 else 0 end) / cast(count(raw) as double), 4) "
    "as bool_rate from mixed_text",
    ("mixed_text",),
)
def parse_mixed_text(t):
    return profile.parseability(t.mixed_text, "raw", ["numeric", "bool"]).drop("datetime_rate")


@query(
    "select 'k' as column_name, count(k) as n_values, 0.0::double as datetime_rate, "
    "round(count(try_cast(k as double)) / cast(count(k) as double), 4) as numeric_rate, "
    "round(sum(case when k in ('0', '1') then 1 else 0 end) / cast(count(k) as double), 4) as bool_rate "
    "from (select json_extract_string(props, '$.k') as k from events)"
)
def parse_event_props(t):
    return profile.parseability(t.events.select(F.get_json_object("props", "$.k").alias("k")), "k", formats=["yyyy-MM-dd"])


DATE_TEXT = (
    "case event_id % 4 when 0 then strftime(ts, '%Y-%m-%d') when 1 then strftime(ts, '%m/%d/%Y') "
    "when 2 then strftime(ts, '%Y-%m-%d %H:%M:%S') else event_type end"
)


@query(
    "select 'day' as column_name, count(day) as n_values, round(greatest("
    "count(try_strptime(day, '%Y-%m-%d')), count(try_strptime(day, '%m/%d/%Y')), "
    "count(try_strptime(day, '%Y-%m-%d %H:%M:%S'))) / cast(count(day) as double), 4) as datetime_rate "
    f"from (select {DATE_TEXT} as day from events)"
)
def parse_dates(t):
    text = t.events.selectExpr(
        "case event_id % 4 when 0 then date_format(ts, 'yyyy-MM-dd') when 1 then date_format(ts, 'MM/dd/yyyy') "
        "when 2 then date_format(ts, 'yyyy-MM-dd HH:mm:ss') else event_type end as day"
    )
    return profile.parseability(text, "day", ["datetime"]).select("column_name", "n_values", "datetime_rate")


SEGMENTS = {"AUTOMOBILE": "A", "BUILDING": "B", "FURNITURE": "F", "HOUSEHOLD": "H", "BOAT": "X"}
SEGMENT_KEYS = ", ".join(f"('{k}')" for k in SEGMENTS)


def coverage_sql(values: str, keys: str) -> str:
    return (
        f"with v as ({values}), k as ({keys}) select coalesce(v.value, k.value) as value, "
        "case when v.value is null then 'extra' when k.value is null then 'missing' else 'ok' end as status "
        "from v full outer join k on v.value = k.value"
    )


SEGMENT_VALUES = "select distinct c_mktsegment as value from customer"


@query(coverage_sql(SEGMENT_VALUES, f"select * from (values {SEGMENT_KEYS}) as k(value)"))
def mapping_coverage_segment(t):
    return counts.mapping_coverage(t.customer, "c_mktsegment", SEGMENTS)


@query(
    coverage_sql(
        "select distinct cast(doc_id as varchar) as value from documents",
        "select distinct cast(doc_id as varchar) as value from labels",
    )
)
def mapping_coverage_labels(t):
    """Keys from a table: documents without a label are missing."""
    return counts.mapping_coverage(t.documents, "doc_id", t.labels.select("doc_id"))


@query(
    coverage_sql(
        "select distinct cast(l_partkey as varchar) as value from lineitem",
        "select distinct cast(p_partkey as varchar) as value from part",
    )
)
def mapping_coverage_parts(t):
    return counts.mapping_coverage(t.lineitem, "l_partkey", t.part.select("p_partkey"))


@query(
    "select count(*) filter (where status <> 'extra') as unique_count, "
    "count(*) filter (where status <> 'missing') as mapping_key_count, "
    "count(*) filter (where status = 'missing') as missing_in_mapping_count, "
    "count(*) filter (where status = 'extra') as extra_mapping_keys_count from ("
    + coverage_sql(SEGMENT_VALUES, f"select * from (values {SEGMENT_KEYS}) as k(value)")
    + ")"
)
def mapping_coverage_totals(t):
    return counts.mapping_coverage_counts(t.customer, "c_mktsegment", list(SEGMENTS))


@query(
    "select page_id, lower(regexp_extract(name, '.\\.([^.]+)$', 1)) as ext, name, parent from (select page_id, "
    "string_split(split_part(url, '?', 1), '/')[-1] as name, string_split(split_part(url, '?', 1), '/')[-2] as parent "
    "from pages)"
)
def url_pieces(t):
    url = F.col("url")
    return t.pages.select(
        "page_id", extension(url).alias("ext"), file_name(url).alias("name"), parent_name(url).alias("parent")
    )


@query(
    "select event_id, case when lower(trim(raw)) in ('true', '1', 'yes', 'y', 'ok', 'pass', 'passed') then true "
    "when lower(trim(raw)) in ('false', '0', 'no', 'n', 'fail', 'failed') then false "
    f"when regexp_matches(trim(raw), '{NUMBER_TEXT}') then try_cast(trim(raw) as double) <> 0 end as verdict, "
    f"case when regexp_matches(trim(raw), '{NUMBER_TEXT}') then try_cast(trim(raw) as double) end as number "
    "from mixed_text",
    ("mixed_text",),
)
def verdict_and_number(t):
    return t.mixed_text.select("event_id", to_verdict(F.col("raw")).alias("verdict"), to_number(F.col("raw")).alias("number"))


@query("select event_id, event_type || ',' || user_id as names from events")
def name_lists(t):
    """Names out of a JSON list kept as text, with stray quotes and blanks."""
    raw = F.format_string('["%s", " \'%s\' "]', "event_type", F.col("user_id").cast("string"))
    return t.events.select("event_id", F.array_join(text_list(raw), ",").alias("names"))


@query(
    "select doc_id, case when length(text) > 2000 then substr(text, 1, 2000) || '…(truncated)' else text end as shown "
    "from documents"
)
def truncated_texts(t):
    """Long texts cut for display, as run reports show them."""
    return t.documents.select("doc_id", truncate_text(F.col("text"), 2000, "…(truncated)").alias("shown"))


@query("select event_id, user_id as \"actor.id\", event_type as \"actor.did.what\", value as \"actor.did.how\" from events")
def flattened_events(t):
    nested = t.events.select(
        "event_id",
        F.struct(
            F.col("user_id").alias("id"),
            F.struct(F.col("event_type").alias("what"), F.col("value").alias("how")).alias("did"),
        ).alias("actor"),
    )
    return flatten_struct(nested)


@query("select n_nationkey as key, n_name as name from nation")
def normalized_names(t):
    return normalize_columns(t.nation.select(F.col("n_nationkey").alias(' "key" '), F.col("n_name").alias("'name")))


@query(
    "select '<dict keys=[event_id, user_id]>' as pair, '<dict keys=[' || event_type || ']>' as one, "
    "'<bytes len=' || octet_length(encode(props)) || '>' as raw from events"
)
def container_placeholders(t):
    """Value text of nested and binary cells."""
    nested = t.events.select(
        F.struct("event_id", "user_id").alias("pair"),
        F.create_map("event_type", "value").alias("one"),
        F.encode("props", "UTF-8").alias("raw"),
    )
    return nested.select(*[canonical_col(nested, c).alias(c) for c in nested.columns])


# Column -> (layout that Spark writes, layout that DuckDB reads); every fourth value is no date.
LAYOUTS = {
    "us": ("M/d/yyyy", "%m/%d/%Y"),
    "iso_fraction": ("yyyy-MM-dd'T'HH:mm:ss.SSS", "%Y-%m-%dT%H:%M:%S.%g"),
    "iso_zone": ("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "%Y-%m-%dT%H:%M:%S.%gZ"),
    "named": ("d MMM yyyy", "%d %b %Y"),
    "long_named": ("MMMM d, yyyy", "%B %d, %Y"),
}
_WRITTEN = {
    "us": "%-m/%-d/%Y", "iso_fraction": "%Y-%m-%dT%H:%M:%S.%g", "iso_zone": "%Y-%m-%dT%H:%M:%S.%gZ", "named": "%-d %b %Y",
    "long_named": "%B %-d, %Y",
}


@query(" union all ".join(
    f"select '{name}' as column_name, round(count(try_strptime(case when o_orderkey % 4 = 0 then 'no date' else "
    f"strftime(o_orderdate, '{_WRITTEN[name]}') end, '{read}')) / cast(count(*) as double), 4) as datetime_rate from orders"
    for name, (_, read) in LAYOUTS.items()
))
def parse_date_layouts(t):
    """One-digit fields, fractions, zones and names of months."""
    broken = F.col("o_orderkey") % 4 == 0
    texts = t.orders.select(*[
        F.when(broken, "no date").otherwise(F.date_format(F.col("o_orderdate").cast("timestamp"), layout)).alias(name)
        for name, (layout, _) in LAYOUTS.items()
    ])
    found = [profile.parseability(texts, name, ["datetime"]) for name in LAYOUTS]
    return reduce(DataFrame.unionByName, found).select("column_name", "datetime_rate")


@query("select count(*) as n, count(*) as found from (select * from embeddings limit 20)")
def previewed_rows_are_in_the_table(t):
    """Every previewed row occurs in the table with all its columns."""
    shown = preview(t.embeddings, 20)
    whole = preview_text(t.embeddings).distinct()
    met = shown.join(whole.withColumn("there", F.lit(True)), shown.columns, "left")
    return met.agg(F.count(F.lit(1)).alias("n"), F.count("there").alias("found"))


@query("select count(*) as n, count(*) as found from (select * from orders limit 100)")
def sampled_rows_are_in_the_table(t):
    shown = sample_head(t.orders, path="orders.parquet")
    met = shown.join(t.orders.distinct().withColumn("there", F.lit(True)), shown.columns, "left")
    return met.agg(F.count(F.lit(1)).alias("n"), F.count("there").alias("found"))


@query()
def preview_embeddings(t):
    return preview(t.embeddings, 20)


@query()
def sample_orders(t):
    return sample_head(t.orders, path="orders.parquet")


@query(
    " union all ".join(
        f"select '{c}' as column_name, count({c}) as cnt, round(avg({c}), 6) as mean, true as near from lineitem"
        for c in LINE_NUMBERS
    )
)
def summary_lineitem_sketch(t):
    """Quartiles by a sketch in one pass, compared with the exact ones."""
    exact = numeric.summary_stats(t.lineitem, LINE_NUMBERS)
    rough = numeric.summary_stats(t.lineitem, LINE_NUMBERS, accuracy=10_000).alias("rough")
    exact = exact.withColumn("room", F.lit(0.03) * (F.col("max_value") - F.col("min_value"))).alias("exact")
    near = [F.abs(F.col(f"exact.{q}") - F.col(f"rough.{q}")) <= F.col("room") for q in ("q1", "median", "q3")]
    return exact.join(rough, "column_name").select(
        "column_name", "exact.cnt", F.round("rough.mean", 6).alias("mean"), (near[0] & near[1] & near[2]).alias("near")
    )


TEN_REQUESTS = [
    {"name": "unique_values", "args": {"column": "l_returnflag"}},
    {"name": "rare_values", "args": {"column": "l_linenumber", "rare_threshold": 100}},
    {"name": "value_counts_topk", "args": {"column": "l_shipdate", "top_k": 5}},
    {"name": "value_counts_topk", "args": {"column": "l_shipdate", "top_k": 5}, "reason": "asked twice"},
    {"name": "mapping_coverage", "args": {"column": "l_linestatus", "mapping_keys": ["F", "O", "X"]}},
    {"name": "summary_stats", "args": {"columns": ["l_quantity", "l_discount"]}},
    {"name": "parseability", "args": {"column": "l_returnflag"}},
    {"name": "column_profile", "args": {"columns": ["l_linestatus"]}},
    {"name": "missing_report", "args": {}},
    {"name": "categorical_summary", "args": {"columns": ["l_returnflag"]}},
    {"name": "value_counts_topk", "args": {"column": "no_such_column"}},
]


@query()
def profile_plan_lineitem(t):
    return profile_plan(t.lineitem, TEN_REQUESTS)


@query(
    "with n as (select count(*) as rows, count(distinct l_returnflag) as flags, "
    "count(distinct l_linestatus) filter (where l_linestatus not in ('F', 'O', 'X')) as missing, "
    "count(distinct l_linestatus) as statuses, count(distinct l_linestatus) filter (where l_linestatus in ('F', 'O', 'X')) as met, "
    "(select count(*) from (select l_linenumber from lineitem group by 1 having count(*) <= 100)) as rare, "
    "count(l_returnflag) as present from lineitem) "
    "select x.request_id, x.name, x.reason, x.stats from n cross join lateral (values "
    "(1, 'unique_values', null, '{\"rows_scanned\":\"' || rows || '\",\"unique_count\":\"' || flags || '\"}'), "
    "(2, 'rare_values', null, '{\"rare_count\":\"' || rare || '\"}'), "
    "(3, 'value_counts_topk', 'first asked', null), "
    "(5, 'mapping_coverage', null, '{\"extra_mapping_keys_count\":\"' || (3 - met) || '\",\"missing_in_mapping_count\":\"' || missing "
    "|| '\",\"unique_count\":\"' || statuses || '\"}'), "
    "(6, 'summary_stats', null, '{\"rows_scanned\":\"' || rows || '\"}'), "
    "(7, 'parseability', null, '{\"sample_size\":\"' || present || '\"}'), (8, 'column_profile', null, null), "
    "(9, 'missing_report', null, '{\"rows_scanned\":\"' || rows || '\"}'), (10, 'categorical_summary', null, null), "
    "(11, 'value_counts_topk', null, null)) as x(request_id, name, reason, stats)"
)
def profile_plan_summary(t):
    """One row for each of ten requests, with why it was made and its totals."""
    requests = [{**r, "reason": "first asked"} if i == 2 else r for i, r in enumerate(TEN_REQUESTS)]
    return plan_summary(profile_plan(t.lineitem, requests)).select("request_id", "name", "reason", "stats")


PLAN_NUMBERS = [
    ("l_quantity", "l_quantity"), ("l_discount", "l_discount"),
]


@query(
    "with s as (" + summary_sql(["l_quantity", "l_discount"], "lineitem") + ") "
    "select column_name || '.' || stat as metric, round(value, 4) as value from s cross join lateral "
    "(values ('count', cast(cnt as double)), ('missing', cast(missing as double)), ('mean', mean), ('std', std), "
    "('min', min_value), ('q1', q1), ('median', median), ('q3', q3), ('max', max_value)) as x(stat, value) "
    "union all select 'l_returnflag.nunique', cast(count(distinct l_returnflag) as double) from lineitem "
    "union all select 'unique_count', cast(count(distinct l_linestatus) as double) from lineitem "
    "union all select 'rows_scanned', cast(count(*) as double) from lineitem "
    "union all select 'rows_scanned', cast(count(*) as double) from lineitem"
)
def profile_plan_numbers(t):
    """The numeric rows of a shared plan."""
    report = profile_plan(t.lineitem, [
        {"name": "summary_stats", "args": {"columns": ["l_quantity", "l_discount"]}},
        {"name": "categorical_summary", "args": {"columns": ["l_returnflag"]}},
        {"name": "unique_values", "args": {"column": "l_linestatus"}},
    ])
    number = F.col("value").try_cast("double")
    return report.filter(number.isNotNull()).select("metric", F.round(number, 4).alias("value"))
