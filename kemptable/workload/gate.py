"""Quality gate queries. Metrics come from whole tables, policies are given."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.names import repair_mojibake, sanitize_filename
from ..operators import quality
from ..operators.profile import column_quality_metrics
from ..operators.transforms import mapping_gap_metrics
from ..session import scratch_path
from .registry import query

CHECKED = ["event_type", "value", "props"]


def metrics_sql(by: str = "") -> str:
    """Metric rows of the nulled events, per key column if one is given."""
    key, group = (f"{by}, ", f" group by {by}") if by else ("", "")
    tests = []
    for c in CHECKED:
        tests.append((c, "missing", f"{c} is null"))
        tests.append((c, "empty", "false" if c == "value" else f"{c} is not null and trim({c}) = ''"))
    tests.append(("event_type", "placeholder", "event_type = 'view'"))
    return " union all ".join(
        f"select {key}'{c}' as column_name, '{m}' as metric, cast(count(*) filter (where {test}) as double) as value "
        f"from events_nulled{group}"
        for c, m, test in tests
    )


def event_metrics(t, by=()):
    return column_quality_metrics(t.events_nulled, CHECKED, {"event_type": ["view"]}, by=by)


@query(metrics_sql(), ("events_nulled",))
def quality_metrics(t):
    return event_metrics(t)


@query(metrics_sql("user_id"), ("events_nulled",))
def quality_metrics_by_user(t):
    return event_metrics(t, ["user_id"])


# Events may lack a type; up to 12 missing values per user pass; blank props do not.
POLICY = {"allowed_missing": ["event_type"], "missing_thresholds": {"value": 12}}
POLICY_SQL = (
    "policy as (select * from (values ('event_type', true, cast(null as double)), ('value', false, 12.0)) "
    "as p(column_name, allowed, threshold))"
)


@query(
    f", m as ({metrics_sql('user_id')}), {POLICY_SQL}, a as (select user_id, column_name, sum(value) as absent from m "
    "where metric in ('missing', 'empty') group by 1, 2) "
    "select m.user_id, m.column_name, m.metric, m.value from m join a using (user_id, column_name) "
    "left join policy p using (column_name) where m.value > 0 and not coalesce(p.allowed, false) "
    "and not coalesce(a.absent <= p.threshold, false)",
    ("events_nulled",),
)
def quality_flags_by_user(t):
    policy = quality.quality_policy(t.spark, **POLICY)
    return quality.quality_flags(event_metrics(t, ["user_id"]), policy, by=["user_id"])


@query(
    f", m as ({metrics_sql('user_id')}) select user_id, column_name from m group by 1, 2 "
    "having bool_or(metric in ('missing', 'empty')) and not bool_or(metric = 'placeholder')",
    ("events_nulled",),
)
def placeholder_coverage_by_user(t):
    return quality.placeholder_coverage(event_metrics(t, ["user_id"]), by=["user_id"])


@query(
    "select 'doc_id' as column_name, 'missing_mapping_count' as metric, "
    "cast(count(distinct doc_id) as double) as value from documents where doc_id not in (select doc_id from labels) "
    "having count(*) > 0"
)
def mapping_gaps_labels(t):
    """Documents that the label table does not cover."""
    return quality.mapping_gaps(mapping_gap_metrics(t.documents, "doc_id", t.labels.select("doc_id")))


@query(
    "select d.doc_id as id, case when l.doc_id is null then 'missing' when l.ok then 'pass' else 'fail' end as status "
    "from (select distinct doc_id from documents) d left join (select doc_id, bool_and(quality <> 0) as ok from labels "
    "group by 1) l on d.doc_id = l.doc_id"
)
def requirement_verdict_documents(t):
    """Every document must carry a quality label that passes."""
    required = t.documents.select(F.col("doc_id").alias("id"))
    reported = t.labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("string").alias("ok_raw"))
    return quality.requirement_verdict(required, reported)


USER_REPORTS = [
    "user_id",
    "user_id % 10 <> 0 as has_report",
    "case when user_id % 10 <> 1 then case when user_id % 10 = 2 then 'fail' else 'passed' end end as ok",
    "'none' as issues",
]
VERDICT_SQL = f"""
, m as ({metrics_sql('user_id')}), {POLICY_SQL},
a as (select user_id, column_name, sum(value) as absent from m where metric in ('missing', 'empty') group by 1, 2),
flags as (select m.user_id, count(*) as n from m join a using (user_id, column_name) left join policy p
  using (column_name) where m.value > 0 and not coalesce(p.allowed, false) and not coalesce(a.absent <= p.threshold, false)
  group by 1),
unmet as (select distinct user_id from events_nulled where event_type = 'error' and value > 300),
r as (select distinct {', '.join(USER_REPORTS)} from events)
select r.user_id, case
  when not has_report then 'missing_report'
  when ok is null then 'missing_ok_issues'
  when unmet.user_id is not null then 'requirements'
  when ok = 'passed' and false then 'placeholder_metrics'
  when ok <> 'passed' or flags.n > 0 then 'silent_miss' end as failed_stage
from r left join flags on r.user_id = flags.user_id left join unmet on r.user_id = unmet.user_id
"""


@query(VERDICT_SQL, ("events_nulled",))
def quality_verdict_by_user(t):
    """One verdict per user: report, requirement, placeholder and metric stages."""
    policy = quality.quality_policy(
        t.spark, **POLICY, placeholder_optional=["nothing"], placeholder_required=["event_type"]
    )
    reports = t.events.selectExpr(*USER_REPORTS).distinct()
    users = t.events.select("user_id").distinct()
    required = users.select("user_id", F.lit("REQ-1").alias("id"))
    big_error = F.coalesce((F.col("event_type") == "error") & (F.col("value") > 300), F.lit(False))
    reported = t.events_nulled.groupBy("user_id").agg((~F.bool_or(big_error)).alias("ok")).select(
        "user_id", F.lit("REQ-1").alias("id"), F.when(F.col("ok"), "pass").otherwise("no").alias("ok_raw")
    )
    verdict = quality.quality_verdict(
        reports, event_metrics(t, ["user_id"]), policy, required, reported, by=["user_id"]
    )
    return verdict.select("user_id", "failed_stage")


@query(
    "select o_orderkey, case when o_totalprice > 400000 and o_orderstatus = 'P' then 'price,status' "
    "when o_totalprice > 400000 then 'price' else 'status' end as reasons from orders "
    "where o_totalprice > 400000 or o_orderstatus = 'P'"
)
def quarantined_orders(t):
    _, rejected = quality.quarantine(t.orders, {
        "price": F.col("o_totalprice") <= 400000,
        "status": F.col("o_orderstatus") != "P",
    })
    return rejected.select("o_orderkey", F.array_join("reasons", ",").alias("reasons"))


@query(
    "select metric, cast(value as bigint) as value from (select count(*) as rows, count(*) - count(value) as value_missing, 0 as value_empty, "
    "0 as props_missing, count(*) filter (where trim(props) = '') as props_empty from events_nulled) "
    "unpivot (value for metric in (rows, value_missing, value_empty, props_missing, props_empty))",
    ("events_nulled",),
)
def observed_quality(t):
    """Counts gathered while the table is written, without a second scan."""
    watched, observation = quality.observe_quality(t.events_nulled, ["value", "props"])
    watched.write.parquet(scratch_path(t.spark, "observed"))
    return t.spark.createDataFrame(list(observation.get.items()), "metric string, value long")


@query("select doc_id, '한글_' || source as name from documents")
def repaired_names(t):
    """UTF-8 names read as Latin-1 are put right."""
    wrong = F.decode(F.encode(F.concat(F.lit("한글_"), F.col("source")), "UTF-8"), "ISO-8859-1")
    return t.documents.select("doc_id", repair_mojibake(wrong).alias("name"))


@query(
    "select page_id, regexp_replace(nfc_normalize(string_split(regexp_replace(url, '/+$', ''), '/')[-1]), "
    "'[^A-Za-z0-9._\\-가-힣ㄱ-ㅎㅏ-ㅣ]', '_', 'g') as name from pages"
)
def safe_page_names(t):
    return t.pages.select("page_id", sanitize_filename(F.col("url")).alias("name"))


@query(
    f", m as ({metrics_sql('user_id')}) select user_id, column_name, metric, value from m",
    ("events_nulled",),
)
def metrics_from_reports(t):
    """Flat metric names of per-user JSON reports split back into columns."""
    metrics = event_metrics(t, ["user_id"])
    name = F.concat_ws("_", "column_name", "metric")
    report = metrics.groupBy("user_id").agg(  # one small object per user
        F.to_json(F.map_from_entries(F.collect_list(F.struct(name, F.col("value").cast("string"))))).alias("metrics")
    )
    return quality.metrics_from_json(report, by=["user_id"])


# What is wrong with a user's run, by the remainder of the id; all eight stages occur.
STAGE_CASES = [
    ("missing_report", ""), ("missing_ok_issues", ""), ("missing_metrics", ""), ("missing_requirements", ""),
    ("requirements", "1: REQ-1=fail"), ("placeholder_metrics", "1: Age"), ("missing_mapping", "1: city_missing_mapping_count"),
    ("silent_miss", "1: Age_missing"),
]


@query(
    "select distinct user_id, user_id % 9 = 8 as ok, case user_id % 9 "
    + " ".join(f"when {i} then '{stage}'" for i, (stage, _) in enumerate(STAGE_CASES))
    + " end as failed_stage, case user_id % 9 "
    + " ".join(f"when {i} then '{detail}'" for i, (_, detail) in enumerate(STAGE_CASES))
    + " end as detail from events"
)
def quality_verdict_stages(t):
    """Verdicts with their details, from runs that fail at every stage in turn."""
    runs = t.events.groupBy("user_id").agg(F.count(F.lit(1)).cast("double").alias("rows"))
    case = F.col("user_id") % 9
    reports = runs.select(
        "user_id", (case != 0).alias("has_report"), F.when(case != 1, "ok").alias("ok"), F.lit("none").alias("issues")
    )

    def metric(column, name, value, *cases):
        chosen = runs.filter(case.isin(*cases))
        return chosen.select("user_id", F.lit(column).alias("column_name"), F.lit(name).alias("metric"), value.alias("value"))

    # Users of the cases 5, 6 and 7 miss values; 6 and 7 say how they filled them.
    parts = [
        metric("", "rows", F.col("rows"), 0, 1, 3, 4, 5, 6, 7, 8),
        metric("Age", "missing", F.when(case == 7, F.col("rows")).otherwise(0.0), 5, 6, 7, 8),
        metric("Age", "placeholder", F.lit(0.0), 6, 7, 8),
        metric("city", "missing_mapping_count", F.col("rows"), 6),
    ]
    required = runs.filter(case != 2).select("user_id", F.lit("REQ-1").alias("id"))
    reported = runs.filter(~case.isin(2, 3)).select(
        "user_id", F.lit("REQ-1").alias("id"), F.when(case == 4, "no").otherwise("pass").alias("ok_raw")
    )
    metrics = reduce(DataFrame.unionByName, parts)
    return quality.quality_verdict(reports, metrics, None, required, reported, by=["user_id"])


@query(
    "select distinct user_id, 'city' as column_name, 'missing_mapping_count' as metric, 2.0::double as value from events "
    "where user_id % 2 = 0"
)
def listed_mapping_gaps(t):
    """Unmapped values that a report lists are counted and caught."""
    gaps = F.when(F.col("user_id") % 2 == 0, '{"city_missing_mapping": ["Oslo", "Bern"], "rows": 5}').otherwise(
        '{"city_missing_mapping": [], "rows": 5}'
    )
    reports = t.events.select("user_id").distinct().withColumn("metrics", gaps)
    return quality.mapping_gaps(quality.metrics_from_json(reports, by=["user_id"]), by=["user_id"])


@query(
    "select distinct user_id, case c when 1 then 'Cabin' when 2 then 'Age' else 'Fare' end as column_name, c = 1 as allowed, "
    "case when c = 2 then cast(user_id as double) end as threshold, c = 3 as ph_required, false as ph_optional "
    "from events cross join (values (1), (2), (3)) as x(c)"
)
def policy_of_reports(t):
    """Policies of many reports from their text entries."""
    entries = F.create_map(
        F.lit("allowed_missing"), F.lit('["Cabin"]'),
        F.lit("missing_thresholds"), F.concat(F.lit('{"Age": '), F.col("user_id").cast("string"), F.lit("}")),
        F.lit("placeholder_required"), F.lit(" 'Fare' "),
    )
    users = t.events.select("user_id").distinct()
    return quality.policy_from_reports(users.withColumn("entries", entries), "entries", ["user_id"])
