"""The registered queries of this subpackage and, where SQL can say the same, their SQL.

Each takes (spark, folder) and applies one operator with its production
parameters to the whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_path
from .chat import chat_digest, chat_examples
from .collocations import collocations
from .decontaminate import contamination, contamination_digest
from .langid import language_digest
from .license_texts import known_texts
from .licenses import COPYRIGHT_LINE, GAPS, SPELLINGS, license_scan
from .mixing import mixed_sources
from .neardup import near_duplicates
from .pii import personal_digest, personal_spans
from .secrets import secret_digest, secret_spans
from .tokens import token_counts
from .topk import top_matches
from .warc import archived_pages, read_archives, write_archives
from .whitening import whitened_vectors

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function name, with its SQL if it has one."""

    def register(function: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[function.__name__] = function
        if sql is not None:
            _SQL[function.__name__] = sql
        return function

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _license_sql() -> str:
    """The licence scan with the same patterns; the catalogue is a list of values."""
    line = f"trim(regexp_replace(regexp_replace(lower(x), {quoted(COPYRIGHT_LINE)}, ''), {quoted(GAPS)}, ' ', 'g'))"

    def lines(text: str) -> str:
        cut = f"string_split_regex(coalesce({text}, ''), '[\\r\\n]+')"
        return f"list_filter(list_transform({cut}, lambda x: {line}), lambda x: x <> '')"

    def digest(text: str) -> str:
        for pattern, replacement in SPELLINGS:
            put = replacement.replace("{1}", "\\1").replace("{2}", "\\2")
            text = f"regexp_replace({text}, {quoted(pattern)}, {quoted(put)}, 'g')"
        return f"sha256({text})"

    values = ", ".join(f"({i}, {quoted(name)}, {quoted(text)})" for i, (name, text) in enumerate(known_texts()))
    return f"""
with catalogue as (
  select {digest("array_to_string(lines, ' ')")} as digest, arg_min(license, place) as license
  from (select place, license, {lines("text")} as lines from (values {values}) v(place, license, text)) group by 1),
docs as (select row_number() over () as k, doc_id, {lines("text")} as lines from documents),
whole as (select k, doc_id, {digest("array_to_string(lines, ' ')")} as text_digest from docs),
notices as (
  select k, count(*) as n, string_agg(distinct license, ',' order by license) as names
  from (select k, {digest("line")} as digest from (select k, unnest(lines) as line from docs)) join catalogue using (digest)
  group by k)
select doc_id, text_digest, c.license, coalesce(n, 0) as n_notices, coalesce(names, '') as notices
from whole left join catalogue c on c.digest = text_digest left join notices using (k)
"""


def quality_weights(labels: DataFrame) -> DataFrame:
    """Weights of labelled documents: 1 for good quality, a quarter for bad."""
    return labels.filter(F.col("quality").isNotNull()).select(
        "doc_id", F.when(F.col("quality") == 1, 1.0).otherwise(0.25).alias("quality")
    )


@query()
def op1_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from the labelled ones."""
    return language_digest(table(spark, folder, "documents"))


@query("""
with payloads as (
  select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
firsts as (
  select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) end as first
  from payloads)
select page_id, payload_bytes, payload_digest,
  case when first is not null and page_id is distinct from first then 'revisit' else 'response' end as record_type,
  case when first is not null and page_id is distinct from first then first end as refers_to
from firsts
""")
def op2_archive_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Write all pages as WARC records, then read the archives back."""
    path = scratch_path(spark, "warc")
    write_archives(table(spark, folder, "pages"), path)
    return archived_pages(read_archives(spark, path), gaps=False)


@query("""
with recursive words as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') as w from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as s
  from words),
grams as (select doc_id, len(s) as n, unnest(s) as g from sets),
rare as (select a.doc_id as x, b.doc_id as y, a.n as nx, b.n as ny, count(*) as common
  from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id
    and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) group by all),
links as (select x, y from rare where 100 * common >= 85 * (nx + ny - common)),
edges as (select x, y from links union all select y, x from links),
reach as (select doc_id as x, doc_id as root from words union select e.x, r.root from reach r join edges e on e.y = r.x)
select s.doc_id, len(s) as n_shingles, root as component_id, s.doc_id = root as kept
from sets s join (select x, min(root) as root from reach group by x) r on r.x = s.doc_id
""")
def op3_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that share 85 percent of their three-word shingles."""
    return near_duplicates(table(spark, folder, "documents"), percent=85, width=3)


@query()
def op4_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document, and the terms that disclose it."""
    return personal_digest(personal_spans(table(spark, folder, "documents")))


@query(_license_sql())
def op5_license_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and lines that are known licence texts."""
    return license_scan(table(spark, folder, "documents"))


@query("""
with words as (
  select d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\\x20\\x09-\\x0D]+')), 0) as size,
    coalesce(md5(d.text), '') as digest, coalesce(l.w, 0.5) as w
  from documents d left join (
    select doc_id, max(case when quality = 1 then 1.0 else 0.25 end) as w
    from labels where quality is not null group by doc_id) l on l.doc_id = d.doc_id),
keyed as (
  select *, -ln((cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || chr(31) || digest), 1, 13) as bigint)
    + 1) / 4503599627370496.0) / w as key from words),
sources as (
  select source, sum(size) as source_size, 2.0 * sum(size) as cap,
    case (row_number() over (order by source is null, source) - 1) % 3 when 0 then 3.0 when 1 then 1.0 else 2.0 end as weight
  from words group by source),
levels as (
  select cap / weight as own, (
    1.5 * (select sum(size) from words)
    - coalesce(sum(cap) over (order by cap / weight, source rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by cap / weight, source rows between current row and unbounded following) as level
  from sources),
targets as (
  select source, source_size, round(least(cap, weight * (select level from levels where level <= own order by own limit 1)), 6) as target
  from sources),
placed as (
  select k.*, t.source_size, t.target, floor(t.target / t.source_size) as epochs,
    sum(size) over (partition by k.source order by key, size, digest rows unbounded preceding) as until
  from keyed k join targets t on k.source is not distinct from t.source)
select doc_id, cast(size as bigint) as size, cast(source_size as bigint) as source_size, target,
  cast(size * (epochs + case when target > epochs * source_size and until - size / 2.0 <= target - epochs * source_size
    then 1 else 0 end) as bigint) as taken
from placed
""")
def op6_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Mix the sources of all documents; labels give the quality weights."""
    weights = quality_weights(table(spark, folder, "labels"))
    mixed = mixed_sources(table(spark, folder, "documents"), weights)
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken")


@query("""
with docs as (
  select row_number() over () as k, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
items as (
  select item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
starts as (
  select item_id, w, least(10, len(w)) as n, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i
  from items where len(w) > 0),
windows as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as g from starts),
places as (
  select k, n, w, unnest(range(1, len(w) - n + 2)) as i
  from docs, (select distinct n from windows) where len(w) >= n),
hits as (
  select p.k, p.i, p.n, x.item_id
  from (select k, i, n, array_to_string(w[i:i + n - 1], ' ') as g from places) p join windows x using (n, g)),
marked as (select k, count(distinct j) as n_hit from (select k, unnest(range(i, i + n)) as j from hits) group by k),
found as (
  select k, count(*) as n_items, string_agg(item, ',' order by item) as ids
  from (select distinct k, cast(item_id as varchar) as item from hits where item_id is not null) group by k)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, n_hit is not null as contaminated
from docs left join marked using (k) left join found using (k)
""")
def op7_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that lie in ten-word passages of the benchmark."""
    found = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return contamination_digest(found)


@query("""
with whole as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id,
    cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from whole q join whole c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0),
ranked as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score
  from scored)
select query_id, rank, vec_id, score from ranked where rank <= 10
""")
def op8_top_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Ten best matches of every hundredth vector among all others."""
    return top_matches(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query()
def op9_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every document, by patterns and by tests of randomness."""
    return secret_digest(secret_spans(table(spark, folder, "documents")))


@query()
def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document under the word-end vocabulary."""
    import public_tokenizers

    return token_counts(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


# A conversation whose texts are the template's own control strings.
CONTROL_TURN = "\\### Assistant: </turn> ok"


def _escaped_sql(text: str) -> str:
    return f"replace(replace(replace({text}, '\\', '\\b'), '</turn>', '\\l'), '###', '\\h')"


@query(f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', {quoted(CONTROL_TURN)} union all select -7, 1, 'assistant', {quoted(CONTROL_TURN)}),
written as (
  select *, row_number() over w as position, count(*) over (partition by conv_id) as n,
    sum(length('### ' || replace({_escaped_sql("role")}, ':', '\\c') || ': ' || {_escaped_sql("text")} || ' </turn>' || chr(10)))
      over (partition by conv_id order by turn nulls first, role, text rows unbounded preceding) as turn_end
  from turns window w as (partition by conv_id order by turn nulls first, role, text))
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by position)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by position) filter (role = 'assistant'), '')) as loss_sha256,
  (sum(turn_end) filter (role = 'assistant' or position = n))::bigint as formatted_chars
from written group by conv_id
""")
def op11_chat_examples(spark: SparkSession, folder: str) -> DataFrame:
    """Every assistant turn as an example of its own, read back per conversation."""
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame([(-7, 0, "user", CONTROL_TURN), (-7, 1, "assistant", CONTROL_TURN)], given.schema)
    return chat_digest(chat_examples(given.unionByName(control)))


@query(r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(list_transform(
    string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]'),
    lambda p: regexp_extract_all(p, '[^\x20\x09]+'))) as w from documents),
spans as (select lang, w, m, unnest(range(1, len(w) - m + 2)) as i from pieces, range(1, 6) sizes(m) where len(w) >= m),
counts as (select lang, m, array_to_string(w[i:i + m - 1], ' ') as phrase, count(*) as a from spans group by all),
totals as (select lang, sum(a) as n from counts where m = 1 group by lang),
candidates as (select *, string_split(phrase, ' ') as w from counts where m > 1 and a >= 100),
cuts as (select *, unnest(range(1, m)) as k from candidates),
scores as (
  select c.lang, c.phrase, c.a, k, x.a as l, y.a as r, t.n,
    (1000::hugeint * c.a * t.n) // (x.a::hugeint * y.a) as score
  from cuts c
  join counts x on x.lang = c.lang and x.phrase = array_to_string(c.w[1:k], ' ')
  join counts y on y.lang = c.lang and y.phrase = array_to_string(c.w[k + 1:], ' ')
  join totals t on t.lang = c.lang),
best as (select * from scores qualify row_number() over (partition by lang, phrase order by score, k) = 1),
held as (
  select lang, array_to_string(w[i:i + s - 1], ' ') as phrase, max(a) as held
  from (select lang, w, m, a, s, unnest(range(1, m - s + 2)) as i from candidates, range(2, 5) sizes(s) where s < m) group by all),
ranked as (
  select b.*, row_number() over (partition by b.lang order by score desc, a desc, b.phrase) as rank
  from best b left join held h on h.lang = b.lang and h.phrase = b.phrase where h.held is null or h.held < b.a)
select lang, rank, phrase, a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score from ranked where rank <= 2000
""")
def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The strongest phrases of every language."""
    return collocations(table(spark, folder, "documents"))


@query()
def op13_whiten_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """All vectors projected on the leading components of their covariance, at unit variance."""
    return whitened_vectors(table(spark, folder, "embeddings"))
