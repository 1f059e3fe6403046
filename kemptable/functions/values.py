"""Column expressions shared by all operators.

Everything here is a built-in Spark expression: no Python runs per row.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Fixed value: longest value text that is shown before it is cut.
VALUE_LIMIT = 200

# Tokens read as booleans when testing whether text parses.
BOOL_TOKENS = ["true", "false", "t", "f", "1", "0", "yes", "no", "y", "n"]

# Tokens a verdict may use.
VERDICT_TRUE = ["true", "1", "yes", "y", "ok", "pass", "passed"]
VERDICT_FALSE = ["false", "0", "no", "n", "fail", "failed"]

# Tokens that stand for a missing value in delimited text.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Text accepted as a number. Spark's own cast also takes "1.5d", which is not one.
NUMBER_PATTERN = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity))$"

# Date and time layouts tried by the parse check; one layout per entry.
DATETIME_FORMATS = [
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM",
    "yyyy/MM/dd",
    "yyyyMMdd",
    "MM/dd/yyyy",
    "dd/MM/yyyy",
    "dd-MM-yyyy",
    "MM/dd/yyyy HH:mm:ss",
    "M/d/yyyy",
    "d/M/yyyy",
    "yyyy-M-d",
    "M/d/yyyy H:mm",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "d MMM yyyy",
    "MMM d, yyyy",
    "d MMMM yyyy",
    "MMMM d, yyyy",
]

MONTHS = "january february march april may june july august september october november december".split()


def quoted(name: str) -> str:
    """A column name as an SQL identifier, dots and spaces included."""
    return "`" + name.replace("`", "``") + "`"


def sql_string(text: str) -> str:
    """A text as an SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def ref(name: str) -> Column:
    """Reference a column by its exact name."""
    return F.col(quoted(name))


def is_number_type(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def present_sql(df: DataFrame, name: str) -> str:
    """SQL for the value, with NaN turned into null: both count as missing."""
    c = quoted(name)
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return f"case when not isnan({c}) then {c} end"
    return c


def present_col(df: DataFrame, name: str) -> Column:
    """The value, with NaN turned into null."""
    return F.expr(present_sql(df, name))


def drop_missing(df: DataFrame, name: str) -> DataFrame:
    """Keep the rows where the column holds a value."""
    return df.filter(present_col(df, name).isNotNull())


def strip(column: Column) -> Column:
    """Trim white space at both ends."""
    return F.trim(column, F.lit(" \t\n\r\f\v"))


def strip_sql(text: str) -> str:
    """SQL that trims white space at both ends."""
    return f"trim(both ' \\t\\n\\r\\u000c\\u000b' from {text})"


# Shortest decimal text of a float: plain from 1e-4 up to 1e16, else ``1e+16``.
# Spark's own text has the usual sizes right. The others go through a lambda,
# which keeps the long branch out of the generated method: the JVM never
# compiles methods that grow too big.
FLOAT_TEXT = """
case when abs({c}) < 1e7D and (abs({c}) >= 1e-3D or {c} = 0) then cast({c} as string)
when {c} is not null and not isnan({c}) then transform(array(cast({c} as string)), t -> case
  when t = 'Infinity' then 'inf'
  when t = '-Infinity' then '-inf'
  when try_cast(substring_index(t, 'E', -1) as int) between -4 and 15 then regexp_replace(
    rtrim('0', cast(try_cast(t as decimal(38, 21)) as string)), '[.]$', '.0')
  else concat(
    regexp_replace(substring_index(t, 'E', 1), '[.]0$', ''),
    case when contains(t, 'E-') then 'e-' else 'e+' end,
    lpad(ltrim('-', substring_index(t, 'E', -1)),
      greatest(2, length(ltrim('-', substring_index(t, 'E', -1)))), '0'))
  end)[0] end
"""


def text_sql(name: str, dtype: T.DataType) -> str:
    """SQL for the whole text form of a column; null for a missing value.

    One text per column rather than a tree of column objects: wide tables need
    thousands of them.
    """
    c = quoted(name)
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, T.BooleanType):
        return f"case when {c} then 'True' when not {c} then 'False' end"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return FLOAT_TEXT.format(c=c)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        text = f"cast({c} as string)"
        return f"case when contains({text}, '.') then rpad({text}, 26, '0') else {text} end"
    if isinstance(dtype, T.BinaryType):
        return f"concat('<bytes len=', octet_length({c}), '>')"
    if isinstance(dtype, T.ArrayType):
        return f"case when {c} is not null then concat('<list len=', size({c}), '>') end"
    if isinstance(dtype, T.MapType):
        keys, size = f"map_keys({c})", f"size({c})"
        shown = f"array_join(transform(slice({keys}, 1, 5), k -> cast(k as string)), ', ')"
        more = f"case when {size} > 5 then concat(', …(+', {size} - 5, ')') else '' end"
        return f"case when {c} is not null then concat('<dict keys=[', {shown}, {more}, ']>') end"
    if isinstance(dtype, T.StructType):
        more = f", …(+{len(dtype.names) - 5})" if len(dtype.names) > 5 else ""
        text = f"<dict keys=[{', '.join(dtype.names[:5])}{more}]>"
        return f"case when {c} is not null then {sql_string(text)} end"
    return f"cast({c} as string)"


def text_value(name: str, dtype: T.DataType) -> Column:
    """The whole text form of a column's values; null for a missing one."""
    return F.expr(text_sql(name, dtype))


def truncate_text(column: Column, limit: int, marker: str = "…") -> Column:
    """Cut text longer than ``limit`` characters and mark the cut."""
    cut = F.concat(F.substring(column, 1, limit), F.lit(marker))
    return F.when(F.char_length(column) > limit, cut).otherwise(column)


def canonical_value(name: str, dtype: T.DataType, limit: int | None = None) -> Column:
    """Text that identifies a value in counts, distinct lists and mappings.

    Whole values are compared. With ``limit`` values that agree in so many
    first characters count as one value.
    """
    text = text_sql(name, dtype)
    if limit is None or not isinstance(dtype, (T.StringType, T.MapType, T.StructType)):
        return F.expr(text)
    return F.expr(
        f"case when char_length({text}) > {limit} then concat(substring({text}, 1, {limit}), '…') else {text} end"
    )


def canonical_col(df: DataFrame, name: str, limit: int | None = None) -> Column:
    return canonical_value(name, df.schema[name].dataType, limit)


def shown_value(column: Column) -> Column:
    """A value's text as reports show it, cut to a fixed length."""
    return truncate_text(column, VALUE_LIMIT)


def safe_string(column: Column) -> Column:
    """Text with nulls as the empty string."""
    return F.coalesce(column.cast("string"), F.lit(""))


def to_number(column: Column) -> Column:
    """Double from text, null where the text is not a number."""
    text = strip(column)
    # The first character rules most other text out before the pattern runs.
    may_be = F.substring(text, 1, 1).isin(*"0123456789+-.iI")
    return F.when(may_be & text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def number_col(df: DataFrame, name: str) -> Column:
    """The column as double; text that is no number and NaN become null."""
    dtype = df.schema[name].dataType
    if is_number_type(dtype):
        return present_col(df, name).cast("double")
    if isinstance(dtype, T.BooleanType):
        return ref(name).cast("double")
    return to_number(text_value(name, dtype))


def is_bool_token(column: Column) -> Column:
    return F.lower(strip(column)).isin(BOOL_TOKENS)


def to_verdict(column: Column) -> Column:
    """Boolean of a reported verdict given as text; null when it is neither."""
    text = F.lower(strip(column))
    number = to_number(column)
    return (
        F.when(text.isin(VERDICT_TRUE), True)
        .when(text.isin(VERDICT_FALSE), False)
        .when(number.isNotNull(), number != 0)
    )


def digit_shape(column: Column) -> Column:
    """Text with every digit as 9, fractions as ``.9``, zone offsets as ``Z``, months as ``MMM``.

    Texts that begin with neither a digit nor the name of a month give null and
    cost nothing.
    """
    text = strip(column)
    short = "|".join(m[:3] for m in MONTHS)
    may_be = ((text >= "0") & (text < ":")) | text.rlike(f"^(?i:{short})")
    shape = F.regexp_replace(F.regexp_replace(text, "[0-9]", "9"), r"(?<=:99)\.9{1,6}", ".9")
    shape = F.regexp_replace(shape, r"(?<=:99)(\.9)?(Z|[+-]99:99)$", "$1Z")
    shape = F.regexp_replace(shape, rf"\b(?i:{short})\b", "MMM")
    shape = F.regexp_replace(shape, rf"\b(?i:{'|'.join(m for m in MONTHS if len(m) > 3)})\b", "MMMM")
    return F.when(may_be, shape)


def format_shapes(fmt: str) -> list[str]:
    """The digit shapes that texts of a date-time layout may have.

    A field that the layout writes with one letter has one or two digits.
    """
    shapes = [""]
    for part in re.findall(r"'T'|SSSSSS|XXX|M{3,4}|yyyy|MM|dd|HH|mm|ss|[MdHms]|.", fmt):
        if part in ("'T'", "SSSSSS", "XXX"):
            ways = {"'T'": ["T"], "SSSSSS": ["9"], "XXX": ["Z"]}[part]
        elif part == "MMMM":
            ways = ["MMMM", "MMM"]  # May is its own short form; the parser refuses the other short ones
        elif part == "MMM":
            ways = ["MMM"]
        elif part in "MdHms":
            ways = ["9", "99"]
        else:
            ways = [re.sub("[yMdHms]", "9", part)]
        shapes = [shape + way for shape in shapes for way in ways]
    return shapes


def to_datetime(column: Column, fmt: str, shape: Column) -> Column:
    """Timestamp from text in one layout, null where the text is not in it.

    ``shape`` is the text's :func:`digit_shape`, computed once for all layouts;
    it keeps text that cannot match away from the slow parser.
    """
    text = F.initcap(strip(column)) if "MMM" in fmt else strip(column)
    return F.when(shape.isin(format_shapes(fmt)), F.try_to_timestamp(text, F.lit(fmt)))


def text_list(column: Column) -> Column:
    """Array of names from text that is a JSON list or one bare name."""
    raw = strip(column)
    listed = F.when(raw.startswith("[") & raw.endswith("]"), F.from_json(raw, "array<string>"))
    items = F.coalesce(listed, F.array(raw))
    cleaned = F.transform(items, lambda x: F.regexp_replace(strip(x), "^['\"]+|['\"]+$", ""))
    return F.array_distinct(F.filter(cleaned, lambda x: x.isNotNull() & (x != "")))


def strip_query(column: Column) -> Column:
    return F.substring_index(column, "?", 1)


def file_name(column: Column) -> Column:
    return F.element_at(F.split(strip_query(column), "/"), -1)


def parent_name(column: Column) -> Column:
    parts = F.split(strip_query(column), "/")
    return F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise("")


def extension(column: Column) -> Column:
    """Lower-case extension without the dot; empty when there is none."""
    return F.lower(F.regexp_extract(file_name(column), r".\.([^.]+)$", 1))


def rate_sql(part: str, whole: str, digits: int = 6) -> str:
    """Rounded share, 0.0 for an empty whole."""
    return f"round(case when {whole} > 0 then cast({part} as double) / {whole} else 0.0D end, {digits})"


def rate(part: Column, whole: Column, digits: int = 6) -> Column:
    """Rounded share, 0.0 for an empty whole."""
    return F.round(F.when(whole > 0, part / whole).otherwise(0.0).cast("double"), digits)


def any_of(conditions: Sequence[Column]) -> Column:
    result = F.lit(False)
    for condition in conditions:
        result = result | condition
    return result
