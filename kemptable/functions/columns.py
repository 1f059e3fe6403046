"""Column names and column selection; no job runs here."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, types as T

from ..functions.values import is_number_type, ref


class MissingColumn(ValueError):
    """A named column is not in the table."""


class EmptyData(ValueError):
    """The table has nothing the operator can work on."""


class InvalidArgs(ValueError):
    """An argument cannot be used."""


def normalize_name(name: object) -> str:
    return str(name).strip().strip("\"'")


def normalize_columns(df: DataFrame) -> DataFrame:
    """Trim white space, then surrounding quotes, from every column name."""
    names = [normalize_name(c) for c in df.columns]
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise InvalidArgs(f"column names are not unique after normalising: {repeated}")
    return df if names == df.columns else df.toDF(*names)


def require_columns(df: DataFrame, names: Sequence[str]) -> list[str]:
    """The normalised names, or MissingColumn; checked on the schema alone."""
    wanted = [normalize_name(n) for n in names]
    absent = [n for n in wanted if n not in df.columns]
    if absent:
        raise MissingColumn(f"columns not found: {absent}")
    return wanted


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_number_type(f.dataType)]


def other_columns(df: DataFrame, most: int | None = None) -> list[str]:
    names = [f.name for f in df.schema.fields if not is_number_type(f.dataType)]
    return names if most is None else names[:most]


def choose_columns(df: DataFrame, columns: Sequence[str] | None = None, max_columns: int | None = None) -> list[str]:
    """The named columns, or the first ``max_columns`` of the table."""
    if columns:
        return require_columns(df, columns)
    return list(df.columns) if max_columns is None else list(df.columns[:max_columns])


def flatten_struct(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested struct fields as top-level columns named ``a.b``; lists stay."""

    def leaves(fields, path, label):
        for field in fields:
            here, name = path + [field.name], label + [field.name]
            if isinstance(field.dataType, T.StructType) and field.dataType.fields:
                yield from leaves(field.dataType.fields, here, name)
            else:
                yield here, sep.join(name)

    picked = []
    for path, name in leaves(df.schema.fields, [], []):
        column = ref(path[0])
        for step in path[1:]:
            column = column.getField(step)
        picked.append(column.alias(name))
    return df.select(*picked)
