"""Writing tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, types as T

from ..functions.columns import InvalidArgs
from ..functions.values import ref, text_value
from .arrow import write_arrow
from .storage import normalize_uri

# Other names of the output formats.
FORMAT_NAMES = {"arrow": "feather", "excel": "xlsx", "hf": "huggingface", "tab": "tsv"}
FORMATS = ("csv", "tsv", "parquet", "json", "feather")


def output_format(name: str | None) -> str:
    """The format meant by a name; csv when none is given."""
    fmt = (name or "csv").strip().lower().lstrip(".")
    fmt = FORMAT_NAMES.get(fmt, fmt)
    if fmt not in FORMATS:
        raise InvalidArgs(f"cannot write {name!r}; formats: {', '.join(FORMATS)}")
    return fmt


def flat_cells(df: DataFrame) -> DataFrame:
    """Nested and binary cells as text, for formats that hold only flat cells."""
    nested = (T.StructType, T.ArrayType, T.MapType, T.BinaryType)
    return df.withColumns({
        f.name: text_value(f.name, f.dataType) for f in df.schema.fields if isinstance(f.dataType, nested)
    }) if any(isinstance(f.dataType, nested) for f in df.schema.fields) else df


def write_table(df: DataFrame, path: str, fmt: str | None = None, mode: str = "errorifexists") -> str:
    """Write a table; an existing target is an error unless ``mode`` says otherwise."""
    kind, target = output_format(fmt), normalize_uri(path)
    if kind in ("csv", "tsv"):
        options = {"header": True, "sep": "\t" if kind == "tsv" else ",", "escape": '"'}
        flat_cells(df).write.mode(mode).options(**options).csv(target)
    elif kind == "feather":
        write_arrow(df, target, "overwrite" if mode == "overwrite" else "append")
    else:
        df.write.mode(mode).format(kind).save(target)
    return target


def publish(df: DataFrame, root: str, run_id: str | None = None, fmt: str | None = None) -> str:
    """Write under a folder of its own for this run, so nothing is replaced.

    Spark's committer stages the files; a second writer with the same run id
    gets an error instead of a mixture.
    """
    return write_table(df, f"{root.rstrip('/')}/run_id={run_id or uuid.uuid4().hex}", fmt)
