"""A cleaning recipe: named steps folded over a DataFrame.

Steps that need statistics are not run one after the other. What a step reads
and what it changes is known from its arguments, so the statistics of all steps
that no earlier one can influence are taken together: one pass for moments and
sketches, one for exact quantiles and counts of values. A step that depends on
an earlier one waits for the next round.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.columns import InvalidArgs, normalize_columns, require_columns
from ..functions.values import canonical_col, number_col, present_col
from ..operators import transforms
from ..operators.numeric import ValueCounts, moments, quantiles
from ..operators.profile import column_quality_metrics
from ..sources.text import null_tokens

STEPS = {
    "normalize_columns": normalize_columns,
    "null_tokens": null_tokens,
    "fill_missing": transforms.fill_missing,
    "drop_missing_rows": transforms.drop_missing_rows,
    "remove_outliers": transforms.remove_outliers,
    "one_hot": transforms.one_hot,
    "ordinal_encode": transforms.ordinal_encode,
    "date_parts": transforms.date_parts,
    "cast_types": transforms.cast_types,
    "scale": transforms.scale,
    "safe_strings": transforms.safe_strings,
    "apply_mapping": transforms.apply_mapping,
    "image_column_to_path": transforms.image_column_to_path,
    "summary_table": transforms.summary_table,
}


def rename(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Rename columns; names must exist."""
    return df.withColumnsRenamed(dict(zip(require_columns(df, list(columns)), columns.values())))


def select(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep the named columns, in that order."""
    return df.select(*require_columns(df, columns))


STEPS.update(rename=rename, select=select)


# Steps that only add columns or change the named ones, without statistics: argument -> columns that change.
CHANGED = {
    "null_tokens": lambda df, a: a.get("columns") or df.columns,
    "cast_types": lambda df, a: list(a["spec"]),
    "safe_strings": lambda df, a: a["columns"],
    "date_parts": lambda df, a: [f"{a['column']}_{p}" for p in a.get("parts", transforms.DATE_PARTS)],
    "apply_mapping": lambda df, a: [a.get("output") or f"{a['column']}_mapped"],
    "ordinal_encode": lambda df, a: [a.get("output") or f"{a['column']}_code"],
    "image_column_to_path": lambda df, a: [a["column"]],
}
# The columns that such a step names.
READ = {
    "null_tokens": lambda a: a.get("columns") or [], "cast_types": lambda a: list(a["spec"]),
    "safe_strings": lambda a: a["columns"], "rename": lambda a: list(a["columns"]), "select": lambda a: a["columns"],
}
WITH_STATISTICS = ("fill_missing", "remove_outliers", "one_hot", "scale")


@dataclass
class Needs:
    """Statistics wanted of the table of a round, by its column names."""

    moments: set[str] = field(default_factory=set)
    points: dict[str, set[float]] = field(default_factory=dict)
    modes: set[str] = field(default_factory=set)
    # Column -> most categories, and the outlier step (column, lower, upper) whose rows alone count.
    categories: dict[str, tuple[int, tuple | None]] = field(default_factory=dict)


class Round:
    """Steps whose statistics come from one table, and where each of its columns is now."""

    def __init__(self, df: DataFrame):
        self.df, self.needs = df, Needs()
        self.steps: list[tuple[str, dict]] = []
        self.origin: dict[str, str | None] = {c: c for c in df.columns}
        self.filter: tuple | None = None

    def takes(self, op: str, args: Mapping) -> bool:
        """Note what the step needs; False if that depends on a step of this round."""
        wanted = Needs()
        if op in WITH_STATISTICS:
            if args.get("accuracy") is not None or not self._want(op, args, wanted):
                return False
        elif op not in CHANGED and op not in ("rename", "select"):
            return False
        elif not all(c in self.origin for c in READ.get(op, lambda a: [a["column"]])(args)):
            return False  # a name to be normalised, or an error that the step itself reports
        self.needs.moments |= wanted.moments
        for c, p in wanted.points.items():
            self.needs.points.setdefault(c, set()).update(p)
        self.needs.modes |= wanted.modes
        self.needs.categories |= wanted.categories
        self._follow(op, args)
        self.steps.append((op, dict(args)))
        return True

    def _want(self, op: str, args: Mapping, wanted: Needs) -> bool:
        named = {"fill_missing": lambda: list(args["rules"]), "scale": lambda: list(args["columns"])}
        names = named.get(op, lambda: [args["column"]])()
        sources = {c: self.origin.get(c) for c in names}
        if any(s is None for s in sources.values()):
            return False
        if op == "one_hot":
            source, limit = sources[args["column"]], args.get("max_categories", transforms.MOST_CATEGORIES)
            if self.filter and None not in self.filter[1:] or source in self.needs.categories:
                return False  # a row within both limits can not be told from the range of a category
            wanted.categories[source] = (limit, self.filter)
            return True
        if self.filter:
            return False
        if op == "fill_missing":
            for c, rule in args["rules"].items():
                if rule == "mean":
                    wanted.moments.add(sources[c])
                elif rule == "median":
                    wanted.points.setdefault(sources[c], set()).add(0.5)
                elif rule == "mode":
                    if not isinstance(self.df.schema[sources[c]].dataType, T.StringType):
                        return not self.steps  # found by the step itself
                    wanted.modes.add(sources[c])
        elif op == "scale":
            wanted.moments |= set(sources.values())
        else:
            points = {args.get("lower_quantile"), args.get("upper_quantile", 0.99)} - {None}
            wanted.points.setdefault(sources[args["column"]], set()).update(points)
        return True

    def _follow(self, op: str, args: Mapping) -> None:
        """Where the columns are after the step."""
        if op == "rename":
            self.origin = {args["columns"].get(c, c): s for c, s in self.origin.items()}
        elif op == "select":
            self.origin = {c: self.origin.get(c) for c in args["columns"]}
        elif op == "fill_missing":
            self.origin.update(dict.fromkeys(args["rules"]))
        elif op == "scale":
            self.origin.update(dict.fromkeys(f"{c}{args.get('suffix', '')}" for c in args["columns"]))
        elif op == "remove_outliers":
            column = args["column"]
            if not args.get("clip"):
                self.filter = (self.origin[column], args.get("lower_quantile"), args.get("upper_quantile", 0.99))
            self.origin[column] = None  # its values are others now
        elif op == "one_hot":
            # Its columns are not known yet; they are new, and may replace others of their name.
            prefix = f"{args['column']}_"
            self.origin = {c: None if c.startswith(prefix) else s for c, s in self.origin.items()}
            if not args.get("keep", True):
                self.origin[args["column"]] = None
        else:
            self.origin.update(dict.fromkeys(CHANGED[op](self.df, args)))

    def statistics(self) -> transforms.Statistics:
        """All statistics of the round: one pass for moments and sketches, one for quantiles and values."""
        needs, df = self.needs, self.df
        points = {c: sorted(p) for c, p in needs.points.items()}
        found = moments(df, sorted(needs.moments | set(points)), points)
        texts = {f"mode {c}": (present_col(df, c), None) for c in needs.modes}
        for c, (_, kept) in needs.categories.items():
            texts[f"category {c}"] = (canonical_col(df, c), number_col(df, kept[0]) if kept else None)
        values = ValueCounts(texts)
        cuts = quantiles(df, points, known=found, texts=values if texts else None) if points else {}
        values.count(df)
        told = transforms.Statistics(moments=found, quantiles=cuts)
        for c in needs.modes:
            row = values.counted.filter(F.col("slot") == f"mode {c}").orderBy(F.desc("cnt"), "s").limit(1).first()
            told.modes[c] = row["s"] if row else None
        for c, (limit, kept) in needs.categories.items():
            rows = values.counted.filter(F.col("slot") == f"category {c}")
            if kept:
                column, low, high = kept
                rows = rows.filter(F.col("least").isNotNull())
                if high is not None and cuts[(column, high)] is not None:
                    rows = rows.filter(F.col("least") <= cuts[(column, high)])
                if low is not None and cuts[(column, low)] is not None:
                    rows = rows.filter(F.col("most") >= cuts[(column, low)])
            told.categories[c] = [r["s"] for r in rows.select("s").limit(limit + 1).collect()]
        return told

    def run(self) -> DataFrame:
        """The table after the round's steps; each step is told the statistics under the names it sees."""
        told = self.statistics()
        df, place = self.df, Round(self.df)
        for op, args in self.steps:
            if op in WITH_STATISTICS:
                now = {s: c for c, s in place.origin.items() if s is not None}
                args = {**args, "known": transforms.Statistics(
                    {now[c]: m for c, m in told.moments.items() if c in now},
                    {(now[c], p): q for (c, p), q in told.quantiles.items() if c in now},
                    {now[c]: m for c, m in told.modes.items() if c in now},
                    {now[c]: v for c, v in told.categories.items() if c in now},
                )}
            df = STEPS[op](df, **args)
            place._follow(op, args)
        return df


def run_recipe(
    df: DataFrame,
    steps: Sequence[Mapping],
    check: Sequence[str] | None = None,
    placeholders: Mapping[str, Sequence] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Apply ``{"op": name, "args": {…}}`` steps in order.

    Returns the cleaned table and its quality metrics: values a cast would
    lose, values without a mapping, and the missing, empty and placeholder
    counts of the checked columns in the final table. ``check`` names columns
    as they were at the start; renames on the way are followed. Metrics are
    lazy: they run only when they are read. Steps that need no statistics of
    each other's results share their passes (:class:`Round`).
    """
    current = {c: c for c in df.columns}
    found: list[DataFrame] = []
    waiting = Round(df)
    for number, step in enumerate(steps, start=1):
        op, args = step.get("op"), dict(step.get("args") or {})
        if op not in STEPS:
            raise InvalidArgs(f"step {number}: unknown operator {op!r}; known: {sorted(STEPS)}")
        if op in ("cast_types", "apply_mapping") or not waiting.takes(op, args):
            df = waiting.run()
            waiting = Round(df)
            if op in WITH_STATISTICS and waiting.takes(op, args):
                continue
        else:
            if op == "rename":
                current = {start: args["columns"].get(now, now) for start, now in current.items()}
            continue
        if op == "cast_types":
            found.append(transforms.cast_failures(df, args["spec"]))
        if op == "apply_mapping":
            found.append(transforms.mapping_gap_metrics(df, args["column"], args["mapping"]))
        before = df.columns
        df = STEPS[op](df, **args)
        if op in ("rename", "normalize_columns"):
            moved = dict(zip(before, df.columns))
            current = {start: moved.get(now, now) for start, now in current.items()}
        waiting = Round(df)
    df = waiting.run()
    names = [current.get(c, c) for c in check] if check else [c for c in current.values() if c in df.columns]
    fills = {current.get(c, c): v for c, v in (placeholders or {}).items()}
    found.append(column_quality_metrics(df, names, fills))
    metrics = reduce(DataFrame.unionByName, found)
    return df, metrics.select("column_name", "metric", F.col("value").cast("double").alias("value"))
