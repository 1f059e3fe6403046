"""Positions of pattern matches as column expressions.

A text may hold very many matches, so nothing here appends to an array step by
step: running sums and maxima are made for all places at once, in as many rounds
as the number of places has binary digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

SPAN = "struct<start:int,end:int,match:string>"

# Characters of a piece of a text that is cut at positions; looking one up costs a piece, not the text.
PIECE = 256


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Array of ``join`` of all values up to each place; ``join`` is associative, such as a sum or a maximum.

    In round r every place takes in the place 2 ** r before it, which by then stands for 2 ** r values.
    """
    reach = F.filter(F.array(*[F.lit(1 << r) for r in range(31)]), lambda r: r < F.size(values))

    def step(held: Column, back: Column) -> Column:
        return F.transform(held, lambda x, i: F.when(i >= back, join(F.get(held, i - back), x)).otherwise(x))

    return F.aggregate(reach, values, step)


def match_spans(text: Column, pattern: str | Column) -> Column:
    """Array of (start, end, match) of the leftmost matches that do not overlap.

    Positions count code points from 0; the end is exclusive. The pattern must
    not match the empty text. The pieces between the matches and the matches
    themselves alternate, so their lengths give the positions.
    """
    given = pattern if isinstance(pattern, Column) else F.lit(pattern)

    def placed(found: Column) -> Column:
        between = F.slice(F.split(text, given, -1), F.lit(1), F.size(found))
        lengths = F.zip_with(between, found, lambda gap, match: F.length(gap) + F.length(match))
        ends = bound(lengths, lambda n: running(n, lambda a, b: a + b))
        return F.zip_with(
            found, ends,
            lambda match, end: F.struct((end - F.length(match)).alias("start"), end.alias("end"), match.alias("match")),
        )

    none = F.array().cast(f"array<{SPAN}>")
    return bound(
        F.regexp_extract_all(text, given, F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(none)
    )


def marked_spans(text: Column, kind: str, order: int, pattern: str, keep: Callable[[Column], Column], may: Column) -> Column:
    """Spans of a kind that pass ``keep`` as (start, order, end, kind, match).

    ``may`` tells cheaply whether a text can hold a match at all.
    """
    spans = F.filter(match_spans(text, pattern), lambda s: keep(s["match"]))
    return F.transform(
        F.when(may, spans).otherwise(F.array().cast(f"array<{SPAN}>")),
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"),
            F.lit(kind).alias("kind"), s["match"].alias("match"),
        ),
    )


MARKED = "struct<start:int,order:int,end:int,kind:string,match:string>"


def described(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def n_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def merged(spans: Column) -> Column:
    """Sorted spans with those that overlap made one: (start, end, kind), the kind being the first one's."""
    def made(s: Column) -> Column:
        return bound(running(F.transform(s, lambda x: x["end"]), F.greatest), lambda upto: joined(s, upto))

    def joined(s: Column, upto: Column) -> Column:
        """``upto`` is the greatest end so far; a span that begins there or later is the first of a new one."""
        numbered = F.transform(
            s, lambda x, i: F.struct(i.alias("i"), x["start"].alias("start"), x["kind"].alias("kind"))
        )
        first = F.filter(numbered, lambda x: (x["i"] == 0) | (x["start"] >= F.get(upto, x["i"] - 1)))
        return bound(first, lambda f: F.transform(f, lambda x, i: F.struct(
            x["start"].alias("start"),
            F.get(upto, F.coalesce(F.get(f, i + 1)["i"], F.size(upto)) - 1).alias("end"),
            x["kind"].alias("kind"),
        )))

    return bound(spans, made)


def replaced(text: Column, spans: Column, put: Callable[[Column], Column]) -> Column:
    """The text with each of the merged spans replaced by ``put`` of the span."""
    def within(pieces: Column, begin: Column, end: Column) -> Column:
        """Characters from ``begin`` to before ``end``."""
        def part(j: Column) -> Column:
            skip = F.greatest(begin - j * PIECE, F.lit(0))
            return F.substring(F.get(pieces, j), skip + 1, end - j * PIECE - skip)

        places = F.sequence(F.floor(begin / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int"))
        return F.when(begin < end, F.array_join(F.transform(places, part), "")).otherwise("")

    def filled(s: Column, pieces: Column) -> Column:
        def before(x: Column, i: Column) -> Column:
            return F.concat(within(pieces, F.coalesce(F.get(s, i - 1)["end"], F.lit(0)), x["start"]), put(x))

        rest = within(pieces, F.coalesce(F.get(s, F.size(s) - 1)["end"], F.lit(0)), F.length(text))
        return F.concat(F.array_join(F.transform(s, before), ""), rest)

    pieces = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % PIECE), F.lit(0))
    return bound(F.struct(spans.alias("spans"), pieces.alias("pieces")), lambda b: filled(b["spans"], b["pieces"]))
