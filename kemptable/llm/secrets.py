"""Secrets by patterns, and random strings by a battery of tests.

A long token is taken for random where it is not an ordinary one and passes for
random. Ordinary tokens are words and identifiers: a chain of character classes
with the letter frequencies of words, in two styles. The likelihood of a token as
an ordinary one over its likelihood as evenly drawn symbols bounds the p-value
(by Markov's inequality), which gets small at 20 characters already. Three
tests must not speak against randomness: the symbols are used evenly
(chi-squared over the alphabet that its characters suggest), the runs above and
below the middle of the alphabet are as many as chance gives, and neighbours do
not correlate. Among all tokens of one alphabet and similar length the share of
false findings is held down by the rule of Benjamini and Hochberg.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.values import ref
from ..session import cut_lineage
from .spans import MARKED, bound, described, marked_spans, match_spans, n_of, running

# Expected share of false findings among the random tokens of a stratum.
FALSE_SHARE = 0.05
# Characters that a token must have to be tested.
LEAST_TOKEN = 20
# Steps of p-values per power of ten, and the last step.
P_STEPS, LAST_STEP = 20, 400

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# Standard deviations from randomness beyond which a token does not pass for random.
FAR = 4.0
# A run of token characters; '=' pads its end and begins the next.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}+(?:={1,6}+(?![A-Za-z0-9+/_=-]))?+" % LEAST_TOKEN
# Pieces of a run between separators: words and paths are joined to keys by any of them.
PIECES = [r"%s{%d,}+=*+" % (piece, LEAST_TOKEN) for piece in ("[^/=]", "[^_=-]", "[^+/=]", "[A-Za-z0-9]")]


def _any(match: Column) -> Column:
    return F.lit(True)


def _long_value(match: Column) -> Column:
    return F.length(F.regexp_extract(match, ASSIGN, 1)) >= 8


# The second and third pattern take whole runs, so only runs that are long
# enough need to be matched at all. The last entry tells whether a text may match.
KINDS: list[tuple[str, str, Callable[[Column], Column], Callable[[Column], Column]]] = [
    ("assign", ASSIGN, _long_value, lambda t: t.rlike(ASSIGN)),
    ("access", r"AKIA[A-Z0-9]{12,}+", _any, lambda t: F.contains(t, F.lit("AKIA"))),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{32,}+", _any, lambda t: t.rlike("[0-9a-f]{32}")),
]
NAMES = [name for name, *_ in KINDS]

# Encodings in the order in which they are tried: name, pattern, alphabet.
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = [
    ("hex", r"^(?:[0-9a-f]*[0-9][0-9a-f]*|[0-9A-F]*[0-9][0-9A-F]*)$", _DIGITS + "abcdef"),
    ("base32", r"^[A-Z2-7]*[2-7][A-Z2-7]*$", _UPPER + "234567"),
    ("letters", r"^[A-Z]?[a-z]+$|^[A-Z]+$", _LOWER),
    ("base62", r"^[A-Za-z0-9]+$", _DIGITS + _UPPER + _LOWER),
    ("base64", r"^[A-Za-z0-9+/]+$", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", r"^[A-Za-z0-9_-]+$", _UPPER + _LOWER + _DIGITS + "-_"),
]
# These are written in one case; their symbols are looked up in lower or upper case.
_LOWERED = ("hex", "letters")


# Ordinary tokens. Letters of words, parts in a thousand over some European languages.
_LETTERS = dict(
    a=85, e=120, i=75, o=75, u=35, y=15, b=16, c=32, d=40, f=19, g=21, h=40, j=4, k=12, l=42, m=27, n=70, p=22, q=2, r=63, s=64,
    t=78, v=13, w=14, x=3, z=5,
)
_SEPARATORS = {"_": 0.35, "-": 0.30, "/": 0.30, "+": 0.05}
# Chances of the next class: lower vowel, lower consonant, upper vowel, upper consonant, digit, separator.
_MIXED = [
    [0.14, 0.72, 0.01, 0.03, 0.03, 0.07], [0.54, 0.33, 0.01, 0.03, 0.03, 0.06], [0.10, 0.80, 0.02, 0.04, 0.02, 0.02],
    [0.70, 0.22, 0.02, 0.03, 0.02, 0.01], [0.03, 0.06, 0.01, 0.04, 0.70, 0.16], [0.20, 0.50, 0.04, 0.11, 0.14, 0.01],
]
_CAPITALS = [
    *_MIXED[:2], [0.01, 0.02, 0.14, 0.70, 0.03, 0.10], [0.01, 0.02, 0.50, 0.34, 0.03, 0.10],
    [0.01, 0.04, 0.03, 0.06, 0.70, 0.16], [0.02, 0.05, 0.21, 0.55, 0.16, 0.01],
]


def _class(c: str) -> int:
    if c.isalpha():
        return 2 * c.isupper() + (c.lower() not in "aeiouy")
    return 4 if c.isdigit() else 5


def _emission(c: str) -> float:
    """Bits (negative) of a character within its class."""
    if c.isalpha():
        return math.log2(_LETTERS[c.lower()] / sum(n for x, n in _LETTERS.items() if _class(x) == _class(c.lower())))
    return math.log2(0.1) if c.isdigit() else math.log2(_SEPARATORS[c])


# By character code: class and bits.
_CODES = [chr(i) if chr(i).isascii() and (chr(i).isalnum() or chr(i) in _SEPARATORS) else None for i in range(128)]
_CLASS = [_class(c) if c else 0 for c in _CODES]
_EMISSION = [_emission(c) if c else 0.0 for c in _CODES]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def _tested(spans: Column) -> Column:
    """(start, end, stratum, step) of each token that has an alphabet; step is -20 log10(p), rounded down."""

    def coded(span: Column) -> Column:
        body = F.rtrim(span["match"], F.lit("="))
        name, alphabet = F.lit(None).cast("string"), F.lit("")
        for encoding, pattern, symbols in reversed(ENCODINGS):
            name = F.when(body.rlike(pattern), encoding).otherwise(name)
            alphabet = F.when(body.rlike(pattern), symbols).otherwise(alphabet)
        name = F.when(body.rlike("^[0-9]*$"), F.lit(None)).otherwise(name)  # plain numbers are no encoding
        return F.struct(
            span["start"].alias("start"), span["end"].alias("end"), name.alias("encoding"), alphabet.alias("alphabet"),
            F.when(name.isin(*_LOWERED), F.lower(body)).otherwise(body).alias("body"), body.alias("written"),
        )

    def listed(values: list) -> Column:
        return F.array(*[F.lit(v) for v in values])

    def codes(token: Column) -> Column:
        return F.transform(F.filter(F.split(token["written"], ""), lambda c: c != ""), lambda c: F.ascii(c) + 1)

    def gain(codes: Column, k: Column) -> Column:
        """Bits by which even symbols explain a token better than either style of ordinary tokens."""
        classes = F.transform(codes, lambda c: F.element_at(listed(_CLASS), c))
        steps = F.zip_with(
            F.slice(classes, F.lit(1), F.size(classes) - 1), F.slice(classes, F.lit(2), F.size(classes) - 1),
            lambda a, b: 6 * a + b + 1,
        )
        words = _sum(F.transform(codes, lambda c: F.element_at(listed(_EMISSION), c))) - math.log2(6)

        def changes(style: list[list[float]]) -> Column:
            bits = listed([math.log2(x) for row in style for x in row])
            return _sum(F.transform(steps, lambda i: F.element_at(bits, i)))

        styles = [changes(style) for style in (_MIXED, _CAPITALS)]
        return -F.size(codes) * F.log2(k) - words - F.greatest(*styles)

    def valued(token: Column) -> Column:
        symbols = F.filter(F.split(token["body"], ""), lambda c: c != "")
        values = F.transform(symbols, lambda c: (F.instr(token["alphabet"], c) - 1).cast("double"))
        return F.struct(
            token["start"].alias("start"), token["end"].alias("end"), token["encoding"].alias("encoding"),
            F.length(token["alphabet"]).cast("double").alias("k"), F.size(values).cast("double").alias("n"),
            values.alias("values"), (_sum(values) / F.size(values)).alias("mean"),
            gain(codes(token), F.length(token["alphabet"])).alias("gain"),
        )

    def measured(token: Column) -> Column:
        values, n, k = token["values"], token["n"], token["k"]
        first, second = F.slice(values, F.lit(1), F.size(values) - 1), F.slice(values, F.lit(2), F.size(values) - 1)
        squares = F.transform(F.array_distinct(values), lambda v: F.pow(F.size(F.filter(values, lambda x: x == v)), F.lit(2.0)))
        changes = F.zip_with(first, second, lambda a, b: ((a >= k / 2) != (b >= k / 2)).cast("double"))
        around = F.zip_with(first, second, lambda a, b: (a - token["mean"]) * (b - token["mean"]))
        spread = F.transform(values, lambda v: (v - token["mean"]) * (v - token["mean"]))
        return F.struct(
            token["start"].alias("start"), token["end"].alias("end"), token["encoding"].alias("encoding"),
            k.alias("k"), n.alias("n"), token["gain"].alias("gain"),
            (k / n * _sum(squares) - n).alias("chi"),
            (_sum(changes) + 1).alias("runs"),
            _sum(F.transform(values, lambda v: (v >= k / 2).cast("double"))).alias("high"),
            F.coalesce(F.try_divide(_sum(around), _sum(spread)), F.lit(1.0)).alias("serial"),
        )

    def judged(token: Column) -> Column:
        n, k = token["n"], token["k"]
        far_chi = (token["chi"] - (k - 1)) / F.sqrt(2 * (k - 1))
        both = 2 * token["high"] * (n - token["high"])
        spread = F.sqrt(F.greatest(both * (both - n) / (n * n * (n - 1)), F.lit(1e-9)))
        far_runs = F.abs(token["runs"] - both / n - 1) / spread
        far_serial = F.abs(token["serial"] + 1 / n) * F.sqrt(n)
        passes = F.greatest(far_chi, far_runs, far_serial) <= FAR
        step = F.least(F.floor(token["gain"] * (P_STEPS * math.log10(2))), F.lit(LAST_STEP))
        return F.struct(
            token["start"].alias("start"), token["end"].alias("end"),
            F.concat_ws(":", token["encoding"], F.floor(2 * F.log2(n))).alias("stratum"),
            F.when(passes, F.greatest(step, F.lit(0))).otherwise(0).cast("int").alias("step"),
        )

    tokens = F.filter(F.transform(spans, coded), lambda t: t["encoding"].isNotNull() & (F.length(t["body"]) >= LEAST_TOKEN))
    return F.transform(F.transform(F.transform(tokens, valued), measured), judged)


def _with_pieces(runs: Column) -> Column:
    """The runs and their long pieces between separators, each once."""
    def pieces(run: Column) -> Column:
        inner = F.flatten(F.array(*[match_spans(run["match"], pattern) for pattern in PIECES]))
        moved = F.transform(
            inner,
            lambda s: F.struct(
                (s["start"] + run["start"]).alias("start"), (s["end"] + run["start"]).alias("end"), s["match"].alias("match")
            ),
        )
        ordered = F.array_sort(F.concat(F.array(run), moved))
        joined = bound(ordered, lambda o: F.filter(o, lambda x, i: (i == 0) | (x != F.get(o, i - 1))))
        return F.when(run["match"].rlike("[+/_-]"), joined).otherwise(F.array(run))

    return F.flatten(F.transform(runs, pieces))


def _free(tokens: Column, base: Column) -> Column:
    """The tokens that overlap none of the spans ``base``, in order of their start.

    Both are sorted together; the greatest end of the spans up to a token and
    the least start of those from it on tell whether one overlaps it.
    """
    far = F.lit(2**31 - 1)

    def place(x: Column, is_token: bool) -> Column:
        return F.struct(x["start"].alias("start"), F.lit(is_token).alias("token"), x["end"].alias("end"))

    def apart(both: Column) -> Column:
        ends = running(F.transform(both, lambda x: F.when(x["token"], -1).otherwise(x["end"])), F.greatest)
        starts = F.transform(both, lambda x: F.when(x["token"], far).otherwise(x["start"]))
        starts = F.reverse(running(F.reverse(starts), F.least))
        return bound(F.struct(ends.alias("ends"), starts.alias("starts")), lambda upto: F.filter(
            both,
            lambda x, i: x["token"] & (F.get(upto["ends"], i) <= x["start"]) & (F.get(upto["starts"], i) >= x["end"]),
        ))

    both = F.array_sort(F.concat(
        F.transform(tokens, lambda t: place(t, True)), F.transform(base, lambda b: place(b, False))
    ))
    return F.when(F.size(tokens) > 0, bound(both, apart)).otherwise(F.array().cast("array<struct<start:int,token:boolean,end:int>>"))


def _widest(tokens: Column) -> Column:
    """The tokens without those inside an earlier, longer or equal one."""
    def outer(t: Column) -> Column:
        upto = running(F.transform(t, lambda x: x["end"]), F.greatest)
        return bound(upto, lambda u: F.filter(t, lambda x, i: (i == 0) | (x["end"] > F.get(u, i - 1))))

    ordered = F.array_sort(F.transform(
        tokens, lambda t: F.struct(t["start"].alias("start"), (-t["end"]).alias("low"), t["end"].alias("end"))
    ))
    return bound(ordered, outer)


def found_secrets(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """row, base, tested for every row of ``documents``: pattern spans, and tokens with their test."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(F.struct(*[ref(c).alias(c) for c in keep]).alias("row"), text.alias("text"))
    base = [marked_spans(F.col("text"), name, i, pattern, keep_, may(F.col("text"))) for i, (name, pattern, keep_, may) in enumerate(KINDS)]
    rows = rows.withColumn("base", F.array_sort(F.concat(*base)))
    tokens = F.when(F.col("text").rlike("[A-Za-z0-9+/_-]{%d}" % LEAST_TOKEN), match_spans(F.col("text"), TOKEN))
    tokens = F.coalesce(tokens, F.array().cast("array<struct<start:int,end:int,match:string>>"))
    rows = rows.select("row", "base", _with_pieces(tokens).alias("tokens"))
    return rows.select("row", "base", _tested(F.col("tokens")).alias("tested"))


def step_limits(found: DataFrame, false_share: float = FALSE_SHARE) -> dict[str, int]:
    """The least step of each stratum that counts as random; strata without one are left out.

    One row per stratum (alphabet and half-power of the length) and step is
    gathered, so its number is bounded whatever the size of the table.
    """
    steps = found.select(F.explode("tested").alias("t")).groupBy("t.stratum", "t.step").agg(F.count(F.lit(1)).alias("n"))
    falling = Window.partitionBy("stratum").orderBy(F.desc("step"))
    steps = steps.withColumn("found", F.sum("n").over(falling))
    steps = steps.withColumn("tests", F.sum("n").over(Window.partitionBy("stratum")))
    # All tokens up to here have p-values of at most 10 ** (-step / 20).
    good = F.pow(F.lit(10.0), -F.col("step") / P_STEPS) <= false_share * F.col("found") / F.col("tests")
    limits = steps.filter(good).groupBy("stratum").agg(F.min("step").alias("step"))
    return {r["stratum"]: r["step"] for r in limits.collect()}


def secret_spans(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",), false_share: float = FALSE_SHARE) -> DataFrame:
    """row, base, spans for every row of ``documents``.

    ``row`` is a struct of the columns ``keep``, so their names clash with none.
    ``base`` are the sorted spans of the patterns; ``spans`` adds the random
    tokens that overlap none of them, as ``random``. A token is a whole run or a
    piece of one between separators, the longest that counts. Null texts are empty.
    Tokens of all rows count in the control of false findings, repeated ones
    each time. An empty table gives no rows; other columns are not read.
    """
    found = cut_lineage(found_secrets(documents, keep))
    limits = step_limits(found, false_share)
    def least(token: Column) -> Column:
        pairs = [x for stratum, step in sorted(limits.items()) for x in (F.lit(stratum), F.lit(step))]
        table = F.create_map(*pairs) if pairs else F.create_map(F.lit(""), F.lit(LAST_STEP + 1))
        return F.coalesce(F.try_element_at(table, token["stratum"]), F.lit(LAST_STEP + 1))

    counted = F.filter("tested", lambda t: t["step"] >= least(t))
    random = F.transform(
        _widest(_free(counted, F.col("base"))),
        lambda t: F.struct(
            t["start"].alias("start"), F.lit(len(KINDS)).alias("order"), t["end"].alias("end"),
            F.lit("random").alias("kind"), F.lit("").alias("match"),
        ),
    ).cast(f"array<{MARKED}>")
    return found.select("row", "base", F.array_sort(F.concat("base", random)).alias("spans"))


def secret_digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans of each row of ``secret_spans``."""
    return found.select(
        "row.doc_id",
        *[n_of(F.col("base"), name).alias(f"n_{name}") for name in NAMES],
        F.sha2(described(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        described(F.col("spans")).alias("spans"),
    )
