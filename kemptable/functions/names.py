"""Text repair that needs Unicode tables or codecs Spark does not carry.

Vectorised pandas functions; use them on name-like columns, not in hot paths.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Fixed value: characters a file name may keep (letters, digits, dot, dash,
# underscore, Hangul syllables and compatibility jamo).
KEPT_IN_NAMES = "A-Za-z0-9._\\-가-힣ㄱ-ㅎㅏ-ㅣ"

# Single-byte codecs whose output may have to be undone.
CP437, LATIN_1 = "cp437", "latin-1"


@F.pandas_udf(T.StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def nfc(column: Column) -> Column:
    """Unicode composed form; ASCII text is composed and never leaves the JVM."""
    return _where_not_ascii(column, _composed)


def _where_not_ascii(column: Column, repair) -> Column:
    plain = column.isNull() | ~column.rlike(r"[^\x00-\x7F]")
    return F.when(plain, column).otherwise(repair(F.when(~plain, column)))


def _bytes_of(text: str, codec: str) -> bytes | None:
    try:
        return text.encode(codec)
    except UnicodeEncodeError:
        return None


def _decoded(raw: bytes, codec: str) -> str | None:
    try:
        return raw.decode(codec)
    except UnicodeDecodeError:
        return None


def _all_syllables(text: str) -> bool:
    """Whether every character beyond ASCII is a Hangul syllable, at least two of them."""
    wide = [c for c in text if c > "\x7f"]
    return len(wide) > 1 and all("가" <= c <= "힣" for c in wide)


def best_reading(text: str) -> str:
    """Text as it was before a wrong single-byte decoding, where its bytes prove one; NFC.

    Bytes that form valid UTF-8 beyond ASCII hardly ever do so by accident, so
    they decide first, those of Latin-1 before those of CP437. Almost any bytes
    are valid CP949, so such a reading must turn all of them into syllables.
    """
    if not text.isascii():
        raw = [r for r in (_bytes_of(text, LATIN_1), _bytes_of(text, CP437)) if r is not None]
        proven = (d for r in raw if (d := _decoded(r, "utf-8")) is not None)
        likely = (d for r in reversed(raw) if (d := _decoded(r, "cp949")) is not None and _all_syllables(d))
        text = next(proven, None) or next(likely, None) or text
    return unicodedata.normalize("NFC", text)


@F.pandas_udf(T.StringType())
def _repaired(texts: pd.Series) -> pd.Series:
    return texts.map(best_reading, na_action="ignore")


def repair_mojibake(column: Column | str) -> Column:
    """Undo text that was decoded with the wrong single-byte codec."""
    return _where_not_ascii(F.col(column) if isinstance(column, str) else column, _repaired)


def sanitize_filename(column: Column) -> Column:
    """Last path part, composed, with every other character replaced by ``_``."""
    base = F.element_at(F.split(F.regexp_replace(column, r"/+$", ""), "/"), -1)
    return F.regexp_replace(nfc(base), f"[^{KEPT_IN_NAMES}]", "_")


def sanitize_path(column: Column) -> Column:
    """Every part of a relative path made safe; empty, ``.`` and ``..`` parts go."""
    parts = F.filter(F.split(nfc(column), "/"), lambda p: ~p.isin("", ".", ".."))
    return F.array_join(F.transform(parts, lambda p: F.regexp_replace(p, f"[^{KEPT_IN_NAMES}]", "_")), "/")
