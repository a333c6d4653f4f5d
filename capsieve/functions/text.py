"""Text expressions: decoding, normalisation, comparison keys and tokens.

Spark has no NFKC and no full case folding, so both go through Arrow UDFs. Text made only of
characters which NFKC leaves alone never reaches Python: such rows are handed to the UDF as nulls
and take the native branch.
"""

from __future__ import annotations

import codecs
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that NFKC maps to themselves, none of which combines with its predecessor,
# and whose case folding is lower-casing plus the sharp-s rule.
STABLE_RANGES = (
    r"\x00-\x7f\u00a1\u00a7\u00ab\u00b0\u00bb\u00bf\u00c0-\u0131\u0134-\u013e\u0141-\u0148"
    r"\u014a-\u017e\u2013\u2014\u2018\u2019\u201c\u201d\u20ac\u3001\u3002\u3008-\u3011"
    r"\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff"
)

# The punctuation that captions drop.
DROPPED_MARKS = "，。！？；：、…“”‘’《》【】,.!?;:"
_ASCII_MARKS = "".join(filter(str.isascii, DROPPED_MARKS))

# Fixed value: engine markup such as <|en|>.
ENGINE_TAG = r"<\|[^|>]+\|>"

# Fixed value: words with inner joiners, and numbers.
TOKEN_PATTERN = r"[A-Za-z]+(?:[._+#/-][A-Za-z0-9]+)*|\p{Nd}+(?:\.\p{Nd}+)?"

# White space characters, the separators U+001C..U+001F among them.
_WIDE = r"\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = rf"[\t-\r\x1c-\x20{_WIDE}]"
_ODD_SPACE = rf"[\t-\r\x1c-\x1f{_WIDE}]"
ANSI_CSI = r"\x1b\[[0-9;?]*[A-Za-z]"


def needs_unicode(text: Column) -> Column:
    """True when the text holds a character outside the NFKC-stable ranges.

    ASCII is told by its length; only other characters are looked up in the ranges.
    """
    return (F.octet_length(text) > F.char_length(text)) & text.rlike(rf"[^\x00-\x7f](?<![{STABLE_RANGES}])")


def by_need(rows: DataFrame, build: Callable[[DataFrame, bool], DataFrame], text: str = "text") -> DataFrame:
    """``build(rows, stable)`` of the rows whose text is stable and of the others, as one table.

    A Python UDF costs each row the way to its worker and back, nulls too; with ``stable`` the rules below have none.
    """
    hard = F.coalesce(needs_unicode(F.col(text)), F.lit(False))
    return build(rows.where(~hard), True).unionByName(build(rows.where(hard), False))


def _map(values: pd.Series, fn) -> pd.Series:
    return pd.Series([None if v is None else fn(v) for v in values], dtype=object)


def _compare(value: str) -> str:
    folded = unicodedata.normalize("NFKC", value).casefold()
    return "".join(filter(str.isalnum, folded))


@F.pandas_udf(T.StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return _map(values, lambda v: unicodedata.normalize("NFKC", v))


@F.pandas_udf(T.StringType())
def _casefold(values: pd.Series) -> pd.Series:
    return _map(values, str.casefold)


@F.pandas_udf(T.StringType())
def _comparison(values: pd.Series) -> pd.Series:
    return _map(values, _compare)


def _native_or(text: Column, native: Column, udf, stable: bool = False) -> Column:
    return native if stable else F.coalesce(udf(F.when(needs_unicode(text), text)), native)


def _lower(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def nfkc(text: Column, stable: bool = False) -> Column:
    return _native_or(text, text, _nfkc, stable)


def casefold(text: Column) -> Column:
    return _native_or(text, _lower(text), _casefold)


def comparison_text(text: Column, stable: bool = False) -> Column:
    """NFKC, case folding, letters and digits only; ``stable`` as in :func:`by_need`."""
    native = F.regexp_replace(_lower(text), r"[^\p{L}\p{N}]", "")
    return _native_or(text, native, _comparison, stable)


def token_set(text: Column) -> Column:
    """Distinct case-folded words and numbers."""
    return tokens_of(nfkc(text))


def tokens_of(normal: Column) -> Column:
    found = F.regexp_extract_all(normal, F.lit(TOKEN_PATTERN), F.lit(0))
    return F.array_distinct(F.transform(found, F.lower))


@lru_cache(maxsize=1)
def _digit_class() -> str:
    """Digits that survive NFKC: the decimal ones, and those with a digit value of another category."""
    odd = (
        chr(cp)
        for cp in range(0x110000)
        if chr(cp).isdigit()
        and unicodedata.category(chr(cp)) != "Nd"
        and unicodedata.is_normalized("NFKC", chr(cp))
    )
    return r"\p{Nd}" + "".join(rf"\x{{{ord(c):x}}}" for c in odd)


def collapse_space(text: Column) -> Column:
    """Runs of white space to one plain space, none at the ends. Lone plain spaces are not touched."""
    # The second branch starts with a cheap class that no letter or mark of common scripts is in.
    odd = rf"[^\x20-\x7e\xa1-\u167f\u3001-\uffff](?<={_ODD_SPACE}){SPACE}*"
    return F.trim(F.regexp_replace(text, f"\x20{SPACE}+|{odd}", " "))


def strip_space(text: Column) -> Column:
    return strip_right(strip_left(text))


def strip_left(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{SPACE}+", "")


def strip_right(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?<!{SPACE}){SPACE}+\z", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(SPACE.replace("[", "[^", 1))


def drop_marks(text: Column) -> Column:
    """Punctuation by context; look-arounds read the neighbours before any replacement.

    A dot stays between two ASCII letters or digits, a colon between two digits. Every other mark
    becomes a space between two ASCII letters or digits, and nothing elsewhere. Patterns start with
    the mark, so that other characters are passed over at once.
    """
    word, digit = "[A-Za-z0-9]", f"[{_digit_class()}]"
    mark = rf"[{_ASCII_MARKS}\u2018-\uffff](?<=[{DROPPED_MARKS}])"
    spaced = F.regexp_replace(text, rf"{mark}(?<={word}[^.])(?={word})(?!(?<={digit}:){digit})", " ")
    kept = rf"(?!(?<={word}\.){word})(?!(?<={digit}:){digit})"
    return F.regexp_replace(spaced, f"{mark}{kept}", "")


def normalize_text(text: Column, stable: bool = False) -> Column:
    """Caption text: NFKC, no engine tags, no marks, single spaces; ``stable`` as in :func:`by_need`."""
    plain = F.regexp_replace(nfkc(text, stable), ENGINE_TAG, "")
    return collapse_space(drop_marks(F.regexp_replace(plain, r"[\r\n\t]+", " ")))


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, ANSI_CSI, "")


# Byte order marks, longest first.
_MARKED = (
    (codecs.BOM_UTF8, "utf-8"),
    (codecs.BOM_UTF16_LE, "utf-16-le"),
    (codecs.BOM_UTF16_BE, "utf-16-be"),
)


def _decode(payload: bytes) -> tuple[str | None, str | None, bool]:
    for bom, encoding in _MARKED:
        if payload.startswith(bom):
            trials, payload, marked = (encoding,), payload[len(bom) :], True
            break
    else:
        trials, marked = ("utf-8", "gb18030"), False
    for encoding in trials:
        try:
            return payload.decode(encoding), encoding, marked
        except UnicodeDecodeError:
            pass
    return None, None, marked


@F.pandas_udf(
    T.StructType()
    .add("text", T.StringType())
    .add("encoding", T.StringType())
    .add("bom", T.BooleanType())
)
def _decode_udf(values: pd.Series) -> pd.DataFrame:
    rows = [(None, None, None) if v is None else _decode(bytes(v)) for v in values]
    return pd.DataFrame(rows, columns=["text", "encoding", "bom"]).astype(object)


def decode_text(content: Column) -> Column:
    """STRUCT<text, encoding, bom>; all but ``bom`` null when the bytes cannot be decoded."""
    head = F.hex(F.substring(content, 1, 3))
    plain = F.is_valid_utf8(content.cast("string")) & ~head.rlike("^(EFBBBF|FFFE|FEFF)")
    native = F.struct(
        content.cast("string").alias("text"),
        F.lit("utf-8").alias("encoding"),
        F.lit(False).alias("bom"),
    )
    return F.when(plain, native).otherwise(_decode_udf(F.when(~plain, content)))


def initial_state(content: Column, exists: Column | None = None) -> Column:
    """missing / zero_byte / whitespace_only / nonempty; undecodable bytes count as nonempty."""
    text = decode_text(content)["text"]
    missing = content.isNull() if exists is None else ~F.coalesce(exists, F.lit(False))
    return (
        F.when(missing, "missing")
        .when(F.octet_length(content) == 0, "zero_byte")
        .when(F.coalesce(is_blank(text), F.lit(False)), "whitespace_only")
        .otherwise("nonempty")
    )
