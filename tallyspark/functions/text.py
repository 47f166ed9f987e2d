"""Normalising descriptions and telling items from item codes and report furniture."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tallyspark.functions.binding import let

# What a spreadsheet trims as white space.
WHITE = r"\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
WHITE_CHARACTERS = " \t\n\x0b\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

# Shorthand of the trade and the word it stands for.
ABBREVIATIONS = {
    "frt": "front",
    "fr": "front",
    "rr": "rear",
    "assy": "assembly",
    "lh": "left",
    "lhs": "left",
    "rh": "right",
    "rhs": "right",
    "hi": "hilux",
}

# Units that may open a description without being a code.
UNIT_WORDS = (
    "no", "nr", "size", "mm", "cm", "m", "in", "inch", "kg", "g", "ml", "l",
    "pcs", "pc", "pair", "pr", "set", "ft", "feet", "ea", "roll", "box",
)

# Labels that may open a pasted description.
LABEL_WORDS = (
    "vendor", "supplier", "sku", "brand", "mfr", "manufacturer", "item",
    "code", "ref", "reference", "stock", "model", "art",
)

# Whole descriptions that are footers.
FOOTERS = (
    "total", "subtotal", "sub total", "grand total", "grandtotal",
    "total amount", "amount", "amount due", "amount payable",
    "balance", "balance due", "continuation", "continued",
    "nothing follows", "end of report", "end of list", "end of file",
)

# Shapes of codes, sizes and markers.
CODE_SHAPE = r"(?i)^[a-z0-9]+([-/][a-z0-9]+)*\z"
SIZE_SHAPE = r"^[0-9]+(x[0-9]+)+\z"
LEADING_CODE_SHAPE = r"^[a-z][a-z0-9]*[0-9][a-z0-9]*\z"
PAGE_SHAPE = r"^(page|pg|p)\s*[0-9]+\z"
TOTAL_SHAPE = r"^((grand|sub)\s+)*total(\s+[0-9][0-9,.]*)?\z"


def js_trim(s: Column) -> Column:
    """Without leading and trailing white space, no-break spaces included."""
    return F.btrim(s, F.lit(WHITE_CHARACTERS))


def is_blank(s: Column) -> Column:
    return s.isNull() | (js_trim(s) == "")


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.str.normalize("NFKC")


def fold_compatibility(df: DataFrame, column: str) -> DataFrame:
    """Unicode compatibility folding (NFKC) of one column.

    Spark has no expression for it, so rows that hold a character beyond ASCII take a
    vectorised function; all others stay in the JVM.
    """
    wide = F.coalesce(F.col(column).rlike(r"[^\x00-\x7F]"), F.lit(False))
    folded = df.filter(wide).withColumn(column, _nfkc(F.col(column)))
    return df.filter(~wide).unionByName(folded)


def join_sizes(s: Column) -> Column:
    """``27 x 40 x 6`` and ``27 40 6`` become ``27x40x6``; of a longer run four numbers at a time."""
    further = r"(?:\s*(x)\s*([0-9]+))?"
    joined = F.regexp_replace(s, rf"([0-9]+)\s*x\s*([0-9]+){further}{further}", "$1x$2$3$4$5$6")
    joined = F.regexp_replace(joined, r"\b([0-9]{1,3}) ([0-9]{1,3}) ([0-9]{1,3})\b", "$1x$2x$3")
    return F.when(s.rlike(r"[0-9]\s*x\s*[0-9]|[0-9] [0-9]"), joined).otherwise(s)  # most have none: one pattern, not two


def expand_abbreviations(s: Column) -> Column:
    """Shorthand tokens become the word they stand for."""
    out = F.regexp_replace(s, r"\bhi lux\b", "hilux")
    words: dict[str, list[str]] = {}
    for short, word in ABBREVIATIONS.items():
        words.setdefault(word, []).append(short)
    for word, shorts in words.items():
        out = F.regexp_replace(out, rf"\b({'|'.join(shorts)})\b", word)
    some = rf"\b(hi lux|{'|'.join(ABBREVIATIONS)})\b"
    return F.when(s.rlike(some), out).otherwise(s)


def normalize_description(s: Column) -> Column:
    """The key that descriptions are compared by: lower case, words of a-z and 0-9 in their
    order, sizes joined, shorthand expanded.  Null becomes empty.

    Fold compatibility characters first (:func:`fold_compatibility`) where they can occur.
    """
    ascii_ = F.translate(F.coalesce(s, F.lit("")), "\u00D7\u2715", "xx")
    plain = F.trim(F.regexp_replace(F.lower(ascii_), "[^a-z0-9]+", " "))
    return let(plain, lambda p: let(join_sizes(p), expand_abbreviations))


def preflight_key(s: Column) -> Column:
    """The looser key of the duplicate check: separators collapse, a trailing one stays;
    names with characters beyond ASCII use the full key."""
    loose = F.ltrim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))
    return F.when(s.rlike(r"[^\x00-\x7F]"), normalize_description(s)).otherwise(loose)


def tokens(s: Column) -> Column:
    """Words between blanks, repeats included."""
    return F.filter(F.split(s, " "), lambda t: t != "")


def _words(name: Column) -> Column:
    return F.split(js_trim(name), rf"[{WHITE}]+")


def _unwrap(token: Column) -> Column:
    return F.regexp_replace(token, r"^[(\[{]+|[)\]}]+\z", "")


def _code_like(token: Column) -> Column:
    return ~token.rlike(SIZE_SHAPE) & token.rlike(CODE_SHAPE) & token.rlike("[0-9]")


def is_code_first(token: Column) -> Column:
    return _code_like(_unwrap(token))


def is_code_last(token: Column) -> Column:
    bare = _unwrap(token)
    return _code_like(bare) & (bare.rlike("(?i)[a-z]") | (F.length(bare) >= 5))


def first_and_last(name: Column) -> tuple[Column, Column, Column]:
    """Number of words, first word, last word."""
    words = _words(name)
    return F.size(words), F.get(words, F.lit(0)), F.element_at(words, -1)


def bare_code(token: Column) -> Column:
    """A code token as the distinct count sees it."""
    return F.lower(_unwrap(token))


def strip_code(name: Column, mode: str, pattern: str | None = None) -> Column:
    """A claim's name without its item code.

    ``mode``: none, firstToken, lastToken, regex (the first match of ``pattern`` goes; a
    pattern that isn't valid changes nothing), or auto (a code at the start, else at the end).
    Names of one word, and those that nothing would be left of, stay.
    """
    if mode == "regex" and not _valid_pattern(pattern):
        return js_trim(name)
    return let(_parts(name), lambda p: _stripped(p["name"], p["words"], mode, pattern))


def strip_codes(name: Column, modes: dict[str, tuple[str, str | None]]) -> Column:
    """A struct of :func:`strip_code` by several (mode, pattern); the name is cut into words once."""
    trimmed = lambda mode, pattern: mode == "regex" and not _valid_pattern(pattern)
    return let(_parts(name), lambda p: F.struct(*[(p["name"] if trimmed(*m) else _stripped(p["name"], p["words"], *m)).alias(c) for c, m in modes.items()]))


def _parts(name: Column) -> Column:
    return F.struct(js_trim(name).alias("name"), _words(name).alias("words"))


def _stripped(trimmed: Column, words: Column, mode: str, pattern: str | None) -> Column:
    n = F.size(words)
    head = F.array_join(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), " ")
    tail = F.array_join(F.slice(words, 2, F.greatest(n - 1, F.lit(0))), " ")
    if mode == "none":
        out = trimmed
    elif mode == "firstToken":
        out = tail
    elif mode == "lastToken":
        out = head
    elif mode == "regex":
        first = F.regexp_replace(trimmed, rf"(?s)\A(.*?)(?:{pattern or ''})(.*)\z", r"$1 " + f"${_groups(pattern) + 2}")
        out = js_trim(F.regexp_replace(first, rf"[{WHITE}]+", " "))
    else:
        out = F.when(is_code_first(F.get(words, F.lit(0))), tail).when(is_code_last(F.element_at(words, -1)), head).otherwise(trimmed)
    return F.when(n < 2, trimmed).otherwise(F.coalesce(F.nullif(out, F.lit("")), trimmed))


def _groups(pattern: str | None) -> int:
    import re

    return re.compile(pattern or "").groups


def _valid_pattern(pattern: str | None) -> bool:
    import re

    try:
        re.compile(pattern or "")
    except re.error:
        return False
    return True


def strip_leading_code(cleaned: Column) -> Column:
    """A normalised description without a stray code or label in front; null if it has none."""
    return let(tokens(cleaned), _without_leading_code)


def _without_leading_code(words: Column) -> Column:
    n = F.size(words)
    first, second = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    rest = lambda k: F.nullif(F.array_join(F.slice(words, k + 1, F.greatest(n - k, F.lit(0))), " "), F.lit(""))
    code = lambda s: (F.length(s) >= 4) & s.rlike(LEADING_CODE_SHAPE) & s.rlike("[a-z]{2}")
    return (
        F.when((n < 2) | first.isin(*UNIT_WORDS), F.lit(None).cast("string"))
        .when((n >= 3) & ~first.rlike("[0-9]") & code(F.concat(first, second)), rest(2))
        .when(code(first), rest(1))
        .when(first.isin(*LABEL_WORDS), rest(1))
    )


def is_non_item(cleaned: Column) -> Column:
    """Footers, page markers and rows of digits only."""
    c = js_trim(cleaned)
    return (c == "") | c.isin(*FOOTERS) | ~c.rlike("[a-z]") | c.rlike(PAGE_SHAPE) | c.rlike(TOTAL_SHAPE)


def column_letters(index: int) -> str:
    """0 is A, 26 is AA."""
    out, n = "", max(index, 0)
    while n >= 0:
        out, n = chr(65 + n % 26) + out, n // 26 - 1
    return out


def snippet(s: Column, most: int = 60) -> Column:
    """For display: white space collapsed, long texts cut with an ellipsis."""
    shown = js_trim(F.regexp_replace(s, rf"[{WHITE}]+", " "))
    return F.when(F.length(shown) > most, F.concat(F.substring(shown, 1, most - 1), F.lit("…"))).otherwise(shown)
