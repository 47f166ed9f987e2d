"""What identifies an item: part codes, sizes and words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions.binding import let
from tallyspark.functions.text import normalize_description, tokens

# Words of packaging; with a number behind them they aren't part codes.
PACK_WORDS = (
    "BOX", "BOXES", "CARTON", "CARTONS", "CTN", "PACK", "PACKS", "PKG",
    "PKGS", "PIECE", "PIECES", "PCS", "PC", "SHEET", "SHEETS", "ROLL",
    "ROLLS", "BAG", "BAGS", "SACK", "SACKS", "SET", "SETS", "PAIR", "PAIRS",
    "DOZEN", "DZ", "KG", "KILO", "GRAM", "GRAMS", "LTR", "LITER", "LITRE",
    "LENGTH", "WIDTH", "SIZE", "QTY", "QUANTITY", "PER", "GROSS", "NET",
    "WEIGHT", "WT", "CAP",
)

# Words that say nothing about which item it is.
STOP_WORDS = (
    "for", "with", "and", "or", "of", "the", "per", "no", "nr", "size", "type",
    "new", "set", "sets", "pair", "pcs", "pc", "piece", "pieces", "box", "pack",
    "genuine", "oem", "aftermarket", "replacement", "part", "parts", "number",
)

# Shapes of part codes in running text.  The look-arounds are ASCII word
# boundaries; \b is Unicode-aware and would lose a code behind an accented letter.
_AT, _END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
CODE_IN_TEXT = (
    rf"{_AT}([0-9]{{5,6}}-[A-Z0-9]{{2,10}}){_END}",
    rf"{_AT}([A-Z]{{1,4}}[-\s][0-9]{{3,6}}[A-Z0-9]*){_END}",
    rf"{_AT}([A-Z]{{1,5}}[0-9]{{3,}}[A-Z0-9]*){_END}",
    rf"{_AT}([0-9]{{2,6}}-[0-9]{{3,6}}){_END}",
)
YEAR_IN_PAIR = r"(^|-)(19|20)[0-9]{2}(-|\z)"
SIZE_IN_TEXT = rf"{_AT}([0-9]{{1,3}}(?:\s*[X×✕]\s*[0-9]{{1,3}}){{1,3}}){_END}"
HYPHEN_SIZE = rf"{_AT}([0-9]{{1,3}}(?:-[0-9]{{1,3}}){{1,3}}){_END}"
CODES_BEFORE_SIZES = (
    rf"{_AT}[0-9]{{5}}-[A-Z0-9]{{2,10}}{_END}",
    rf"{_AT}[A-Z]{{1,4}}[-\s][0-9]{{3,6}}[A-Z0-9]*{_END}",
    rf"{_AT}[A-Z]{{1,5}}[0-9]{{3,}}[A-Z0-9]*{_END}",
    rf"{_AT}[0-9]{{2,6}}-[0-9]{{3,6}}{_END}",
)

#: Below this overlap of words a shared code is a conflict.
CONFLICT_OVERLAP = 0.3


def part_code(raw: Column) -> Column:
    """Upper case, letters and digits only; null unless 4 to 24 long with a digit."""
    return let(F.regexp_replace(F.upper(raw), "[^A-Z0-9]", ""), lambda code: F.when(F.length(code).between(4, 24) & code.rlike("[0-9]"), code))


def codes_in_text(raw: Column) -> Column:
    """Part codes in a raw description, in order of pattern, then of place; distinct."""
    none = F.array().cast("array<string>")
    return let(F.upper(F.coalesce(raw, F.lit(""))), lambda t: F.when(t.rlike("[0-9]{3}"), _codes_in_upper(t)).otherwise(none))


def _codes_in_upper(text: Column) -> Column:
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in CODE_IN_TEXT]
    found[3] = F.filter(found[3], lambda c: ~c.rlike(YEAR_IN_PAIR))
    codes = F.array_distinct(F.filter(F.transform(F.concat(*found), part_code), lambda c: c.isNotNull()))
    return F.filter(codes, lambda c: ~F.regexp_extract(c, "^([A-Z]*)", 1).isin(*PACK_WORDS))


def dimensions(raw: Column) -> Column:
    """Sizes such as ``27x40x6``, first those with a multiplication sign, then hyphened ones."""
    none = F.array().cast("array<string>")
    return let(F.upper(F.coalesce(raw, F.lit(""))), lambda t: F.when(t.rlike(r"[0-9]\s*[X×✕-]\s*[0-9]"), _sizes_in_upper(t)).otherwise(none))


def _sizes_in_upper(text: Column) -> Column:
    crossed = F.transform(F.regexp_extract_all(text, F.lit(SIZE_IN_TEXT), F.lit(1)), lambda m: F.lower(F.regexp_replace(m, r"\s+", "")))
    rest = text
    for pattern in CODES_BEFORE_SIZES:
        rest = F.regexp_replace(rest, pattern, " ")
    hyphened = F.filter(F.regexp_extract_all(rest, F.lit(HYPHEN_SIZE), F.lit(1)), lambda m: ~m.rlike(r"(^|-)0+(-|\z)"))
    return F.array_distinct(F.concat(crossed, F.transform(hyphened, lambda m: F.replace(m, F.lit("-"), F.lit("x")))))


def all_codes(raw: Column, column_code: Column) -> Column:
    """The code column's code first, then those of the text."""
    own = F.filter(F.array(part_code(column_code)), lambda c: c.isNotNull())
    return F.array_distinct(F.concat(own, codes_in_text(raw)))


def content_words(raw: Column, codes: Column, dims: Column, cleaned: Column | None = None) -> Column:
    """Normalised words without stop words, sizes and the tokens of codes and sizes."""
    words = tokens(normalize_description(raw) if cleaned is None else cleaned)
    words = F.filter(words, lambda w: ~w.isin(*STOP_WORDS) & ~w.rlike(r"^[0-9]+(x[0-9]+)+\z"))
    of_size = F.flatten(F.transform(dims, lambda d: F.split(d, "x")))
    return let(F.concat(code_tokens(codes), of_size), lambda used: F.filter(words, lambda w: ~F.array_contains(used, w)))


def code_tokens(codes: Column) -> Column:
    """Each code in lower case, and its letters and digits apart."""
    return F.flatten(F.transform(codes, lambda c: F.concat(F.array(F.lower(c)), F.regexp_extract_all(F.lower(c), F.lit("(^[a-z]+|[0-9]+[a-z0-9]*)"), F.lit(1)))))


def without_code_tokens(words: Column, codes: Column) -> Column:
    """Content words without the tokens of further codes."""
    return F.when(F.size(codes) == 0, words).otherwise(let(code_tokens(codes), lambda used: F.filter(words, lambda w: ~F.array_contains(used, w))))


def word_overlap(a: Column, b: Column) -> Column:
    """Shared share of two vocabularies; 1 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def sizes_differ(a: Column, b: Column) -> Column:
    """Both have sizes, and one of ``a`` isn't among those of ``b``."""
    return (F.size(a) > 0) & (F.size(b) > 0) & (F.size(F.array_except(a, b)) > 0)
