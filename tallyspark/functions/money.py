"""Prices as they are typed, and rounding to cents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions.binding import let
from tallyspark.functions.text import js_trim

#: Amounts are summed in millionths, as whole numbers.
MICRO, EXACT = 1_000_000, "decimal(38,0)"


def clean_price(s: Column) -> Column:
    """A typed price as a number; null where none can be recovered.

    Accounting brackets and a minus on either side make it negative; the rightmost of two
    kinds of separators is the decimal one.  Dates and fractions are refused: their digits
    would be a large and meaningless price.
    """
    text = js_trim(F.translate(s.cast("string"), "\u00A0", " "))
    return let(text, _price_of_text)


def _price_of_text(text: Column) -> Column:
    """Most prices are plain numbers; one pattern tells them."""
    return F.when(text.rlike(r"^[0-9]+(\.[0-9]+)?\z"), text.try_cast("double")).otherwise(_price_of_marked(text))


def _price_of_marked(text: Column) -> Column:
    bracketed = text.rlike(r"^\(.*\)\z")
    inner = F.when(bracketed, F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)
    return let(inner, lambda s: F.when((text == "") | _refused(s), F.lit(None).cast("double")).otherwise(_price_of_digits(s, bracketed)))


def _refused(s: Column) -> Column:
    """Dates and fractions."""
    hyphens = F.length(s) - F.length(F.replace(s, F.lit("-")))
    return s.rlike(r"[0-9]\s*/\s*[0-9]") | (hyphens >= 2) | s.rlike(r"[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{2,4}")


def _price_of_digits(s: Column, bracketed: Column) -> Column:
    def signed(kept: Column) -> Column:
        negative = bracketed | kept.rlike(r"-\z") | kept.rlike("^-")
        bare = F.regexp_replace(F.regexp_replace(kept, r"-\z", ""), "^-", "")
        number = let(bare, lambda x: F.regexp_extract(_plain_number(x), r"^([0-9]*\.?[0-9]*)", 1).try_cast("double"))
        return let(number, lambda n: F.when(negative & (n != 0), -n).otherwise(n))

    return let(F.regexp_replace(s, "[^0-9.,-]", ""), signed)


def _plain_number(s: Column) -> Column:
    """Grouping gone, a point before the decimals."""
    comma, dot = s.contains(","), s.contains(".")
    no_commas, no_dots = F.replace(s, F.lit(",")), F.replace(s, F.lit("."))
    return (
        F.when(comma & dot, F.when(s.rlike(r",[^.,]*\z"), F.replace(no_dots, F.lit(","), F.lit("."))).otherwise(no_commas))
        .when(comma, F.when(s.rlike(r"^[^,]*,[^,]*\z") & ~s.rlike(r",[^,]{3}\z"), F.replace(s, F.lit(","), F.lit("."))).otherwise(no_commas))
        .when(s.rlike(r"\..*\.") & ~s.rlike(r"^[^.]{0,2}\.[^.]{0,2}\.([^.]{4}|[^.]{0,2})\z"), no_dots)
        .otherwise(s)
    )


def clean_number(x: Column) -> Column:
    """A price that is a number already: itself if finite."""
    d = x.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def round2(x: Column) -> Column:
    """To cents, halves upwards, on the binary value."""
    return F.floor(x * 100 + 0.5) / 100


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def ext_amount(qty: Column, price: Column) -> Column:
    """Quantity times price, to cents; null if either is missing."""
    return round2(qty * price)


def difference(b_price: Column, a_price: Column) -> Column:
    return round2(b_price - a_price)


def gap_percent(diff: Column, a_price: Column) -> Column:
    """The absolute difference as a percentage of the claimed price; null for a price of 0."""
    return F.when(a_price != 0, F.abs(diff) / a_price * 100)


def micro(x: Column) -> Column:
    """An amount in whole millionths, so that sums of amounts are exact and don't depend on their order."""
    return F.floor(x * MICRO + 0.5).cast(EXACT)


def total(x: Column) -> Column:
    """The exact sum of amounts (to millionths); null where there is none."""
    return F.sum(micro(x)).cast("double") / MICRO


def mean(x: Column) -> Column:
    return total(x) / F.count(x)


def cents_of_quotient(value: Column, units: Column) -> Column:
    """``value / units`` of whole numbers (value in millionths, both positive) to cents; exact halves go up."""
    whole = lambda c: c.cast(EXACT)
    rounded = F.call_function("div", whole(value) * 200 + whole(units) * MICRO, whole(units) * (2 * MICRO))
    return rounded / 100.0
