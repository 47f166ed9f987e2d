"""The sentences that results carry, and how they are filled in."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The notes of a claim, as its reviewers know them.
NO_NAME = "File A row has no item name."
EMPTY_NAME = "Description became empty after removing the item code."
NO_ITEM = "Row does not look like an item (a total/footer line or numbers only) — matching skipped."
CODE_CONFLICT = 'Part number {code} also appears on B{row} ("{name}") but the description conflicts — verify before accepting.'
CODE_SIZES = "Part number {code} matches B{row} but dimensions differ ({sizes} vs {other}) — verify size."
BY_CODE = "Identity by part number: {codes}."
ONE_CONFLICT = "{n} costing row shares this part number but describe a different product — query the insured."
CONFLICTS = "{n} costing rows share this part number but describe a different product — query the insured."
ONE_MORE_CONFLICT = "{n} further costing row shares the part number with a conflicting description — see the notes above."
MORE_CONFLICTS = "{n} further costing rows share the part number with a conflicting description — see the notes above."
FUZZY_ONLY = "Best name similarity {score} — fuzzy evidence only, confirm manually or with Jev."

#: Of a claim with very many notes on codes.
MORE_NOTES = "And {n} further costing rows of these part numbers to verify."

#: What a file's health suggests, by category.
HINTS = {
    "blank_names": "Rows with other cells but no name take no part in the comparison.",
    "unreadable": "Some prices have no number in them; look at those claims by hand.",
    "date_like": "The price column holds whole numbers as dates are stored: is it the right column?",
    "duplicates": "Names stand on several rows, so it is open which of them a costing row supports.",
    "zero": "A price of zero is compared as zero and differs from every positive one.",
    "negative": "Some prices are negative: credits, or a sign typed by mistake.",
}


def filled(template: str, **values: Column) -> Column:
    """The sentence with columns in its places."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.lit(p) if k % 2 == 0 else values[p].cast("string") for k, p in enumerate(parts) if p])


def filled_sql(template: str, **values: str) -> str:
    """The same as an SQL expression."""
    parts = re.split(r"\{(\w+)\}", template)
    return " || ".join("'" + p.replace("'", "''") + "'" if k % 2 == 0 else f"CAST({values[p]} AS VARCHAR)" for k, p in enumerate(parts) if p)
