"""How alike two normalised descriptions are, 0 to 100 (and above, where letters repeat)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions.binding import let
from tallyspark.functions.money import round_half_up
from tallyspark.functions.text import tokens

# What each differing number costs, and the most that they cost.
SIBLING_STEP, SIBLING_MOST = 22, 45


def packed(s: Column) -> Column:
    return F.replace(s, F.lit(" "))


def bigrams(s: Column) -> Column:
    """Pairs of neighbouring letters of the text without blanks, by position."""
    t = packed(s)
    at = F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1)))
    return F.when(F.length(t) < 2, F.array().cast("array<string>")).otherwise(F.transform(at, lambda i: F.substring(t, i, F.lit(2))))


def dice(a: Column, b: Column, a_grams: Column | None = None, b_grams: Column | None = None) -> Column:
    """Places of ``b`` whose bigram occurs in ``a``, doubled, over the bigrams of both."""
    in_a = F.array_distinct(bigrams(a)) if a_grams is None else a_grams
    of_b = bigrams(b) if b_grams is None else b_grams
    shared = let(in_a, lambda grams: F.size(F.filter(of_b, lambda g: F.array_contains(grams, g))))

    def score(p: Column) -> Column:
        pa, pb = p["a"], p["b"]
        share = F.try_divide(2 * shared, F.length(pa) - 1 + F.length(pb) - 1)
        return (
            F.when((pa == "") | (pb == ""), 0)
            .when(pa == pb, 100)
            .when((F.length(pa) < 2) | (F.length(pb) < 2), 0)
            .otherwise(round_half_up(share * 100))
            .cast("int")
        )

    return let(F.struct(packed(a).alias("a"), packed(b).alias("b")), score)


def sibling_penalty(a: Column, b: Column) -> Column:
    """Descriptions that differ in numbers only are siblings, not the same item."""
    return let(F.struct(tokens(a).alias("a"), tokens(b).alias("b")), lambda p: sibling_penalty_of_tokens(p["a"], p["b"]))


def sibling_penalty_of_tokens(ta: Column, tb: Column) -> Column:
    count = lambda xs, t: F.size(F.filter(xs, lambda x: x == t))
    apart = F.filter(
        F.transform(F.array_union(ta, tb), lambda t: F.struct(t.alias("t"), F.abs(count(ta, t) - count(tb, t)).alias("n"))),
        lambda d: d["n"] > 0,
    )

    def cost(found: Column) -> Column:
        n = F.aggregate(found, F.lit(0), lambda s, d: s + d["n"])
        words_differ = F.exists(found, lambda d: ~d["t"].rlike("[0-9]"))
        return F.when(words_differ | (F.size(found) == 0), 0).otherwise(F.least(F.lit(SIBLING_MOST), n * SIBLING_STEP)).cast("int")

    return let(apart, cost)


def similarity(a: Column, b: Column) -> Column:
    """Dice less the sibling penalty; only equal texts skip the penalty."""
    return F.when(packed(a) == packed(b), dice(a, b)).otherwise(F.greatest(F.lit(0), dice(a, b) - sibling_penalty(a, b))).cast("int")


def engine_score(a: Column, b: Column, a_grams: Column | None = None, b_grams: Column | None = None) -> Column:
    """As the matcher scores: a dice of exactly 100 skips the penalty, one above it doesn't."""
    penalised = lambda base: F.when(base == 100, 100).otherwise(F.greatest(F.lit(0), base - sibling_penalty(a, b))).cast("int")
    return let(dice(a, b, a_grams, b_grams), penalised)
