"""Decisions on claims: by hand, and by an outside screening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.money import difference, round_half_up
from tallyspark.plans.settings import OPEN
from tallyspark.sources.shared import settle

# Probabilities from which a screening decides.
MATCH_FROM, NO_MATCH_TO = 0.8, 0.2


def decide(probability: Column) -> tuple[Column, Column]:
    """Verdict and confidence in percent of a probability that two descriptions are one item."""
    verdict = F.when(probability >= MATCH_FROM, "MATCH").when(probability <= NO_MATCH_TO, "NOT_MATCH").otherwise("UNCERTAIN")
    sure = F.when(probability >= MATCH_FROM, probability).when(probability <= NO_MATCH_TO, 1 - probability).otherwise(F.greatest(probability, 1 - probability))
    return verdict, round_half_up(sure * 100)


def decisions(probabilities: DataFrame) -> DataFrame:
    """``a_id, probability`` -> ``a_id, verdict, confidence``."""
    verdict, confidence = decide(F.col("probability"))
    return probabilities.select("a_id", verdict.alias("verdict"), confidence.alias("confidence"))


def review_pairs(results: DataFrame) -> DataFrame:
    """``a_id, a_name, b_name`` of open claims that have a costing row to compare with."""
    reference = F.coalesce(F.col("chosen"), F.get("candidates", F.lit(0)))
    pairs = results.filter(F.col("status").isin(*OPEN)).select("a_id", F.col("a_raw_name").alias("a_name"), reference["raw_name"].alias("b_name"))
    return pairs.filter(F.col("b_name").isNotNull())


def apply_picks(results: DataFrame, picks: DataFrame, costing: DataFrame) -> DataFrame:
    """Confirm claims by hand: ``picks`` has ``a_id, b_row``.

    The picked row becomes the reference with the similarity it has as a candidate; one that
    isn't among the candidates is appended with similarity 0 from ``costing`` (``b_row,
    b_raw_name, b_cleaned, b_price``).
    """
    # Few rows are picked, by many claims each: written, so that these go to the costing rows and not those to them.
    picked_rows = settle(picks.select("b_row").distinct(), "picked-rows")
    wanted = costing.select("b_row", "b_raw_name", "b_cleaned", "b_price").join(picked_rows, "b_row", "left_semi")
    offered = picks.join(wanted, "b_row")
    new = F.struct(
        F.col("b_row"),
        F.col("b_raw_name").alias("raw_name"),
        F.col("b_cleaned").alias("cleaned"),
        F.col("b_price").alias("price"),
        F.lit(0).alias("similarity"),
        F.lit(None).cast("string").alias("matched_code"),
    )
    df = results.join(offered.select("a_id", new.alias("new")), "a_id", "left")
    known = F.get(F.filter("candidates", lambda c: c["b_row"] == F.col("new.b_row")), F.lit(0))
    df = df.withColumn("known", known).withColumn("pick", F.coalesce("known", "new"))
    picked = F.col("new").isNotNull()
    note = F.concat(F.lit("Manually confirmed — File B row "), F.col("pick.b_row").cast("string"), F.lit("."))
    changed = {
        "chosen": F.col("pick"),
        "b_price": F.col("pick.price"),
        "difference": difference(F.col("pick.price"), F.col("a_price")),
        "method": F.lit("manual"),
        "score": F.col("pick.similarity"),
        "status": F.lit("CONFIRMED"),
        "candidates": F.when(F.col("known").isNull(), F.concat("candidates", F.array("new"))).otherwise(F.col("candidates")),
        "notes": F.concat(F.filter("notes", lambda n: ~n.startswith("Manually")), F.array(note)),
    }
    return df.select(*[F.when(picked, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in results.columns])


def apply_decisions(results: DataFrame, verdicts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Apply a screening to open claims: ``verdicts`` has ``a_id, verdict, confidence``, ``pairs``
    is what was screened (:func:`review_pairs`).

    MATCH confirms the chosen candidate, else the one of the screened name, else the first.
    NOT_MATCH clears the choice and keeps the candidates.  UNCERTAIN only leaves a note.
    """
    # Both grow with the claims, and are read from tables whose files are many times smaller: never broadcast.
    asked = verdicts.join(pairs.select("a_id", "b_name").hint("merge"), "a_id", "left")
    df = results.join(asked.hint("merge"), "a_id", "left")
    hit = F.col("verdict").isNotNull() & F.col("status").isin(*OPEN)
    named = F.get(F.filter("candidates", lambda c: c["raw_name"] == F.col("b_name")), F.lit(0))
    screened = F.when(F.col("b_name").isNotNull(), F.coalesce(named, F.get("candidates", F.lit(0))))
    df = df.withColumn("hit", hit).withColumn("best", F.coalesce(F.col("chosen"), screened))
    match = F.coalesce(F.col("hit") & (F.col("verdict") == "MATCH"), F.lit(False))
    no_match = F.coalesce(F.col("hit") & (F.col("verdict") == "NOT_MATCH"), F.lit(False))
    percent = F.col("confidence").cast("long").cast("string")
    other_notes = F.filter("notes", lambda n: ~n.startswith("Jev"))
    note = (
        F.when(F.col("verdict") == "MATCH", F.concat(F.lit("Jev-verified (confidence "), percent, F.lit("%).")))
        .when(F.col("verdict") == "NOT_MATCH", F.lit("Jev-rejected."))
        .otherwise(F.concat(F.lit("Jev uncertain (confidence "), percent, F.lit("%) — manual review.")))
    )
    changed = {
        "chosen": F.when(match, F.col("best")).when(~no_match, F.col("chosen")),
        "b_price": F.when(match, F.col("best.price")).when(~no_match, F.col("b_price")),
        "difference": F.when(match, difference(F.col("best.price"), F.col("a_price"))).when(~no_match, F.col("difference")),
        "method": F.when(match, "jev").when(~no_match, F.col("method")),
        "score": F.when(~no_match, F.col("score")),
        "status": F.when(match, "CONFIRMED").when(no_match, "UNMATCHED").otherwise(F.col("status")),
        "jev_verdict": F.when(F.col("hit"), F.col("verdict")).otherwise(F.col("jev_verdict")),
        "jev_confidence": F.when(F.col("hit"), F.col("confidence").cast("double")).otherwise(F.col("jev_confidence")),
        "notes": F.when(F.col("hit"), F.concat(other_notes, F.array(note))).otherwise(F.col("notes")),
    }
    df = df.withColumn("hit", F.coalesce("hit", F.lit(False)))
    return df.select(*[(changed[c] if c in changed else F.col(c)).alias(c) for c in results.columns])


def details(results: DataFrame, claim_qty: DataFrame, costing_qty: DataFrame) -> DataFrame:
    """What the view of one claim adds: ``a_id, pickable, same_name, claimed_qty, assessed_qty, qty_differs``.

    ``same_name``: the chosen row has the claim's cleaned name.  Quantities differ only where
    both are known.
    """
    claimed = claim_qty.select("a_row", F.col("qty").alias("claimed_qty"))
    assessed = costing_qty.select(F.col("b_row").alias("chosen_row"), F.col("qty").alias("assessed_qty"))
    df = results.withColumn("chosen_row", F.col("chosen.b_row")).join(claimed, "a_row", "left").join(assessed, "chosen_row", "left")
    known = lambda c: F.coalesce(c, F.lit(False))
    return df.select(
        "a_id",
        pickable(F.col("status"), F.col("candidates")).alias("pickable"),
        known(F.col("chosen.cleaned") == F.col("a_cleaned")).alias("same_name"),
        "claimed_qty",
        "assessed_qty",
        known(F.col("claimed_qty") != F.col("assessed_qty")).alias("qty_differs"),
    )


def pickable(status: Column, candidates: Column) -> Column:
    """Whether a candidate may be picked by hand."""
    return status.isin(*OPEN) | ((status == "UNMATCHED") & (F.size(candidates) > 0))
