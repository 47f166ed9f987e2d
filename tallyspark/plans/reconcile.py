"""A whole comparison: prepared sides, results, valuation and the report's tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import text
from tallyspark.operators import coverage, matching, report, valuation
from tallyspark.operators.infer import AnalyzedSheet, check_runnable
from tallyspark.plans.settings import Settings
from tallyspark.sources.shared import discard, settle
from tallyspark.sources.workbook import engine_rows


@dataclass(frozen=True)
class Comparison:
    """Claims against costing rows (``row_num, raw_name, raw_price, raw_code, raw_qty``).

    Tables that several results need are written once, when they are first asked for.
    """

    claims: DataFrame
    costing: DataFrame
    settings: Settings = Settings()
    fold: bool = False
    #: Where claim names carry their code, if that is known; automatic settings find it out otherwise.
    known_mode: str | None = None
    #: Nothing but the results is wanted: the costing rows go once their items are written.
    results_only: bool = False

    @cached_property
    def mode(self) -> str:
        if self.known_mode and self.settings.code_strip == "auto":
            return self.known_mode
        return matching.resolve_mode(self.claims, self.settings)

    @cached_property
    def a(self) -> DataFrame:
        return settle(matching.prepare_claims(self.claims, self.mode, self.settings.code_pattern, self.fold), "claims")

    @property
    def alt_keys(self) -> bool:
        return self.mode == "firstToken"

    @cached_property
    def rows(self) -> DataFrame:
        return settle(matching.costing_rows(self.costing, self.fold), "costing-rows")

    @cached_property
    def b(self) -> DataFrame:
        """The costing rows with what their names tell: a comparison itself does without, and takes items."""
        return settle(matching.named_rows(self.rows, self.alt_keys), "costing")

    def keys(self, wanted: DataFrame | None = None) -> DataFrame:
        """``key, key_rank, b_row`` of the costing rows (of ``wanted`` keys), without what else they tell."""
        return matching.row_keys(self.costing, self.alt_keys, self.fold, wanted)

    @cached_property
    def stages(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """What codes tell of each claim, which claims share a list, and the lists of ranked candidates."""
        rows = settle(matching.costing_rows(self.costing, self.fold), "costing-rows") if self.results_only else self.rows
        items = settle(matching.costing_items(rows, self.alt_keys), "costing-items")
        if self.results_only:
            discard(rows)
        stages = matching.match_stages(self.a, items, self.settings.review_floor)  # all written
        discard(items)
        return stages

    @cached_property
    def results(self) -> DataFrame:
        return settle(matching.classify(self.a, *self.stages), "results")

    @cached_property
    def claim_qty(self) -> DataFrame:
        """``a_row, qty``; rows without a quantity are left out."""
        qty = matching.price_column(self.claims, "raw_qty")
        return self.claims.filter(F.col("raw_qty").isNotNull()).select(F.col("row_num").cast("long").alias("a_row"), qty.alias("qty"))

    @cached_property
    def costing_qty(self) -> DataFrame:
        return self.rows.filter("qty is not null").select("b_row", "qty")

    @cached_property
    def items(self) -> DataFrame:
        """The costing rows as the report lists them."""
        cleaned = text.normalize_description(F.col("b_raw_name"))
        return self.rows.select("b_row", "b_raw_name", cleaned.alias("b_cleaned"), "b_price", "qty", "b_code")

    @cached_property
    def values(self) -> DataFrame:
        return valuation.valuation(self.results, self.costing_qty)

    def flagged(self) -> DataFrame:
        return valuation.flagged(self.results, self.values, self.settings.depreciation_pct)

    def report(self) -> dict[str, DataFrame]:
        """The report's sheets as tables; write each with ``df.write``.

        Columns of quantities and duplicates are there if any row has one, the ledger if there is a
        costing row.
        """
        given = lambda df: None if df.isEmpty() else df
        lists = (self.values, given(self.claim_qty), given(self.costing_qty), given(coverage.duplicate_lists(self.claims)))
        sheets = {
            "summary": report.summary(self.results, self.settings, self.mode),
            "price_summary": report.price_summary(self.results, self.values, self.settings.depreciation_pct),
            "status_money": report.status_money(self.results),
            "full_audit": report.audit(self.results, *lists),
            "action_list": report.audit(report.action_list(self.results), *lists),
        }
        if not self.items.isEmpty():
            sheets["ledger"] = coverage.ledger(self.items, self.results, self.claim_qty)
        return sheets

    def write_report(self, path: str, fmt: str = "parquet") -> None:
        """One folder for each sheet below ``path``."""
        for name, df in self.report().items():
            renamed = df.toDF(*[c.lower().replace(" %", "_pct").replace(" ", "_") for c in df.columns])
            renamed.write.mode("overwrite").format(fmt).option("header", True).save(f"{path}/{name}")


def compare_sheets(claims: DataFrame, a: AnalyzedSheet, costing: DataFrame, b: AnalyzedSheet, settings: Settings = Settings(), fold: bool = True) -> Comparison:
    """A comparison of two analysed sheets of cells."""
    check_runnable(a, b)
    return Comparison(engine_rows(claims, a.mapping), engine_rows(costing, b.mapping), settings, fold)
