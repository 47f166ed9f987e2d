"""Settings of a comparison."""

from __future__ import annotations

import re
from dataclasses import dataclass

# Statuses in the order of reports, and the order in which they want review.
STATUSES = ("CONFIRMED", "STRONG", "PROBABLE", "CONFLICT", "UNMATCHED")
REVIEW_ORDER = ("CONFLICT", "PROBABLE", "UNMATCHED", "STRONG", "CONFIRMED")
#: Statuses that assert a pairing.
PAIRED = ("CONFIRMED", "STRONG")
#: Statuses that wait for a decision.
OPEN = ("PROBABLE", "CONFLICT")
FLAGS = ("in-range", "above", "above-allowed", "below", "unpriced")
STRIP_MODES = ("auto", "none", "firstToken", "lastToken", "regex")

#: Descriptions that fuzzy scoring looks at for one claim, and candidates that are kept.
FUZZY_POOL, STORED = 400, 50


@dataclass(frozen=True)
class Settings:
    """``review_floor``: least similarity of a suggestion, 0 to 99; ``price_tolerance``: shown
    in reports, never evidence of identity; ``code_strip``: how codes are taken off claim names."""

    review_floor: int = 60
    price_tolerance: float = 0.0
    code_strip: str = "auto"
    code_pattern: str | None = None
    depreciation_pct: float = 0.0

    def __post_init__(self) -> None:
        if not 0 <= self.review_floor <= 99:
            raise ValueError("review_floor must lie between 0 and 99")
        if not 0 <= self.price_tolerance <= 50:
            raise ValueError("price_tolerance must lie between 0 and 50")
        if not 0 <= self.depreciation_pct <= 100:
            raise ValueError("depreciation_pct must lie between 0 and 100")
        if self.code_strip not in STRIP_MODES:
            raise ValueError(f"code_strip must be one of {', '.join(STRIP_MODES)}")
        if self.code_strip == "regex":
            if not self.code_pattern:
                raise ValueError("code_strip regex needs a code_pattern")
            re.compile(self.code_pattern)
