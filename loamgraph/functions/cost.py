"""Cost of code: lines that count, effort, tokens, blended value."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A, b, c, d of the published Basic COCOMO table.
COCOMO = {"organic": (2.4, 1.05, 2.5, 0.38), "semi-detached": (3.0, 1.12, 2.5, 0.35), "embedded": (3.6, 1.20, 2.5, 0.32)}
#: Decisions for each line at which code counts as usual; characters of a line where they aren't known.
TYPICAL_DENSITY, CHARS_PER_LINE = 0.2, 32
UNCOUNTED = ["markdown", "json"]


@dataclass(frozen=True)
class CostParams:
    currency: str = "$"
    salary: float = 56286.0
    overhead: float = 2.4
    mode: str = "organic"
    ai_share: float = 0.0
    token_price: float = 10.0
    reasoning_multiplier: float = 300.0
    chars_per_token: float = 4.0

    def having(self, **changes) -> CostParams:
        return replace(self, **changes)


def sloc(lines: Column, blank: Column, comment: Column, language: Column) -> Column:
    counted = F.greatest(lines - blank - comment, F.lit(0))
    return F.when(language.isin(UNCOUNTED) | lines.isNull(), 0).otherwise(counted)


def effort_months(n: Column, p: CostParams) -> Column:
    a, b, _, _ = COCOMO.get(p.mode, COCOMO["organic"])
    return F.when(n > 0, a * F.pow(n / 1000.0, F.lit(b))).otherwise(0.0)


def cocomo(n: Column, p: CostParams) -> dict[str, Column]:
    """effort_months, schedule_months, people, cost of n lines."""
    _, _, c, d = COCOMO.get(p.mode, COCOMO["organic"])
    effort = effort_months(n, p)
    schedule = F.when(n > 0, c * F.pow(effort, F.lit(d))).otherwise(0.0)
    return {"effort_months": effort, "schedule_months": schedule, "people": F.when(schedule > 0, effort / schedule).otherwise(0.0), "cost": effort * (p.salary / 12.0) * p.overhead}


def ai_estimate(t: dict[str, Column], p: CostParams) -> dict[str, Column]:
    """tokens_kept, multiplier, tokens_spent, ai_cost of totals (sloc, chars, decisions, decision_sloc)."""
    some = t["sloc"] > 0
    kept = t["chars"] / (p.chars_per_token if p.chars_per_token > 0 else 4.0)
    density = t["decisions"] / F.nullif(t["decision_sloc"], F.lit(0)) / TYPICAL_DENSITY
    # greatest() skips NULL, so unknown complexity needs a case of its own
    complexity = F.when(t["decision_sloc"] > 0, F.least(F.greatest(density, F.lit(0.5)), F.lit(2.0))).otherwise(1.0)
    size = 1.0 + 0.5 * F.log10(F.greatest(t["sloc"] / 1000.0, F.lit(1.0)))
    multiplier = p.reasoning_multiplier * complexity * size
    out = {"tokens_kept": kept, "multiplier": multiplier, "tokens_spent": kept * multiplier, "ai_cost": kept * multiplier / 1e6 * p.token_price}
    return {k: F.when(some, v).otherwise(0.0) for k, v in out.items()}


def value(t: dict[str, Column], p: CostParams) -> Column:
    """What the code is worth: the share not made by AI at its cost by hand, the rest at its cost in tokens."""
    share = min(max(p.ai_share, 0.0), 1.0)
    by_hand = cocomo(F.round(t["sloc"] * (1.0 - share)), p)["cost"]
    return by_hand + share * ai_estimate(t, p)["ai_cost"]
