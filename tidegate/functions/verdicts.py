"""Ordinal verdicts as column expressions: decisions, severities, tiers, count buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegate.functions import fixed


def rank(value: Column, scale: list[str]) -> Column:
    """0 for the first of the scale; null for null and for what is not on it."""
    place = F.array_position(F.array(*map(F.lit, scale)), value)
    return F.when(place > 0, (place - 1).cast("int"))


def unrank(place: Column, scale: list[str], default: int = 0) -> Column:
    return F.element_at(F.array(*map(F.lit, scale)), F.coalesce(place, F.lit(default)).cast("int") + 1)


def worst(decision: Column) -> Column:
    """Aggregate: the worst decision of a group; PASS without any. Sums partially before a shuffle."""
    return unrank(F.max(rank(decision, fixed.DECISIONS)), fixed.DECISIONS)


def worst_of(*decisions: Column) -> Column:
    """The worst of several columns of a row."""
    return unrank(F.array_max(F.array(*(F.coalesce(rank(d, fixed.DECISIONS), F.lit(0)) for d in decisions))), fixed.DECISIONS)


def tier_of(decision: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in fixed.TIER_OF_DECISION.items() for x in kv)), decision)


def bucket(n: Column) -> Column:
    return F.when(n <= 0, "0").when(n == 1, "1").when(n == 2, "2").otherwise("3+")


def top_severity(findings: Column) -> Column:
    """Rank 0 to 2 of the highest severity in an array of findings; null without any."""
    return F.array_max(F.transform(findings, lambda f: rank(f["severity"], fixed.SEVERITIES)))


def gate_decision(top: Column, assessable: Column | None = None) -> Column:
    """Of gate 1, from the highest severity rank."""
    decision = F.when(top == 2, "BLOCK").when(top == 1, "REVIEW").otherwise("PASS")
    return decision if assessable is None else F.when(~assessable, "BLOCK").otherwise(decision)


def gate_tier(top: Column, assessable: Column | None = None) -> Column:
    tier = F.when(top.isNull(), "NONE").otherwise(unrank(top, fixed.SEVERITIES))
    return tier if assessable is None else F.when(~assessable, "HIGH").otherwise(tier)


def inspector_decision(categories: Column, injection: Column) -> Column:
    """Of gate 3, from its categories (array of code, severity, occurrences) and the injection flag."""
    some = F.size(categories) > 0
    bright = F.arrays_overlap(F.transform(categories, lambda c: c["code"]), F.array(*map(F.lit, fixed.BRIGHT_LINE)))
    high = F.exists(categories, lambda c: c["severity"] == "HIGH")
    return F.when(some & (bright | high | injection), "BLOCK").when(some | injection, "REVIEW").otherwise("PASS")


def inspector_tier(categories: Column, injection: Column) -> Column:
    decision = inspector_decision(categories, injection)
    return F.when(decision == "BLOCK", "HIGH").when(decision == "PASS", "NONE").when(F.size(categories) > 0, unrank(top_severity(categories), fixed.SEVERITIES)).otherwise("LOW")


def item_decision(gate: Column, inspector: Column, injected: Column, sensitive: Column) -> Column:
    """Of an item, from its worst gate-1 and inspector decisions; injection alone means review."""
    return F.when(injected, F.when(sensitive | (gate != "PASS"), "BLOCK").otherwise("REVIEW")).otherwise(worst_of(gate, inspector))
