"""Evidence: spans behind findings, merged, shown in parts, masked and revealed."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.functions import fixed
from tidegate.functions.udf import vectorised

SPAN = "struct<s:int,e:int,mask:boolean,code:string>"


@lru_cache(maxsize=1)
def _locators() -> dict[str, list[tuple[re.Pattern, bool, str | int]]]:
    return {
        code: [(re.compile(p, (re.I if fold else 0) | (re.S if dotall else 0)), mask, group) for p, mask, group, fold, dotall in rules]
        for code, rules in fixed.LOCATORS.items()
    }


def spans_in(text: str, codes: list[str]) -> list[dict]:
    """Code-point spans of the locators of some codes; a code without locators has none."""
    return [
        {"s": m.start(group), "e": m.end(group), "mask": mask, "code": code}
        for code in codes
        for pattern, mask, group in _locators().get(code, ())
        for m in pattern.finditer(text)
        if m.end(group) > m.start(group)
    ]


@vectorised(f"array<{SPAN}>")
def locate_spans(text: pd.Series, codes: pd.Series) -> pd.Series:
    return pd.Series([spans_in(t, list(c)) if t is not None and c is not None else [] for t, c in zip(text, codes)])


def merge_spans(spans: DataFrame, keys: list[str], tie: list[str] | None = None) -> DataFrame:
    """Overlapping or adjacent spans (s, e, mask, code) of a key as one; masked if any of them is, with the first one's code.

    Windows over a key's spans; ``tie`` orders spans of equal start and end, the code those equal in that too.
    """
    order = Window.partitionBy(*keys).orderBy("s", "e", *(tie or []), "code")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("s") <= reach, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = spans.withColumn("__island", island).withColumn("__place", F.row_number().over(order))
    merged = rows.groupBy(*keys, "__island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.max("mask").alias("mask"), F.min_by("code", "__place").alias("code"))
    return merged.drop("__island")


def merged(spans: Column) -> Column:
    """The same for an array of spans in a row, by a fold over the sorted array."""
    ranked = F.transform(spans, lambda x, i: F.struct(x["s"].alias("s"), x["e"].alias("e"), i.alias("i"), x["mask"].alias("mask"), x["code"].alias("code")))
    empty = F.array().cast(f"array<{SPAN}>")

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & (x["s"] <= F.get(done, F.size(done) - 1)["e"])
        grown = F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"), (last["mask"] | x["mask"]).alias("mask"), last["code"].alias("code"))
        new = F.struct(x["s"].alias("s"), x["e"].alias("e"), x["mask"].alias("mask"), x["code"].alias("code"))
        return F.when(joins, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(done, F.array(new)))

    return F.aggregate(F.array_sort(ranked), empty, step)


@vectorised("array<struct<kind:string,t:string,code:string,mid:int>>")
def evidence_parts(text: pd.Series, spans: pd.Series) -> pd.Series:
    """Plain, highlighted and masked parts of a text; a masked part has a number and no text."""
    out = []
    for t, found in zip(text, spans):
        parts, at, masks = [], 0, 0
        for x in found if found is not None else ():
            if x["s"] > at:
                parts.append({"kind": "plain", "t": t[at : x["s"]], "code": None, "mid": None})
            if x["mask"]:
                parts.append({"kind": "mask", "t": None, "code": x["code"], "mid": masks})
                masks += 1
            else:
                parts.append({"kind": "hl", "t": t[x["s"] : x["e"]], "code": x["code"], "mid": None})
            at = x["e"]
        if t is not None and at < len(t):
            parts.append({"kind": "plain", "t": t[at:], "code": None, "mid": None})
        out.append(parts)
    return pd.Series(out)


def revealed(text: Column, spans: Column, mid: Column) -> Column:
    """The text of the mid-th masked span, counted from 0; null if there is none."""
    x = F.get(F.filter(spans, lambda s: s["mask"]), mid)
    return F.when((mid >= 0) & x.isNotNull(), F.substring(text, x["s"] + 1, x["e"] - x["s"]))


def segment_evidence(segments: DataFrame, findings: DataFrame, keys: list[str]) -> DataFrame:
    """keys, provenance, text, spans, parts of the segments that gate 2 or 3 found something in.

    The first segment of a provenance stands for it; spans come from gate-3 codes only.
    """
    shown = findings.filter(F.col("stage").isin("INSPECTOR", "PROMPTGUARD")).groupBy(*keys, "provenance")
    codes = shown.agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("stage") == "INSPECTOR", F.struct("seq", "code")))), lambda c: c["code"]).alias("codes"))
    first = segments.groupBy(*keys, "provenance").agg(F.min_by("text", "seg_idx").alias("text"))
    rows = first.join(codes, [*keys, "provenance"]).withColumn("spans", merged(locate_spans("text", "codes")))
    return rows.withColumn("parts", evidence_parts("text", "spans")).drop("codes")
