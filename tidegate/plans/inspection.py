"""The inspection plan: segments to findings, segment results, item and job verdicts.

``segments`` has the key columns of an item, ``seg_idx``, ``provenance`` and ``text``. Everything up
to the item verdict is a projection of the segment's row; then one aggregation by item and one by job,
both of which sum partially before their shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions import fixed
from tidegate.functions.text import is_blank, sanitise
from tidegate.functions.verdicts import gate_decision, item_decision, rank, tier_of, top_severity, unrank, worst
from tidegate.operators.characters import FINDING, segment_findings
from tidegate.operators.gates import VERDICT, Gate, lexical_guard, lexical_inspector


def explain(code: Column) -> tuple[Column, Column]:
    """Title and explanation of a code, with a default."""
    titles = F.create_map(*(F.lit(x) for k, (t, _) in fixed.EXPLAIN.items() for x in (k, t)))
    texts = F.create_map(*(F.lit(x) for k, (_, t) in fixed.EXPLAIN.items() for x in (k, t)))
    title, text = fixed.EXPLAIN_DEFAULT
    return F.coalesce(F.try_element_at(titles, code), F.lit(title)), F.coalesce(F.try_element_at(texts, code), F.lit(text))


def inspect_segments(segments: DataFrame, guard: Gate = lexical_guard, inspector: Gate = lexical_inspector, short_circuit: bool = False) -> DataFrame:
    """A row for each segment with gate findings and what the verdicts need of it; ``early`` holds findings from staging, if there."""
    gate1 = segment_findings(F.col("text"))
    if "early" in segments.columns:
        gate1 = F.concat(F.coalesce("early", F.array().cast(f"array<{FINDING}>")), gate1)
    rows = segments.withColumn("gate1", gate1).withColumn("clean", sanitise(F.col("text")))
    rows = rows.withColumn("cg_decision", gate_decision(top_severity(F.col("gate1"))))
    # Gates 2 and 3 get a null where they are not to look; a plug-in UDF would run on every row otherwise.
    skipped = is_blank(F.col("clean")) | F.lit(short_circuit) & (F.col("cg_decision") == "BLOCK")
    rows = rows.withColumn("seen", F.when(~skipped, F.col("clean")))
    rows = rows.withColumn("guard", F.when(F.col("seen").isNotNull(), guard(F.col("seen"))))
    rows = rows.withColumn("verdict", F.when(F.col("seen").isNotNull(), inspector(F.col("seen"))).cast(VERDICT))
    injection = F.coalesce(F.col("guard.label") == "malicious", F.lit(False))
    other = F.coalesce(F.exists("verdict.categories", lambda c: c["code"] != "INJECTION_ATTEMPT"), F.lit(False))
    severe = F.exists("gate1", lambda f: f["severity"].isin("MEDIUM", "HIGH"))
    return rows.select(
        *segments.columns, "gate1", "guard", "verdict", "cg_decision",
        F.coalesce("verdict.decision", F.lit("PASS")).alias("insp_decision"),
        injection.alias("injection"), (severe | other).alias("sensitive"),
    )


def findings(results: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each finding of the three gates, with its title and explanation; ``seq`` is its place in the segment."""
    title, text = explain(F.col("f.code"))
    row = f"struct<stage:string,seq:int,f:{FINDING}>"
    one = lambda stage: lambda f, i: F.struct(F.lit(stage).alias("stage"), i.cast("int").alias("seq"), f.alias("f")).cast(row)
    detail = F.format_string(fixed.DETAIL["INJECTION_ATTEMPT"], F.lit(fixed.EXPLAIN["INJECTION_ATTEMPT"][1]), F.col("guard.score"), F.col("guard.windows"))
    null = F.lit(None).cast("string")
    attempt = F.struct(F.lit("INJECTION_ATTEMPT").alias("code"), F.lit("HIGH").alias("severity"), F.lit("1").alias("occurrences"), detail.alias("detail"), null.alias("verbatim"), F.lit(None).cast("int").alias("position"))
    said = F.transform(
        F.coalesce("verdict.categories", F.array().cast("array<struct<code:string,severity:string,occurrences:string>>")),
        lambda c: F.struct(c["code"].alias("code"), F.coalesce(c["severity"], F.lit("MEDIUM")).alias("severity"), F.coalesce(c["occurrences"], F.lit("1")).alias("occurrences"), null.alias("detail"), null.alias("verbatim"), F.lit(None).cast("int").alias("position")),
    )
    guard = F.when(F.col("injection"), F.array(attempt)).otherwise(F.array().cast(f"array<{FINDING}>"))
    # A detector that failed is no finding of gate 1.
    first = F.filter("gate1", lambda f: f["code"] != "PARSE_ERROR")
    failed = F.slice(F.filter("gate1", lambda f: f["code"] == "PARSE_ERROR"), 1, 1)
    every = F.concat(F.transform(first, one("CHARGUARD")), F.transform(guard, one("PROMPTGUARD")), F.transform(F.concat(failed, said), one("INSPECTOR")))
    rows = results.select(*keys, "seg_idx", "provenance", F.explode(every).alias("x")).select(*keys, "seg_idx", "provenance", "x.stage", "x.seq", "x.f")
    return rows.select(
        *keys, "seg_idx", "provenance", "stage", "seq", "f.code", "f.severity", title.alias("title"), F.coalesce("f.detail", text).alias("explanation"), "f.verbatim", "f.position", "f.occurrences",
    )


def finding_order() -> list[Column]:
    """The order in which a reviewer reads findings, ties broken by place."""
    stage = F.when(F.col("stage") == "CHARGUARD", 0).when(F.col("stage") == "PROMPTGUARD", 1).otherwise(2)
    severity = F.when(F.col("severity") == "HIGH", 0).when(F.col("severity") == "MEDIUM", 1).otherwise(2)
    return [stage, severity, F.col("seg_idx"), F.col("seq")]


def item_verdicts(results: DataFrame, keys: list[str], status: bool = False) -> DataFrame:
    """keys, decision, risk_tier and the worst of each gate; and how the item ended, if asked for."""
    items = results.groupBy(*keys).agg(
        worst(F.col("cg_decision")).alias("charguard"),
        worst(F.col("insp_decision")).alias("inspector"),
        F.bool_or("injection").alias("injection"),
        F.bool_or("sensitive").alias("sensitive"),
        F.bool_or(F.exists("gate1", lambda f: f["code"] == "PARSE_ERROR")).alias("failed"),
    )
    decision = item_decision(F.col("charguard"), F.col("inspector"), F.col("injection"), F.col("sensitive"))
    return items.select(
        *keys, decision.alias("decision"), tier_of(decision).alias("risk_tier"), "charguard",
        F.when(F.col("injection"), "malicious").otherwise("benign").alias("promptguard"), "inspector",
        *([F.when(F.col("failed"), "ERROR").otherwise("DONE").alias("status")] if status else []),
    )


def uninspectable(items: DataFrame, note: Column) -> DataFrame:
    """Items without a segment: review, with the note or a default as explanation."""
    title, text = fixed.EXPLAIN["NOT_INSPECTED"]
    return items.select("*", F.lit("REVIEW").alias("decision"), F.lit("MEDIUM").alias("risk_tier"), F.lit("NOT_INSPECTED").alias("code"), F.lit(title).alias("title"), F.coalesce(note, F.lit(text)).alias("explanation"))


def with_uninspectable(verdicts: DataFrame, found: DataFrame, items: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Verdicts (with status) and findings of inspected items, and those of staged items (segments, note) that have no segment."""
    lost = uninspectable(items.filter(F.coalesce(F.size("segments"), F.lit(0)) <= 0), F.col("note"))
    none = F.lit("n/a")
    rows = lost.select(*keys, "decision", "risk_tier", none.alias("charguard"), none.alias("promptguard"), none.alias("inspector"), F.lit("DONE").alias("status"))
    null = F.lit(None)
    more = lost.select(
        *keys, null.cast("int").alias("seg_idx"), null.cast("string").alias("provenance"), F.lit("CHARGUARD").alias("stage"), F.lit(0).alias("seq"), "code", F.lit("MEDIUM").alias("severity"),
        "title", "explanation", null.cast("string").alias("verbatim"), null.cast("int").alias("position"), F.lit("1").alias("occurrences"),
    )
    return verdicts.unionByName(rows), found.unionByName(more)


def job_verdicts(items: DataFrame, job: str) -> DataFrame:
    """job, n_items, n_done, status, decision: a decision once every item is terminal, and there is one."""
    terminal = F.col("status").isin(*fixed.ITEM_TERMINAL)
    rows = items.groupBy(job).agg(
        F.count("*").alias("n_items"),
        F.count_if(terminal).alias("n_done"),
        F.bool_or(F.col("status") == "RUNNING").alias("running"),
        F.max(rank(F.col("decision"), fixed.DECISIONS)).alias("worst"),
    )
    done = F.col("n_done") == F.col("n_items")
    return rows.select(
        job, "n_items", "n_done",
        F.when(done, "DONE").when(F.col("running"), "RUNNING").otherwise("QUEUED").alias("status"),
        F.when(done, unrank(F.col("worst"), fixed.DECISIONS)).alias("decision"),
    )


def verdict_tally(items: DataFrame, by: str) -> DataFrame:
    """Items by decision, a column each."""
    return items.groupBy(by).agg(*(F.count_if(F.col("decision") == d).alias(f"n_{d.lower()}") for d in fixed.DECISIONS))
