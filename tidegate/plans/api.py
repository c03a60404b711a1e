"""What a console asks for, as DataFrames: health, stocktake, confirmation, progress, drill-down, reveal."""

from __future__ import annotations

import tidegate
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.config import Config
from tidegate.operators.evidence import revealed, segment_evidence
from tidegate.operators.gates import GUARDS, INSPECTORS, gate
from tidegate.plans.inspection import finding_order, findings, inspect_segments, item_verdicts, with_uninspectable
from tidegate.sources.ingest import segments_of


def health(config: Config | None = None) -> dict[str, str]:
    config = config or Config()
    return {"status": "ok", "version": tidegate.__version__, "guard_backend": config.guard, "inspector_backend": config.inspector}


def run_inspection(items: DataFrame, config: Config | None = None) -> tuple[DataFrame, DataFrame]:
    """Verdicts and findings of staged items, by the gates that the settings name: a verdict for every item."""
    config = config or Config()
    keys = ["job_id", "item_id"]
    results = inspect_segments(segments_of(items, keys), gate(GUARDS, config.guard), gate(INSPECTORS, config.inspector), config.short_circuit)
    return with_uninspectable(item_verdicts(results, keys, status=True), findings(results, keys), items, keys)


def confirmed(jobs: DataFrame, job_ids: list[str], now: float) -> DataFrame:
    """The jobs with drafts among ``job_ids`` queued; ``conflict`` marks those that are no drafts any more."""
    asked = F.col("job_id").isin(job_ids)
    fresh = asked & (F.col("status") == "DRAFT")
    return jobs.withColumn("conflict", asked & (F.col("status") != "DRAFT")).withColumns({"confirmed_at": F.when(fresh, F.lit(now)).otherwise(F.col("confirmed_at")), "status": F.when(fresh, "QUEUED").otherwise(F.col("status"))})


def item_detail(items: DataFrame, found: DataFrame, job_id: str, item_id: str) -> tuple[DataFrame, DataFrame]:
    """Findings in reading order and the segments behind them in parts; both empty if the job has no such item."""
    own = (F.col("job_id") == job_id) & (F.col("item_id") == item_id)
    keys = ["job_id", "item_id"]
    mine = found.filter(own)
    return mine.orderBy(*finding_order()), segment_evidence(segments_of(items.filter(own), keys), mine, keys).select(*keys, "provenance", "parts")


def reveal(items: DataFrame, found: DataFrame, job_id: str, item_id: str, provenance: str, mid: int) -> DataFrame:
    """The text of a masked span, as ``value``; no row if there is no such span."""
    own = (F.col("job_id") == job_id) & (F.col("item_id") == item_id)
    keys = ["job_id", "item_id"]
    shown = segment_evidence(segments_of(items.filter(own), keys), found.filter(own), keys).filter(F.col("provenance") == provenance)
    return shown.select(revealed(F.col("text"), F.col("spans"), F.lit(mid)).alias("value")).filter("value IS NOT NULL")
