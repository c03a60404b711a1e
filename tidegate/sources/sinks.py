"""Tables in and out: staged segments, findings, verdicts, cleaned texts, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.functions.text import sanitise
from tidegate.functions.verdicts import gate_decision, gate_tier, top_severity
from tidegate.operators.characters import FINDING, byte_findings, character_findings
from tidegate.sources.ingest import SEGMENT

STAGED = f"job_id string, item_id string, segments array<{SEGMENT}>, note string, early array<{FINDING}>"


def write_segments(items: DataFrame, path: str) -> None:
    """Staged items as JSON lines, a folder a job; a job that is staged again replaces its folder."""
    items.select("job_id", "item_id", "segments", "note", "early").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_id").json(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STAGED).json(path)


def append(table: DataFrame, path: str, by: str = "job_id") -> None:
    """Replace the partitions that ``table`` has rows for, so that a second run leaves no double."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def reports(files: DataFrame) -> DataFrame:
    """A JSON report for each file (source_name, content), its exit code, and its cleaned text if it can be assessed."""
    content = F.col("content")
    bom = content.startswith(F.unhex(F.lit("EFBBBF")))
    rows = files.withColumn("early", byte_findings(content)).withColumn("assessable", F.is_valid_utf8(content.cast("string")))
    text = F.when(F.col("assessable"), F.when(bom, F.substring(content, 4, 2**31 - 1)).otherwise(content).cast("string"))
    rows = rows.withColumn("text", text).withColumn("found", F.concat("early", F.coalesce(F.when(F.col("assessable"), character_findings(F.col("text"))), F.array().cast(f"array<{FINDING}>"))))
    rows = rows.withColumn("top", top_severity(F.col("found")))
    rows = rows.withColumn("decision", gate_decision(F.col("top"), F.col("assessable"))).withColumn("risk_tier", gate_tier(F.col("top"), F.col("assessable")))
    report = F.to_json(F.struct(F.octet_length(content).alias("input_bytes"), "assessable", F.col("found").alias("findings"), "decision", "risk_tier"))
    code = F.when(F.col("decision") == "BLOCK", 3).when(F.col("decision") == "REVIEW", 2).otherwise(0)
    return rows.select("source_name", "decision", "risk_tier", code.alias("exit_code"), report.alias("report"), F.when(F.col("assessable"), sanitise(F.col("text"))).alias("sanitized"))
