"""The inspection plan over a stream of text files.

A landing folder is a file source; each micro-batch runs the batch plan and writes a folder named by
its batch id, so a batch that runs again after a crash replaces its own output. The checkpoint keeps
what has been read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidegate.plans.inspection import findings, inspect_segments, item_verdicts

ITEM = "job_id string, item_id string, text string"


def landing(spark: SparkSession, path: str, files_a_batch: int = 64) -> DataFrame:
    """Items as they land: JSON lines of job_id, item_id, text."""
    return spark.readStream.schema(ITEM).option("maxFilesPerTrigger", files_a_batch).json(path)


def inspect_stream(items: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Verdicts and findings of every item, below ``out``; status says how each item ended."""
    keys = ["job_id", "item_id"]

    def batch(rows: DataFrame, number: int) -> None:
        segments = rows.select(*keys, F.lit(0).alias("seg_idx"), F.lit("Text").alias("provenance"), F.coalesce("text", F.lit("")).alias("text"))
        results = inspect_segments(segments).persist()  # both tables come from one run of the gates
        try:
            item_verdicts(results, keys, status=True).write.mode("overwrite").parquet(f"{out}/verdicts/batch={number}")
            findings(results, keys).write.mode("overwrite").parquet(f"{out}/findings/batch={number}")
        finally:
            results.unpersist()

    writer = items.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def job_progress(items: DataFrame) -> DataFrame:
    """Running totals a job over a stream of item states (job_id, status), for complete or update mode."""
    return items.groupBy("job_id").agg(F.count("*").alias("total"), F.count_if(F.col("status").isin("DONE", "ERROR", "SKIPPED")).alias("done"))
