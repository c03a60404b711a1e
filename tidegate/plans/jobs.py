"""Queries over jobs and items: lists, stocktakes, progress, queues, lookups and table changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.functions import fixed


def job_label(name: Column, first_source: Column, n_items: Column) -> Column:
    """The job's name, else its first source and how many more."""
    more = F.when(n_items > 1, F.concat(F.lit(" +"), (n_items - 1).cast("string"), F.lit(" more"))).otherwise("")
    return F.coalesce(F.nullif(name, F.lit("")), F.concat(F.coalesce(first_source, F.lit("inspection")), more))


def jobs_overview(jobs: DataFrame, items: DataFrame, limit: int = fixed.JOB_LIMIT) -> DataFrame:
    """The latest jobs that are no drafts, with counts, label and bucket. One join; the first source is a min_by beside the counts."""
    counted = items.groupBy("job_id").agg(
        F.count("item_id").alias("item_count"),
        F.count_if(F.col("status").isin(*fixed.ITEM_TERMINAL)).alias("done"),
        F.min_by("source_name", "seq").alias("first_source"),
    )
    rows = jobs.filter(F.col("status") != "DRAFT").join(counted, "job_id", "left")
    rows = rows.withColumns({"item_count": F.coalesce("item_count", F.lit(0)), "done": F.coalesce("done", F.lit(0))})
    rows = rows.orderBy(F.coalesce("confirmed_at", "created_at").desc(), "job_id").limit(limit)  # a top-k report
    bucket = F.when(F.col("status").isin(*fixed.JOB_OPEN), "in_progress").otherwise("completed")
    return rows.select("job_id", job_label(F.col("name"), F.col("first_source"), F.col("item_count")).alias("label"), "status", "item_count", "done", bucket.alias("bucket"))


def stocktake(jobs: DataFrame, items: DataFrame) -> DataFrame:
    """What a job holds: counts, sizes, and its items in order."""
    held = items.groupBy("job_id").agg(
        F.count("*").alias("item_count"),
        F.sum("size_bytes").alias("total_bytes"),
        F.sum("extracted_chars").alias("total_chars"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "source_name"))), lambda x: x["source_name"]), ",").alias("sources"),
    )
    return jobs.join(held, "job_id", "left").select("job_id", "name", "status", F.coalesce("item_count", F.lit(0)).alias("item_count"), F.coalesce("total_bytes", F.lit(0)).alias("total_bytes"), F.coalesce("total_chars", F.lit(0)).alias("total_chars"), F.coalesce("sources", F.lit("")).alias("sources"))


def pending_items(items: DataFrame) -> DataFrame:
    """The queue, first in first out."""
    return items.filter(F.col("status").isin(*fixed.JOB_OPEN)).orderBy("created_at", "item_id").select("item_id", "job_id", "status", "created_at")


def items_of(items: DataFrame, job_id: object, item_id: object | None = None) -> DataFrame:
    """The items of a job in order, or one of them; an item of another job is not found."""
    rows = items.filter(F.col("job_id") == F.lit(job_id))
    return (rows if item_id is None else rows.filter(F.col("item_id") == F.lit(item_id))).orderBy("seq")


def updated(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The table with the columns of ``changes`` set where a row has its key; a null keeps what there is.

    Every row stays one row. Changes of one key act one after another in the order of their values, nulls first.
    """
    fields = [c for c in changes.columns if c != key]
    place = F.struct(*fields)
    new = changes.groupBy(key).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(f"__new_{c}") for c in fields))
    rows = table.join(new, key, "left")
    return rows.select(*(F.coalesce(f"__new_{c}", c).alias(c) if c in fields else c for c in table.columns))


def cleared(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The table without the rows of some keys, as before a re-run."""
    return table.join(gone.select(key).distinct(), key, "left_anti")


def running_total(rows: DataFrame, key: str, order: str, value: str, width: int = 4096) -> DataFrame:
    """A running sum of ``value`` by ``key`` in the order of a whole-number column, as ``running``.

    Sums by ranges of the order column first, so that a hot key is spread over its ranges and only a
    row a range is ever summed over the whole key.
    """
    ranged = rows.withColumn("__range", F.floor(F.col(order) / width))
    sums = ranged.groupBy(key, "__range").agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(key, "__range", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy(key, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(sums, [key, "__range"]).withColumn("running", F.col("__base") + F.sum(value).over(within)).drop("__range", "__base")


def caps(rows: DataFrame, job: str, seq: str, size: str, most_file: int = fixed.MAX_FILE_BYTES, most_job: int = fixed.MAX_JOB_BYTES) -> DataFrame:
    """Each item with its job's running size and why it would be rejected, if it would."""
    rows = running_total(rows, job, seq, size)
    reason = F.when(F.col(size) > most_file, "file exceeds size cap").when(F.col("running") > most_job, "job exceeds size cap")
    return rows.withColumn("rejected", reason)
