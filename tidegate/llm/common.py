"""Shared pieces of the corpus operators: table access, shared scratch tables, batch helpers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``, and must. Only where all of Spark runs on one machine
    (tests, a laptop) a temporary folder is made instead, and kept for the life of the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidegate-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/tidegate/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_tables: list[dict] = []


def worker_table() -> dict:
    """A table that an operator keeps in the worker process, until another operator's task begins there."""
    _tables.append({})
    return _tables[-1]


def begin(own: dict | None = None) -> None:
    """At the start of a task in a worker process: the tables of other operators go, and free memory goes back to the system."""
    gone = False
    for table in _tables:
        if table is not own and table:
            table.clear()
            gone = True
    if gone or own is None:
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass


def text_bytes(name: str = "text") -> Column:
    """A text column as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def partitions_for(spark: SparkSession, rows: int, per_task: int) -> int:
    """Enough partitions that a task gets about ``per_task`` rows, and no fewer than a shuffle's."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task), 1)


#: A group that holds over one in so many rows is hot; there are no more than this many.
HOT = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, n: str, how: str = "inner") -> DataFrame:
    """``rows`` with the one row of ``groups`` that has their key; ``n`` says how many rows a group has.

    Hot groups, ``HOT`` at most, are broadcast to where the rows are, so no task gets all rows of one.
    """
    hot = groups.filter(F.col(n) > rows.count() // HOT)
    if hot.isEmpty():
        return rows.join(groups, key, how)
    hot = F.broadcast(hot)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(groups, key, how))


#: Rows of a few numbers, 16 MB or so, up to which a table is broadcast.
FEW = 500_000


def few(table: DataFrame) -> DataFrame:
    """A written table of narrow rows, to be broadcast if its rows are counted to be few; else it is shuffled like any other."""
    return F.broadcast(table) if table.count() <= FEW else table


def row_key(doc_id: Column, raw: Column) -> Column:
    """What a row is known by: its id, null or not, and the hash of its text."""
    doc_id = doc_id.cast("long")
    return F.struct(doc_id.isNull().alias("none"), F.coalesce(doc_id, F.lit(0)).alias("id"), raw.alias("raw")).alias("__tg_key")


def without_rows(docs: DataFrame, gone: DataFrame, again: DataFrame) -> DataFrame:
    """``docs`` without the rows whose key is in ``gone``; of rows whose key is in ``again``, one stays, that with the smallest hash of all columns.

    Both have ``__tg_key`` once each and come from the shared folder; where they are few the texts stay where they are.
    """
    gone = few(gone)
    rows = docs.withColumn("__tg_key", row_key(F.col("doc_id"), F.xxhash64(text_bytes()))).join(gone, "__tg_key", "left_anti")
    names = [F.col(f"`{c}`") for c in docs.columns]
    if again.isEmpty():
        return rows.select(*names)
    one = Window.partitionBy("__tg_key").orderBy(F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if f.dataType.typeName() != "map"]))
    again = few(again)
    twice = rows.join(again, "__tg_key", "left_semi").withColumn("__tg_row", F.row_number().over(one)).filter("__tg_row = 1")
    return rows.join(again, "__tg_key", "left_anti").select(*names).unionByName(twice.select(*names))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def blocks(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges [a, b) of rows whose sizes sum to about ``most``; a larger row stands alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
