"""Tables, checkpoints and Arrow helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. A folder of this machine stands in for it only
    where the whole session runs on this machine, as in tests."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them see")
        folder = tempfile.mkdtemp(prefix="decilens-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget its lineage."""
    spark = df.sparkSession
    shared_folder(spark)
    # The rows are in the shared folder then, so the shuffle files behind them may go at once.
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        return df.select("*").checkpoint()
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


#: There are at most so many hot keys, so they may be broadcast; fewer rows than LEAST_HOT are never hot.
HOT_KEYS, LEAST_HOT = 10_000, 512


def hot_keys(counts: DataFrame, total: int) -> DataFrame:
    """Of ``counts(key..., n)`` the keys with more than one row in HOT_KEYS of all ``total``
    rows, with the number of ``parts`` to deal each to; at most HOT_KEYS rows."""
    most = max(LEAST_HOT, total // HOT_KEYS)
    keys = [c for c in counts.columns if c != "n"]
    return counts.where(F.col("n") > most).select(*keys, F.ceil(F.col("n") / most).cast("long").alias("parts"))


def spread(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame, by: str | Column) -> DataFrame:
    """Inner join of ``left``, which may have many rows of one key, with ``right``: rows of hot
    keys are dealt to parts by a hash of ``by``, and each part gets its copy of the right row."""
    hot = F.broadcast(hot)
    one = left.join(hot, keys, "left").withColumn("__part", F.coalesce(F.pmod(F.xxhash64(by), "parts"), F.lit(0))).drop("parts")
    last = F.coalesce(F.col("parts"), F.lit(1).cast("long")) - 1
    two = right.join(hot, keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), last))).drop("parts")
    return one.join(two, [*keys, "__part"]).drop("__part")


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns whose names an operator is about to add (case-insensitive)."""
    taken = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in taken])


def _release() -> None:
    """Give freed memory back to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


Batches = Iterator[pa.RecordBatch]


def releasing(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` for mapInArrow, with the worker's freed memory given back when a task ends: workers
    outlive tasks, and would else keep what their largest task took beside all that come later."""

    def task(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            _release()

    return task


def filled(column: pa.Array) -> pa.Array:
    """A string column without nulls (null reads as empty)."""
    return pc.fill_null(column.cast(pa.string()), "")


def plus(schema: StructType, **types: str) -> StructType:
    """A schema with more columns; ``schema`` itself stays as it is."""
    out = StructType(list(schema.fields))
    for name, kind in types.items():
        out = out.add(name, DataType.fromDDL(kind))
    return out
