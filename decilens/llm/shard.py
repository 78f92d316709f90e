"""Sharding by jump consistent hashing.

The shard of a row follows from its key and the number of shards alone: no ring table is
kept, and one more shard takes its share of rows from all others and moves no other row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from decilens.llm._io import without

#: Rows numbered within one task.
BLOCK = 500_000


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of 64-bit keys: each step leaps to the next shard count at which
    the key would have moved, until that lies beyond ``shards``."""
    state = keys.astype(np.uint64)
    at = np.zeros(len(state), np.int64)
    to = np.zeros(len(state), np.int64)
    moving = np.arange(len(state))
    while len(moving):
        at[moving] = to[moving]
        state[moving] = state[moving] * np.uint64(2862933555777941757) + np.uint64(1)
        draw = (state[moving] >> np.uint64(33)).astype(np.float64) + 1.0
        to[moving] = ((at[moving] + 1) * (2.0**31 / draw)).astype(np.int64)
        moving = moving[to[moving] < shards]
    return at


def _jump_udf(shards: int):
    @F.pandas_udf("int")
    def shard(key: pd.Series) -> pd.Series:
        return pd.Series(jump(key.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return shard


def assign_shards(docs: DataFrame, key: str = "doc_id", shards: int = 40, tie: str | None = None) -> DataFrame:
    """``docs`` with shard, grown_shard (with one more shard) and slot (gapless from 0 in a shard).

    Law ``key``: key and shard count decide, so repeated rows meet in one shard. A null key
    counts as one more key value. Slots follow the key's blocks and, within a block, key and
    ``tie`` (a column that orders rows of one key). Columns named like the new ones are replaced.

    Slots need no task that sees a whole shard: rows are numbered within hash blocks of a
    shard, and a block starts where the counts of those before it end.
    """
    docs = without(docs, "shard", "grown_shard", "slot")
    hashed = F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("\0null")))
    placed = docs.withColumns({"shard": _jump_udf(shards)(hashed), "grown_shard": _jump_udf(shards + 1)(hashed)})
    blocks = max(1, -(-docs.count() // (shards * BLOCK)))
    order = [F.col(key).asc_nulls_last()] + ([F.col(tie)] if tie else [])
    placed = placed.withColumn("__block", F.pmod(F.xxhash64(F.lit(1), hashed), F.lit(blocks)))
    placed = placed.withColumn("__at", F.row_number().over(W.partitionBy("shard", "__block").orderBy(*order)))
    counts = placed.groupBy("shard", "__block").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select(
        "shard", "__block", F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__base")
    )
    out = placed.join(before, ["shard", "__block"]).withColumn("slot", (F.col("__base") + F.col("__at") - 1).cast("long"))
    return out.select(*docs.columns, "shard", "slot", "grown_shard")


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder for each shard, rows in slot order within a file."""
    placed.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(path)
