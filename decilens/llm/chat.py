"""Chat formatting after cumulative-snapshot collapse.

Logs often hold a conversation several times, each time a few turns longer. The hash of each
prefix of a conversation is the running xor of hashes of (position, role, text); a
conversation whose full hash is a shorter prefix of another one is dropped by an anti-join,
as are all but the least id of equal ones. The rest is rendered turn by turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from decilens.llm._io import cut

OPEN, CLOSE = "<|{role}|>\n", "\n<|end|>\n"


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` with position (from 1) and two hashes of the prefix
    up to it. Turns are ordered by turn, then role, then text, nulls first.

    The running xor needs one pass over sorted turns and no buffer, however long a
    conversation is.
    """
    turns = turns.select("conv_id", "turn", "role", "text").where("conv_id is not null")
    w = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.withColumn("position", F.row_number().over(w))
    one = lambda seed: F.xxhash64(F.lit(seed), "position", F.col("role").isNull(), "role", F.col("text").isNull(), "text")
    run = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumns({"h1": one(1), "h2": one(2)}).withColumns({"p1": F.bit_xor("h1").over(run), "p2": F.bit_xor("h2").over(run)}).drop("h1", "h2")


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that are no prefix of a longer one; of equal
    ones the least conv_id. Rows without a conv_id belong to no conversation."""
    hashed = cut(prefix_hashes(turns).select("conv_id", "position", "p1", "p2"))
    length = hashed.groupBy("conv_id").agg(F.max("position").alias("n_turns"))
    marked = hashed.join(length, "conv_id")
    full = marked.where("position = n_turns").select("conv_id", "n_turns", "p1", "p2")
    # Prefixes are made distinct before they meet a conversation: a first turn that many share is one row.
    shorter = marked.where("position < n_turns").select(F.col("position").alias("n_turns"), "p1", "p2").distinct()
    open_ = full.groupBy("n_turns", "p1", "p2").agg(F.min("conv_id").alias("conv_id"))
    return open_.join(shorter, ["n_turns", "p1", "p2"], "left_anti").select("conv_id", "n_turns")


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, position, n_turns, segment): the turns of maximal conversations as chat text.

    A conversation is its segments in order of position. They stay rows: no task has to hold
    a conversation of any length. Null roles read ``unknown``, null texts are empty.
    """
    role = F.coalesce("role", F.lit("unknown"))
    before, after = OPEN.split("{role}")
    segment = F.concat(F.lit(before), role, F.lit(after), F.trim(F.coalesce("text", F.lit(""))), F.lit(CLOSE))
    kept = maximal(turns)
    rows = turns.select("conv_id", "turn", "role", "text")
    w = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    return rows.join(kept, "conv_id").withColumn("position", F.row_number().over(w).cast("long")).select("conv_id", "position", F.col("n_turns").cast("long").alias("n_turns"), segment.alias("segment"))
