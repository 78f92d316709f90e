"""Question cohorts: balancing, caps, deficits, set logic, resume."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def draw_order(key: str = "question_id", seed: int = 42):
    """A fixed pseudo-random order: md5 of seed and key, the same in any engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def first_rows(df: DataFrame, n, *by: str, order) -> DataFrame:
    """The first ``n`` rows (a number or a column) of each group."""
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def fill_quotas(counts: dict[tuple[int, str], int], datasets: list[str], quota: dict[int, int]) -> list[tuple[int, str, int]]:
    """Fill from the bottom: in each decile the smallest dataset first, each taking an equal
    part of what is left; a dataset without rows still has its turn."""
    out = []
    for decile, left in sorted(quota.items()):
        order = sorted(datasets, key=lambda d: (counts.get((decile, d), 0), d))
        for i, d in enumerate(order):
            take = min(counts.get((decile, d), 0), left // (len(order) - i))
            left -= take
            out.append((decile, d, take))
    return out


def balance_fill(questions: DataFrame, quota: int | None = None, seed: int = 42) -> DataFrame:
    """Per decile, rows of all datasets up to a quota, by default the least decile-dataset count
    times the number of datasets. The counts, a row for each pair, come to the driver."""
    rows = questions.groupBy("decile", "dataset").count().collect()
    counts = {(r.decile, r.dataset): r["count"] for r in rows}
    datasets = sorted({r.dataset for r in rows})
    deciles = sorted({r.decile for r in rows})
    each = {d: quota if quota is not None else min(v for (dd, _), v in counts.items() if dd == d) * len(datasets) for d in deciles}
    plan = questions.sparkSession.createDataFrame(fill_quotas(counts, datasets, each), "decile int, dataset string, take int")
    return first_rows(questions.join(F.broadcast(plan), ["decile", "dataset"]), F.col("take"), "decile", "dataset", order=[draw_order(seed=seed), "question_id"]).drop("take")


def balance_deciles(questions: DataFrame, target: int | None = None, seed: int = 42) -> DataFrame:
    """At most ``target`` rows of each decile, by default the smallest decile's count."""
    if target is None:
        target = questions.groupBy("decile").count().agg(F.min("count")).first()[0] or 0
    return first_rows(questions, target, "decile", order=[draw_order(seed=seed), "question_id"])


def cap(questions: DataFrame, target: int, seed: int = 42) -> DataFrame:
    """``target // datasets`` rows of each decile and dataset; a larger target only adds rows."""
    n = questions.agg(F.countDistinct("dataset")).first()[0] or 1
    return first_rows(questions, target // n, "decile", "dataset", order=[draw_order(seed=seed), "question_id"])


def deficit(questions: DataFrame, target: int) -> DataFrame:
    """(decile, needed) for the deciles with fewer than ``target`` rows."""
    spine = questions.sparkSession.range(10).select(F.col("id").cast("int").alias("decile"))
    have = questions.groupBy("decile").agg(F.count(F.lit(1)).alias("n"))
    return spine.join(have, "decile", "left").select("decile", (F.lit(target) - F.coalesce("n", F.lit(0))).alias("needed")).where("needed > 0")


def hash_split(df: DataFrame, key: str = "question_id", train: float = 0.9, seed: int = 42) -> DataFrame:
    """``split``: train or test by a hash of the key, stable as rows come and go."""
    low = F.conv(F.substring(draw_order(key, seed), 1, 6), 16, 10).cast("long")
    return df.withColumn("split", F.when(low < train * 16**6, "train").otherwise("test"))


def in_all(tables: dict[str, DataFrame], key: str = "question_id") -> DataFrame:
    """Keys that every table has."""
    rows = reduce(DataFrame.union, [df.select(key, F.lit(n).alias("t")) for n, df in tables.items()])
    return rows.groupBy(key).agg(F.countDistinct("t").alias("n")).where(F.col("n") == len(tables)).select(key)


def pending(items: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Items that no finished row covers."""
    return items.join(done.select(*keys).distinct(), list(keys), "left_anti")


def same_cohort(a: DataFrame, b: DataFrame, key: str = "question_id") -> bool:
    return a.select(key).exceptAll(b.select(key)).isEmpty() and b.select(key).exceptAll(a.select(key)).isEmpty()


def not_all_equal(df: DataFrame, *metrics: str) -> DataFrame:
    """Rows in which the known metrics are not all equal."""
    return df.where(F.size(F.array_distinct(F.filter(F.array(*metrics), lambda x: x.isNotNull()))) > 1)


def with_default_columns(df: DataFrame, **types: str) -> DataFrame:
    """``df`` with null columns for the named ones it lacks."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in types.items() if c not in df.columns})


def many_to_one(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Inner join that fails when a key is repeated on the right."""
    w = W.partitionBy(*keys)
    once = right.withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__n", F.when(F.col("__n") > 1, F.raise_error(F.lit(f"keys {keys} are not unique"))).otherwise(F.col("__n")))
    return left.join(once.where("__n = 1").drop("__n"), list(keys))


def one_to_one(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Inner join that fails when a key is repeated on either side."""
    return many_to_one(many_to_one(right.select(*keys), left, *keys), right, *keys)
