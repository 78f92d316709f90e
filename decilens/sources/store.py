"""Tables that are kept: replaced as a whole, looked up by key, or worked out once and cached."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decilens.operators.cohort import first_rows, pending


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _folder(spark, path)
    return bool(fs.exists(at))


def replace(df: DataFrame, path: str, write: Callable[[DataFrame, str], None] = lambda d, p: d.write.parquet(p)) -> None:
    """Put ``df`` at ``path``: written beside it first, then renamed, so readers see the old table
    or the new one, and ``df`` may read the old one. A failed write leaves the old one."""
    spark = df.sparkSession
    beside = f"{path}.new-{uuid.uuid4().hex}"
    write(df, beside)
    at, fs = _folder(spark, path)
    fs.delete(at, True)
    if not fs.rename(_folder(spark, beside)[0], at):
        raise OSError(f"cannot rename {beside} to {path}")


@dataclass(frozen=True)
class DocStore:
    """Documents by ``uid`` and the positions a vector index knows them by, as two Parquet tables
    below ``path``; lookups are joins."""

    path: str

    def add(self, docs: DataFrame) -> None:
        """Append ``docs(uid, text, title, ...)``; a uid added again is another version."""
        docs.withColumn("added_at", F.current_timestamp()).write.mode("append").parquet(f"{self.path}/docs")

    def docs(self, spark: SparkSession) -> DataFrame:
        """The last version of each document."""
        rows = spark.read.parquet(f"{self.path}/docs")
        return first_rows(rows, 1, "uid", order=[F.desc("added_at"), F.xxhash64(*[c for c in rows.columns if c != "added_at"])]).drop("added_at")

    def search(self, spark: SparkSession, wanted: DataFrame) -> DataFrame:
        """``wanted(uid, ...)`` with its documents; unknown ids go."""
        return wanted.join(self.docs(spark), "uid")

    def set_positions(self, positions: DataFrame, append: bool = False) -> None:
        """``positions(position, uid)``, in place of the known ones or behind them."""
        if append:
            positions.write.mode("append").parquet(f"{self.path}/positions")
        else:
            replace(positions, f"{self.path}/positions")

    def at(self, found: DataFrame) -> DataFrame:
        """``found(position, ...)`` with the documents that stand there."""
        spark = found.sparkSession
        return self.search(spark, found.join(spark.read.parquet(f"{self.path}/positions"), "position"))

    def stats(self, spark: SparkSession) -> DataFrame:
        """One row: documents, versions, and documents without a position."""
        rows, known = spark.read.parquet(f"{self.path}/docs"), spark.read.parquet(f"{self.path}/positions")
        missing = pending(rows.select("uid").distinct(), known, "uid").agg(F.count(F.lit(1)).alias("without_position"))
        return rows.agg(F.countDistinct("uid").alias("documents"), F.count(F.lit(1)).alias("versions")).crossJoin(missing)  # two single rows


def save_answers(answers: DataFrame, path: str) -> None:
    """Append ``answers(question_id, answer, ...)`` as JSON lines."""
    answers.write.mode("append").json(path)


def load_answers(spark: SparkSession, path: str) -> DataFrame:
    """(question_id, answer): of a question answered several times, the answer that sorts first;
    a folder that is not there has none."""
    kind = "question_id string, answer string"
    if not exists(spark, path):
        return spark.createDataFrame([], kind)
    rows = spark.read.schema(kind).json(path).where("question_id is not null")
    return rows.groupBy("question_id").agg(F.min("answer").alias("answer"))


def unanswered(questions: DataFrame, path: str) -> DataFrame:
    """The questions a run has still to answer."""
    return pending(questions, load_answers(questions.sparkSession, path), "question_id")


_VALUES: dict[str, dict] = {}


def cached(spark: SparkSession, path: str, make: Callable[[], dict] | None = None) -> dict:
    """A small document by path: from memory, else from the file, else made and written; a
    LookupError if it is nowhere and nothing makes it."""
    if path in _VALUES:
        return _VALUES[path]
    if exists(spark, path):
        value = json.loads("".join(r.value for r in spark.read.text(path).collect()))
    elif make is not None:
        value = make()
        text = spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string")
        replace(text, path, lambda d, p: d.coalesce(1).write.text(p))
    else:
        raise LookupError(f"no values at {path}")
    _VALUES[path] = value
    return value


def forget(path: str | None = None) -> None:
    """Drop what is held in memory, all of it or one path's."""
    _VALUES.clear() if path is None else _VALUES.pop(path, None)
