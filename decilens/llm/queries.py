"""Registered queries of this subpackage: name -> callable(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from decilens.llm import chat, langid, minhash_dedup, packing, pieces, quality, secrets, shard, syncmers, toxicity
from decilens.llm._io import table
from decilens.llm.oracles import ORACLES


__all__ = ["ORACLES", "QUERIES"]


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law")
    )
    return shard.assign_shards(docs, "doc_id", 40, "text_crc32")


def op3_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return quality.quality_rules(docs, text=False).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def toxicity_model(docs: DataFrame, labels: DataFrame, max_rows: int = 16_000) -> toxicity.Model:
    """Fitted on labelled documents that are not held out."""
    known = toxicity.bounded(labels.where(~held_out()), max_rows)
    # At most about max_rows pairs of numbers: bounded by a parameter, so it may be broadcast.
    return toxicity.train(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id"))


def op4_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op5_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op6_distinct_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("piece_bpe_32k.model"))


def language_model(docs: DataFrame) -> langid.Model:
    """Counted over all documents with a language that are not held out."""
    return langid.train(docs.where(~held_out() & F.col("lang").isNotNull()).select("lang", "text"))


def op7_mixture_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs.select("doc_id", "text"), language_model(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "lang_set")


def op8_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan_secrets(docs, secrets.train(secrets.default_samples(docs)))
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secrets.listed("assign", "access", "hex"), 256).alias("base_sha256"),
        secrets.listed("assign", "access", "hex", "markov").alias("spans"),
    )


def op9_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op10_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = syncmers.fingerprints(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        syncmers.written("fp").alias("fingerprint"),
        syncmers.written("edited_fp").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_dedup,
        op2_jump_sharding,
        op3_adaptive_quality,
        op4_counterfactual_toxicity,
        op5_snapshot_collapse,
        op6_distinct_chunks,
        op7_mixture_langid,
        op8_markov_secrets,
        op9_bin_slack_packing,
        op10_closed_syncmers,
    )
}
