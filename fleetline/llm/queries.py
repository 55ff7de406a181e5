"""The queries opN_<name> and pipeline, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetline.llm import ann, balltree, chat, decontaminate, divergence, katz, langid, linededup, mixing, neardup, secrets, tokenfile, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """Path of the tokenizer file that op10 and the pipeline use."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs).withColumn("text", F.coalesce("text", F.lit("")))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ann.usable_vectors(_table(spark, sf_dir, "embeddings"))
    return ann.nearest(vectors, vectors.filter(F.col("id") % 100 == 0), 10)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return leaks.select(F.col("k.id").alias("doc_id"), "item_id", "n_windows", "n_matched", "coverage", "n_slots", "consistency", "n_items", "verbatim")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_classes(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_class")


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_documents(_table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(_table(spark, sf_dir, "documents"))


def op10_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.encode_documents(spark, _table(spark, sf_dir, "documents"), vocabulary())


def op11_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(_table(spark, sf_dir, "documents"))


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = [F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")]
    return chat.format_and_digest(chat.text_turns(turns.unionByName(spark.range(2).select(*extra))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_nearest": op2_nearest,
        "op3_decontamination": op3_decontamination,
        "op4_near_duplicates": op4_near_duplicates,
        "op5_katz": op5_katz,
        "op6_secrets": op6_secrets,
        "op7_mixing": op7_mixing,
        "op8_toxicity": op8_toxicity,
        "op9_langid": op9_langid,
        "op10_token_file": op10_token_file,
        "op11_ball_tree": op11_ball_tree,
        "op12_divergence": op12_divergence,
        "op13_chat": op13_chat,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": linededup.SQL, "op11_ball_tree": balltree.SQL, "op12_divergence": divergence.SQL, "op13_chat": chat.SQL}
