"""Registered queries of the training-data operators, with their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm import chat, exact_dedup, hard_negatives, mixing, packing, periodic, quality, secrets, simhash, sitetree, token_counts, tokens, topk, toxicity
from palaver.llm.common import table

VOCABULARY = "word_bpe_49k.json"
CHAT_PROBE = "\\### Assistant: </turn> ok"


def op1_block_max_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), tokens.vocabulary(VOCABULARY))


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_site_tree(spark: SparkSession, folder: str) -> DataFrame:
    return sitetree.extract_text(table(spark, folder, "pages"))


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(spark, folder, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"), tokens.vocabulary(VOCABULARY))


def op8_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CHAT_PROBE).alias("text"),
    )
    chats = chat.format_chats(turns.unionByName(probe))
    out = chats.select(
        "conv_id", "valid",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: chat.unescape(s["text"])).alias("trained"),
    ).select(
        "*", chat.read_back(F.col("formatted")).alias("turns"), F.array_join("trained", "").alias("loss")
    )
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform(
            "turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, folder, "documents"))
    return groups.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op10_secrets(spark: SparkSession, folder: str) -> DataFrame:
    scanned = secrets.scan_secrets(table(spark, folder, "documents"))
    live = F.filter("found", lambda s: s["live"])
    return scanned.select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", secrets.span_text(F.col("found")).alias("spans"),
        secrets.span_text(live).alias("live_spans"),
        F.coalesce(F.array_max(F.transform("found", lambda s: s["owners"])), F.lit(0)).alias("most_owners"),
    )


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", periodic.repeating_tail(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic.periodic_runs(docs).withColumn("best", periodic.greatest(F.col("runs")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(periodic.listed(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, folder, "embeddings").withColumn("label", moved)
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 50 == 0)


QUERIES = {
    "op1_block_max_topk": op1_block_max_topk,
    "op2_packing": op2_packing,
    "op3_mixing": op3_mixing,
    "op4_site_tree": op4_site_tree,
    "op5_toxicity": op5_toxicity,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_chat_format": op8_chat_format,
    "op9_simhash": op9_simhash,
    "op10_secrets": op10_secrets,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_quality": op12_quality,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLES = {
    "op1_block_max_topk": topk.SQL, "op13_hard_negatives": hard_negatives.SQL,
    "op3_mixing": mixing.SQL, "op6_exact_dedup": exact_dedup.SQL, "op8_chat_format": chat.SQL}
