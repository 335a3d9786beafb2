"""Registered queries: each operator over its whole table, as the contracts
word the columns.  ``QUERIES`` and ``SQL`` are added by the entry module."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from . import (chat_format, fingerprints, line_dedup, lm_scoring, mixing, packing, periodic_runs, pieces, pii,
               quality_rules, secret_scan, simhash_dedup, vector_codes)
from .common import text_of, words
from .sql import SQL  # noqa: F401

SHINGLE, MAX_BITS = 3, 3      # of op5's contract


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return lm_scoring.score(docs, lm_scoring.hold_out(docs))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_report(read_table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "n_lines", "n_deleted", "deleted",
                      F.sha2(text_of(out).cast("binary"), 256).alias("text_sha256"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat_format.digest(chat_format.format_conversations(rows.unionByName(planted)))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_dedup.clusters(read_table(spark, sf_dir, "documents"), SHINGLE, MAX_BITS)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "end", "label", F.round("probability", 6).alias("probability"), "is_secret")


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(read_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path()).drop("n_loss")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(read_table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(_with_periodic_tails(read_table(spark, sf_dir, "documents")))
    return found.withColumn("_best", periodic_runs.strongest(F.col("runs"))).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "_best.start", "_best.length", "_best.period",
        F.floor(F.col("_best.length") * 1000 / F.col("_best.period")).alias("exponent_milli"),
        F.sha2(periodic_runs.listed(F.col("runs")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def _with_periodic_tails(docs: DataFrame) -> DataFrame:
    """The contract's documents: where crc32(id) divides by 10, the words from
    one on repeat with a period; a null id changes nothing."""
    h = F.crc32(docs["doc_id"].cast("string").cast("binary"))
    g = F.floor(h / 10)
    df = docs.select("doc_id", text_of(docs).alias("text"), g.alias("_g"),
                     F.when(h % 10 == 0, words(text_of(docs))).alias("_w"))
    df = df.withColumn("_n", F.size("_w").cast("long")).withColumn("_a", F.pmod(F.col("_g"), F.greatest("_n", F.lit(1))))
    df = df.withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8)))
    left = F.col("_n") - F.col("_a")
    tail = F.flatten(F.array_repeat(F.slice("_w", (F.col("_a") + 1).cast("int"), F.col("_p").cast("int")),
                                    F.ceil(left / F.col("_p")).cast("int")))
    edited = F.array_join(F.concat(F.slice("_w", F.lit(1), F.col("_a").cast("int")),
                                   F.slice(tail, F.lit(1), left.cast("int"))), " ")
    return df.select("doc_id", F.when(F.col("_n") > 0, edited).otherwise(F.col("text")).alias("text"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs, tokenizer_path("piece_bpe_32k.model"), decoded_col="decoded").select(
        "row.doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.compress(read_table(spark, sf_dir, "embeddings"))
    return codes.select(F.col("id").alias("vec_id"), "code", "error", "label_error",
                        F.lit(vector_codes.books_digest(books)).alias("codebooks_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_lm_scoring, op2_line_dedup, op3_chat_format, op4_quality_rules, op5_simhash_dedup, op6_secret_scan,
    op7_source_mix, op8_fingerprints, op9_packing, op10_pii, op11_periodic_runs, op12_sentencepiece,
    op13_vector_codes)}
