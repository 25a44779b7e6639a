"""One query for each corpus operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuslens.llm import (hard_negatives, html_text, jaccard_join, line_chunks, merkle_manifest, mixing, packing, quality_model, quality_rules,
                            rotated_codes, secret_ledger, simhash_index, toxicity)
from corpuslens.llm.common import read_table
from corpuslens.llm.oracles import ORACLES  # noqa: F401


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read_table(spark, sf_dir, "documents"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = mixing.place(read_table(spark, sf_dir, "documents"), keep=["doc_id", "source"])
    return placed.select("doc_id", "source", F.col("__cl_block_no").alias("block"), F.col("__cl_release").alias("release"),
                         F.col("__cl_deadline").alias("deadline"), F.col("__cl_slot").alias("slot"))


def op4_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_ledger.scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("findings", lambda x: x["kind"].isin(*secret_ledger.BASE_KINDS))
    return found.select("doc_id", *map(count, secret_ledger.BASE_KINDS), F.sha2(secret_ledger.joined(base), 256).alias("base_sha256"),
                        secret_ledger.joined(F.col("findings")).alias("spans"))


def op5_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotated_codes.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept")


def op8_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_chunks.deduplicate(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", F.size("__cl_removed").alias("n_removed"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read_table(spark, sf_dir, "pages"))


def op10_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.predict(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return scored.withColumn("toxic", (F.col("p_toxic") >= toxicity.TOXIC).cast("int"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    return hard_negatives.mine(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0,
                               F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.col("n_chars").cast("decimal(38,0)")
    claimed = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, said + 1).otherwise(said)
    proofs = merkle_manifest.manifest(read_table(spark, sf_dir, "documents"), claimed)
    top = merkle_manifest.folded(F.col("claimed"), F.col("digits"), F.col("siblings"))
    return proofs.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join(F.flatten("siblings"), ""), 256).alias("proof_sha256"),
                         top.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_simhash_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_index.near_duplicates(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_quality_model": op2_quality_model,
    "op3_pfair_mix": op3_pfair_mix,
    "op4_secret_ledger": op4_secret_ledger,
    "op5_rotated_codes": op5_rotated_codes,
    "op6_quality_rules": op6_quality_rules,
    "op7_packing": op7_packing,
    "op8_line_chunks": op8_line_chunks,
    "op9_html_text": op9_html_text,
    "op10_toxicity_chain": op10_toxicity_chain,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_simhash_index": op13_simhash_index,
}

