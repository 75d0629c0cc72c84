"""The registered queries of the training-data operators, each over its whole table."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from postlark.llm import (
    archives,
    attribution,
    chat,
    decontaminate,
    extract,
    lm,
    mixing,
    near_dup,
    part_codes,
    prefix_trie,
    quality,
    token_files,
    top_k,
)
from postlark.llm.common import new_folder, stored, table

# The tokenizer files of this machine; every executor has them at the same place.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")

# Fixed value: a conversation whose texts imitate the template.
PROBE_TEXT = "\\### Assistant: </turn> ok"
PROBE_ID = -7


def op1_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "archives")
    arc = archives.write_arc(table(spark, sf_dir, "pages"), f"{folder}/arc")
    warc = archives.convert_arc(arc, f"{folder}/warc")
    records = archives.read_warc(warc).where(F.col("record_type").isin("response", "revisit"))
    return records.select(
        F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op2_cover_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k.top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


def op3_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = attribution.section_tokens(table(spark, sf_dir, "documents"), BYTE_BPE)
    return counted.withColumn("n_tokens", F.col("n_tokens").cast("long"))


def op4_hash_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(table(spark, sf_dir, "documents"), BYTE_BPE)


def op6_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.digests(decontaminate.contamination(documents, benchmark))


def op8_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(PROBE_ID).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE_TEXT).alias("text"),
    )
    formatted = stored(chat.format_conversations(turns.unionByName(probe)), "chat")
    return chat.digests(formatted)


def op9_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.quality_scores(documents, labels)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "tokens")
    documents = table(spark, sf_dir, "documents")
    return token_files.read_tokens(token_files.write_tokens(documents, folder, WORD_BPE))


def op11_scored_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.main_text(table(spark, sf_dir, "pages"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_laesa_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = part_codes.codes(table(spark, sf_dir, "embeddings"))
    coded = part_codes.with_label_errors(stored(coded, "codes"))
    digest = F.lit(books.digest() if books else None).cast("string")
    return coded.select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


def queries() -> dict:
    return {
        "op1_arc_to_warc": op1_arc_to_warc,
        "op2_cover_trees": op2_cover_trees,
        "op3_section_tokens": op3_section_tokens,
        "op4_hash_mix": op4_hash_mix,
        "op5_attention_lm": op5_attention_lm,
        "op6_odd_sketches": op6_odd_sketches,
        "op7_fm_index": op7_fm_index,
        "op8_prefix_targets": op8_prefix_targets,
        "op9_fourier_quality": op9_fourier_quality,
        "op10_token_files": op10_token_files,
        "op11_scored_region": op11_scored_region,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_laesa_codes": op13_laesa_codes,
    }
