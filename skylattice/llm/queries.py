"""Registered queries of the text and vector operators: thin digests of each operator's results over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm import compaction, embedding_dedup, filter_audit, html_extract, language_id, line_rules, merge_dropout, ngram_join, packing, secret_scan, storage, target_resampling, token_files, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str, folds: int):
    """Which of ``folds`` parts a document is in, by the checksum of its id as text."""
    return F.crc32(F.col(doc_id).cast("string")) % folds


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_packing_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole conversations under all three limits; answers alone bear loss."""
    counted = packing.count_turns(table(spark, sf_dir, "conversations"), public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack_examples(counted, "example_id", "tokens", "loss_tokens", CONVERSATIONS)


#: A sequence holds few conversations, and no more answers than that their loss weighs like other sequences'.
CONVERSATIONS = packing.Limits(tokens=8192, segments=6, loss_tokens=5120)


def op4_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merge_dropout.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"), "lossless")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    profiles = language_id.fit(docs.where(~held_out), "doc_id", "text", "lang")
    found = docs.select("doc_id", held_out.alias("held_out"), language_id.predicted(F.col("text"), profiles, spark).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = storage.new_path(spark, "token-files")
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_token_files(spark, path, [tuple(r) for r in manifest.collect()])


def op7_shard_compaction(spark: SparkSession, sf_dir: str, waves: int = 4) -> DataFrame:
    """Documents arrive in waves; each is appended and the shards are compacted. Read back: where each row lies."""
    docs = table(spark, sf_dir, "documents")
    store = compaction.ShardStore(spark, storage.new_path(spark, "shards"), docs.schema)
    wave = F.pmod(F.xxhash64("doc_id"), F.lit(waves))
    for k in range(waves):
        store.append(docs.where(wave == k))
        store.compact()
        store.vacuum()
    return store.read().select(
        "doc_id",
        F.length("text").cast("long").alias("text_chars"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.col("_metadata.file_name").alias("shard"),
        F.col("_metadata.file_size").alias("shard_bytes"),
        F.lit(store.versions()[-1]).cast("long").alias("version"),
    )


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.near_copies(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "n_links")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    scorer = toxicity.fit(docs, labels.where(~held_out))
    found = docs.select("doc_id", held_out.alias("held_out"), toxicity.scored(F.col("text"), scorer, spark).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.judge(table(spark, sf_dir, "documents"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    counts = ["n_assign", "n_access", "n_hex", "base_sha256"]
    return found.select("doc_id", *counts, secret_scan.listed("reported").alias("spans"), "n_weak", F.size("credentials").cast("long").alias("n_credentials"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_QUERIES = [op1_html_extraction, op2_embedding_near_dedup, op3_packing, op3_packing_conversations, op4_merge_dropout, op5_language_id, op6_token_files, op7_shard_compaction, op8_ngram_jaccard_join, op9_toxicity, op10_quality_rules, op11_secret_scan, op12_filter_audit, op13_target_resampling]


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op2_embedding_near_dedup": embedding_dedup.SQL, "op8_ngram_jaccard_join": ngram_join.SQL, "op10_quality_rules": line_rules.SQL, "op12_filter_audit": filter_audit.SQL, "op13_target_resampling": target_resampling.SQL}
