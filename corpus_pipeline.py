"""From raw documents to packed training sequences, as a row of stages over Parquet tables.

Every stage takes what its predecessor kept. All but the last return the columns of ``documents``, in their order and
whatever their names.

Defined results: texts that are null, empty or without letters go in the first stage; rows with a null id are judged like
any other; repeated rows are copies of each other, of which one stays; without labelled languages every row goes, and
without labels of both kinds for toxicity no row goes, or every one if all are toxic; a text of any length is judged and
packed as a whole; from empty tables come no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm import language_id, ngram_join, packing, storage, toxicity

#: A text whose nearest language leads by less than this share of the next one's distance is in no known language.
LEAST_LEAD = 0.005


def _rows(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` as the only column, ``row``, so no name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and texts that are near no learned language: whose nearest one hardly leads, or is
    further away than its own labelled rows are. Both are learned from all labelled rows; each text is looked at once
    for its counts and once for its language, which is written beside it."""
    profiles = language_id.fit(docs, "doc_id", "text", "lang")
    found = storage.written(_rows(docs).withColumn("found", language_id.predicted(F.col("row.text"), profiles, spark)), "languages")
    labelled = found.where("row.doc_id is not null and row.text is not null and row.lang is not null")
    bounds = language_id.reach_of(labelled.select(F.col("row.lang").alias("lang"), "found"))
    far = F.create_map(*[F.lit(x) for b in bounds.items() for x in b]) if bounds else F.create_map().cast("map<string,double>")
    f = F.col("found")
    near = (f.lang_pred != language_id.UNKNOWN) & (f.score >= LEAST_LEAD) & (f.distance <= F.coalesce(far[f.lang_pred], F.lit(0.0)))
    return found.where(near).select("row.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that are likelier toxic than not, as learned from the labels of the documents at hand."""
    scorer = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _rows(docs).withColumn("found", toxicity.scored(F.col("row.text"), scorer, spark)).where("found < 0.5").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group whose five-word n-gram sets are connected by similarities of 0.8 or more."""
    return ngram_join.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents that are left into sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", keep_known_languages), ("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("packing", pack)]

#: The stages' models and hashes cannot be expressed in SQL; tests compare them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = storage.written(docs, "pipeline")
    return docs
