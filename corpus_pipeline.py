"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read by the next.

1. ``quality_rules``: lines that fail a rule go, and documents that fail go whole.
2. ``line_dedup``: lines that repeat an earlier line up to one word go, and documents of which no words are left.
3. ``near_duplicates``: of documents linked by a Jaccard similarity of 0.8 or more of their five-word shingles, directly or
   through others, the one of the smallest id stays. Rows of one id and different texts are different documents here.
4. ``mixing``: documents are repeated or left out so that sources come near their target shares.
5. ``packing``: what is left is packed into sequences of tokens, one row per piece.

A stage takes and returns the columns of ``documents``; the last returns pieces. Null texts fail the first stage; rows
without an id are near duplicates of nothing; empty tables give empty tables; columns beyond those of ``documents`` are dropped.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import jaccard, line_dedup, mixing, packing
from ledgerloom.llm.quality_rules import WORD, kept_documents
from ledgerloom.llm.shared import shared_folder, split_by_ids, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
NEAR = jaccard.Join(words=5, percent=80)


def with_text(df: DataFrame) -> DataFrame:
    """The columns of ``documents`` with ``clean_text`` as the text."""
    text = F.col("clean_text")
    return df.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_text(kept_documents(docs.select(*COLUMNS)))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return with_text(left.filter((F.col("n_removed") == 0) | F.col("clean_text").rlike(WORD)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # A document is an id with a text; rows repeated whole are one.
    uid = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text"))
    docs = docs.select(*COLUMNS, uid.alias("uid"))
    groups = stored(jaccard.similar_documents(docs.select(F.col("uid").alias("doc_id"), "text"), NEAR), "near-groups")
    groups = groups.select(F.col("doc_id").alias("uid"), "component_id").filter("uid IS NOT NULL")
    counts = stored(groups.groupBy("uid").agg(F.min("component_id").alias("first"), F.count("*").alias("times")), "near-counts")
    linked = counts.filter("first <> uid")
    ends = linked.select("uid", "first").unionByName(linked.select(F.col("first").alias("uid"), "first").distinct())
    changed = ends.unionByName(counts.filter("first = uid AND times > 1").select("uid", "first")).distinct()
    changed = stored(changed, "near-changed")
    touched, rest = split_by_ids(docs, "uid", changed)
    stay = touched.join(changed, "uid", "left_anti")
    members = touched.select("uid", "doc_id").join(changed, "uid")
    least = members.groupBy("first").agg(F.min(F.struct("doc_id", "uid")).alias("least"))
    least = stored(least.select("least.uid"), "near-least")
    once = touched.join(least, "uid").groupBy("doc_id", "uid").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("row"))
    return rest.unionByName(stay).select(*COLUMNS).unionByName(once.select("doc_id", "row.*"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_documents(docs.select(*COLUMNS)).filter("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("near_duplicates", near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_documents),
]

#: Packing needs a tokenizer and mixing random numbers; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps lies in the shared folder until it is cleared."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
