"""A training-corpus pipeline: five stages over ``documents``, each written and read again before the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from barweave.llm import decontaminate, ngram_trees, queries, sentencepiece_table, substring_chain, weak_quality
from barweave.llm.shared import shared_dir, small_batches, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label quality scorer rejects go.

    Null and empty texts are judged by their missing statistics; equal texts are judged alike, so repeated rows stay or
    go together; null ids stay null.
    """
    small_batches(spark)
    return weak_quality.keep_good(docs, *weak_quality.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that with the group's smallest doc_id.

    Groups are connected by links of five-word shingle sets with a Jaccard similarity of 0.8 or more. Documents without
    words are no copies of each other. Of rows with one doc_id in one group one stays; different texts under one doc_id
    are told apart by the hash of id and text, and each goes or stays by its own group. Rows with a null id stay.
    """
    small_batches(spark)
    doc = F.col("doc_id").cast("long")
    texts = docs.where(doc.isNotNull()).groupBy(doc.alias("__clash")).agg(F.min(F.xxhash64("text")).alias("t0"), F.max(F.xxhash64("text")).alias("t1"))
    clashes = written(texts.where("t0 <> t1").select("__clash"), "clashes")
    keyed = docs.join(clashes, doc == F.col("__clash"), "left")
    keyed = keyed.select(*[docs[c] for c in docs.columns], F.when(F.col("__clash").isNull(), doc).otherwise(F.xxhash64(doc, docs["text"])).alias("__row_key"))
    found = ngram_trees.near_duplicates(keyed.select(F.col("__row_key").alias("doc_id"), "text"), n=5, percent=80)
    found = written(found.where("n_shingles > 0 and doc_id is not null").groupBy(F.col("doc_id").alias("__row_key"), "component_id").count(), "found")
    large = found.groupBy("component_id").count().where("count > 1").select("component_id")
    ids = keyed.join(clashes, doc == F.col("__clash")).select("__row_key", doc.alias("doc")).distinct()
    members = found.join(large, "component_id").join(ids, "__row_key", "left").select("component_id", "__row_key", F.coalesce("doc", "__row_key").alias("doc"))
    members = written(members, "members")
    first = members.groupBy("component_id").agg(F.min(F.struct("doc", "__row_key")).alias("first"))
    gone = members.join(first, "component_id").where("__row_key <> first.__row_key").select("__row_key")
    gone = written(gone, "gone")
    repeated = written(found.where("count > 1").select("__row_key").join(gone, "__row_key", "left_anti"), "repeated")
    once = keyed.join(gone.unionByName(repeated), "__row_key", "left_anti")
    return once.unionByName(keyed.join(repeated, "__row_key", "left_semi").dropDuplicates(["__row_key"])).select(*docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has too are cut out; documents of which nothing is left go.

    Null texts stay; empty ones and those of white space only go. A document keeps the first of its own repeats. Rows of
    one doc_id count as one document, and null ids are left as they are.
    """
    small_batches(spark)
    return substring_chain.cut_out(docs).where(F.col("text").isNull() | (F.length(F.btrim("text")) > 0))


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go; null and empty texts and null ids have none and stay.

    Of rows with one doc_id all go if one of them has a passage. An empty benchmark keeps everything.
    """
    return decontaminate.clean(docs, queries.table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's SentencePiece ids, counted and digested: a row for each row, with two ids for null and empty texts."""
    small_batches(spark)
    return sentencepiece_table.encode_documents(docs, queries.tokenizer_model())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("passages", passages), ("contamination", contamination), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's Parquet lies in the shared folder, so a lost executor costs a reread."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: SQL can express neither the trained scorer nor SentencePiece; the tests plant rows for each stage and look what becomes of them.
ORACLE_SQL = None
