"""The registered query of each operator, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from barweave.llm import conversation_cyk, decontaminate, embedding_lsh, exact_trie, html_graph, html_labelled, license_digest, ngram_trees, sentencepiece_table, spelling_permuterm, substring_chain, toxicity_cnn, warc_zstd, weak_quality
from barweave.llm.shared import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_model(path: str | None = None) -> bytes:
    """The tokenizer model's bytes; ``path`` defaults to the installed public file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as file:
        return file.read()


def op1_html_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_graph.extract_pages(table(spark, sf_dir, "pages"), html_labelled.fitted())


def op2_substring_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_chain.passages(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return weak_quality.score(documents, *weak_quality.fit(documents))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_table.encode_documents(table(spark, sf_dir, "documents"), tokenizer_model())


def op6_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity_cnn.score(documents, toxicity_cnn.fit(documents, table(spark, sf_dir, "labels")))


def op7_embedding_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_lsh.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_ngram_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_trees.near_duplicates(table(spark, sf_dir, "documents"))


def op9_license_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest.scan(table(spark, sf_dir, "documents"))


def op10_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = written(warc_zstd.write_archives(table(spark, sf_dir, "pages")), "archives")
    return warc_zstd.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op11_conversation_cyk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_cyk.report(conversation_cyk.damaged(table(spark, sf_dir, "conversations")))


def op12_patricia_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_trie.membership(table(spark, sf_dir, "documents"))


def op13_permuterm_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_permuterm.variants(table(spark, sf_dir, "documents"), typo_every=spelling_permuterm.TYPO_EVERY)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_graph": op1_html_graph,
    "op2_substring_chain": op2_substring_chain,
    "op3_decontaminate": op3_decontaminate,
    "op4_weak_quality": op4_weak_quality,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_toxicity_cnn": op6_toxicity_cnn,
    "op7_embedding_lsh": op7_embedding_lsh,
    "op8_ngram_trees": op8_ngram_trees,
    "op9_license_digest": op9_license_digest,
    "op10_warc_zstd": op10_warc_zstd,
    "op11_conversation_cyk": op11_conversation_cyk,
    "op12_patricia_owners": op12_patricia_owners,
    "op13_permuterm_spelling": op13_permuterm_spelling,
}
ORACLES: dict[str, str] = {"op9_license_digest": license_digest.oracle(), "op12_patricia_owners": exact_trie.oracle()}
