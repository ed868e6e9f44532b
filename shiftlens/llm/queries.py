"""The registered queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftlens.llm import (
    collocations,
    coordinate_join,
    divergence_cube,
    mtree,
    ngram_trie,
    quality_bayes,
    repetition,
    retrieval_packing,
    secret_layers,
    source_mixing,
    suffix_dedup,
    toxicity_cnn,
    url_automaton,
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Read one of the given tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_elias_fano_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Score every document by the language model of those not held out."""
    return ngram_trie.score_texts(table(spark, folder, "documents"))


def op2_coordinate_join(spark: SparkSession, folder: str) -> DataFrame:
    """Group near-duplicate documents."""
    return coordinate_join.near_duplicates(table(spark, folder, "documents"))


def op3_mtree_search(spark: SparkSession, folder: str) -> DataFrame:
    """Return the 20 largest inner products of every 20th vector."""
    return mtree.top_products(table(spark, folder, "embeddings"))


def op4_toxicity_cnn(spark: SparkSession, folder: str) -> DataFrame:
    """Score the toxicity of every document."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return toxicity_cnn.toxicity(spark, docs, labels)


def op5_url_automaton(spark: SparkSession, folder: str) -> DataFrame:
    """Judge the url of every page by the packed glob rules."""
    return url_automaton.filter_urls(table(spark, folder, "pages"))


def op6_golden_schedule(spark: SparkSession, folder: str) -> DataFrame:
    """Mix all documents to the target words of their sources."""
    return source_mixing.mix_sources(table(spark, folder, "documents")).docs


def op7_deep_shallow(spark: SparkSession, folder: str) -> DataFrame:
    """Remove repeated 400-byte strings from every document, and tell repeated passages of over 50 words."""
    return suffix_dedup.remove_repeats(table(spark, folder, "documents"), words=51)


def op8_bm25_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pack all documents into sequences with their lexical neighbours."""
    return retrieval_packing.pack_documents(table(spark, folder, "documents"))


def op9_repetition_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Measure and judge repetition in every document."""
    judged = repetition.repetition_coverage(table(spark, folder, "documents"))
    chars = [F.col("ngram_chars")[i].alias(f"chars_{n}") for i, n in enumerate(sorted(repetition.LIMITS))]
    return judged.select("*", *chars).drop("ngram_chars")


def op10_site_bayes(spark: SparkSession, folder: str) -> DataFrame:
    """Judge the quality of every document by its own evidence and its site's."""
    return quality_bayes.site_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op11_divergence_cube(spark: SparkSession, folder: str) -> DataFrame:
    """Hold the sources of each language against each other and against the language."""
    return divergence_cube.source_divergence(table(spark, folder, "documents"))


def op12_decoding_worklist(spark: SparkSession, folder: str) -> DataFrame:
    """Find secrets in every document, through all layers of encoding."""
    return secret_layers.digest_spans(secret_layers.secret_spans(table(spark, folder, "documents")))


def op13_toivonen_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """Mine the strongest phrases of each language."""
    return collocations.collocations(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_elias_fano_trie": op1_elias_fano_trie,
    "op2_coordinate_join": op2_coordinate_join,
    "op3_mtree_search": op3_mtree_search,
    "op4_toxicity_cnn": op4_toxicity_cnn,
    "op5_url_automaton": op5_url_automaton,
    "op6_golden_schedule": op6_golden_schedule,
    "op7_deep_shallow": op7_deep_shallow,
    "op8_bm25_packing": op8_bm25_packing,
    "op9_repetition_coverage": op9_repetition_coverage,
    "op10_site_bayes": op10_site_bayes,
    "op11_divergence_cube": op11_divergence_cube,
    "op12_decoding_worklist": op12_decoding_worklist,
    "op13_toivonen_phrases": op13_toivonen_phrases,
}
ORACLES: dict[str, str] = {
    "op2_coordinate_join": coordinate_join.SQL,
    "op3_mtree_search": mtree.SQL,
    "op5_url_automaton": url_automaton.SQL,
    "op6_golden_schedule": source_mixing.SQL,
    "op9_repetition_coverage": repetition.sql(),
    "op11_divergence_cube": divergence_cube.SQL,
    "op13_toivonen_phrases": collocations.SQL,
}
