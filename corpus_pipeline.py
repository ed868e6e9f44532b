"""The corpus pipeline: documents in, packed sequences of tokens out.

``STAGES`` run in this order. Every stage but the last takes and returns the columns of documents;
each is written before the next one reads it. Rows are told apart by doc_id; a stage that
removes or repeats rows does so on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftlens.llm import (
    coordinate_join,
    retrieval_packing,
    source_mixing,
    suffix_dedup,
    toxicity_cnn,
)
from shiftlens.session import materialize

#: A word and the white space after it; white space ahead of the first word.
PIECES = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"
#: Overlap of two documents' five-word shingles, in percent of their union, that links them.
SIMILAR_PERCENT = 80
#: Words of the shortest passage that must not repeat across documents.
REPEATED_WORDS = 51


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the toxicity classifier accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity_cnn.fit_model(docs, labels)
    scored = toxicity_cnn.score_toxicity(docs, model)
    return scored.filter("NOT tox_rejected").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates, and all without an id."""
    kept = coordinate_join.near_duplicates(docs, percent=SIMILAR_PERCENT).filter("kept").select("doc_id").distinct()
    return docs.filter("doc_id IS NULL").unionByName(docs.join(kept.dropna(), "doc_id", "left_semi"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove repeated strings of over 50 words, or of 400 bytes, from the texts.

    A document of nothing else stays, empty.
    """
    return suffix_dedup.cut_repeats(docs, words=REPEATED_WORDS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or cut documents so that sources come to their target words.

    A document taken t times its words comes t times; a part comes as that many words from its
    beginning, with the white space between them. One that is not taken goes.
    """
    mix = source_mixing.mix_sources(docs).docs
    # Rows alike in key, source and size (repeated rows) get the most that one of them is taken.
    takes = mix.groupBy("doc_id", "source", "size").agg(F.max("taken").alias("mix_taken"))
    takes = takes.select(
        "mix_taken", F.col("doc_id").alias("mix_k"), F.col("source").alias("mix_s"), F.col("size").alias("mix_n")
    )
    # The row travels as one column, so that names of its columns cannot clash.
    size = F.coalesce(F.regexp_count("text", F.lit(source_mixing.WORD)), F.lit(0)).cast("long")
    sized = docs.select(
        F.struct(*docs.columns).alias("mix_row"), F.col("doc_id").alias("mix_id"),
        F.col("source").cast("string").alias("mix_source"), size.alias("mix_size"),
    )
    same = F.col("mix_id").eqNullSafe(F.col("mix_k")) & F.col("mix_source").eqNullSafe(F.col("mix_s"))
    joined = sized.join(takes, same & (F.col("mix_size") == F.col("mix_n"))).filter("mix_taken > 0")
    text = F.col("mix_row.text")
    whole = F.floor(F.col("mix_taken") / F.col("mix_size"))
    part = F.col("mix_taken") % F.col("mix_size")
    head = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(PIECES), F.lit(0)), 1, part.cast("int")), "")
    copies = F.concat(
        F.array_repeat(text, whole.cast("int")), F.when(part > 0, F.array(head)).otherwise(F.array())
    )
    out = joined.withColumn("mix_text", F.explode(copies))
    columns = {"text": F.col("mix_text")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.length("mix_text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[columns.get(c, F.col(f"mix_row.`{c}`")).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of tokens."""
    return retrieval_packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("repeated strings", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Learned scores decide in the first stage, so SQL cannot say the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = materialize(docs)
    return docs
