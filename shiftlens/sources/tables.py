"""Typed scans with reject tables, write-once sinks and artifact digests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftlens.functions.answers import extract_final_answer
from shiftlens.functions.text import collapse_spaces
from shiftlens.schema import OPTION_LABELS
from shiftlens.session import literal_rows, setting

#: Large files that the driver hashes at once.
STREAMS = 4
_CORRUPT = "_corrupt_record"
QUESTION_RULES = {
    "missing_id": "question_id IS NOT NULL",
    "missing_prompt": "prompt IS NOT NULL",
    "too_few_options": "size(options) >= 2",
    "gold_not_an_option": "map_contains_key(options, gold_answer)",
}
MATH_RULES = {
    "missing_id": "question_id IS NOT NULL",
    "missing_prompt": "prompt IS NOT NULL",
    "blank_gold": "trim(gold_answer) <> ''",
}
ROLLOUT_RULES = {
    "missing_id": "rollout_id IS NOT NULL AND question_id IS NOT NULL",
    "negative_latency": "latency_seconds IS NULL OR latency_seconds >= 0",
    "unknown_status": (
        "status IN ('clean_stop', 'parse_invalid', 'length_truncated', 'malformed')"
    ),
}


def first_broken_rule(rules: Mapping[str, str], first: Column | None = None) -> Column:
    """Return the name of the first rule a row breaks; a null verdict counts as broken."""
    reason = F.when(F.lit(False) if first is None else first, "not_json")
    for name, rule in rules.items():
        reason = reason.when(~F.coalesce(F.expr(rule), F.lit(False)), name)
    return reason


def apply_rules(rows: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """Add ``reject_reason`` to a typed table."""
    return rows.withColumn("reject_reason", first_broken_rule(rules))


def scan_jsonl(
    spark: SparkSession,
    path: str | list[str],
    schema: str,
    rules: Mapping[str, str] | None = None,
    *,
    strict: bool = False,
) -> DataFrame:
    """Read typed JSON lines with ``source_file`` and ``reject_reason`` columns.

    Blank lines are skipped. With ``strict`` the first invalid record fails the query and is
    named in the error.
    """
    raw = (
        spark.read.schema(f"{schema}, {_CORRUPT} STRING")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _CORRUPT)
        .json(path)
    )
    rows = raw.select(
        "*", F.col("_metadata.file_path").alias("source_file"),
        first_broken_rule(rules or {}, F.col(_CORRUPT).isNotNull()).alias("reject_reason"),
    )
    if not strict:
        return rows.drop(_CORRUPT)
    where = F.concat_ws(
        ": ", F.lit("invalid JSONL record"), "source_file", "reject_reason", _CORRUPT
    )
    checked = F.when(F.col("reject_reason").isNotNull(), F.raise_error(where)).otherwise(
        F.col("source_file")
    )
    return rows.withColumn("source_file", checked).drop(_CORRUPT, "reject_reason")


def split_rejects(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Divide a scan into valid rows and rejects."""
    valid = rows.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    return valid, rows.filter(F.col("reject_reason").isNotNull())


def scan_json_objects(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Read JSON lines as variants; anything but an object is a reject."""
    lines = spark.read.text(path)
    return json_objects(lines.select("value", F.col("_metadata.file_path").alias("source_file")))


def json_objects(lines: DataFrame, column: str = "value") -> DataFrame:
    """Parse a text column into variants, keeping objects only."""
    rows = lines.filter(F.trim(column) != "").withColumn("record", F.try_parse_json(column))
    is_object = F.coalesce(F.schema_of_variant("record").startswith("OBJECT"), F.lit(False))
    reason = F.when(F.col("record").isNull(), "not_json").when(~is_object, "not_an_object")
    return rows.select(
        *[c for c in lines.columns if c != column],
        F.when(reason.isNull(), F.col("record")).alias("record"),
        F.when(reason.isNotNull(), F.col(column)).alias("rejected_line"),
        reason.alias("reject_reason"),
    )


def write_once(
    df: DataFrame, path: str, file_format: str = "parquet", *, by: Sequence[str] = ()
) -> None:
    """Write a new dataset, in a folder for each value of ``by``; an existing path is an error."""
    writer = df.write.mode("errorifexists").format(file_format)
    (writer.partitionBy(*by) if by else writer).save(path)


def normalize_mcq(rows: DataFrame, *, source_split: str, prefix: str) -> DataFrame:
    """Map four-choice rows to the question table, options relabelled by display order.

    Rows outside the four-choice contract get ``reject_reason``; malformed ones an error.
    """
    texts, labels = F.col("choices.text"), F.col("choices.label")
    letters = F.array(*[F.lit(x) for x in OPTION_LABELS])
    cleaned = F.transform(texts, lambda t: F.trim(t))
    malformed = texts.isNull() | labels.isNull()
    outside = (
        (F.size(texts) != 4)
        | (F.size(labels) != 4)
        | ~F.coalesce(F.array_contains(labels, F.col("answerKey")), F.lit(False))
    )
    broken = (
        (F.size(F.array_distinct(labels)) != 4)
        | F.exists(cleaned, lambda t: t.isNull() | (t == ""))
        | (F.trim(F.coalesce("id", F.lit(""))) == "")
        | (F.trim(F.coalesce("question", F.lit(""))) == "")
        | (source_collection(F.col("id")) == "")
    )
    message = F.concat(F.lit("malformed choices in row "), F.coalesce("id", F.lit("?")))
    reason = (
        F.when(malformed, F.raise_error(message))
        .when(outside, "off_contract")
        .when(F.coalesce(broken, F.lit(True)), F.raise_error(message))
    )
    checked = rows.withColumn("reject_reason", reason.cast("string"))
    ok = F.col("reject_reason").isNull()
    gold = F.try_element_at(letters, F.array_position(labels, F.col("answerKey")).cast("int"))
    return checked.select(
        F.concat(F.lit(f"{prefix}:{source_split}:"), "id").alias("question_id"),
        F.lit("science_mcq").alias("task_family"),
        collapse_spaces(F.col("question")).alias("prompt"),
        F.when(ok, F.map_from_arrays(letters, cleaned)).alias("options"),
        F.when(ok, gold).alias("gold_answer"),
        source_collection(F.col("id")).alias("template_group"),
        F.col("id").alias("source_id"),
        labels.alias("original_choice_labels"),
        "reject_reason",
    )


def source_collection(source_id: Column) -> Column:
    """Return the part of an id before its first underscore."""
    return F.trim(F.substring_index(source_id, "_", 1))


def scan_mcq_parquet(
    spark: SparkSession, path: str | list[str], *, source_split: str, prefix: str = "mcq"
) -> DataFrame:
    """Read four-choice parquet rows as questions with a ``reject_reason``."""
    return normalize_mcq(spark.read.parquet(path), source_split=source_split, prefix=prefix)


def hard_answerable(
    rows: DataFrame,
    *,
    level: str = "level",
    solution: str = "solution",
    levels: Sequence[str] = ("4", "5"),
) -> DataFrame:
    """Keep problems of the hardest levels whose solution commits to one answer."""
    number = F.trim(F.replace(F.lower(F.col(level)), F.lit("level"), F.lit("")))
    rows = rows.filter(number.isin(*levels))
    answered = rows.withColumn("gold_answer", extract_final_answer(F.col(solution)))
    return answered.filter(F.col("gold_answer").isNotNull())


def scan_math_parquet(spark: SparkSession, paths: Sequence[str], **columns: str) -> DataFrame:
    """Read several parquet shards of problems and keep the hard, answerable ones."""
    return hard_answerable(spark.read.parquet(*paths), **columns)


def artifact_digests(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Return path, size and SHA-256 of files of any size.

    A digest is one chain over all bytes of a file, so one place has to read them. A task does, but
    holds the file in memory; files above ``spark.shiftlens.bytesPerFile`` are streamed instead,
    ``STREAMS`` at once, through small buffers of the driver.
    """
    files = spark.read.format("binaryFile").load(paths)
    most = setting(files, "bytesPerFile")
    held = files.filter(F.col("length") <= most)
    found = held.select("path", "length", F.sha2("content", 256).alias("sha256"))
    large = files.filter(F.col("length") > most).select("path", "length").collect()
    if not large:
        return found
    with ThreadPoolExecutor(STREAMS) as pool:
        digests = list(pool.map(lambda row: streamed_digest(spark, row.path), large))
    rows = [(row.path, row.length, digest) for row, digest in zip(large, digests, strict=True)]
    return found.unionByName(literal_rows(spark, rows, "path string, length long, sha256 string"))


def streamed_digest(spark: SparkSession, path: str) -> str:
    """Return the SHA-256 of a file of any store that Spark reads, without holding the file."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(context._jsc.hadoopConfiguration()).open(where)
    try:
        return context._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def manifest_digest(manifest: DataFrame) -> DataFrame:
    """Return one digest over a manifest, independent of row order.

    Entries are digested in 4096 buckets by path hash first, then the bucket digests together.
    """
    entry = F.concat_ws("|", "path", F.col("length").cast("string"), "sha256")
    rows = manifest.select(
        F.substring(F.sha2("path", 256), 1, 3).alias("_bucket"), "length", entry.alias("_entry")
    )
    buckets = rows.groupBy("_bucket").agg(
        F.count("*").alias("n"),
        F.sum("length").alias("bytes"),
        F.sha2(F.array_join(F.array_sort(F.collect_list("_entry")), "\n"), 256).alias("_digest"),
    )
    whole = buckets.agg(
        F.sum("n").alias("artifacts"),
        F.sum("bytes").alias("bytes"),
        F.array_sort(F.collect_list(F.concat_ws("|", "_bucket", "_digest"))).alias("_d"),
    )
    return whole.select(
        "artifacts", "bytes", F.sha2(F.array_join("_d", "\n"), 256).alias("manifest_sha256")
    )
