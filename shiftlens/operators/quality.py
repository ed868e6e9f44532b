"""Data-quality assertions: each returns the violations, so an empty result means sound."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlens.functions.text import collapse_spaces
from shiftlens.schema import OPTION_LABELS, SPLITS
from shiftlens.session import literal_rows


def group_leakage(
    rows: DataFrame, *, group: str = "question_id", split: str = "split"
) -> DataFrame:
    """Return groups that appear in more than one split."""
    spread = rows.groupBy(group).agg(F.countDistinct(split).alias("splits"))
    return spread.filter(F.col("splits") > 1)


def missing_classes(
    rows: DataFrame, *, label: str = "binary_label", splits: Sequence[str] = SPLITS
) -> DataFrame:
    """Return splits that lack a class, absent splits included."""
    wanted = literal_rows(rows.sparkSession, [(s,) for s in splits], "split string")
    seen = rows.groupBy("split").agg(F.countDistinct(label).alias("classes"))
    return (
        F.broadcast(wanted)
        .join(seen, "split", "left")
        .select("split", F.coalesce("classes", F.lit(0)).alias("classes"))
        .filter(F.col("classes") != 2)
    )


def freeze_validation(questions: DataFrame, *, group: str = "template_group") -> DataFrame:
    """Return all violations of a question freeze as (rule, value, rows)."""
    ids = (
        questions.groupBy(F.col("question_id").alias("value"))
        .agg(F.count("*").alias("rows"))
        .filter("rows > 1")
        .select(F.lit("duplicate_id").alias("rule"), "value", "rows")
    )
    text = F.lower(collapse_spaces(F.col("prompt")))
    prompts = (
        questions.groupBy(F.sha2(text, 256).alias("value"))
        .agg(F.count("*").alias("rows"))
        .filter("rows > 1")
        .select(F.lit("duplicate_prompt").alias("rule"), "value", "rows")
    )
    labels = F.array(*[F.lit(x) for x in OPTION_LABELS])
    keys = F.array_sort(F.map_keys("options"))
    options = questions.filter(~F.coalesce(keys == labels, F.lit(False))).select(
        F.lit("option_set").alias("rule"),
        F.col("question_id").alias("value"),
        F.lit(1).cast("long").alias("rows"),
    )
    groups = questions.agg(
        F.countDistinct(group).alias("_g"), F.count_if(F.col(group).isNull()).alias("_none"),
        F.count("*").alias("_n"),
    )
    whole = groups.select(
        F.inline(
            F.array(
                F.struct(F.lit("empty").alias("rule"), (F.col("_n") == 0).alias("_bad"),
                         F.col("_n").alias("rows")),
                F.struct(F.lit("no_collection").alias("rule"),
                         (F.col("_none") > 0).alias("_bad"), F.col("_none").alias("rows")),
                F.struct(F.lit("fewer_than_two_collections").alias("rule"),
                         (F.col("_g") < 2).alias("_bad"), F.col("_g").alias("rows")),
            )
        )
    ).filter("_bad").select("rule", F.lit(None).cast("string").alias("value"), "rows")
    return ids.unionByName(prompts).unionByName(options).unionByName(whole)


def collection_counts(questions: DataFrame, group: str = "template_group") -> DataFrame:
    """Count questions per source collection."""
    return questions.groupBy(group).agg(F.count("*").alias("questions"))


def uniqueness(bank: DataFrame) -> DataFrame:
    """Report whether all prompts and ids of a generated bank are unique."""
    return bank.agg(
        F.count("*").alias("rows"),
        F.countDistinct("question_id").alias("distinct_ids"),
        F.countDistinct(F.sha2("prompt", 256)).alias("distinct_prompts"),
    ).select(
        "*",
        (
            (F.col("rows") == F.col("distinct_ids"))
            & (F.col("rows") == F.col("distinct_prompts"))
        ).alias("unique"),
    )


def require_empty(violations: DataFrame, message: str) -> None:
    """Raise with one example when a violations table is not empty."""
    first = violations.take(1)
    if first:
        raise ValueError(f"{message}: {first[0].asDict()}")


def score_union(*parts: DataFrame) -> DataFrame:
    """Stack component score tables by column name."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def identity_difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Return identities of one side only, duplicates counted, with the side they are on."""
    a, b = left.select(*keys), right.select(*keys)
    return (
        a.exceptAll(b)
        .withColumn("side", F.lit("left"))
        .unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
    )
