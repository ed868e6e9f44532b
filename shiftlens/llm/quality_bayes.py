"""Quality by hierarchical empirical Bayes: a document's own evidence and that of its site.

A logistic classifier on measures of form gives every document a probability. Grouped sums of
these give each host, and each path below a host, a Beta posterior: a path shrinks to its host
and a host to the whole, the more so the fewer documents it has. Prior strengths come from the
spread between hosts and between paths, by the method of moments. A document's site evidence
leaves the document itself out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftlens.llm.repetition import measure
from shiftlens.llm.texts import chunks, flat_bytes, remainder
from shiftlens.session import materialize

#: The most labelled rows of each class that the classifier is fitted on.
MOST_ROWS = 5000
#: Bounds of a prior's strength, in documents.
WEAKEST, STRONGEST = 1.0, 10_000.0
#: Probabilities stay this far from 0 and 1.
MARGIN = 1e-4
#: Sites up to this number are broadcast (about 100 bytes each).
BROADCAST_SITES = 1_000_000
THRESHOLD = 0.5
FEATURES = ("length", "symbols", "repeats", "ngrams", "lines", "capitals", "shouts", "digits", "wordsize")


def features(column: pa.Array) -> np.ndarray:
    """Measure the form of every text: a row of ``FEATURES`` each, all zero for no words."""
    m = measure(column, (5,))
    data, at = flat_bytes(column)
    share = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[at])
    words = np.maximum(m["n_words"], 1)
    chars = np.maximum(m["word_chars"], 1)
    ngrams = np.array([x[0] for x in m["ngram_chars"]], float).reshape(len(words))
    table = np.column_stack([
        np.log1p(m["n_words"]), np.minimum(m["n_symbols"] / words, 2), m["n_repeat_words"] / words, ngrams / chars,
        np.minimum(np.array(m["dup_line_chars"]) / chars, 1), share((data >= 65) & (data <= 90)) / chars,
        np.minimum(share(data == 33) / words, 2), share((data >= 48) & (data <= 57)) / chars,
        np.minimum(m["word_chars"] / words, 30) / 10,
    ])
    return np.where(m["n_words"][:, None] > 0, table, 0.0)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Fit weights (the last is the constant) by Newton steps; 0 rows or one class: a constant."""
    scaled = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(scaled.shape[1])
    prior = (y.sum() + 1) / (len(y) + 2)
    w[-1] = np.log(prior / (1 - prior))
    if not len(y) or y.min() == y.max():
        return w
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(scaled @ w, -30, 30)))
        curve = (scaled * (p * (1 - p))[:, None]).T @ scaled + np.diag(penalty)
        step = np.linalg.solve(curve, scaled.T @ (p - y) + penalty * w * (np.arange(len(w)) < len(w) - 1))
        w = w - np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def logit(p: Column) -> Column:
    inside = F.least(F.greatest(p, F.lit(MARGIN)), F.lit(1 - MARGIN))
    return F.log(inside / (1 - inside))


def strength(groups: DataFrame, mean: Column) -> float:
    """Return how many documents the prior of groups (n, s) around ``mean`` is worth.

    The variance of group means about ``mean`` less what chance gives is the spread between
    groups; without any the prior is at its strongest.
    """
    got = groups.filter("n > 0").select(
        F.sum(F.col("n") * (F.col("s") / F.col("n") - mean) ** 2).alias("spread"),
        F.sum(mean * (1 - mean)).alias("chance"), F.sum("n").alias("n"),
        F.sum(F.col("n") * mean * (1 - mean)).alias("whole"),
    ).first()
    if not got["n"] or not got["whole"]:
        return STRONGEST
    between = (got["spread"] - got["chance"]) / got["n"]
    if between <= 0:
        return STRONGEST
    return float(min(max(got["whole"] / got["n"] / between - 1, WEAKEST), STRONGEST))


def site_quality(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
    host: str = "source", path: str = "lang",
) -> DataFrame:
    """Judge every document by its own evidence and its site's.

    Returns, one row per row of ``docs``: key, doc_score (the classifier's probability of good
    quality), host_posterior and path_posterior (of the site without this document), score and
    kept (score >= 0.5). The classifier learns from at most ``MOST_ROWS`` labelled rows per
    class, chosen by hash, none with crc32 of the key modulo 4 equal to 2; weights make up for
    the share of each class that the bound keeps. Null hosts are one host and null paths one
    path of theirs. A null or empty text has all measures 0. Repeated rows are judged alike, null
    keys too. A host with any share of all rows is summed up before rows move.
    """
    source = docs.select(
        F.col(key).alias("key"), F.col(host).cast("string").alias("host"),
        F.col(path).cast("string").alias("path"), F.col(text).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            table = features(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("key", "host", "path")), *(pa.array(c) for c in table.T)],
                names=["key", "host", "path", *FEATURES],
            )

    kinds = f"key {source.schema['key'].dataType.simpleString()}, host string, path string, "
    measured = materialize(source.mapInArrow(run, kinds + ", ".join(f"{f} double" for f in FEATURES)))
    weights = _classifier(measured, labels, key)
    linear = sum((F.col(f) * float(w) for f, w in zip(FEATURES, weights, strict=False)), F.lit(float(weights[-1])))
    p = (1 / (1 + F.exp(-linear))).alias("p")
    judged = measured.select("key", "host", "path", p)

    paths = materialize(judged.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")))
    hosts = materialize(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")))
    n, s = hosts.agg(F.sum("n"), F.sum("s")).first()
    mean = min(max((s or 0.5) / (n or 1), MARGIN), 1 - MARGIN)
    by_host = strength(hosts, F.lit(mean))
    host_mean = (F.col("host_s") + by_host * mean) / (F.col("host_n") + by_host)
    sites = paths.join(
        hosts.select(F.col("host").alias("h"), F.col("n").alias("host_n"), F.col("s").alias("host_s")),
        F.col("host").eqNullSafe(F.col("h")),
    ).drop("h")
    by_path = strength(sites, host_mean)
    sites = sites.select(F.col("host").alias("h"), F.col("path").alias("q"), "n", "s", "host_n", "host_s")
    sites = F.broadcast(sites) if paths.count() <= BROADCAST_SITES else sites
    joined = judged.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")))
    host_post = (F.col("host_s") - F.col("p") + by_host * mean) / (F.col("host_n") - 1 + by_host)
    path_post = (F.col("s") - F.col("p") + by_path * F.col("host_posterior")) / (F.col("n") - 1 + by_path)
    site = logit(F.col("path_posterior")) - float(np.log(mean / (1 - mean)))
    score = 1 / (1 + F.exp(-(logit(F.col("p")) + site)))
    return (
        joined.withColumn("host_posterior", host_post).withColumn("path_posterior", path_post)
        .withColumn("score", score)
        .select(F.col("key").alias(key), F.col("p").alias("doc_score"), "host_posterior", "path_posterior",
                "score", (F.col("score") >= THRESHOLD).alias("kept"))
    )


def _classifier(measured: DataFrame, labels: DataFrame, key: str) -> np.ndarray:
    """Fit the classifier on labelled rows: at most ``MOST_ROWS`` feature rows of each class."""
    known = (
        labels.select(F.col(key).alias("id"), "quality").dropna().groupBy("id")
        .agg(F.min("quality").alias("quality")).filter(remainder("id", 4) != 2)
    )
    total = known.agg(F.sum((F.col("quality") > 0).cast("long")), F.count("*")).first()
    good, bad = int(total[0] or 0), int(total[1]) - int(total[0] or 0)
    order = F.xxhash64("id")
    some = known.filter("quality > 0").orderBy(order, "id").limit(MOST_ROWS).unionByName(
        known.filter("quality <= 0").orderBy(order, "id").limit(MOST_ROWS)
    )
    rows = measured.join(F.broadcast(some), F.col("key") == F.col("id")).select("quality", *FEATURES).collect()
    table = np.array([tuple(r) for r in sorted(rows)], float).reshape(-1, len(FEATURES) + 1)
    weights = fit_logistic(table[:, 1:], (table[:, 0] > 0).astype(float))
    # Where the bound keeps another share of each class, the constant goes back to the true rate.
    rate = [min(1.0, MOST_ROWS / max(c, 1)) for c in (good, bad)]
    weights[-1] -= float(np.log(rate[0] / rate[1]))
    return weights
