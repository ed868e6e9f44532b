"""Source divergence audit: every source of a language held against every other one.

Counts of terms are reduced once. The work on them is a cube: a task owns a cell of (source block,
source block, term block), gets the two blocks' slices of that term block, replicated to it, and
returns the sums of the divergence over its terms for all ordered pairs of its sources. The sums
are added along the term axis. Terms that neither block of a cell has anywhere are not sent: all of
them weigh the same for a pair of sources, so their number is enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftlens.llm.texts import chunks, flat_bytes
from shiftlens.session import materialize

#: Documents of a language that a term must occur in to be kept.
LEAST_DOCS = 3
#: Terms reported for a source, those of the largest divergence from its language.
MOST_TERMS = 200
#: Sources of a block and terms of a block, on average; a cell is dense, two blocks by one.
BLOCK_SOURCES, BLOCK_TERMS = 48, 12_000
#: Probabilities are counted in units of one part in so many.
UNIT = 1_000_000_000

#: Letters are A-Z, a-z and all that is not ASCII; A-Z become lower case, the rest separates.
FOLD = np.array(
    [c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 0 for c in range(256)], np.uint8
)


def terms_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Return the terms of all texts of a column, end to end, and the text of each."""
    data, at = flat_bytes(column)
    code = FOLD[data]
    letter = code != 0
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    begin = at[:-1][at[:-1] < len(data)]
    first[begin] = letter[begin]
    starts = np.flatnonzero(first)
    bounds = np.append((np.cumsum(letter) - 1)[starts], np.count_nonzero(letter)).astype(np.int64)
    buffers = [None, pa.py_buffer(bounds), pa.py_buffer(code[letter])]
    terms = pa.Array.from_buffers(pa.large_binary(), len(starts), buffers)
    return terms, np.searchsorted(at, starts, side="right") - 1


def count_terms(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    """Return lang, source, term, n and docs (documents with the term), some rows to be added up.

    Each group of documents also has a row with a null term.
    """
    empty = F.lit("")
    rows = docs.select(
        F.coalesce(F.col(lang).cast("string"), empty).alias("lang"),
        F.coalesce(F.col(source).cast("string"), empty).alias("source"),
        F.col(text).cast("string").alias("text"),
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            names = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True))
            number = {g: i for i, g in enumerate(dict.fromkeys(names))}
            group = np.array([number[g] for g in names], np.int64)
            terms, doc = terms_of(batch.column("text"))
            coded = terms.dictionary_encode()
            width = max(1, len(coded.dictionary))
            ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            keys, n = np.unique(group[doc] * width + ids, return_counts=True)
            once = np.unique(doc * width + ids)
            once = group[once // width] * width + once % width
            _, docs_with = np.unique(once, return_counts=True)
            owner = np.concatenate([keys // width, np.arange(len(number))])
            langs, sources = (pa.array([g[k] for g in number], pa.string()) for k in (0, 1))
            found = coded.dictionary.take(pa.array(keys % width)).cast(pa.binary()).cast(pa.string())
            none = np.zeros(len(number), np.int64)
            yield pa.RecordBatch.from_arrays(
                [langs.take(pa.array(owner)), sources.take(pa.array(owner)),
                 pa.concat_arrays([found, pa.nulls(len(number), pa.string())]),
                 pa.array(np.concatenate([n, none])), pa.array(np.concatenate([docs_with, none]))],
                names=["lang", "source", "term", "n", "docs"],
            )

    return rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def kept_terms(counts: DataFrame, least_docs: int) -> DataFrame:
    """Add up the counts and keep the terms in enough documents of their language.

    Adds lang_n, the term's count in the language, and first, true for one row of each term.
    """
    added = counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    same = Window.partitionBy("lang", "term")
    added = added.withColumns({
        "first": F.row_number().over(same.orderBy("source")) == 1,
        "lang_n": F.sum("n").over(same),
        "lang_docs": F.sum("docs").over(same),
    })
    kept = added.filter(F.col("term").isNull() | (F.col("lang_docs") >= least_docs))
    return kept.select("lang", "source", "term", "n", "lang_n", "first")


def group_sizes(kept: DataFrame, sources_together: int, terms_together: int) -> DataFrame:
    """Return each group with total (N + V), those of its language, and its block of sources."""
    own = F.col("first") & F.col("term").isNotNull()
    groups = kept.groupBy("lang", "source").agg(
        F.sum("n").alias("size"), F.sum(own.cast("long")).alias("leads")
    )
    langs = groups.groupBy("lang").agg(
        F.sum("size").alias("lang_size"), F.sum("leads").alias("v"), F.count("*").alias("n_groups")
    )
    blocks = F.ceil(F.col("n_groups") / sources_together)
    return groups.join(langs, "lang").select(
        "lang", "source", "v", (F.col("size") + F.col("v")).alias("total"),
        (F.col("lang_size") + F.col("v")).alias("lang_total"), blocks.alias("blocks"),
        F.pmod(F.xxhash64("source"), blocks).alias("block"),
        F.greatest(F.lit(1), F.ceil(F.col("v") / terms_together)).alias("slices"),
    )


def probability(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Return 1 + floor(UNIT * (n + 1) / total), exact while total is below 9e15."""
    whole, rest = np.divmod(n + 1, total)
    for _ in range(3):  # three digits at a time: a product never passes 64 bits
        more, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + more
    return whole + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Return floor((p - q)**2 / q)."""
    gap = p - q
    return gap * gap // q


CELL = "lang string, source string, other string, part long, seen long, rest long, v long"


def cell_sums(table: pa.Table) -> pa.Table:
    """Sum the divergence over a cell's terms for all ordered pairs of its sources.

    Rows without a term name the sources, with their totals; others hold a source's count of a
    term. ``seen`` is the number of terms with a row, ``rest`` what any other term adds.
    """
    heads = table.filter(table["term"].is_null())
    rows = table.filter(table["term"].is_valid())
    names = heads["source"].to_pylist()
    number = {s: i for i, s in enumerate(names)}
    total = heads["total"].to_numpy().astype(np.int64)[:, None]
    block = heads["block"].to_numpy()
    at = rows["source"].combine_chunks().dictionary_encode()
    owner = np.array([number[s] for s in at.dictionary.to_pylist()], np.int64)[at.indices.to_numpy()]
    term = rows["term"].combine_chunks().dictionary_encode()
    n = np.zeros((len(names), len(term.dictionary)), np.int64)
    n[owner, term.indices.to_numpy()] = rows["n"].to_numpy()
    v = int(heads["v"][0].as_py())
    alone = np.zeros((len(names), 1), np.int64)
    p, p0 = probability(n, total), probability(alone, np.maximum(total, 1))
    i, j = table["i"][0].as_py(), table["j"][0].as_py()
    left, right, part, rest = [], [], [], []
    for g in range(len(names)):
        others = np.flatnonzero(block == (j if block[g] == i else i))
        others = others[others != g]
        left += [g] * len(others)
        right += others.tolist()
        part.append(divergence(p[g], p[others]).sum(axis=1))
        rest.append(divergence(p0[g], p0[others])[:, 0])
    take = pa.array(names, pa.string())
    size = len(left)
    return pa.table({
        "lang": pa.array([table["lang"][0].as_py()] * size, pa.string()),
        "source": take.take(pa.array(left, pa.int64())), "other": take.take(pa.array(right, pa.int64())),
        "part": np.concatenate(part), "seen": np.full(size, n.shape[1]), "rest": np.concatenate(rest),
        "v": np.full(size, v),
    })


def pair_divergences(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """Return lang, source, other and value for all ordered pairs of a language's sources."""
    terms = kept.filter("term IS NOT NULL").select("lang", "source", "term", "n")
    sized = terms.join(groups, ["lang", "source"]).withColumn(
        "slice", F.pmod(F.xxhash64("term"), F.col("slices"))
    )
    every = F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    heads = groups.select("*", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"))
    rows = sized.unionByName(heads.withColumn("slice", every))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = rows.select(
        "lang", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "slice",
        "source", "block", "total", "v", "term", "n",
    )
    sums = cells.groupBy("lang", "i", "j", "slice").applyInArrow(cell_sums, CELL)
    value = F.sum("part") + (F.max("v") - F.sum("seen")) * F.max("rest")
    value = F.when(F.max("v") > 0, value).otherwise(0)
    return sums.groupBy("lang", "source", "other").agg(value.alias("value"))


def scaled(n: str, total: str) -> Column:
    """Return the probability of ``probability`` as a column."""
    return F.expr(f"1 + ({UNIT}BD * CAST({n} + 1 AS DECIMAL(20, 0))) div CAST({total} AS DECIMAL(20, 0))")


def source_divergence(
    docs: DataFrame,
    lang: str = "lang",
    source: str = "source",
    text: str = "text",
    *,
    least_docs: int = LEAST_DOCS,
    most_terms: int = MOST_TERMS,
    sources_together: int = BLOCK_SOURCES,
    terms_together: int = BLOCK_TERMS,
) -> DataFrame:
    """Audit how far the sources of each language lie apart, in whole numbers.

    Returns lang, source, part, item, value, rank. Part ``pair``: all other sources of the language
    by divergence; part ``term``: the ``most_terms`` terms that a source has oftener than its
    language does. Ties go to the smaller item in UTF-8 order. Null lang, source and text count as
    empty. Every row is a document, also repeated ones. A group without terms takes part with its
    smoothed probabilities; in a language without kept terms all pairs are 0. An empty table gives no
    rows. Other columns are not read. A very long text needs its own bytes a few times over.
    """
    kept = materialize(kept_terms(count_terms(docs, lang, source, text), least_docs))
    groups = materialize(group_sizes(kept, sources_together, terms_together))
    pairs = pair_divergences(kept, groups).select(
        "lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value"
    )
    terms = kept.filter("term IS NOT NULL AND n > 0").join(
        groups.select("lang", "source", "total", "lang_total"), ["lang", "source"]
    )
    terms = terms.select(
        "lang", "source", "term", scaled("n", "total").alias("p"), scaled("lang_n", "lang_total").alias("q")
    ).filter("p > q")
    terms = terms.select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
        F.expr("(p - q) * (p - q) div q").alias("value"),
    )
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order).alias("rank")
    best = terms.select("*", rank).filter(F.col("rank") <= most_terms)
    return pairs.select("*", rank).unionByName(best)


SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  coalesce(text, '') AS text FROM documents),
words AS (SELECT row, lang, source, unnest(regexp_extract_all(text,
  '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS word FROM docs),
terms AS (SELECT row, lang, source,
  translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM words),
kept AS (SELECT lang, term, count(*) AS n FROM terms GROUP BY ALL
  HAVING count(DISTINCT row) >= {LEAST_DOCS}),
langs AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT + count(*) AS total FROM kept GROUP BY lang),
pairs AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM terms SEMI JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS size FROM pairs
  LEFT JOIN counts USING (lang, source) GROUP BY ALL),
dense AS (SELECT k.lang, s.source, k.term, coalesce(c.n, 0) AS n,
  1 + ({UNIT}::HUGEINT * (coalesce(c.n, 0) + 1)) // (s.size + l.v) AS p,
  1 + ({UNIT}::HUGEINT * (k.n + 1)) // l.total AS q
  FROM kept k JOIN langs l USING (lang) JOIN sizes s USING (lang) LEFT JOIN counts c USING (lang, source, term)),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
    coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) AS value
  FROM pairs a JOIN pairs b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN dense x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN dense y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM dense WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value,
  row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM found QUALIFY part = 'pair' OR rank <= {MOST_TERMS}
"""
