"""Phrase collocation mining in the manner of Toivonen.

A sample of documents proposes phrases at a lowered threshold. The full pass counts every phrase
whose shorter parts were all proposed, and every word: these are the proposals and their negative
border, the phrases that first fall out of them. Counts are exact, so only a border phrase that
turns out frequent can hide longer ones. While there are such failures, a further pass counts the
phrases that all frequent parts now admit and that no pass has counted; it ends when none is left.

Tasks tell proposed phrases by a bit map of bounded size. A phrase that shares a bit with a
proposed one is merely counted too, so neither collisions nor a full map change the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftlens.llm.suffix_dedup import RangeHash
from shiftlens.llm.texts import U64, chunks, flat_bytes, mix
from shiftlens.session import materialize

#: Least occurrences of a phrase, and most words.
LEAST, MOST_WORDS = 10, 3
#: Share of the documents that propose phrases, and least occurrences there.
SAMPLE, SAMPLE_LEAST = 0.1, 2
#: A phrase goes where a longer one has this percentage of its occurrences.
INSIDE_PERCENT = 50
#: Phrases returned of a language.
MOST_PHRASES = 2000
#: Units of a score.
UNIT = 1_000_000
#: Bits of a map: this many for a phrase, but no more than so many in all (64 MB).
PHRASE_BITS, MOST_BITS = 32, 1 << 29
#: Bits that one task of the map's building holds.
PIECE_BITS = 1 << 19
#: Parts into which a language is cut when its best phrases are picked.
SPREAD = 64

#: UTF-8 bytes that a task counts at once.
CHUNK_BYTES = 3 << 19

#: A phrase that often in a chunk is held back until a task ends, and so many of them at most.
HEAVY, MOST_HEAVY = 16, 100_000

PIECE, BLANK = 10, 32
#: A-Z become lower case, what ends a piece becomes ``PIECE``, a tab a space.
FOLD = np.array(
    [PIECE if chr(c) in ".,;:!?\n\x0b\x0c\r" else BLANK if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256)],
    np.uint8,
)
STEP = U64(0x9E3779B97F4A7C15)

COUNTS = "lang string, phrase string, n long"


class Mined(NamedTuple):
    """All frequent phrases with their counts, and the passes over all documents that it took."""

    frequent: DataFrame
    passes: int


def words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Return the words of all texts end to end, the text of each, and the piece of each."""
    data, at = flat_bytes(column)
    code = FOLD[data]
    ends = code == PIECE
    inside = ~ends & (code != BLANK)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begin = at[:-1][at[:-1] < len(data)]
    first[begin] = inside[begin]
    starts = np.flatnonzero(first)
    bounds = np.append((np.cumsum(inside) - 1)[starts], np.count_nonzero(inside)).astype(np.int64)
    buffers = [None, pa.py_buffer(bounds), pa.py_buffer(code[inside])]
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), buffers)
    text = np.searchsorted(at, starts, side="right") - 1
    return words, text, np.cumsum(ends)[starts] + text


def hashed_ranges(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Return 64-bit hashes of words that lie in one array of bytes."""
    return RangeHash(data)(starts, stops) if len(data) else np.zeros(len(starts), U64)


def hashed_strings(column: pa.Array) -> np.ndarray:
    """Return 64-bit hashes of whole strings."""
    data, at = flat_bytes(column)
    return hashed_ranges(data, at[:-1], at[1:])


def extended(phrase: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Return the hashes of phrases made longer by a word."""
    return mix(phrase * STEP + word)


class PhraseMap(NamedTuple):
    """A bit map of phrases, one bit for each."""

    bits: Broadcast

    def has(self, hashes: np.ndarray) -> np.ndarray:
        data = self.bits.value
        slot = hashes & U64(8 * len(data) - 1)
        return (data[slot >> U64(3)] >> (slot & U64(7)).astype(np.uint8)) & 1 == 1


def count_phrases(
    rows: DataFrame, most_words: int, admit: PhraseMap | None, counted: list[PhraseMap], words_too: bool
) -> DataFrame:
    """Count the phrases all of whose shorter parts ``admit`` has, apart from those counted before.

    A phrase was counted before if an earlier map has its parts. ``words_too`` counts all single
    words as well, and adds a row with a null phrase for the words of each language.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy: dict[tuple[str, str | None], int] = {}

        def rows_of(pairs: list[tuple[tuple[str, str | None], int]]) -> pa.RecordBatch:
            keys = [k for k, _ in pairs]
            columns = [pa.array([k[i] for k in keys], pa.string()) for i in (0, 1)]
            return pa.RecordBatch.from_arrays(
                [*columns, pa.array([n for _, n in pairs], pa.int64())], names=["lang", "phrase", "n"]
            )

        for batch in chunks(batches, most_bytes=CHUNK_BYTES):
            if len(heavy) > MOST_HEAVY:
                yield rows_of(list(heavy.items()))
                heavy.clear()
            names = batch.column("lang").to_pylist()
            number = {x: i for i, x in enumerate(dict.fromkeys(names))}
            words, text, piece = words_of(batch.column("text"))
            if not len(words):
                continue
            lang = np.array([number[x] for x in names], np.int64)[text]
            coded = words.dictionary_encode()
            width = len(coded.dictionary)
            ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            langs = pa.array(list(number), pa.string())
            string = coded.dictionary.cast(pa.binary()).cast(pa.string())
            hashed = mix(hashed_strings(string)[ids] + mix(hashed_strings(langs))[lang])

            def table(keys, n, phrases):
                much = n >= HEAVY
                at = pa.array(np.flatnonzero(much))
                pairs = zip(langs.take(pa.array(keys[much])).to_pylist(), phrases.take(at).to_pylist(), strict=True)
                for key, count in zip(pairs, n[much].tolist(), strict=True):
                    heavy[key] = heavy.get(key, 0) + count
                few = pa.array(np.flatnonzero(~much))
                return pa.RecordBatch.from_arrays(
                    [langs.take(pa.array(keys[~much])), phrases.take(few), pa.array(n[~much])],
                    names=["lang", "phrase", "n"],
                )

            if words_too:
                found = pa.array(lang * width + ids).value_counts()
                keys, n = (found.field(i).to_numpy() for i in (0, 1))
                yield table(keys // width, n, string.take(pa.array(keys % width)))
                n = np.bincount(lang, minlength=len(number))
                yield table(np.arange(len(number)), n, pa.nulls(len(n), pa.string()))
            # Of each level: places where a phrase begins, which of the earlier passes counted it,
            # its number, its spelling and its hash.
            at, done = np.arange(len(ids)), [np.ones(len(ids), bool) for _ in counted]
            code, owner, part, spelling = lang * width + ids, lang, hashed, string
            for size in range(2, most_words + 1):
                # Two phrases of size - 1 that begin one word apart, in one piece.
                ahead = np.flatnonzero((np.diff(at) == 1) & (piece[at[:-1]] == piece[np.minimum(at[:-1] + size - 1, len(ids) - 1)]))
                ahead = ahead[at[ahead] + size - 1 < len(ids)]
                if admit is not None:
                    ahead = ahead[admit.has(part[ahead]) & admit.has(part[ahead + 1])]
                last = at[ahead] + size - 1
                pairs = pa.array(code[ahead] * width + ids[last]).dictionary_encode()
                keys, inverse = pairs.dictionary.to_numpy(), pairs.indices.to_numpy()
                owner_of = np.zeros(len(keys), np.int64)
                owner_of[inverse] = owner[ahead]
                first = keys // width % width if size == 2 else keys // width
                spelling = pc.binary_join_element_wise(
                    spelling.take(pa.array(first)), string.take(pa.array(keys % width)), " "
                )
                before, after = part[ahead], part[ahead + 1]
                # An earlier pass reached a phrase only if it had reached both of these.
                done = [d[ahead] & d[ahead + 1] & m.has(before) & m.has(after) for d, m in zip(done, counted, strict=True)]
                new = ~np.logical_or.reduce(done) if done else np.ones(len(ahead), bool)
                n = np.bincount(inverse[new], minlength=len(keys))
                some = np.flatnonzero(n)
                yield table(owner_of[some], n[some], spelling.take(pa.array(some)))
                if size < most_words:
                    part = extended(before, hashed[last])
                    at, code, owner = at[ahead], inverse.astype(np.int64), owner[ahead]

        if heavy:
            yield rows_of(list(heavy.items()))

    # Most phrases of a task occur in it once: frequent ones are summed in it, the others after the
    # shuffle only, where a hash table is as small as its part.
    counts = rows.mapInArrow(count, COUNTS).repartition("lang", "phrase")
    spaces = F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit("")))
    added = counts.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return added.select("lang", (spaces + 1).alias("words"), "phrase", "n")


def phrase_hashes(batch: pa.RecordBatch) -> np.ndarray:
    """Return the hashes of phrases given as text."""
    data, at = flat_bytes(batch.column("phrase"))
    spaces = np.flatnonzero(data == BLANK)
    starts, stops = np.sort(np.append(at[:-1], spaces + 1)), np.sort(np.append(at[1:], spaces))
    first = np.searchsorted(starts, at[:-1])
    sizes = np.diff(np.append(first, len(starts)))
    langs = np.repeat(mix(hashed_strings(batch.column("lang"))), sizes)
    words = mix(hashed_ranges(data, starts, stops) + langs)
    out = words[first]
    for i in range(1, int(sizes.max(initial=0))):
        longer = np.flatnonzero(sizes > i)
        out[longer] = extended(out[longer], words[first[longer] + i])
    return out


def phrase_map(phrases: DataFrame) -> PhraseMap:
    """Build the bit map of a table of phrases; the driver holds no more than ``MOST_BITS``."""
    spark = phrases.sparkSession
    size = 1 << 16
    while size < min(MOST_BITS, PHRASE_BITS * phrases.count()):
        size *= 2

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = np.unique(phrase_hashes(batch) & U64(size - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot // PIECE_BITS), pa.array((slot % PIECE_BITS).astype(np.int32))], names=["piece", "bit"]
            )

    def pieces(table: pa.Table) -> pa.Table:
        flags = np.zeros(min(size, PIECE_BITS), np.uint8)
        flags[table["bit"].to_numpy()] = 1
        bits = np.packbits(flags, bitorder="little").tobytes()
        return pa.table({"piece": table["piece"][:1], "bits": pa.array([bits], pa.binary())})

    made = phrases.select("lang", "phrase").mapInArrow(slots, "piece long, bit int")
    made = made.groupBy("piece").applyInArrow(pieces, "piece long, bits binary")
    bits = np.zeros(size // 8, np.uint8)
    for row in made.toLocalIterator():
        at = row.piece * (PIECE_BITS // 8)
        bits[at : at + len(row.bits)] = np.frombuffer(row.bits, np.uint8)
    return PhraseMap(spark.sparkContext.broadcast(bits))


def missing(phrases: DataFrame, known: PhraseMap) -> DataFrame:
    """Return the phrases that a map does not have."""

    def absent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~known.has(phrase_hashes(batch))))

    return phrases.select("lang", "phrase").mapInArrow(absent, "lang string, phrase string")


def frequent_phrases(
    rows: DataFrame, least: int, most_words: int, sample: float, sample_least: int
) -> Mined:
    """Count all phrases of ``rows`` (lang, text, draw in 0 .. 1) that occur ``least`` times.

    Rows with a null phrase hold the words of a language.
    """
    proposed = count_phrases(rows.filter(F.col("draw") < sample), most_words - 1, None, [], True)
    proposed = materialize(proposed.filter(F.col("phrase").isNotNull() & (F.col("n") >= sample_least)))
    maps = [phrase_map(proposed)]
    tables: list[DataFrame] = []
    while True:
        counts = count_phrases(rows, most_words, maps[-1], maps[:-1], not tables)
        tables.append(materialize(counts.filter(F.col("phrase").isNull() | (F.col("n") >= least))))
        # Border failures: frequent, but not among the parts that were admitted so far.
        shorter = tables[-1].filter(F.col("phrase").isNotNull() & (F.col("words") < most_words))
        if missing(shorter, maps[-1]).isEmpty():
            break
        known = tables[0]
        for more in tables[1:]:
            known = known.unionByName(more)
        maps.append(phrase_map(known.filter(F.col("phrase").isNotNull() & (F.col("words") < most_words))))
    known = tables[0]
    for more in tables[1:]:
        known = known.unionByName(more)
    return Mined(known, len(tables))


def scored_phrases(frequent: DataFrame, inside_percent: int) -> DataFrame:
    """Score all phrases of two words or more by their weakest cut and drop the contained ones."""
    known = frequent.filter("phrase IS NOT NULL")
    lookup = known.select("lang", "phrase", "n")
    long = known.filter("words > 1").withColumn("w", F.split("phrase", " "))
    cuts = long.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "lang", "phrase", "words", "k", F.col("n").alias("a"),
        F.expr("array_join(slice(w, 1, k), ' ')").alias("left"),
        F.expr("array_join(slice(w, k + 1, words - k), ' ')").alias("right"),
    )
    for side, count in (("left", "l"), ("right", "r")):
        part = lookup.select("lang", F.col("phrase").alias(side), F.col("n").alias(count))
        cuts = cuts.join(part, ["lang", side])
    big = "CAST({} AS DECIMAL(14, 0))".format
    score = f"({big('a')} * {big('a')} * {UNIT}BD) div ({big('l')} * {big('r')})"
    weakest = cuts.withColumn("score", F.expr(score)).groupBy("lang", "phrase", "words", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut")
    )
    # Every shorter phrase of two words or more inside a longer one, with that one's count.
    spans = "flatten(transform(sequence(2, words - 1), s -> transform(sequence(1, words - s + 1), i -> array_join(slice(w, i, s), ' '))))"
    inside = long.filter("words > 2").select("lang", F.explode(F.expr(spans)).alias("phrase"), "n")
    inside = inside.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = weakest.join(inside, ["lang", "phrase"], "left").filter(
        F.coalesce(100 * F.col("longer") < inside_percent * F.col("a"), F.lit(True))
    )
    return kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def collocations(
    docs: DataFrame,
    key: str = "doc_id",
    lang: str = "lang",
    text: str = "text",
    *,
    least: int = LEAST,
    most_words: int = MOST_WORDS,
    sample: float = SAMPLE,
    sample_least: int = SAMPLE_LEAST,
    inside_percent: int = INSIDE_PERCENT,
    most_phrases: int = MOST_PHRASES,
) -> DataFrame:
    """Return the strongest phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase is 2 to ``most_words`` words of one piece (pieces end at ``.,;:!?`` and line ends) that
    occurs ``least`` times or more. Its score is that of its weakest cut. Ties go to the larger
    count, then to the smaller phrase in UTF-8 order. A null text is empty, a null language ``und``.
    Repeated rows count as often as they come. The key only draws the sample, which changes no
    result. An empty table gives no rows. Counts up to 1e14 are exact. A very long text needs its
    own words some times over.
    """
    rows = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
        F.col(text).cast("string").alias("text"),
        (F.pmod(F.xxhash64(F.col(key).cast("string"), F.col(text)), 1 << 20) / (1 << 20)).alias("draw"),
    )
    frequent = frequent_phrases(rows, least, most_words, sample, sample_least).frequent
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The best of each part of a language first, so that no task sorts a whole language.
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SPREAD))).orderBy(*order)
    best = scored_phrases(frequent, inside_percent).withColumn("rank", F.row_number().over(part))
    whole = Window.partitionBy("lang").orderBy(*order)
    best = best.filter(F.col("rank") <= most_phrases).withColumn("rank", F.row_number().over(whole).cast("long"))
    totals = frequent.filter("phrase IS NULL").select("lang", "n")
    best = best.filter(F.col("rank") <= most_phrases).join(totals, "lang")
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = rf"""
WITH texts AS (SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
cut AS (SELECT row, lang, string_split_regex(text, '[.,;:!?\x0A-\x0D]') AS pieces FROM texts),
pieces AS (SELECT lang, row, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS p FROM cut),
split AS (SELECT lang, row, p, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
words AS (SELECT lang, row, p, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM split),
near AS (SELECT lang, word AS w1, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3
  FROM words WINDOW o AS (PARTITION BY row, p ORDER BY i)),
totals AS (SELECT lang, count(*) AS n FROM near GROUP BY lang),
f1 AS (SELECT lang, w1, count(*) AS n FROM near GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS n FROM near WHERE w2 IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS n FROM near WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}),
c2 AS (SELECT b.lang, b.w1 || ' ' || b.w2 AS phrase, b.n AS a, x.n AS l, y.n AS r,
  {UNIT}::HUGEINT * b.n * b.n // (x.n::HUGEINT * y.n) AS score
  FROM f2 b JOIN f1 x ON x.lang = b.lang AND x.w1 = b.w1 JOIN f1 y ON y.lang = b.lang AND y.w1 = b.w2
  WHERE b.n >= {LEAST} AND NOT EXISTS (SELECT 1 FROM f3 t WHERE t.lang = b.lang AND 100 * t.n >= {INSIDE_PERCENT} * b.n
    AND (t.w1 = b.w1 AND t.w2 = b.w2 OR t.w2 = b.w1 AND t.w3 = b.w2))),
c3 AS (SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3 AS phrase, t.n AS a, u.n AS l1, vw.n AS r1, uv.n AS l2, w.n AS r2,
  {UNIT}::HUGEINT * t.n * t.n // (u.n::HUGEINT * vw.n) AS s1, {UNIT}::HUGEINT * t.n * t.n // (uv.n::HUGEINT * w.n) AS s2
  FROM f3 t JOIN f1 u ON u.lang = t.lang AND u.w1 = t.w1 JOIN f1 w ON w.lang = t.lang AND w.w1 = t.w3
  JOIN f2 uv ON uv.lang = t.lang AND uv.w1 = t.w1 AND uv.w2 = t.w2
  JOIN f2 vw ON vw.lang = t.lang AND vw.w1 = t.w2 AND vw.w2 = t.w3),
found AS (SELECT lang, phrase, a, l, r, score FROM c2 UNION ALL
  SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM c3)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n,
  score::BIGINT AS score FROM found JOIN totals USING (lang) QUALIFY rank <= {MOST_PHRASES}
"""
