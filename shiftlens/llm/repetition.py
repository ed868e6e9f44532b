"""Quality rules by repetition coverage: characters inside duplicated n-grams and lines.

Rolling hashes of several n-gram lengths find, in numpy and for many documents at once, the
n-grams that a document holds twice; equal hashes are confirmed on the words. Longer n-grams are
looked for only where a shorter one repeats, so one sort of all windows serves all lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shiftlens.llm.texts import U64, chunks, flat_bytes, mix, same_rows, texts_of

#: Largest share of characters inside n-grams that occur twice or more, by length in words.
LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of characters inside lines that repeat an earlier line.
LINE_LIMIT = 0.20
#: Most symbols per word.
SYMBOL_LIMIT = 0.10
#: Length of the windows that n_repeat_words counts.
BASE_WIDTH = 8
SYMBOLS = b"#*$%&|<>"

FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "dup_line_chars long, ngram_chars array<long>"
)


def repeated_starts(words: np.ndarray, docs: np.ndarray, starts: np.ndarray, n: int, hashes):
    """Return those of the n-gram starts whose n-gram occurs again in the same document."""
    order = np.argsort(hashes, kind="stable")
    left, right = starts[order[:-1]], starts[order[1:]]
    same = hashes[order[:-1]] == hashes[order[1:]]
    left, right = left[same], right[same]
    wrong = docs[left] != docs[right]
    for j in range(n):
        wrong |= words[left + j] != words[right + j]
    if wrong.any():  # two n-grams share a hash: group by the words themselves
        rows = np.column_stack([docs[starts], *[words[starts + j] for j in range(n)]])
        _, which, count = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        return starts[count[which.ravel()] > 1]
    return np.union1d(left, right)


def covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Mark the words that windows of n words from these starts cover."""
    edge = np.zeros(total + 1, np.int64)
    edge[starts] += 1
    np.subtract.at(edge, starts + n, 1)
    return np.cumsum(edge[:-1]) > 0


def measure(column: pa.Array, widths: tuple[int, ...] = tuple(LIMITS)) -> dict[str, list]:
    """Measure every text of a column: see ``FIELDS``; ngram_chars follows ``widths``."""
    data, at = flat_bytes(column)
    kind = np.zeros(256, np.uint8)
    kind[list(SYMBOLS)] = 1
    per_text = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[at])
    blank = np.zeros(256, bool)
    blank[[32, *range(9, 14)]] = True
    points = per_text(((data & 0xC0) != 0x80) & ~blank[data])
    symbols = per_text(kind[data])

    ids: dict[bytes, int] = {}
    split, dup_lines, dup_chars = [], [], []
    for text in texts_of(column):
        split.append([ids.setdefault(w, len(ids)) for w in text.split()])
        seen, count, chars = set(), 0, 0
        for line in text.split(b"\n"):
            if line in seen:
                count += 1
                chars += sum(len(w.decode("utf-8", "replace")) for w in line.split())
            elif line.strip():
                seen.add(line)
        dup_lines.append(count)
        dup_chars.append(chars)
    sizes = np.array([len(s) for s in split], np.int64)
    words = np.fromiter((x for s in split for x in s), np.int64, int(sizes.sum()))
    docs = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.repeat(np.cumsum(sizes), sizes)
    lengths = np.array([len(w.decode("utf-8", "replace")) for w in ids] or [0], np.int64)[words]

    coded = mix(words.astype(U64) + U64(1))
    rolling, done = mix(docs.astype(U64) + U64(1 << 40)), 0
    starts, base = np.arange(len(words)), np.zeros(len(sizes), np.int64)
    ngram_chars = []
    for n in sorted({*widths, BASE_WIDTH}):
        keep = starts + n <= ends[starts]
        starts, rolling = starts[keep], rolling[keep]
        while done < n:
            rolling = rolling * U64(0x9E3779B97F4A7C15) + coded[starts + done]
            done += 1
        found = repeated_starts(words, docs, starts, n, mix(rolling)) if len(starts) else starts
        inside = covered(found, n, len(words))
        if n == BASE_WIDTH:
            base = np.bincount(docs[inside], minlength=len(sizes))
        if n in widths:
            chars = np.bincount(docs[inside], lengths[inside], len(sizes)).astype(np.int64)
            ngram_chars.append(chars)
        rolling = rolling[np.isin(starts, found, assume_unique=True)]
        starts = found
    return {
        "n_words": sizes, "word_chars": points, "n_symbols": symbols, "n_dup_lines": dup_lines,
        "n_repeat_words": base, "dup_line_chars": dup_chars,
        "ngram_chars": list(np.array(ngram_chars).T) if len(sizes) else [],
    }


def repetition_coverage(
    docs: DataFrame, key: str = "doc_id", text: str = "text", limits: dict[int, float] | None = None
) -> DataFrame:
    """Measure repetition in every text and judge it: one row per row of ``docs``.

    Columns: the key, those of ``FIELDS``, ``worst`` (name of the first rule broken, null if
    none), ``base_failed`` (under 20 words, or over 30% of the words in repeated 8-word windows)
    and ``kept``. The rules: characters in repeated n-grams against ``limits`` by length,
    characters in repeated lines, symbols per word. A null or empty text has no words: all
    measures 0, base_failed. A null key and repeated rows are judged like any other row; the
    work is local to a row, so a very long text needs only the memory of its own words.
    """
    limits = limits or LIMITS
    widths = tuple(sorted(limits))
    source = same_rows(docs, key, text)
    key_type = source.schema[key].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text):
            m = measure(batch.column(text), widths)
            words, chars = m["n_words"], np.maximum(m["word_chars"], 1)
            failed = (words < 20) | (100 * m["n_repeat_words"] > 30 * words)
            rules = {f"ngram_{n}": np.array([r[i] for r in m["ngram_chars"]]) > limits[n] * chars
                     for i, n in enumerate(widths)}
            rules["lines"] = np.array(m["dup_line_chars"]) > LINE_LIMIT * chars
            rules["symbols"] = m["n_symbols"] > SYMBOL_LIMIT * words
            worst = [next((k for k, v in rules.items() if v[i]), None) for i in range(len(words))]
            kept = ~failed & np.array([w is None for w in worst], bool)
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), *[pa.array(v) for v in m.values()],
                 pa.array(worst, pa.string()), pa.array(failed), pa.array(kept)],
                names=[key, *m, "worst", "base_failed", "kept"],
            )

    schema = f"`{key}` {key_type}, {FIELDS}, worst string, base_failed boolean, kept boolean"
    return source.mapInArrow(judge, schema)


def sql() -> str:
    """Return SQL over documents that gives the rows of ``repetition_coverage``, one column a length."""
    grams, covers, sums = [], [], []
    for n in sorted({*LIMITS, BASE_WIDTH}):
        ahead = f"OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)"
        grams.append(f"CASE WHEN i + {n - 1} <= size THEN string_agg(word, ' ') {ahead} END AS g{n}")
        covers.append(
            f"max(CASE WHEN d{n} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i "
            f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS c{n}"
        )
        sums.append(f"coalesce(sum(length(word)) FILTER (c{n} = 1), 0)::BIGINT AS chars{n}")
    doubles = ", ".join(
        f"g{n} IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g{n}) > 1 AS d{n}"
        for n in sorted({*LIMITS, BASE_WIDTH})
    )
    tests = " ".join(
        f"WHEN coalesce(chars{n}, 0) > {LIMITS[n]}::DOUBLE * greatest(word_chars, 1) THEN 'ngram_{n}'"
        for n in sorted(LIMITS)
    )
    chars = ", ".join(f"coalesce(chars{n}, 0) AS chars_{n}" for n in sorted(LIMITS))
    return rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
  length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols FROM texts),
words AS (SELECT doc_id, len(w) AS size, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM split),
grams AS (SELECT doc_id, i, word, {", ".join(grams)} FROM words),
doubled AS (SELECT doc_id, i, word, {doubles} FROM grams),
covered AS (SELECT doc_id, word, {", ".join(covers)} FROM doubled),
sums AS (SELECT doc_id, sum(c{BASE_WIDTH})::BIGINT AS n_repeat_words, {", ".join(sums)}
  FROM covered GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM texts)),
again AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS turn FROM lines
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dups AS (SELECT doc_id, count(*) AS n_dup_lines,
  sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')))::BIGINT AS dup_line_chars
  FROM again WHERE turn > 1 GROUP BY doc_id),
measured AS (SELECT doc_id, len(w)::BIGINT AS n_words, word_chars, n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  coalesce(dup_line_chars, 0) AS dup_line_chars, {chars},
  CASE {tests} WHEN coalesce(dup_line_chars, 0) > {LINE_LIMIT}::DOUBLE * greatest(word_chars, 1) THEN 'lines'
    WHEN n_symbols > {SYMBOL_LIMIT}::DOUBLE * len(w) THEN 'symbols' END AS worst
  FROM split LEFT JOIN sums USING (doc_id) LEFT JOIN dups USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND worst IS NULL AS kept FROM measured
"""
