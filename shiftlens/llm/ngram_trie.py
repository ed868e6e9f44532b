"""LM scoring with an Elias-Fano n-gram trie, sharded by word.

A shard's trie holds words and, below each word, the words seen before it, with quantised
log10 probabilities. Blocks of documents send every shard their distinct words and word pairs,
with how often they occur in training texts; the shard adds these up, builds its trie and
answers each block from it. Nothing that grows with the corpus is gathered in one place: a word
that is a large part of all tokens has its pairs dealt over all shards by the word before.

The score of a token w after v is log10((N p(v, w) + MU p(w)) / (c(v) + MU)), a Dirichlet-smoothed
bigram: p(v, w) from the trie, p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)), counts over training tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlens.llm.elias_fano import Trie
from shiftlens.llm.texts import U64, WordHashes, chunks, remainder, texts_of
from shiftlens.session import checkpoint_folder, materialize

#: Pseudo-count of the unigram part.
MU = 100.0
#: Bytes of text per shard, about.
SHARD_BYTES = 16 << 20
#: The hashes that stand for a text's end and for what comes before its first word.
END, BEFORE = U64(0xFFFFFFFFFFFFFFF1), U64(0xFFFFFFFFFFFFFFF3)
#: Contexts are told apart within a word by the high bits of their hashes: a wrong match takes
#: as many contexts of one word in a shard as 2**40 has values.
CONTEXT_BITS = 40


class Block:
    """Documents of one block as token arrays, and the words and word pairs they hold."""

    def __init__(self, words: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, held: np.ndarray) -> None:
        self.words, self.tokens, self.sizes, self.held = words, tokens, sizes, held
        starts = np.cumsum(sizes) - sizes
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[starts] = np.searchsorted(words, BEFORE)
        self.before = before
        learn = np.repeat(~held, sizes).astype(float)
        self.counts = np.bincount(tokens, learn, len(words)).astype(np.int64)
        pairs, self.pair_of = np.unique(tokens * len(words) + before, return_inverse=True)
        self.pair_counts = np.bincount(self.pair_of, learn, len(pairs)).astype(np.int64)
        self.word, self.context = pairs // len(words), pairs % len(words)

    def parts(self, shards: int, heavy: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Yield, per shard, the words and the pairs it answers for, as indices in order."""
        bits = U64(65 - shards.bit_length())
        place = lambda hashes: (hashes >> bits).astype(np.int64) if shards > 1 else np.zeros(len(hashes), np.int64)
        word_shard = place(self.words)
        split = np.isin(self.words, heavy)[self.word]
        pair_shard = np.where(split, place(self.words)[self.context], word_shard[self.word])
        word_order = np.argsort(word_shard, kind="stable")
        pair_order = np.argsort(pair_shard, kind="stable")
        ends = np.arange(shards + 1)
        w, p = np.searchsorted(word_shard[word_order], ends), np.searchsorted(pair_shard[pair_order], ends)
        for s in range(shards):
            if w[s] < w[s + 1] or p[s] < p[s + 1]:
                yield s, word_order[w[s] : w[s + 1]], pair_order[p[s] : p[s + 1]]


def tokenised(batch: pa.RecordBatch, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Return distinct word hashes of a batch, its tokens as their indices, tokens per text."""
    coded = [hashes(t.lower().split()) for t in texts_of(batch.column("text"))]
    end = np.array([END], U64)
    flat = np.concatenate([x for c in coded for x in (c, end)])
    words = np.unique(np.concatenate([flat, end, np.array([BEFORE], U64)]))
    return words, np.searchsorted(words, flat), np.array([len(c) + 1 for c in coded])


def block_table(docs: DataFrame, shards: int) -> DataFrame:
    """Write and return the blocks: their documents, tokens, words and frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, first = WordHashes(), TaskContext.get().partitionId() << 32
        for number, batch in enumerate(chunks(batches)):
            words, tokens, sizes = tokenised(batch, hashes)
            count = np.bincount(tokens, minlength=len(words))
            # Tokens are stored by rank of frequency, which packs well.
            often = np.argsort(-count, kind="stable")
            rank = np.empty_like(often)
            rank[often] = np.arange(len(often))
            heavy = words[count * 4 * shards >= len(tokens)]
            columns = {
                "block": pa.array([first + number]), "ids": pa.array([batch.column("id").to_pylist()], pa.list_(pa.int64())),
                "held": np.array(batch.column("held").to_pylist(), np.uint8), "sizes": sizes.astype(np.int64),
                "words": words[often], "tokens": rank[tokens].astype(np.uint32),
                "heavy": pa.array([heavy.view(np.int64)], pa.list_(pa.int64())),
                "heavy_n": pa.array([count[np.isin(words, heavy)]], pa.list_(pa.int64())),
                "n": pa.array([len(tokens)]),
            }
            packed = [pa.array([v.tobytes()], pa.binary()) if isinstance(v, np.ndarray) else v for v in columns.values()]
            yield pa.RecordBatch.from_arrays(packed, names=list(columns))

    schema = (
        "block long, ids array<long>, held binary, sizes binary, words binary, tokens binary, "
        "heavy array<long>, heavy_n array<long>, n long"
    )
    spark = docs.sparkSession
    path = f"{checkpoint_folder(spark)}/blocks-{spark.range(1).select(F.uuid()).first()[0]}"
    docs.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def read_block(row) -> Block:
    """Make a block from a row of the block table."""
    words, tokens = np.frombuffer(row["words"], U64), np.frombuffer(row["tokens"], np.uint32)
    order = np.argsort(words)
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    held = np.frombuffer(row["held"], np.uint8).astype(bool)
    return Block(words[order], place[tokens], np.frombuffer(row["sizes"], np.int64), held)


def messages(blocks: DataFrame, shards: int, heavy: np.ndarray) -> DataFrame:
    """Return what each block tells each shard: its words and pairs with training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block, out = read_block(row), []
                for shard, words, pairs in block.parts(shards, heavy):
                    # Pairs of one word are neighbours: the word is named once with their number.
                    word = block.word[pairs]
                    cut = np.flatnonzero(np.diff(word, prepend=-1))
                    context = (block.words[block.context[pairs]] >> U64(64 - CONTEXT_BITS)).view(np.uint8)
                    out.append((
                        shard, row["block"], block.words[words].tobytes(),
                        block.counts[words].astype(np.uint32).tobytes(), block.words[word[cut]].tobytes(),
                        np.diff(cut, append=len(pairs)).astype(np.uint32).tobytes(),
                        context.reshape(-1, 8)[:, : CONTEXT_BITS // 8].tobytes(),
                        block.pair_counts[pairs].astype(np.uint32).tobytes(),
                    ))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names
                )

    names = ["shard", "block", "words", "counts", "heads", "fans", "contexts", "pair_counts"]
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 6]
    schema = "shard long, block long, " + ", ".join(f"{n} binary" for n in names[2:])
    needed = blocks.select("block", "held", "sizes", "words", "tokens")
    return needed.mapInArrow(run, schema)


def build_shard(frame: pd.DataFrame, total: int) -> tuple[np.ndarray, np.ndarray, Trie, list]:
    """Add up the messages to a shard: its words, their counts, its trie, and what was asked."""
    join = lambda column, kind: np.concatenate([np.frombuffer(x, kind) for x in frame[column]])
    named, heads, fans = join("words", U64), join("heads", U64), join("fans", np.uint32)
    narrow = join("contexts", np.uint8).reshape(-1, CONTEXT_BITS // 8)
    wide = np.zeros((len(narrow), 8), np.uint8)
    wide[:, : CONTEXT_BITS // 8] = narrow
    contexts = wide.view(U64).ravel()
    words = np.unique(np.concatenate([named, heads]))
    if len(words) >= 1 << (64 - CONTEXT_BITS):
        raise ValueError("a shard holds too many words; lower SHARD_BYTES")
    counts = np.bincount(np.searchsorted(words, named), join("counts", np.uint32), len(words)).astype(np.int64)
    keys = (np.repeat(np.searchsorted(words, heads), fans).astype(U64) << U64(CONTEXT_BITS)) | contexts
    pairs, which = np.unique(keys, return_inverse=True)
    seen = np.bincount(which, join("pair_counts", np.uint32), len(pairs))
    known = np.flatnonzero(seen > 0)
    below = (pairs[known] & ((U64(1) << U64(CONTEXT_BITS)) - U64(1)))
    starts = np.searchsorted(pairs[known] >> U64(CONTEXT_BITS), np.arange(len(words) + 1).astype(U64))
    unigram = np.log10((counts + 0.5) / (total + 0.5))
    trie = Trie.build([words, below], [starts], [unigram, np.log10(seen[known] / max(total, 1))])
    return words, counts, trie, [pairs, which]


def answers(frame: pd.DataFrame, total: int) -> pd.DataFrame:
    """Answer every block from the shard's trie: counts of its words, log10 p of its pairs."""
    words, counts, trie, (pairs, which) = build_shard(frame, total)
    root = np.zeros(len(words), np.int64)
    node = trie.find(0, words, root, root + len(words))
    start, stop = trie.children(0, node)
    word = (pairs >> U64(CONTEXT_BITS)).astype(np.int64)
    context = pairs & ((U64(1) << U64(CONTEXT_BITS)) - U64(1))
    found = trie.find(1, context, start[word], stop[word])
    level = trie.levels[1]
    # One byte per pair on the way back: 0 for absent, else the code of the level, plus one ...
    codes = np.where(found < 0, 0, level["codes"][np.maximum(found, 0)].astype(np.int64) + 1 if len(level["codes"]) else 0)
    codes = codes.astype(np.uint16)[which]
    rows, at = [], 0
    for i, (block, named, fans) in enumerate(zip(frame["block"], frame["words"], frame["fans"], strict=True)):
        n = int(np.frombuffer(fans, np.uint32).sum())
        mine = counts[np.searchsorted(words, np.frombuffer(named, U64))]
        rows.append((
            block, frame["shard"].iloc[0], mine.astype(np.uint64).tobytes(), codes[at : at + n].tobytes(),
            level["book"].tobytes(), int(counts.sum()) if not i else 0, int((counts > 0).sum()) if not i else 0,
        ))
        at += n
    return pd.DataFrame(rows, columns=["block", "shard", "counts", "codes", "book", "tokens", "distinct"])


def score_block(row, replies: pd.DataFrame, shards: int, heavy: np.ndarray, total: int, distinct: int) -> pd.DataFrame:
    """Put a block's answers together and score its documents."""
    block = read_block(row)
    counts = np.zeros(len(block.words), np.int64)
    joint = np.zeros(len(block.word))
    by_shard = {r.shard: r for r in replies.itertuples()}
    for shard, words, pairs in block.parts(shards, heavy):
        reply = by_shard[shard]
        counts[words] = np.frombuffer(reply.counts, np.uint64)
        book = np.concatenate([[0.0], 10.0 ** np.frombuffer(reply.book, np.float32).astype(float)])
        joint[pairs] = book[np.frombuffer(reply.codes, np.uint16)]
    single = (counts + 0.5) / (total + 0.5 * (distinct + 1))
    after = counts.copy()  # how often a word is a context: each token is, but for the ends
    after[np.searchsorted(block.words, BEFORE)] = counts[np.searchsorted(block.words, END)]
    after[np.searchsorted(block.words, END)] = 0
    pair = np.log10((total * joint + MU * single[block.word]) / (after[block.context] + MU))
    starts = np.cumsum(block.sizes) - block.sizes
    summed = lambda values: np.add.reduceat(values, starts)
    return pd.DataFrame({
        "id": pd.array(row["ids"], dtype="Int64"), "held_out": block.held, "n_tokens": block.sizes,
        "n_known": summed((counts > 0)[block.tokens].astype(np.int64)), "train_tokens": np.full(len(block.sizes), total),
        "base_score": summed(np.log10(single)[block.tokens]), "score": summed(pair[block.pair_of]),
    })


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Score every whole text with a bigram trie learned from texts that are not held out.

    Returns key, held_out (crc32 of the key modulo 5 is 1), n_tokens, n_known, train_tokens,
    base_score and score, one row per row of ``docs``. A null or empty text is its end token
    alone. Repeated rows count each; a null key has the crc32 of an empty text. Without training
    texts every token has probability 1 by the smoothing. An empty table gives no rows.
    """
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    shards = 1
    while shards * SHARD_BYTES < size:
        shards *= 2
    source = docs.select(
        F.col(key).cast("long").alias("id"), (remainder(key, 5) == 1).alias("held"), F.col(text).alias("text")
    )
    blocks = block_table(source, shards)
    # A word with a share of 1 / (4 shards) of all tokens has it in some block: at most 4 x shards.
    everything = blocks.agg(F.sum("n")).first()[0] or 0
    listed = blocks.select(F.explode(F.arrays_zip("heavy", "heavy_n")).alias("h"))
    heavy = np.array([
        r[0] for r in listed.groupBy("h.heavy").agg(F.sum("h.heavy_n").alias("n"))
        .filter(F.col("n") * 4 * shards >= everything).select("heavy").collect()
    ], np.int64).view(U64)
    heavy = heavy if shards > 1 else heavy[:0]

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [int(np.frombuffer(s, np.int64)[np.frombuffer(h, np.uint8) == 0].sum())
                 for s, h in zip(batch.column("sizes").to_pylist(), batch.column("held").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], names=["n"])

    total = blocks.select("sizes", "held").mapInArrow(learned, "n long").agg(F.sum("n")).first()[0] or 0
    replies = materialize(
        messages(blocks, shards, heavy).groupBy("shard")
        .applyInPandas(lambda frame: answers(frame, total), "block long, shard long, counts binary, "
                       "codes binary, book binary, tokens long, distinct long")
    )
    distinct = replies.agg(F.sum("distinct")).first()[0] or 0

    def finish(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return score_block(left.iloc[0], right, shards, heavy, total, distinct)

    asked = blocks.select("block", "ids", "held", "sizes", "words", "tokens").groupBy("block")
    return (
        asked.cogroup(replies.drop("tokens", "distinct").groupBy("block"))
        .applyInPandas(finish, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                       "base_score double, score double")
        .withColumnRenamed("id", key)
    )
