"""Lexical retrieval packing: windows of tokens filled with documents that match by BM25.

Documents are encoded to token ids and go to shards, dealt by a hash. A shard keeps an inverted
index of its whole documents by token, with the frequencies of tokens over all documents. Whole
windows are cut off the front of a long document; what is left is packed. Each window starts with a
seed, the next unused document; the index returns its best unused neighbours, which fill the window
one after another. The last one is cut where the window ends, and its rest seeds the next window.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlens.llm.texts import chunks
from shiftlens.session import checkpoint_folder

WINDOW = 2048
#: Id that ends every document.
END = 1
#: Bytes of text per shard, about.
SHARD_BYTES = 8 << 20
#: The usual constants of BM25.
K1, B = 1.2, 0.75
#: Tokens of a seed that its query is made of: those of the highest BM25 weight.
QUERY_TOKENS = 8


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Return where a tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def encoder(path: str | None) -> Encoder:
    """Return the encoder of a tokenizer file, loaded once per Python process."""
    if path is None:
        return Encoder(tokenizer_path(), tokenizer_path("byte_bpe_50k.tiktoken"))
    return Encoder(path)


class Encoder:
    """Token ids of texts by a tokenizer file.

    With ``ranks``, the same vocabulary for a faster library, plain Latin texts go there: both
    split and merge those alike. Texts with any other character or a special token's name are
    encoded by the tokenizer itself.
    """

    #: Characters that the two libraries may class differently.
    unusual = re.compile(r"[^\t\n\r -~\u00a1-\u024f]|<\|")
    #: UTF-8 bytes that only characters classed alike have; C2 and C9 begin others too.
    alike = bytes([9, 10, 13, *range(0x20, 0x7F), *range(0x80, 0xC0), *range(0xC3, 0xC9)])

    def __init__(self, path: str, ranks: str | None = None) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.fast = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as file:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            self.fast = tiktoken.Encoding(
                "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}
            )

    def is_unusual(self, text: str) -> bool:
        """Check a text for what ``unusual`` finds; most texts are told by their bytes at once."""
        raw = text.encode("utf-8", "surrogatepass")
        if not raw.translate(None, self.alike):
            return b"<|" in raw
        return self.unusual.search(text) is not None

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """Return the ids of every text, without the end."""
        slow = [i for i, t in enumerate(texts) if self.fast is None or self.is_unusual(t)]
        found = self.tokenizer.encode_batch_fast([texts[i] for i in slow], add_special_tokens=False)
        by_place = {i: np.array(x.ids, "<u4") for i, x in zip(slow, found, strict=True)}
        return [
            by_place[i] if i in by_place else self.fast.encode_to_numpy(t, disallowed_special=())
            for i, t in enumerate(texts)
        ]


def encoded_table(docs: DataFrame, path: str | None) -> DataFrame:
    """Write and return the encoded documents: key, shard and all their ids.

    Rows without ``ids`` hold how many documents of one task each token is in (``token``, ``seen``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        seen = np.zeros(encode.size, np.int64)
        # Where a token last stood; a text writes its own places before it reads them.
        where = np.zeros(encode.size, np.int64)
        for batch in chunks(batches):
            ids = []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for found in encode(texts):
                tokens = np.append(found, np.uint32(END)).astype("<u4")
                place = np.arange(len(tokens))
                where[tokens] = place
                seen[tokens[where[tokens] == place]] += 1  # each distinct token at one of its places
                ids.append(tokens.tobytes())
            none = pa.nulls(len(ids), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("shard"), pa.array(ids, pa.binary()), none, none], names=names
            )
        some = np.flatnonzero(seen)
        blank = [pa.nulls(len(some), t) for t in (key_arrow, pa.int64(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*blank, pa.array(some), pa.array(seen[some])], names=names)

    names = ["key", "shard", "ids", "token", "seen"]
    key_type = docs.schema["key"].dataType.simpleString()
    key_arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(key_type, pa.int64())
    schema = f"key {key_type}, shard long, ids binary, token long, seen long"
    spark = docs.sparkSession
    name = spark.range(1).select(F.uuid()).first()[0]
    path_out = f"{checkpoint_folder(spark)}/encoded-{name}"
    docs.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path_out)
    return spark.read.schema(schema).parquet(path_out)


class Index:
    """A shard's inverted index: per token the documents that hold it and its BM25 weight there."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
        sizes = np.array([len(d) for d in docs])
        owner = np.repeat(np.arange(len(docs)), sizes)
        flat = np.concatenate([*docs, np.zeros(0, np.uint32)]).astype(np.int64)
        cells, often = np.unique(flat * len(docs) + owner, return_counts=True)
        token, doc = cells // max(len(docs), 1), cells % max(len(docs), 1)
        damp = K1 * (1 - B + B * sizes[doc] / max(mean, 1e-9))
        weight = idf[token] * often * (K1 + 1) / (often + damp)
        self.start = np.searchsorted(token, np.arange(len(idf) + 1))
        self.doc, self.weight = doc, weight
        # Per document, tokens by falling weight in steps of a millionth of the largest; cells are
        # in the order of tokens, so of equal weights the smaller token comes first.
        steps = (weight * (((1 << 20) - 1) / max(weight.max(initial=0), 1e-9))).astype(np.int64)
        by_doc = np.argsort((doc << 20) + ((1 << 20) - 1 - steps), kind="stable")
        first = np.searchsorted(doc[by_doc], np.arange(len(docs)))
        last = np.append(first[1:], len(by_doc))
        self.query = [token[by_doc[a : min(b, a + QUERY_TOKENS)]] for a, b in zip(first, last, strict=True)]
        self.unused = np.ones(len(docs), bool)
        self.total = np.zeros(len(docs))

    def neighbours(self, seed: int) -> np.ndarray:
        """Return the unused documents that share a query token with the seed, best first."""
        parts = [slice(self.start[t], self.start[t + 1]) for t in self.query[seed]]
        if not parts:
            return np.zeros(0, np.int64)
        docs = np.concatenate([self.doc[p] for p in parts])
        weights = np.concatenate([self.weight[p] for p in parts])
        live = self.unused[docs]
        docs, weights = docs[live], weights[live]
        np.add.at(self.total, docs, weights)
        found = np.unique(docs)
        found = found[np.lexsort((found, -self.total[found]))]
        self.total[docs] = 0
        return found


def pack_shard(docs: list[np.ndarray], idf: np.ndarray, mean: float) -> list[list[tuple[int, int, int]]]:
    """Pack what whole windows leave of documents into windows: lists of (document, from, to).

    Neighbours are found by the whole documents. Every token after a document's whole windows is
    used once. All windows but the last are full; its tokens are cut to lengths that are powers of
    two.
    """
    index = Index(docs, idf, mean)
    start = [len(d) // WINDOW * WINDOW for d in docs]
    windows: list[list[tuple[int, int, int]]] = []
    rest: tuple[int, int] | None = None
    next_seed = 0
    while True:
        if rest is None:
            while next_seed < len(docs) and not index.unused[next_seed]:
                next_seed += 1
            if next_seed == len(docs):
                break
            index.unused[next_seed] = False
            rest = (next_seed, start[next_seed])
        seed, at = rest
        rest, window, room = None, [], WINDOW
        waiting = iter([(seed, at)])
        asked = False
        while room:
            item = next(waiting, None)
            if item is None and not asked:
                asked, waiting = True, ((int(d), start[d]) for d in index.neighbours(seed))
                continue
            if item is None:  # no neighbour is left: the next unused document seeds on
                while next_seed < len(docs) and not index.unused[next_seed]:
                    next_seed += 1
                if next_seed == len(docs):
                    break
                item, seed, asked = (next_seed, start[next_seed]), next_seed, False
                waiting = iter(())
            doc, at = item
            index.unused[doc] = False
            take = min(room, len(docs[doc]) - at)
            if take:
                window.append((doc, at, at + take))
            room -= take
            if at + take < len(docs[doc]):
                rest = (doc, at + take)
        windows += [window] if not room else powers_of_two(window)
    return windows


def powers_of_two(window: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Cut a window that is not full to sequences whose lengths are powers of two, largest first."""
    total, out = sum(b - a for _, a, b in window), []
    pieces = list(reversed(window))
    for bit in reversed(range(total.bit_length())):
        room, part = total & (1 << bit), []
        while room:
            doc, a, b = pieces.pop()
            take = min(room, b - a)
            part.append((doc, a, a + take))
            room -= take
            if a + take < b:
                pieces.append((doc, a + take, b))
        if part:
            out.append(part)
    return out


def pack_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None
) -> DataFrame:
    """Pack all documents into sequences of at most 2048 tokens, similar documents together.

    A document is its ids and the end id; a null text is empty. Returns a row per piece: key,
    start, length, ids_crc32, doc_tokens, sequence_id, offset. Sequences are full but for the
    last ones of a shard, which are powers of two long, so none needs padding. Null keys are
    packed like others. Repeated rows are packed each, and rows of one key go to shards by key
    and text. ``tokenizer`` is the path of a tokenizer file on every machine (default: the
    installed byte-level one). The result is the same for any partitioning of the input.
    """
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    shards = max(1, -(-int(size) // SHARD_BYTES))
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    place = F.pmod(F.xxhash64("key", F.length("text")), F.lit(shards)).alias("shard")
    table = encoded_table(source.select("key", place, "text"), tokenizer)
    length = F.octet_length("ids") / 4
    n, tokens = table.filter("ids IS NOT NULL").agg(F.count("*"), F.sum(length)).first()
    # One row per id of the vocabulary at most.
    seen = {r[0]: r[1] for r in table.filter("token IS NOT NULL").groupBy("token").agg(F.sum("seen")).collect()}
    frequency = np.zeros(max(seen, default=0) + 1)
    frequency[list(seen)] = list(seen.values())
    idf = docs.sparkSession.sparkContext.broadcast(np.log1p((n - frequency + 0.5) / (frequency + 0.5)))
    mean = float(tokens or 0) / max(n, 1)
    key_type = source.schema["key"].dataType.simpleString()

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(size=frame["ids"].map(len))
        frame = frame.sort_values(["key", "size", "ids"]).reset_index(drop=True)
        keys, sequence = frame["key"], int(frame["shard"].iloc[0]) << 32
        docs = [np.frombuffer(x, "<u4") for x in frame["ids"]]
        cuts = [[(i, at, at + WINDOW)] for i, d in enumerate(docs) for at in range(0, len(d) - WINDOW + 1, WINDOW)]
        rows = []
        for window in cuts + pack_shard(docs, idf.value, mean):
            offset = 0
            for doc, a, b in window:
                rows.append((keys.iloc[doc], a, b - a, zlib.crc32(docs[doc][a:b]), len(docs[doc]), sequence, offset))
                offset += b - a
            sequence += 1
        out = pd.DataFrame(rows, columns=columns)
        return out.astype({"key": frame["key"].dtype})

    columns = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return (
        table.filter("ids IS NOT NULL").select("key", "shard", "ids").groupBy("shard")
        .applyInPandas(pack, f"key {key_type}, start long, length long, ids_crc32 long, doc_tokens long, "
                       "sequence_id long, offset long")
        .withColumnRenamed("key", key)
    )
