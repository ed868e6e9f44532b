"""Suffix-array dedup: bytes of long strings that start at two places or more.

A 400-byte window is a suffix cut to 400 bytes. Windows that are equal pick the same anchor: the
smallest of the 100-byte hashes they hold (leftmost of equals). So every window belongs to one
anchor, and only anchors of one hash need to be compared. What an anchor's windows span is its
segment. Segments that occur twice as they are need no sorting. The different segments of one
hash are sorted, from the anchor onwards and backwards, by deep-shallow suffix sorting: multikey
quicksort to a shallow depth, then blind tries for the groups that still agree. Common prefixes
along the two sorted orders give, for each window, the class of its part right and left of the
anchor; a window whose two classes meet again elsewhere is repeated.

Windows may also be counted in words. Then a text is the sequence of 64-bit hashes of its words, an
anchor is half a window of words, and all else is the same.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftlens.llm.texts import U64, WordHashes, chunks, flat_bytes, mix, texts_of
from shiftlens.session import discard, materialize

#: Bytes hashed for an anchor, at most half of a window.
ANCHOR = 100
#: Segments sorted in one task, and the most of one hash; a hash with more is split by window.
SEGMENTS_TOGETHER, HOT_SEGMENTS = 10_000, 50_000
#: Depth in bytes, a multiple of 8, at which multikey quicksort hands over to blind tries.
SHALLOW = 32
#: Groups up to this size are ordered by a blind trie; it is built in passes of this many.
TRIE_GROUP = 2_000
#: Bytes of a word's hash.
WORD_BYTES = 8
#: UTF-8 bytes of the texts that a task works on at once, and the windows of a longer text that it looks
#: at together; finding anchors takes about a hundred times as much memory as either.
TEXT_BYTES, WINDOWS_TOGETHER = 1 << 20, 2 << 20
WORD = re.compile(rb"[^\x20\x09-\x0D]+")

FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)
_codes = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)


def _powers(base: int, n: int) -> np.ndarray:
    """Return base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, U64(base))
    out[:1] = 1
    return np.multiply.accumulate(out)


class RangeHash:
    """Hashes of any range of one array of bytes or words, from one running sum."""

    def __init__(self, data: np.ndarray) -> None:
        codes = _codes[data] if data.dtype == np.uint8 else mix(data) | U64(1)
        scaled = codes * _powers(INVERSE, len(data))
        self.sums = np.concatenate([np.zeros(1, U64), np.cumsum(scaled, dtype=U64)])
        self.scale = _powers(FACTOR, len(data) + 1)

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.scale[start])


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """Return the minimum of every ``width`` consecutive keys, in linear time."""
    n = len(keys) - width + 1
    full = -(-len(keys) // width) * width
    blocks = np.full(full, np.iinfo(np.uint64).max, U64)
    blocks[: len(keys)] = keys
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(
    data: np.ndarray, at: np.ndarray, window: int, size: int = ANCHOR, together: int = WINDOWS_TOGETHER
) -> dict[str, np.ndarray]:
    """Find the anchors, of ``size``, of all windows of several texts laid end to end.

    Returns text, hash, segment (a hash of the segment's contents), at (of the anchor in its text),
    low and high: the anchor's windows begin low .. high bytes (or words) ahead of it. Windows are
    looked at ``together`` at most, so memory is bounded however long a text is; an anchor whose
    windows are parted by that has a row for each part.
    """
    parts = [
        _anchors(data[start : start + together + window - 1], at - start, window, size)
        for start in range(0, max(1, len(data) - window + 1), together)
    ]
    return {k: np.concatenate([part[k] for part in parts]) for k in parts[0]}


def _anchors(data: np.ndarray, at: np.ndarray, window: int, size: int) -> dict[str, np.ndarray]:
    """Find the anchors of all windows of ``data``, of which texts may start ahead."""
    none = {k: np.zeros(0, np.int64) for k in ("text", "hash", "segment", "at", "low", "high")}
    if len(data) < window:
        return none
    hashed = RangeHash(data)
    grams = np.arange(len(data) - size + 1)
    key = hashed(grams, grams + size)
    # Equal high halves: the leftmost wins, which is the same choice in equal windows.
    least = window_minima((key & U64(0xFFFFFFFF00000000)) | grams.astype(U64), window - size + 1)
    anchor = (least & U64(0xFFFFFFFF)).astype(np.int64)
    text = np.searchsorted(at, np.arange(len(anchor)), side="right") - 1
    inside = np.arange(len(anchor)) + window <= at[text + 1]
    starts = np.flatnonzero(inside)
    if not len(starts):
        return none
    new = np.concatenate([[True], (np.diff(anchor[starts]) != 0) | (np.diff(starts) != 1)])
    first, last = starts[new], starts[np.concatenate([new[1:], [True]])]
    place = anchor[first]
    segment = mix(hashed(first, last + window) + (place - first).astype(U64))
    return {
        "text": text[first], "hash": key[place].view(np.int64), "segment": segment.view(np.int64),
        "at": place - at[text[first]], "low": place - last, "high": place - first,
    }


def flat_words(column: pa.Array, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Return the hashes of all words of a text column, and where each text starts and ends."""
    words = [hashes(text.split()) for text in texts_of(column)]
    return np.concatenate([*words, np.zeros(0, U64)]), np.cumsum([0, *map(len, words)])


def anchor_table(docs: DataFrame, window: int, words: bool = False) -> DataFrame:
    """Return the anchors of all texts: (uid, hash, segment, at, low, high)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in chunks(batches, most_bytes=TEXT_BYTES):
            column = batch.column("text")
            if words:
                found = anchors(*flat_words(column, hashes), window, window // 2)
            else:
                found = anchors(*flat_bytes(column), window)
            uid = batch.column("uid").take(pa.array(found.pop("text")))
            columns = [pa.array(found[k]) for k in ("hash", "segment")]
            columns += [pa.array(found[k].astype(np.int32)) for k in ("at", "low", "high")]
            yield pa.RecordBatch.from_arrays(
                [uid, *columns], names=["uid", "hash", "segment", "at", "low", "high"]
            )

    schema = "uid long, hash long, segment long, at int, low int, high int"
    return docs.select("uid", "text").mapInArrow(run, schema)


def blind_trie_order(rows: list[bytes]) -> list[int]:
    """Order byte strings of one length by a blind trie, which stores branching places only.

    A new string first goes down by its bytes at those places alone to some leaf; one comparison
    with that leaf shows where it leaves the trie. Equal strings share a leaf.
    """
    # A node is [depth, {byte: node}], a leaf a list of row numbers.
    root: list = [0]
    for i in range(1, len(rows)):
        row, node = rows[i], root
        while isinstance(node[-1], dict):
            node = node[1].get(row[node[0]]) or next(iter(node[1].values()))
        other = rows[node[0]]
        if row == other:
            node.append(i)
            continue
        low, high = 0, len(row)
        while high - low > 1:  # the longest common prefix, by halves
            half = (low + high) // 2
            low, high = (half, high) if row[:half] == other[:half] else (low, half)
        depth, parent, edge, node = low, None, None, root
        while isinstance(node[-1], dict) and node[0] < depth:
            parent, edge, node = node, row[node[0]], node[1][row[node[0]]]
        if isinstance(node[-1], dict) and node[0] == depth:
            node[1][row[depth]] = [i]
            continue
        branch = [depth, {other[depth]: node, row[depth]: [i]}]
        if parent is None:
            root = branch
        else:
            parent[1][edge] = branch
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node[-1], dict):
            stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
        else:
            order.extend(node)
    return order


def deep_shallow_order(table: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order the rows of a byte table by (group, bytes): multikey quicksort, then blind tries."""
    n, width = table.shape
    wide = np.zeros((n, -(-width // 8) * 8), np.uint8)
    wide[:, :width] = table
    words = wide.view(">u8")
    order = np.argsort(group, kind="stable")
    bounds = np.flatnonzero(np.diff(group[order])) + 1
    tied = np.split(order, bounds) if n else []
    place = np.concatenate([[0], bounds])
    tied = [(int(p), rows) for p, rows in zip(place, tied, strict=False) if len(rows) > 1]
    # Multikey: all tied groups of one depth are split by their next eight bytes at once.
    for depth in range(words.shape[1]):
        deep = depth * 8 >= SHALLOW
        if deep:
            small = [(p, rows) for p, rows in tied if len(rows) <= TRIE_GROUP]
            for p, rows in small:
                ranked = blind_trie_order([table[r].tobytes() for r in rows])
                order[p : p + len(rows)] = rows[ranked]
            tied = [(p, rows) for p, rows in tied if len(rows) > TRIE_GROUP]
        if not tied:
            break
        rows = np.concatenate([r for _, r in tied])
        sizes = np.array([len(r) for _, r in tied])
        label = np.repeat(np.arange(len(tied)), sizes)
        by = np.lexsort((words[rows, depth], label))
        rows, label = rows[by], label[by]
        places = np.concatenate([np.arange(p, p + len(r)) for p, r in tied])
        order[places] = rows
        value = words[rows, depth]
        cut = np.flatnonzero((np.diff(label) != 0) | (value[1:] != value[:-1])) + 1
        edges = np.concatenate([[0], cut, [len(rows)]])
        tied = [(int(places[a]), rows[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True) if b - a > 1]
    return order


def prefix_classes(table: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Return the sorted order and, along it, how many bytes each row shares with the one before."""
    order = deep_shallow_order(table, group)
    common = np.zeros(len(order), np.int64)
    for at in range(1, len(order), 4096):
        here, before = order[at : at + 4096], order[at - 1 : at + 4095][: len(order[at : at + 4096])]
        differ = table[here] != table[before]
        same = np.where(differ.any(axis=1), differ.argmax(axis=1), table.shape[1])
        common[at : at + 4096] = np.where(group[here] == group[before], same, -1)
    common[:1] = -1
    return order, common


def repeated_windows(
    left: np.ndarray, right: np.ndarray, group: np.ndarray, low: np.ndarray, high: np.ndarray,
    twice: np.ndarray, window: int, unit: int = 1,
) -> list[tuple[int, int, int]]:
    """Return (row, from, to): windows beginning from .. to bytes ahead of the anchor repeat.

    ``left`` holds the bytes before each anchor, nearest first, ``right`` those from it on; rows
    of ``twice`` stand for segments that occur more than once. ``unit`` is the bytes of what low,
    high and window count.
    """
    orders = [prefix_classes(left, group), prefix_classes(right, group)]
    marks = np.zeros((len(group), int(high.max()) + 2), bool)
    for ahead in range(int(low.min()), int(high.max()) + 1):
        rows = np.flatnonzero((low <= ahead) & (ahead <= high))
        if not len(rows):
            continue
        classes = []
        for (order, common), depth in zip(orders, (ahead, window - ahead), strict=True):
            label = np.empty(len(order), np.int64)
            label[order] = np.cumsum(common < depth * unit)
            classes.append(label[rows])
        both = classes[0] * (len(group) + 1) + classes[1]
        _, which, count = np.unique(both, return_inverse=True, return_counts=True)
        many = np.bincount(which, twice[rows], len(count)) > 0
        marks[rows, ahead] = (count[which] > 1) | many[which]
    edge = np.diff(np.pad(marks, ((0, 0), (1, 0))).astype(np.int8), axis=1)
    row, start = np.nonzero(edge == 1)
    _, stop = np.nonzero(edge == -1)
    return list(zip(row.tolist(), start.tolist(), (stop - 1).tolist(), strict=True))


def sort_shard(frame: pd.DataFrame, window: int, unit: int = 1) -> pd.DataFrame:
    """Compare the segments of one shard: (uid, start, stop) of the bytes or words that repeat."""
    high, low = frame["high"].to_numpy(), frame["low"].to_numpy()
    n = len(frame)
    left = np.zeros((n, max(1, int(high.max())), unit), np.uint8)
    right = np.zeros((n, window, unit), np.uint8)
    for i, (piece, ahead) in enumerate(zip(frame["bytes"], high, strict=True)):
        data = np.frombuffer(piece, np.uint8).reshape(-1, unit)
        left[i, :ahead] = data[:ahead][::-1]
        right[i, : min(window, len(data) - ahead)] = data[ahead : ahead + window]
    found = repeated_windows(
        left.reshape(n, -1), right.reshape(n, -1), frame["hash"].to_numpy(), low, high,
        frame["n"].to_numpy() > 1, window, unit,
    )
    rows = np.array(found, np.int64).reshape(-1, 3)
    at = frame["at"].to_numpy()[rows[:, 0]]
    return pd.DataFrame({
        "uid": frame["uid"].to_numpy()[rows[:, 0]],
        "start": (at - rows[:, 2]).astype(np.int64), "stop": (at - rows[:, 1] + window).astype(np.int64),
    })


def repeated_spans(docs: DataFrame, window: int, words: bool = False) -> DataFrame:
    """Return (uid, spans): the sorted spans of repeated bytes, or words, of docs that have any."""
    found = materialize(anchor_table(docs, window, words))
    segment = ["hash", "segment", "low", "high"]
    groups = (
        found.groupBy(*segment).agg(F.count("*").alias("n"), F.min(F.struct("uid", "at")).alias("one"))
    )
    alike = Window.partitionBy("hash")
    groups = groups.withColumns({"all": F.sum("n").over(alike), "kinds": F.count("*").over(alike)})
    groups = materialize(groups.filter("all > 1"))
    twice = groups.filter("n > 1")
    whole = found.join(twice.select(*segment), segment).select(
        "uid", (F.col("at") - F.col("high")).alias("start"),
        (F.col("at") - F.col("low") + window).alias("stop"),
    )
    mixed = groups.filter("kinds > 1").select(
        *segment, "one.uid", "one.at", "n", (F.col("kinds") > hot_segments(docs)).alias("hot")
    )
    shards = max(1, mixed.count() // SEGMENTS_TOGETHER)
    wanted = mixed.groupBy("uid").agg(
        F.collect_list(F.struct("hash", "at", "low", "high", "n", "hot")).alias("wanted")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cut the wanted segments out of the texts, hot ones window by window."""
        hashes = WordHashes()
        for batch in chunks(batches, most_bytes=TEXT_BYTES):
            out: list[tuple] = []
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for uid, text, items in zip(
                batch.column("uid").to_pylist(), texts, batch.column("wanted").to_pylist(), strict=True
            ):
                if words:
                    text = hashes(text.split()).tobytes()
                for x in items:
                    at, low, high = x["at"], x["low"], x["high"]
                    if not x["hot"]:
                        piece = text[(at - high) * unit : (at - low + window) * unit]
                        out.append((x["hash"], uid, at, low, high, x["n"], piece, False))
                        continue
                    for ahead in range(low, high + 1):
                        piece = text[(at - ahead) * unit : (at - ahead + window) * unit]
                        name = hashlib.blake2b(piece, digest_size=16).digest()
                        key = int.from_bytes(name[:8], "little", signed=True)
                        out.append((key, uid, at, ahead, ahead, x["n"], name, True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 8, types, strict=True)],
                names=["hash", "uid", "at", "low", "high", "n", "bytes", "single"],
            )

    unit = WORD_BYTES if words else 1
    types = [pa.int64(), pa.int64(), *[pa.int32()] * 3, pa.int64(), pa.binary(), pa.bool_()]
    pieces = docs.select("uid", "text").join(wanted, "uid").mapInArrow(
        cut, "hash long, uid long, at int, low int, high int, n long, bytes binary, single boolean"
    )
    pieces = materialize(pieces.dropDuplicates(["uid", "at", "low", "single"]))
    sorted_ = (
        pieces.filter("NOT single")
        .withColumn("shard", F.pmod(F.xxhash64("hash"), F.lit(shards)))
        .groupBy("shard")
        .applyInPandas(lambda frame: sort_shard(frame, window, unit), "uid long, start long, stop long")
    )
    single = pieces.filter("single")
    again = single.groupBy("hash", "bytes").agg(F.sum("n").alias("all")).filter("all > 1")
    singly = single.join(again.select("hash", "bytes"), ["hash", "bytes"]).select(
        "uid", (F.col("at") - F.col("high")).cast("long").alias("start"),
        (F.col("at") - F.col("high") + window).cast("long").alias("stop"),
    )
    spans = materialize(
        whole.select("uid", F.col("start").cast("long"), F.col("stop").cast("long"))
        .unionByName(sorted_).unionByName(singly)
        .groupBy("uid").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    )
    discard(found, groups, pieces)
    return spans


def hot_segments(docs: DataFrame) -> int:
    """Return the number of different segments above which a hash is split by window."""
    return int(docs.sparkSession.conf.get("spark.shiftlens.hotSegments", str(HOT_SEGMENTS)))


def kept_runs(size: int, spans: list | None) -> tuple[list[tuple[int, int]], int, int]:
    """Return the runs of bytes outside all spans, the bytes inside, and the merged spans."""
    runs, at, removed, count = [], 0, 0, 0
    last = -1
    for span in spans or []:
        start, stop = span["start"], span["stop"]
        if start > last:
            count += 1
            if start > at:
                runs.append((at, start))
        if stop > last:
            removed += stop - max(start, last if last > start else start)
            last = at = stop
    if at < size:
        runs.append((at, size))
    return runs, removed, count


def passages(body: bytes, word_spans: list | None) -> list[dict[str, int]]:
    """Return the maximal runs of words that the spans cover, as the bytes from first to last word."""
    if not word_spans:
        return []
    edges = [m.span() for m in WORD.finditer(body)]
    merged: list[list[int]] = []
    for span in word_spans:
        if merged and span["start"] <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], span["stop"])
        else:
            merged.append([span["start"], span["stop"]])
    return [{"start": edges[a][0], "stop": edges[b - 1][1]} for a, b in merged]


def spans_in_bytes(body: bytes, spans: list | None, word_spans: list | None) -> list:
    """Return the spans together, sorted, those of words as bytes."""
    found = [*(spans or []), *passages(body, word_spans)]
    return sorted(found, key=lambda span: (span["start"], span["stop"]))


def _prepared(docs: DataFrame, key: str, text: str, window: int, words: int | None = None) -> DataFrame:
    """Add uid, the text without null as ``body``, spans and, with ``words``, word_spans to the docs."""
    if window < 2 * ANCHOR:
        raise ValueError(f"window must be at least {2 * ANCHOR} bytes")
    body = F.coalesce(F.col(text), F.lit(""))
    source = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(F.col(key), body).alias("uid"),
                         body.alias("text"))
    rows = source.join(repeated_spans(source, window), "uid", "left")
    if words is None:
        return rows
    if words < 2:
        raise ValueError("words must be at least 2")
    found = repeated_spans(source, words, words=True).withColumnRenamed("spans", "word_spans")
    return rows.join(found, "uid", "left")


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 400, words: int | None = None
) -> DataFrame:
    """Remove every byte that a ``window``-byte string covers which starts elsewhere as well.

    Per row of ``docs``: key, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256
    (of the bytes left, end to end). Matches never cross documents; all are judged on the input.
    A null text is empty; a text under ``window`` bytes keeps all. Repeated rows are copies of
    each other, so they lose all that windows cover. Null keys are kept as they are. Any number
    of equal strings is handled: equal segments are counted, not listed, and a hash with very
    many different segments (``spark.shiftlens.hotSegments``) is compared window by window.

    With ``words`` two columns tell of passages that have fewer bytes: n_passages and passage_bytes,
    the maximal runs of words covered by that many words that start elsewhere as well (compared as
    words, whatever white space is between them). They are counted, not removed.
    """
    rows = _prepared(docs.select(F.col(key).alias("key"), F.col(text).alias("body")), "key", "body", window, words)
    told = [] if words is None else ["n_passages", "passage_bytes"]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, most_bytes=TEXT_BYTES):
            out = []
            data = batch.column("text").cast(pa.binary()).to_pylist()
            by_words = batch.column("word_spans").to_pylist() if told else [None] * len(data)
            for body, spans, word_spans in zip(data, batch.column("spans").to_pylist(), by_words, strict=True):
                runs, removed, count = kept_runs(len(body), spans)
                left = b"".join(body[a:b] for a, b in runs)
                row = [len(body), removed, count, hashlib.sha256(left).hexdigest()]
                if told:
                    found = passages(body, word_spans)
                    row += [len(found), sum(x["stop"] - x["start"] for x in found)]
                out.append(row)
            kinds = [*[pa.int64()] * 3, pa.string(), *[pa.int64()] * len(told)]
            columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=names
            )

    names = ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", *told]
    schema = f"key {docs.schema[key].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema += "".join(f", {c} long" for c in told)
    columns = ["row.key", "text", "spans", *(["word_spans"] if told else [])]
    return rows.select(*columns).mapInArrow(finish, schema).withColumnRenamed("key", key)


def cut_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 400, words: int | None = None
) -> DataFrame:
    """Return ``docs`` with the bytes that ``remove_repeats`` removes cut out of the texts.

    With ``words``, runs of that many words that start elsewhere as well are cut too, however few
    bytes they have and whatever white space is between them. All columns stay; ``n_chars``, if
    there is one, follows the text. Of a character that is cut in two nothing is left. A null text
    comes back empty.
    """
    rows = _prepared(docs, key, text, window, words)
    if words is None:
        rows = rows.withColumn("word_spans", F.lit(None).cast(rows.schema["spans"].dataType))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, most_bytes=TEXT_BYTES):
            out = []
            data = batch.column("text").cast(pa.binary()).to_pylist()
            found = (batch.column(c).to_pylist() for c in ("spans", "word_spans"))
            for body, *spans in zip(data, *found, strict=True):
                runs = kept_runs(len(body), spans_in_bytes(body, *spans))[0]
                out.append(b"".join(body[a:b] for a, b in runs).decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(out, pa.string())], names=["row", "kept"]
            )

    kind = rows.schema["row"].dataType.simpleString()
    done = rows.select("row", "text", "spans", "word_spans").mapInArrow(cut, f"row {kind}, kept string")
    columns = {text: F.col("kept")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return done.select(*[columns.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
