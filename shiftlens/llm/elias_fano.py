"""Elias-Fano sequences and an n-gram trie over them, in flat buffers that can be memory-mapped."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_ONE, _BYTE = U64(1), 8


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Store the low ``width`` bits of each value end to end, with eight spare bytes."""
    if not width or not len(values):
        return np.zeros(_BYTE, np.uint8)
    total = len(values) * width
    out = np.zeros(-(-total // 64) + 2, U64)
    at = np.arange(len(values), dtype=np.int64) * width
    word, shift = at >> 6, (at & 63).astype(U64)
    np.bitwise_or.at(out, word, values << shift)
    over = (at & 63) + width > 64
    np.bitwise_or.at(out, word[over] + 1, values[over] >> (U64(64) - shift[over]))
    return out.view(np.uint8)


class EliasFano:
    """A non-decreasing sequence of 64-bit numbers: low bits packed, high bits in unary.

    ``parts`` are the arrays that make it up; they may be views of a memory-mapped file.
    """

    def __init__(self, n: int, low: int, lows: np.ndarray, highs: np.ndarray, ones: np.ndarray) -> None:
        self.n, self.low = n, low
        self.lows, self.highs, self.ones = lows, highs, ones
        self.windows = np.ndarray(max(0, len(lows) - 7), "<u8", np.ascontiguousarray(lows), 0, (1,))
        self.zeros = np.arange(len(ones), dtype=np.int64) * 64 - ones

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) if n else 0
        low = min(56, max(0, (top // max(n, 1)).bit_length() - 1))
        low = max(low, top.bit_length() - 40)  # keeps the unary part in proportion
        high = (values >> U64(low)).astype(np.int64)
        size = int(n + (high[-1] if n else 0) + 1)
        bits = np.zeros(-(-(size + 1) // 64) * 64, np.uint8)
        bits[high + np.arange(n)] = 1
        highs = np.packbits(bits, bitorder="little").view(U64)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(highs), dtype=np.int64)])
        mask = (_ONE << U64(low)) - _ONE
        return cls(n, low, pack_bits(values & mask, low), highs, ones)

    def parts(self) -> dict[str, np.ndarray]:
        return {"head": np.array([self.n, self.low]), "lows": self.lows, "highs": self.highs, "ones": self.ones}

    @classmethod
    def of(cls, parts: dict[str, np.ndarray]) -> EliasFano:
        return cls(int(parts["head"][0]), int(parts["head"][1]), parts["lows"], parts["highs"], parts["ones"])

    def _select(self, which: np.ndarray, before: np.ndarray, flip: bool) -> np.ndarray:
        """Return the places of the given set (or, flipped, unset) bits."""
        word = np.searchsorted(before, which, side="right") - 1
        bits = self.highs[word]
        bits = ~bits if flip else bits.copy()
        rest = which - before[word]
        place = np.zeros(len(which), np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count(bits & ((_ONE << U64(step)) - _ONE)).astype(np.int64)
            right = rest >= count
            rest -= np.where(right, count, 0)
            place += np.where(right, step, 0)
            bits = np.where(right, bits >> U64(step), bits)
        return word * 64 + place

    def lowest(self, i: np.ndarray) -> np.ndarray:
        """Return the packed low bits of the given elements."""
        if not self.low:
            return np.zeros(len(i), U64)
        at = i * self.low
        return (self.windows[at >> 3] >> (at & 7).astype(U64)) & ((_ONE << U64(self.low)) - _ONE)

    def access(self, i: np.ndarray) -> np.ndarray:
        """Return the given elements."""
        i = np.asarray(i, np.int64)
        high = (self._select(i, self.ones, False) - i).astype(U64)
        return (high << U64(self.low)) | self.lowest(i)

    def below(self, high: np.ndarray) -> np.ndarray:
        """Return how many elements have a smaller high part."""
        out = np.zeros(len(high), np.int64)
        some = high > 0
        last = int(self.zeros[-1]) - 1
        wanted = np.minimum(high[some] - 1, last)
        out[some] = np.minimum(self._select(wanted, self.zeros, True) - wanted, self.n)
        return out

    def successor(self, target: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Return the first place in start .. stop whose element is the target or more, else stop."""
        high = (target >> U64(self.low)).astype(np.int64)
        low_target = target & ((_ONE << U64(self.low)) - _ONE)
        left = np.clip(self.below(high), start, stop)
        right = np.clip(self.below(high + 1), start, stop)
        end = right.copy()
        open_ = np.flatnonzero(left < right)
        while len(open_):
            half = (left[open_] + right[open_]) >> 1
            less = self.lowest(half) < low_target[open_]
            left[open_[less]] = half[less] + 1
            right[open_[~less]] = half[~less]
            open_ = open_[left[open_] < right[open_]]
        return np.minimum(left, end)


class Trie:
    """Words and, below each, the contexts seen before it, with quantised log10 probabilities.

    A level is an Elias-Fano sequence of keys, one of pointers to the children of each node, and
    one byte per node: an index into the level's codebook. Keys below a node are made monotone
    over the whole level by adding the last stored key of the node before it, so a child is
    found by successor search relative to its context's own range. ``levels[0]`` has one range.
    """

    def __init__(self, levels: list[dict]) -> None:
        self.levels = levels

    @classmethod
    def build(cls, keys: list[np.ndarray], pointers: list[np.ndarray], logs: list[np.ndarray]) -> Trie:
        """Take per level the keys (sorted within a range), where each node's children begin (one
        more than nodes; none on the last level), and the log10 probabilities."""
        levels, starts = [], np.array([0, len(keys[0])])
        for depth, (key, log) in enumerate(zip(keys, logs, strict=True)):
            codes, book = quantise(log)
            level = {"keys": EliasFano.build(relative(key, starts)), "codes": codes, "book": book}
            if depth + 1 < len(keys):
                starts = pointers[depth]
                level["pointers"] = EliasFano.build(starts.astype(U64))
            levels.append(level)
        return cls(levels)

    def children(self, depth: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Return the range of children, on the next level, of nodes of this level."""
        pointers = self.levels[depth]["pointers"]
        return pointers.access(node).astype(np.int64), pointers.access(node + 1).astype(np.int64)

    def find(self, depth: int, key: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Return the nodes of these keys within ranges of a level, -1 where there is none."""
        sequence = self.levels[depth]["keys"]
        base = np.zeros(len(key), U64)
        later = start > 0
        base[later] = sequence.access(start[later] - 1) + _ONE
        goal = base + key
        fits = (goal >= base) & (start < stop)
        node = np.full(len(key), -1, np.int64)
        at = sequence.successor(goal[fits], start[fits], stop[fits])
        inside = at < stop[fits]
        same = np.zeros(len(at), bool)
        same[inside] = sequence.access(at[inside]) == goal[fits][inside]
        node[np.flatnonzero(fits)[same]] = at[same]
        return node

    def log10(self, depth: int, node: np.ndarray) -> np.ndarray:
        """Return the quantised log10 probabilities of nodes, -inf for -1."""
        level = self.levels[depth]
        if not len(level["codes"]):
            return np.full(len(node), -np.inf)
        return np.where(node < 0, -np.inf, level["book"][level["codes"][np.maximum(node, 0)]])

    def dump(self) -> bytes:
        """Lay all arrays out in one buffer: a count, then per array its type, size and bytes."""
        arrays: list[np.ndarray] = [np.array([len(self.levels)])]
        for level in self.levels:
            for name in ("keys", "pointers"):
                sequence = level.get(name) or EliasFano.build(np.zeros(0, U64))
                arrays += sequence.parts().values()
            arrays += [level["codes"], level["book"]]
        out = [np.array([len(arrays)]).tobytes()]
        for a in arrays:
            body = np.ascontiguousarray(a).tobytes()
            out.append(np.array([ord(a.dtype.char), len(body)]).tobytes() + body + bytes(-len(body) % 8))
        return b"".join(out)

    @classmethod
    def open(cls, data) -> Trie:
        """Read a dumped trie from bytes or a ``numpy.memmap`` without copying its arrays."""
        data = np.frombuffer(data, np.uint8)
        count, at = int(data[:8].view(np.int64)[0]), 8
        arrays = []
        for _ in range(count):
            kind, size = data[at : at + 16].view(np.int64).tolist()
            arrays.append(data[at + 16 : at + 16 + size].view(chr(kind)))
            at += 16 + size + -size % 8
        rest = iter(arrays)
        levels = []
        for _ in range(int(next(rest)[0])):
            level = {}
            for name in ("keys", "pointers"):
                level[name] = EliasFano.of({p: next(rest) for p in ("head", "lows", "highs", "ones")})
            level |= {"codes": next(rest), "book": next(rest)}
            levels.append(level)
        return cls(levels)


def relative(keys: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Add to the keys of each range the last key stored before it, plus one."""
    sizes = np.diff(starts)
    full = sizes > 0
    last = np.zeros(len(sizes), U64)
    last[full] = keys[starts[1:][full] - 1] + _ONE
    base = np.concatenate([np.zeros(1, U64), np.cumsum(last, dtype=U64)[:-1]]) if len(sizes) else last
    return keys + np.repeat(base, sizes)


def quantise(logs: np.ndarray, size: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Return one byte per value and the codebook: exact for few values, else means of bins."""
    values = np.unique(logs)
    if len(values) <= size:
        return np.searchsorted(values, logs).astype(np.uint8), values.astype(np.float32)
    # The most frequent values keep a code of their own; the rest share equally wide bins.
    values, count = np.unique(logs, return_counts=True)
    own = np.sort(values[np.argsort(-count, kind="stable")[: size // 2]])
    edges = np.linspace(values[0], values[-1], size - len(own) + 1)
    place = np.clip(np.searchsorted(edges, values, side="right") - 1, 0, len(edges) - 2)
    weight = np.bincount(place, count, len(edges) - 1)
    mean = np.bincount(place, count * values, len(edges) - 1) / np.maximum(weight, 1)
    code = place + len(own)
    kept = np.isin(values, own)
    code[kept] = np.searchsorted(own, values[kept])
    return code[np.searchsorted(values, logs)].astype(np.uint8), np.concatenate([own, mean]).astype(np.float32)
