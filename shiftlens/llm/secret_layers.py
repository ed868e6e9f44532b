"""Secret scans with a recursive decoding worklist.

A text is the first layer. Each layer is scanned by the same patterns and unwrapped further: URL
and Unicode escapes are replaced in place, base64 runs and compressed blobs become layers of their
own. What comes out goes to the worklist until nothing new does. A layer that has been seen at
the same place of the text is not taken again, which also ends cycles (blobs that unpack to
themselves). Every layer knows how its bytes map to its parent's, so spans found at any depth are
told as spans of the text. All work is local to a row.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlens.llm.texts import chunks, same_rows, texts_of

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    rb"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
#: One of these is in every text that ``ASSIGN`` matches (after A-Z are lower case).
ASSIGN_HINTS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18

PERCENT = re.compile(rb"%([0-9A-Fa-f]{2})")
UNICODE = re.compile(
    rb"\\u([Dd][89ABab][0-9A-Fa-f]{2})\\u([Dd][C-Fc-f][0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})|\\u\{([0-9A-Fa-f]{1,6})\}"
    rb"|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});"
)
#: A base64 run, also one broken into lines as mail and key files do.
BASE64 = re.compile(rb"(?:[A-Za-z0-9+/]{60,76}\r?\n)*[A-Za-z0-9+/_-]{16,}={0,2}")
#: Share of a decoded base64 run's characters that must be printable for it to be a text.
PRINTABLE = 0.95
#: Bytes that the compressed blobs of one text may unpack to in all; what is beyond is counted in
#: ``unread``, never left out silently.
MOST_UNPACKED = 64 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_PLAIN = bytes([9, 10, 13, *range(32, 127)])


class Layer:
    """Bytes, what they were unwrapped from, and how a span of them maps to the parent's bytes."""

    def __init__(self, data: bytes, parent: Layer | None = None, kind: str = "", back: Callable | None = None):
        self.data, self.parent, self.back = data, parent, back
        self.path = f"{parent.path}>{kind}".strip(">") if parent else ""

    def span(self, start: int, stop: int) -> tuple[int, int]:
        """Return the span of the text that a span of this layer came from."""
        layer = self
        while layer.parent is not None:
            start, stop = layer.back(start, stop)
            layer = layer.parent
        return start, stop


def scan(data: bytes) -> Iterator[tuple[str, int, int]]:
    """Yield kind, start and end of the secrets in one layer."""
    lower = data.translate(_LOWER)
    if any(hint in lower for hint in ASSIGN_HINTS):
        for m in ASSIGN.finditer(data):
            if len(m[2]) >= LEAST_ASSIGN:
                yield "assign", m.start(), m.end()
    if b"AKIA" in data:
        for m in ACCESS.finditer(data):
            if m.end() - m.start() >= LEAST_ACCESS:
                yield "access", m.start(), m.end()
    for m in HEX.finditer(data):
        yield "hex", m.start(), m.end()


def replaced(layer: Layer, kind: str, pattern: re.Pattern, value: Callable[[re.Match], bytes]) -> Layer | None:
    """Replace all escapes of a layer; None where there are none."""
    begin, end, out, pieces, at, size = [], [], [], [], 0, 0
    for m in pattern.finditer(layer.data):
        new = value(m)
        plain = layer.data[at : m.start()]
        begin.append(m.start())
        end.append(m.end())
        out.append((size + len(plain), size + len(plain) + len(new)))
        pieces += [plain, new]
        size, at = out[-1][1], m.end()
    if not begin:
        return None
    first, last = np.array(out, np.int64).T

    def back(start: int, stop: int) -> tuple[int, int]:
        i = int(np.searchsorted(first, start, side="right")) - 1
        j = int(np.searchsorted(first, stop - 1, side="right")) - 1
        if i >= 0:
            start = begin[i] if start < last[i] else end[i] + start - int(last[i])
        if j >= 0:
            stop = end[j] if stop <= last[j] else end[j] + stop - int(last[j])
        return start, stop

    return Layer(b"".join([*pieces, layer.data[at:]]), layer, kind, back)


def character(m: re.Match) -> bytes:
    """Return the UTF-8 bytes of one Unicode escape; what is no character becomes U+FFFD."""
    if m[1]:
        code = 0x10000 + ((int(m[1], 16) - 0xD800) << 10) + int(m[2], 16) - 0xDC00
    else:
        digits = next(g for g in m.groups()[2:] if g)
        code = int(digits, 10 if m[8] else 16)
    if code > 0x10FFFF or 0xD800 <= code < 0xE000:
        code = 0xFFFD
    return chr(code).encode()


def readable(data: bytes) -> bool:
    """Check that bytes are a text rather than a chance decoding of a long word."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return False
    odd = sum(not (c.isprintable() or c in "\t\r\n") for c in text) if data.translate(None, _PLAIN) else 0
    return bool(text) and odd <= (1 - PRINTABLE) * len(text)


def packed(data: bytes) -> str | None:
    """Name the compression that bytes begin like."""
    if data[:2] == b"\x1f\x8b":
        return "gzip"
    if data[:3] == b"BZh":
        return "bzip2"
    if data[:6] == b"\xfd7zXZ\x00":
        return "xz"
    if len(data) > 2 and data[0] & 0x0F == 8 and data[0] >> 4 <= 7 and (data[0] * 256 + data[1]) % 31 == 0:
        return "zlib"
    return None


def unpack(data: bytes, kind: str, most: int) -> tuple[bytes, bool]:
    """Return what a blob unpacks to, up to ``most`` bytes, and whether that is all of it."""
    makers = {
        "gzip": lambda: zlib.decompressobj(31), "zlib": zlib.decompressobj,
        "bzip2": bz2.BZ2Decompressor, "xz": lzma.LZMADecompressor,
    }
    tool = makers[kind]()
    try:
        out = tool.decompress(data, max(1, most))
    except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
        return b"", True
    rest = getattr(tool, "unconsumed_tail", b"") or not getattr(tool, "needs_input", True)
    return out, tool.eof or not rest


def base64_layers(layer: Layer) -> Iterator[Layer]:
    """Yield what the base64 runs of a layer hold, where that is text or a compressed blob."""
    for m in BASE64.finditer(layer.data):
        run = m[0].translate(None, b"\r\n")
        digits = run.rstrip(b"=").replace(b"-", b"+").replace(b"_", b"/")
        digits = digits[: len(digits) - (len(digits) % 4 == 1)]
        data = binascii.a2b_base64(digits + b"=" * (-len(digits) % 4))
        if not packed(data) and not readable(data):
            continue
        # Where each character of the run lies, line breaks left out.
        broken = np.flatnonzero(~np.isin(np.frombuffer(m[0], np.uint8), (10, 13))) if len(run) < len(m[0]) else None

        def back(start: int, stop: int, at=m.start(), size=len(run), broken=broken) -> tuple[int, int]:
            left, right = start // 3 * 4, min(size, -(-stop // 3) * 4)
            if broken is not None:
                left, right = int(broken[left]), int(broken[right - 1]) + 1
            return at + left, at + right

        yield Layer(data, layer, "base64", back)


def find_secrets(text: bytes, most_unpacked: int = MOST_UNPACKED) -> tuple[dict[tuple[str, int, int], str], int]:
    """Return the path of layers to each (kind, start, end) in bytes, and the blobs not read whole."""
    found: dict[tuple[str, int, int], str] = {}
    seen: set[tuple[bytes, int, int]] = set()
    unread, left = 0, most_unpacked
    work = deque([Layer(text)])
    while work:
        layer = work.popleft()
        if not layer.data:
            continue
        if layer.parent is not None:
            mark = (hashlib.blake2b(layer.data, digest_size=16).digest(), *layer.span(0, len(layer.data)))
            if mark in seen:
                continue
            seen.add(mark)
        for kind, start, stop in scan(layer.data):
            found.setdefault((kind, *layer.span(start, stop)), layer.path)
        method = packed(layer.data) if layer.parent is not None else None
        if method:
            data, whole = unpack(layer.data, method, left)
            left -= len(data)
            unread += not whole
            size = len(layer.data)
            work.append(Layer(data, layer, method, lambda start, stop, size=size: (0, size)))
        if b"%" in layer.data:
            work.append(replaced(layer, "url", PERCENT, lambda m: bytes([int(m[1], 16)])) or Layer(b""))
        if b"\\" in layer.data or b"&#" in layer.data:
            work.append(replaced(layer, "unicode", UNICODE, character) or Layer(b""))
        work.extend(base64_layers(layer))
    return found, unread


def points(text: bytes, offsets: list[int]) -> list[int]:
    """Turn byte offsets of a text into code points."""
    if text.isascii():
        return offsets
    # An offset inside a character (of a layer) counts the characters begun before it.
    before = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return before[offsets].tolist()


SPANS = "array<struct<kind: string, start: long, end: long, layers: string>>"


def secret_spans(
    docs: DataFrame, key: str = "doc_id", text: str = "text", *, most_unpacked: int = MOST_UNPACKED
) -> DataFrame:
    """Find the secrets of every text: one row per row of ``docs`` with the key, spans and unread.

    A span has kind, start and end (code points of the text, end exclusive) and layers, the way to
    it: empty where the text itself holds it, else like ``base64>gzip``. Spans are ordered by
    start and kind; one found on several ways is listed once, with the shortest. A span inside a
    blob that was unpacked covers the whole run of base64. ``unread`` counts blobs that unpack to
    more than is left of ``most_unpacked`` bytes a text; their beginning is scanned. A null or empty
    text has no spans. Null keys and repeated rows are scanned like others.
    """
    source = same_rows(docs, key, text)
    key_type = source.schema[key].dataType.simpleString()
    rank = {kind: i for i, kind in enumerate(KINDS)}
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("layers", pa.string())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text):
            spans, unread = [], []
            for value in texts_of(batch.column(text)):
                found, missed = find_secrets(value, most_unpacked)
                keys = list(found)
                starts, ends = (points(value, [k[i] for k in keys]) if keys else [] for i in (1, 2))
                rows: dict[tuple, str] = {}
                for k, start, end in zip(keys, starts, ends, strict=True):
                    rows.setdefault((start, rank[k[0]], end), found[k])
                spans.append([
                    {"kind": KINDS[k], "start": s, "end": e, "layers": rows[s, k, e]} for s, k, e in sorted(rows)
                ])
                unread.append(missed)
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(spans, pa.list_(item)), pa.array(unread, pa.int64())],
                names=[key, "spans", "unread"],
            )

    return source.mapInArrow(judge, f"`{key}` {key_type}, spans {SPANS}, unread long")


def digest_spans(found: DataFrame) -> DataFrame:
    """Give the spans of ``secret_spans`` as counts, joined strings and a hash."""
    joined = "array_join(transform({}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    base = "filter(spans, s -> s.layers = '')"
    count = "CAST(size(filter(spans, s -> s.layers {} AND s.kind = '{}')) AS LONG)"
    return found.withColumns(
        {f"n_{kind}": F.expr(count.format("= ''", kind)) for kind in KINDS}
        | {"base_sha256": F.sha2(F.expr(joined.format(base)).cast("binary"), 256)}
        | {"n_decoded": F.expr("CAST(size(filter(spans, s -> s.layers <> '')) AS LONG)")}
        | {"spans": F.expr(joined.format("spans"))}
    ).select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_decoded", "unread")
