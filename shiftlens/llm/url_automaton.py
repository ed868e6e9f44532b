"""URL filters by a bit-parallel wildcard automaton.

All glob rules are packed into multiword Shift-And masks: one bit per pattern position, 64 to a
word. Every canonical URL moves all patterns at once, and a batch of URLs moves in lockstep, one
character a step. ``*`` keeps its position alive on any character, ``?`` takes any one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shiftlens.llm.texts import U64, same_rows, texts_of

#: Stands between host and path in a canonical URL: a byte that no UTF-8 text holds.
BORDER = b"\xff"
#: URLs that move in lockstep.
LOCKSTEP = 4096


@dataclass(frozen=True)
class Rule:
    """A host (with its subdomains) and the start of a path, and what a match means."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def glob(self) -> bytes:
        """Return the rule as a glob over canonical URLs; its own ``*`` and ``?`` are literal."""
        literal = f".{self.host}".encode() + BORDER + self.path.encode()
        return b"*" + re.sub(rb"([*?\\])", rb"\\\1", literal) + b"*"


#: The rules of the query, longest match first wins.
RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)
#: Globs over ``.host`` that block a URL to which no rule applies.
BLOCKED_HOSTS = (
    "*ads-track*", "*adult-?*", "*casino*", "*cheap-*pills*", "*free-bets*", "*spam*",
)


class Automaton:
    """Shift-And over several globs at once; a backslash makes the next character literal."""

    def __init__(self, globs: list[bytes]) -> None:
        places: list[int] = []  # byte value of each position, -1: any
        loops: list[int] = []  # positions that stay alive on any byte
        first: list[int] = []
        self.last: list[int] = []
        for glob in globs:
            # A start position, reached before any byte, comes ahead of each pattern.
            first.append(len(places))
            places.append(-2)
            at = 0
            while at < len(glob):
                c = glob[at : at + 1]
                if c == b"*":
                    loops.append(len(places) - 1)
                elif c == b"?":
                    places.append(-1)
                else:
                    at += c == b"\\"
                    places.append(glob[at])
                at += 1
            self.last.append(len(places) - 1)
        self.words = max(1, -(-len(places) // 64))
        self.bytes = np.zeros((256, self.words), U64)
        for i, place in enumerate(places):
            if place != -2:
                rows = slice(None) if place == -1 else place
                self.bytes[rows, i // 64] |= U64(1) << U64(i % 64)
        self.loops, self.start = self._mask(loops), self._mask(first)

    def _mask(self, positions: list[int]) -> np.ndarray:
        mask = np.zeros(self.words, U64)
        for i in positions:
            mask[i // 64] |= U64(1) << U64(i % 64)
        return mask

    def matches(self, texts: list[bytes]) -> np.ndarray:
        """Return a table of booleans: texts by globs, each glob against the whole text."""
        out = np.zeros((len(texts), len(self.last)), bool)
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        for at in range(0, len(order), LOCKSTEP):
            block = order[at : at + LOCKSTEP]
            sizes = np.array([len(texts[i]) for i in block])
            offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            data = np.frombuffer(b"".join(texts[i] for i in block) + b"\0", np.uint8)
            state = np.repeat(self.start[None, :], len(block), axis=0)
            for step in range(int(sizes[0])):
                live = int(np.searchsorted(-sizes, -step, side="left"))  # texts longer than step
                old = state[:live]
                moved = old << U64(1)
                moved[:, 1:] |= old[:, :-1] >> U64(63)
                state[:live] = (moved & self.bytes[data[offsets[:live] + step]]) | (old & self.loops)
            for g, bit in enumerate(self.last):
                out[block, g] = (state[:, bit // 64] >> U64(bit % 64)) & U64(1) == 1
        return out


def host_and_path(url: bytes) -> tuple[bytes, bytes]:
    """Cut a URL into its host, A-Z lower-cased, and its path; both empty without ``://``."""
    _, found, rest = url.partition(b"://")
    if not found:
        return b"", b""
    host = re.match(rb"[^/?#]*", rest)[0]
    return host.lower(), re.match(rb"[^?#]*", rest[len(host) :])[0]


def filter_urls(
    pages: DataFrame,
    key: str = "page_id",
    url: str = "url",
    rules: tuple[Rule, ...] = RULES,
    blocked: tuple[str, ...] = BLOCKED_HOSTS,
) -> DataFrame:
    """Judge every URL: the key, host, path, rule and verdict, one row per row of ``pages``.

    The longest rule that fits decides and is named in ``rule``; of equally long ones the first
    given. Where none fits, ``rule`` is null and a glob of ``blocked`` over the host blocks.
    A null URL, or one without ``://``, has an empty host and path, fits no rule and is allowed.
    Repeated rows and null keys are judged alike. The work is local to a row.
    """
    ranked = sorted(rules, key=lambda r: -len(r.name))
    source = same_rows(pages, key, url)
    key_type = source.schema[key].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(
            [r.glob() for r in ranked] + [g.encode() + BORDER + b"*" for g in blocked]
        )
        for batch in batches:
            parts = [host_and_path(u) for u in texts_of(batch.column(url))]
            hits = automaton.matches([b"." + h + BORDER + p for h, p in parts])
            names, verdicts = [], []
            for row in hits:
                rule = next((r for r, hit in zip(ranked, row, strict=False) if hit), None)
                names.append(rule and rule.name)
                spam = "block" if row[len(ranked) :].any() else "allow"
                verdicts.append(rule.verdict if rule else spam)
            text = lambda values: pa.array(values, pa.binary()).cast(pa.string(), safe=False)
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), text([h for h, _ in parts]), text([p for _, p in parts]),
                 pa.array(names, pa.string()), pa.array(verdicts, pa.string())],
                names=[key, "host", "path", "rule", "verdict"],
            )

    schema = f"`{key}` {key_type}, host string, path string, rule string, verdict string"
    return source.mapInArrow(judge, schema)


#: The same rules in SQL, over the table pages.
SQL = r"""
WITH parts AS (
  SELECT page_id,
    CASE WHEN contains(url, '://') THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1)
      ELSE '' END AS path
  FROM pages),
rules(h, p, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fits AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM parts JOIN rules ON ('.' || host) LIKE ('%.' || h) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(fits.verdict,
  CASE WHEN regexp_matches(host, 'ads-track|adult-.|casino|cheap-.*pills|free-bets|spam')
    THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN fits USING (page_id)
"""
