"""Stable identities, hash orders and hash draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def stable_id(*parts: Column | str, length: int = 20) -> Column:
    """Hash pipe-joined identity fields to a short hexadecimal id."""
    joined = F.concat_ws("|", *[_col(part).cast("string") for part in parts])
    return F.substring(F.sha2(joined, 256), 1, length)


def hash_order(seed: int | str | Column, key: Column | str) -> Column:
    """Return an outcome-independent uniform order key for a row."""
    prefix = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.sha2(F.concat_ws("|", prefix.cast("string"), _col(key).cast("string")), 256)


def hash_draw(seed: int | Column, replicate: Column, slot: Column, size: Column) -> Column:
    """Draw an index in ``[0, size)`` from the hash of (seed, replicate, slot).

    60 bits of the hash are used, so every slot of any table can be drawn, and a table of 1e9
    slots draws each alike to within 1e-9.
    """
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    text = F.concat_ws("|", *[c.cast("string") for c in (seed, replicate, slot)])
    word = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")
    return F.pmod(word, size)
