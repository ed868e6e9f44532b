"""Digests of canonical JSON payloads."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _digest_any(payload: Column) -> Column:
    """Digest any JSON text in Python; self-contained, so executors need no extra package."""

    def digest(text: str | None) -> str | None:
        if text is None:
            return None
        canonical = json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"))
        return hashlib.sha256(canonical.encode()).hexdigest()

    def digests(texts: pd.Series) -> pd.Series:
        return texts.map(digest)

    return F.pandas_udf(digests, T.StringType())(payload)


def canonical_json(fields: Mapping[str, Column]) -> Column:
    """Render flat fields as JSON with sorted keys, no blanks and nulls kept."""
    ordered = F.struct(*[fields[name].alias(name) for name in sorted(fields)])
    return F.to_json(ordered, {"ignoreNullFields": "false"})


def canonical_digest(payload: Column) -> Column:
    """Return the SHA-256 of a JSON text in canonical form.

    ``payload`` has sorted keys already. Printable ASCII is hashed in the JVM; only texts that
    need escaping travel to Python.
    """
    plain = payload.rlike(r"^[ -~]*$")
    return F.coalesce(F.when(plain, F.sha2(payload, 256)), _digest_any(F.when(~plain, payload)))


def config_digest(config: Mapping) -> str:
    """Return the SHA-256 of a configuration, whatever the order of its keys."""
    canonical = json.dumps(config, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(canonical.encode()).hexdigest()


def raw_json_digest(payload: Column) -> Column:
    """Return the SHA-256 of any JSON text after sorting its keys."""
    return _digest_any(payload)
