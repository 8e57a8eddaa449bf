"""Canonical JSON and its digests: sorted keys, no white space, ASCII escapes."""

from __future__ import annotations

import hashlib
import hmac
import json
import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SIDECAR_FIELD = "integrity"


def safe(value: object) -> object:
    """value with non-finite numbers as tagged objects."""
    if isinstance(value, float) and not math.isfinite(value):
        return {"nonfinite": str(value)}
    if isinstance(value, dict):
        return {k: safe(v) for k, v in value.items()}
    return [safe(v) for v in value] if isinstance(value, list) else value


def canonical(value: object) -> str:
    return json.dumps(safe(value), sort_keys=True, separators=(",", ":"))


def body_digest(line: str | None) -> str | None:
    """The digest of a record without its sidecar; null for what is no object."""
    try:
        record = json.loads(line or "")
    except ValueError:
        return None
    if not isinstance(record, dict):
        return None
    record.pop(SIDECAR_FIELD, None)
    return hashlib.sha256(canonical(record).encode()).hexdigest()


@F.pandas_udf(StringType())
def body_digests(line: pd.Series) -> pd.Series:
    return line.map(body_digest)


def keyed_scope(secret: bytes):
    """A column function: the first 32 hex digits of an HMAC of a scope."""

    @F.pandas_udf(StringType())
    def scope(value: pd.Series) -> pd.Series:
        return value.map(lambda v: None if v is None else hmac.new(secret, v.encode(), hashlib.sha256).hexdigest()[:32])

    return scope
