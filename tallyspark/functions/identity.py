"""Pseudonymous identifiers: HMAC-SHA-256 in base64url without padding, behind a typed prefix.

`derive` hands the key to Python workers only, so it never shows in a plan. `derive_inline` stays in the JVM but
leaves the key in the plan: for test keys.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import secrets

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST_KEY_BYTES = 32
# Fixed values: (prefix, domain, digest bytes) of each identifier.
KINDS = {
    "project": ("prj_h1_", "project:v1:", 32),
    "thread": ("thr_h1_", "thread:v1:", 32),
    "turn": ("turn_h1_", "turn:v1:", 32),
    "source": ("src_h1_", "usage:v1:", 32),
    "source_fallback": ("src_h1_", "usage-fallback:v1:", 32),
    "usage_event": ("evt_h1_", "event:v1:", 32),
    "mapping_event": ("map_h1_", "mapping-event:v1:", 32),
    "key": ("key_h1_", "", 16),
}


class IdentifierError(ValueError):
    pass


def new_key(length: int = LEAST_KEY_BYTES) -> bytes:
    if isinstance(length, bool) or length < LEAST_KEY_BYTES:
        raise IdentifierError(f"keys have {LEAST_KEY_BYTES} bytes at least")
    return secrets.token_bytes(length)


def checked(key: bytes) -> bytes:
    if not isinstance(key, bytes) or len(key) < LEAST_KEY_BYTES:
        raise IdentifierError(f"keys have {LEAST_KEY_BYTES} bytes at least")
    return key


def derive_one(key: bytes, kind: str, value: str) -> str:
    prefix, domain, size = KINDS[kind]
    if not value or value != value.strip():
        raise IdentifierError("values are not empty and have no outer spaces")
    digest = hmac.digest(checked(key), (domain + value).encode(), "sha256")[:size]
    return prefix + base64.urlsafe_b64encode(digest).rstrip(b"=").decode()


def key_id(key: bytes) -> str:
    return derive_one(key, "key", "key-id:v1")


def derive(key: bytes, kind: str, value: Column) -> Column:
    """Identifier of each value; null stays null."""
    checked(key)

    def run(values: pd.Series) -> pd.Series:
        seen: dict[str, str] = {}
        for v in values.dropna().unique():
            seen[v] = derive_one(key, kind, v)
        return values.map(seen).astype(object).where(values.notna(), None)

    return F.pandas_udf(run, "string")(value)


def derive_inline(key: bytes, kind: str, value: Column) -> Column:
    """The same from nested sha2 over the padded key."""
    prefix, domain, size = KINDS[kind]
    block = (hashlib.sha256(checked(key)).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda x: F.lit(bytearray(b ^ x for b in block))
    message = F.concat(F.lit(domain), value).cast("binary")
    inner = F.unhex(F.sha2(F.concat(pad(0x36), message), 256))
    digest = F.substring(F.unhex(F.sha2(F.concat(pad(0x5C), inner), 256)), 1, size)
    return F.concat(F.lit(prefix), F.rtrim(F.translate(F.base64(digest), "+/", "-_"), F.lit("=")))


def opaque_or_derived(value: Column, kind: str, derived: Column) -> Column:
    """Values that are identifiers of this kind already stay; others that only look so give null."""
    prefix, _, size = KINDS[kind]
    n = -(-size * 8 // 6)
    return F.when(value.rlike(f"^{prefix}[A-Za-z0-9_-]{{{n}}}$"), value).when(~F.startswith(value, F.lit(prefix)), derived)


def is_identifier(value: Column, prefix: str) -> Column:
    return value.rlike(f"^{prefix}[A-Za-z0-9_-]{{{22 if prefix == 'key_h1_' else 43}}}$")
