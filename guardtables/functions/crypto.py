"""Keyed digests from built-in functions.

The padded keys become literals of the plan: read the key from a secret at run time
and do not print plans that contain it.
"""
from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

_SIZE = 64


def _pads(key: bytes) -> tuple[bytearray, bytearray]:
    if not isinstance(key, bytes) or not key:
        raise ValueError("the key must be nonempty bytes")
    if len(key) > _SIZE:
        key = hashlib.sha256(key).digest()
    key = key.ljust(_SIZE, b"\0")
    return bytearray(k ^ 0x36 for k in key), bytearray(k ^ 0x5C for k in key)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 of a text column as 64 hexadecimal characters."""
    inner, outer = _pads(key)
    first = F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)


def digest(message: Column, key: bytes | None = None) -> Column:
    """Keyed digest when a key is given, plain SHA-256 otherwise."""
    return hmac_sha256(key, message) if key else F.sha2(message, 256)
