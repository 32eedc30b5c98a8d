"""Digests, subresource integrity and HMAC by the engine's own functions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(content: Column) -> Column:
    """SHA-256 in hex."""
    return F.sha2(content, 256)


def sri(content: Column) -> Column:
    """sha512-<base64>, as package metadata gives it."""
    return F.concat(F.lit("sha512-"), F.regexp_replace(F.base64(F.unhex(F.sha2(content, 512))), "[\r\n]", ""))


def integrity(content: Column, shasum: Column, declared: Column) -> Column:
    """P12: '' if the content fits its declarations, else what does not.

    SHA-1 is compared without case; of the integrity string only sha512 is checked, one without an
    algorithm is malformed.
    """
    wrong_sha = (F.coalesce(shasum, F.lit("")) != "") & (F.lower(shasum) != F.sha1(content))
    has = F.coalesce(declared, F.lit("")) != ""
    return (
        F.when(wrong_sha, F.lit("shasum mismatch"))
        .when(has & ~declared.contains("-"), F.lit("malformed integrity"))
        .when(has & declared.startswith("sha512-") & (declared != sri(content)), F.lit("integrity mismatch"))
        .otherwise(F.lit(""))
    )


def hmac_sha256(message: Column, secret: str) -> Column:
    """K3: HMAC-SHA256 in hex."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in key).hex()))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(message, "utf-8")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)
