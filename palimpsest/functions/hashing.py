"""Stable buckets and time-ordered identifiers."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let


def bucket10(text: Column) -> Column:
    """The SHA-256 of a text, as a number, modulo 10.

    16 to any power from 1 up is 6 modulo 10, so it is the last digit plus six times the sum of the others.
    """
    value = lambda c: F.conv(c, 16, 10).cast("int")
    total = lambda h: F.aggregate(F.regexp_extract_all(h, F.lit("."), F.lit(0)), F.lit(0), lambda a, c: a + value(c))
    return let(F.sha2(text, 256), lambda h: F.pmod(6 * total(h) - 5 * value(F.right(h, F.lit(1))), F.lit(10)))


def uuid7(ts: Column) -> Column:
    """A version 7 identifier: 48 bits of milliseconds, then random bits of a version 4 one."""
    ms = F.lpad(F.lower(F.hex(F.unix_millis(ts.cast("timestamp")))), 12, "0")
    rest = F.replace(F.uuid(), F.lit("-"), F.lit(""))
    variant = F.substring(rest, 17, 16)
    return F.concat_ws("-", F.substring(ms, 1, 8), F.substring(ms, 9, 4), F.concat(F.lit("7"), F.substring(rest, 14, 3)), F.substring(variant, 1, 4), F.substring(variant, 5, 12))


def unit(*cols: Column, seed: str) -> Column:
    """A number in [0, 1) with 52 bits, from the MD5 of the columns' text: the same in every run and partitioning."""
    text = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("~")) for c in cols], F.lit(seed))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def padded_keys(key: str | bytes) -> tuple[bytes, bytes]:
    """The inner and the outer key of an HMAC over SHA-256: longer keys than a block are hashed, all are filled up to it."""
    raw = key.encode() if isinstance(key, str) else key
    block = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def hmac256(text: Column, key: str | bytes) -> Column:
    """HMAC-SHA256 of a text's UTF-8, in lowercase hex; null for null."""
    inner, outer = (F.lit(bytearray(k)) for k in padded_keys(key))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(text, "UTF-8")), 256))), 256)


def anonymised(user: Column, key: str | bytes, key_id: str) -> Column:
    """``anon:`` with half of a user's HMAC and the key's id, so that keys can change."""
    return F.concat_ws(":", F.lit("anon"), F.substring(hmac256(user, key), 1, 32), F.lit(key_id))


def is_anonymised(name: Column, user: Column, keys: dict[str, str | bytes]) -> Column:
    """Whether a name stands for a user under the key that it names; false for keys that aren't known."""
    out = F.lit(False)
    for key_id, key in keys.items():
        out = out | (name == anonymised(user, key, key_id))
    return F.coalesce(out, F.lit(False))
