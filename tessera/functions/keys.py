"""Key and hash expressions (PR1, FX3, FX4, portable hashes).

All hashes are engine-portable (md5/sha2 hex and integer arithmetic), never
``hash``/``xxhash64``, so a DuckDB oracle can recompute them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise_key(c: Column | str) -> Column:
    """PR1: ``'01349'`` == ``' 1349 '`` == 1349; unparsable -> NULL (caller drops)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(c.cast("string")).try_cast("bigint")


def identity_key(text: Column | str) -> Column:
    """FX4: canonical identity of a text: sha256 of lower(trim(text))."""
    t = F.col(text) if isinstance(text, str) else text
    return F.sha2(F.lower(F.trim(t)), 256)


def loose_identity_key(text: Column | str) -> Column:
    """FX4, second level ("stereo-free"): also collapses runs of whitespace."""
    t = F.col(text) if isinstance(text, str) else text
    return F.sha2(F.regexp_replace(F.lower(F.trim(t)), r"\s+", " "), 256)


def group_key(core: Column | str, identity: Column | str) -> Column:
    """FX3: the core structure is the group; an empty core is its own group."""
    core = F.col(core) if isinstance(core, str) else core
    identity = F.col(identity) if isinstance(identity, str) else identity
    return F.coalesce(F.nullif(core, F.lit("")), identity)


def md5_int32(c: Column) -> Column:
    """First 8 hex digits of md5 as a non-negative BIGINT (portable)."""
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("bigint")


def mul_mod32(c: Column, factor: int) -> Column:
    """``(c * factor) % 2**32`` without overflowing 64-bit arithmetic.

    The factor is split in 16-bit halves so every intermediate stays < 2**49.
    """
    m = 4294967296
    a = F.pmod(c.cast("bigint"), F.lit(m))
    hi, lo = factor >> 16, factor & 0xFFFF
    return F.pmod(F.pmod(a * F.lit(hi), F.lit(m)) * F.lit(65536) + a * F.lit(lo), F.lit(m))
