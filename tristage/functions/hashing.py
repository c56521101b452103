"""Portable deterministic hashing: the first eight bytes of SHA-256, as any engine computes them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TWO64 = 18446744073709551616.0


def hash64(text: Column) -> Column:
    """Unsigned 64-bit value as decimal(20,0)."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def uniform(text: Column) -> Column:
    """A value in [0, 1) fixed by the text."""
    return hash64(text).cast("double") / F.lit(TWO64)


def modulo(text: Column, k: int | Column) -> Column:
    k = F.lit(k) if isinstance(k, int) else k
    return F.pmod(hash64(text), k.cast("decimal(20,0)")).cast("long")


def keyed(*parts: Column | str | int) -> Column:
    """``a:b:c`` of literals and columns, the text that is hashed."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws(":", *[c.cast("string") for c in cols])


def kfold_of(group: Column, seed: int, k: int) -> Column:
    return modulo(keyed(seed, "cv", group), k).cast("int")
