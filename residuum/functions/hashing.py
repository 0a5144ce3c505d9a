"""Seeded, engine-independent pseudo-randomness.

Every "random" choice in the package is a function of ``md5(seed ':' key)``.
The digest is the same in Spark and in any SQL engine with ``md5``, so a
shuffle, a sample or a split is reproducible across runs, retries and
engines (the SQL oracles use the same expression).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rank_key(seed, *cols) -> Column:
    """Hex digest ``md5(seed ':' c1 ':' c2 ...)``; sorts as a uniform key."""
    parts = [F.lit(str(seed))]
    for c in cols:
        parts += [F.lit(":"), _as_col(c).cast("string")]
    return F.md5(F.concat(*parts))


def hex_prefix_int(hex_col: Column, n_hex: int = 8) -> Column:
    """First ``n_hex`` hex digits of a digest as a non-negative BIGINT."""
    return F.conv(F.substring(hex_col, 1, n_hex), 16, 10).cast("bigint")


def draw_int(seed, modulus: int, *cols) -> Column:
    """Uniform-ish integer in ``[0, modulus)`` from the digest of the key."""
    return hex_prefix_int(rank_key(seed, *cols)) % F.lit(modulus)


def draw_unit(seed, *cols) -> Column:
    """Uniform double in ``[0, 1)`` from the first 8 hex digits."""
    return hex_prefix_int(rank_key(seed, *cols)).cast("double") / F.lit(4294967296.0)


def hash_bucket(hex_col: Column, n_hex: int = 4) -> Column:
    """Order-preserving bucket of a hex key: its first ``n_hex`` digits.

    Buckets partition the key space into 16**n_hex equal ranges, so ranks
    and running sums can be computed per bucket in parallel and stitched
    with per-bucket offsets.
    """
    return F.substring(hex_col, 1, n_hex)
