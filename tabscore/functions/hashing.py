"""Repeatable per-row hashing for sampling and splitting.

The value is the first 32 bits of the md5 of the key columns rendered as
strings, together with a seed.  Each part carries its length and NULL has a
mark of its own, so that different keys never make one text (``a|b, c`` and
``a, b|c``; NULL and the empty text).  It depends only on the
row's key, never on partitioning or row order, and DuckDB computes the same
number with ``('0x' || substr(md5(...), 1, 8))::BIGINT``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0
#: What a NULL key part is in the hashed text; no other part looks like it (those start with their length).
NULL_PART = "~"


def _as_cols(keys: str | Column | Sequence[str | Column]) -> list[Column]:
    if isinstance(keys, (str, Column)):
        keys = [keys]
    return [F.col(k) if isinstance(k, str) else k for k in keys]


ALGORITHMS = ("md5", "xxhash64")


def hash32(keys, seed: str | int | None = None, algorithm: str = "md5") -> Column:
    """Unsigned 32-bit hash of the key columns (bigint in [0, 2^32)).

    ``md5`` (the default) is portable: DuckDB and other engines compute the
    same value from the same text.  ``xxhash64`` is Spark's native hash,
    several times cheaper per row; it takes the upper 32 bits of
    ``xxhash64(keys..., seed)`` and is repeatable across Spark runs and
    cluster sizes, but only Spark computes it.
    """
    if algorithm == "xxhash64":
        cols = list(_as_cols(keys))
        if seed is not None:
            cols.append(F.lit(str(seed)))
        return F.shiftrightunsigned(F.xxhash64(*cols), 32)
    if algorithm != "md5":
        raise ValueError(f"algorithm must be one of {ALGORITHMS}")
    parts = [c.cast("string") for c in _as_cols(keys)]
    parts = [F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit(NULL_PART)) for p in parts]
    text = F.concat(*parts, F.lit("" if seed is None else f"|{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def unit_hash(keys, seed: str | int | None = None, algorithm: str = "md5") -> Column:
    """The hash mapped to [0, 1) as a double (exact: a 32-bit integer over 2^32)."""
    return hash32(keys, seed, algorithm) / F.lit(TWO_POW_32)


def sql_hash32(keys: Sequence[str], seed: str | int | None = None) -> str:
    """DuckDB text of :func:`hash32` (used by the oracle queries and tests)."""
    return f"CAST(('0x' || substr(md5({sql_key_text(keys, seed, 'VARCHAR')}), 1, 8)) AS BIGINT)"


def sql_key_text(keys: Sequence[str], seed: str | int | None = None, string_type: str = "STRING",
                 seed_text: str | None = None) -> str:
    """SQL of the text that is hashed (``seed_text``: an expression in place of the literal seed)."""
    parts = []
    for k in keys:
        text = f"CAST({k} AS {string_type})"
        # || gives NULL for a NULL, in Spark and DuckDB alike (concat does not in DuckDB)
        parts.append(f"coalesce(CAST(length({text}) AS {string_type}) || ':' || {text}, '{NULL_PART}')")
    if seed is not None:
        parts += ["'|'", seed_text or f"'{seed}'"]
    return f"({' || '.join(parts)})"
