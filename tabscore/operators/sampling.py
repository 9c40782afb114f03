"""Row sampling and train/validation splits that do not depend on partitioning.

* ``random_sample`` is the plain ``RAND() < f`` form (Bernoulli per row).
* ``keyed_sample`` keeps a row when the md5-based hash of its key falls under
  ``f``: one narrow pass, the same rows on every run, on every cluster size,
  and in DuckDB.
* ``split_approx`` is the keyed form used as a split (about ``f`` of the rows).
* ``split_exact`` puts exactly ``ceil(n * f)`` rows in the test side when the
  key is unique: the rows smallest by ``(hash, key)``.  A repeated key is
  never split across the sides; if the cut falls inside a repeated key, that
  key's rows all go to the test side.  The cut is found by counting the hash
  in two or three rounds of at most 2,048 bins, and both sides are then plain
  filters against two literals, so there is no global sort and no ``limit``
  over a large k.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscore.functions.hashing import TWO_POW_32, hash32
from tabscore.functions.naming import free_name

DEFAULT_SEED = 42


def random_sample(df: DataFrame, fraction: float, seed: int | None = None) -> DataFrame:
    """Bernoulli sample; fraction 1.0 keeps every row."""
    if fraction >= 1.0:
        return df
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)


def keyed_sample(df: DataFrame, fraction: float, key, seed=None, algorithm: str = "md5") -> DataFrame:
    """Rows whose key hash lies below ``fraction`` (repeatable, partition independent)."""
    if fraction >= 1.0:
        return df
    return df.where(hash32(key, seed, algorithm) < F.lit(float(fraction) * TWO_POW_32))


def split_approx(df: DataFrame, test_fraction: float, key, seed=DEFAULT_SEED, algorithm: str = "md5",
                 hash_column: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, test) with about ``test_fraction`` of the rows in test."""
    h = F.col(hash_column) if hash_column else hash32(key, seed, algorithm)
    in_test = h < F.lit(float(test_fraction) * TWO_POW_32)
    return df.where(~in_test), df.where(in_test)


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


#: The hash is 32 bits: how many of its low bits each round of the rank search leaves together (at most
#: 2,048 groups a round, which is all that a task or the driver holds), and the rows of an open range from
#: which the single hash values are counted at once.
ROUND_BITS = (21, 10, 0)
FEW_ROWS = 4096


def hash_rank(hashes: DataFrame, name: str, rank_of) -> tuple[int, int, int, int] | None:
    """(hash value at a rank, rows below it, rows at it, rows); None without rows.

    ``hashes`` has the hash as the bigint column ``name``; ``rank_of`` turns
    the number of rows, which the first round counts, into the 1-based rank.
    The hashes are uniform, so equal bins are enough: each round counts the
    bins of the open range and goes on with the one that holds the rank.
    """
    h, low, below, rank, total = F.col(name), None, 0, None, 0
    rows = hashes
    for bits in ROUND_BITS:
        if low is not None and low[1] <= FEW_ROWS:
            bits = 0
        if low is not None:
            rows = hashes.where((h >= F.lit(low[0])) & (h < F.lit(low[0] + low[2])))
        bins = sorted(tuple(r) for r in rows.groupBy(F.shiftright(h, bits).alias("b")).agg(F.count("*").alias("n")).collect())
        if rank is None:
            total = sum(n for _, n in bins)
            if not total:
                return None
            rank = rank_of(total)
        for b, n in bins:
            if below + n >= rank:
                low = (b << bits, n, 1 << bits)
                break
            below += n
        if bits == 0:
            break
    return low[0], below, low[1], total


def exact_cut(df: DataFrame, test_fraction: float, key, seed=DEFAULT_SEED, algorithm: str = "md5",
              hash_column: str | None = None) -> tuple[int, Column]:
    """Size of the test side and the predicate that selects it.

    The first round of the rank search also counts the rows (no separate
    count pass).  ``hash_column`` names a column that already holds the keys'
    hash, so that neither the rounds nor the two sides compute it again.
    Keys are expected to be unique and non-NULL, as a split key should be; a
    NULL has a hash of its own.
    """
    keys = _keys(key)
    h = F.col(hash_column) if hash_column else hash32(keys, seed, algorithm)
    name = free_name(keys, "_h")
    hashed = df.select(*keys, h.alias(name))
    found = hash_rank(hashed.select(name), name, lambda n: max(1, min(math.ceil(n * test_fraction), n)))
    if found is None:
        return 0, F.lit(False)
    h_star, below, ties, n = found
    k = math.ceil(n * test_fraction)
    if k <= 0:
        return 0, F.lit(False)
    need = k - below
    if need == ties:
        cut = h <= F.lit(h_star)
    else:
        # Rows sharing the cut's hash: count them per distinct key (one aggregate,
        # combined map-side, so a key holding a third of all rows costs one
        # partial row per task) and walk the keys in order.  Distinct keys per
        # 32-bit hash are few (about distinct keys / 2^32).  A key's rows stay
        # together: with unique keys the test side has exactly k rows; a
        # repeated key lands whole on one side, never straddling the split.
        per_key = hashed.where(F.col(name) == F.lit(h_star)).groupBy(*keys).agg(F.count(F.lit(1)).alias(free_name(keys, "_n")))
        running, last = 0, None
        # NULLs first, as in Spark's struct ordering used by the cut below; one partition at a time
        for row in per_key.orderBy(*[F.col(c).asc_nulls_first() for c in keys]).toLocalIterator():
            running, last = running + row[-1], row
            if running >= need:
                break
        bound = F.struct(*[F.lit(last[c]).alias(c) for c in keys])
        key_struct = F.struct(*[F.col(c) for c in keys])
        cut = (h < F.lit(h_star)) | ((h == F.lit(h_star)) & (key_struct <= bound))
    return k, F.coalesce(cut, F.lit(False))


def split_exact(df: DataFrame, test_fraction: float, key, seed=DEFAULT_SEED, algorithm: str = "md5",
                hash_column: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, test) with exactly ``ceil(n * test_fraction)`` rows in test."""
    _, cut = exact_cut(df, test_fraction, key, seed, algorithm, hash_column)
    return df.where(~cut), df.where(cut)


def split(df: DataFrame, test_fraction: float = 0.2, key: str | Sequence[str] = "id",
          seed=DEFAULT_SEED, mode: str = "exact", algorithm: str = "md5",
          hash_column: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Train/validation split; ``mode`` is ``exact`` or ``approx``; ``hash_column`` as in ``exact_cut``."""
    if mode == "exact":
        return split_exact(df, test_fraction, key, seed, algorithm, hash_column)
    if mode == "approx":
        return split_approx(df, test_fraction, key, seed, algorithm, hash_column)
    raise ValueError("mode must be 'exact' or 'approx'")
