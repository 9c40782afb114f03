"""Exact order statistics without a global sort.

``select_ranks`` finds the values at given ranks of numeric columns by
narrowing a value range with histograms.  Every round is one aggregate that
returns at most ``bins`` rows per open range (count, min, max per bin), read
back through Arrow; nothing unbounded reaches a single task or the driver.
Rows outside the open ranges are filtered first, which lets Parquet skip row
groups by their min/max statistics from the second round on.  A heavy value
(one value held by a third of the rows) needs no special care: it lands alone
in a bin whose ``min == max`` and the round that sees it returns it; the
group-by combines map-side, so the hot bin costs one partial row per task.

Rounds needed: about ``log(n) / log(bins)`` + 1 (two or three in practice);
each round reads only the target columns.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_BINS = 2048
MAX_BINS = 65536
# Histogram rows a round may return to the driver, over all open ranges.  With
# many ranges open at once the bin count per range shrinks (to no fewer than
# FLOOR_BINS) and more rounds are taken instead.
ROUND_BUDGET = 1 << 20
FLOOR_BINS = 64
MAX_ROUNDS = 200

Rank = int | Callable[[int], int]


class EmptyInput(ValueError):
    """The column has no valid (non-NULL, non-NaN) values in the searched range."""


@dataclass
class _Target:
    column: str
    rank: Rank           # 1-based rank among the valid values (or n -> rank)
    lo: float
    hi: float
    below: int = 0       # number of valid values < lo
    value: float | None = None
    ties: int = 0        # number of valid values == value (once found)


def default_bins(n: int | None) -> int:
    if not n:
        return MAX_BINS
    return int(min(MAX_BINS, max(MIN_BINS, 2 ** math.ceil(math.log2(max(2.0, math.sqrt(n)))))))


def _valid(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c.cast("double"))


def column_stats(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[int, float, float]]:
    """count, min, max of the valid (non-NULL, non-NaN) values of each column."""
    aggs = []
    for i, name in enumerate(columns):
        v = F.when(_valid(F.col(name)), F.col(name).cast("double"))
        aggs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
    row = df.agg(*aggs).first()
    return {name: (row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"]) for i, name in enumerate(columns)}


def _histogram(df: DataFrame, probes: dict[tuple[str, float, float], int], bins: int,
               full: frozenset = frozenset()):
    """Per probe (column, lo, hi): count, min, max in each of ``bins`` equal-width bins.

    Probes in ``full`` span the column's whole range, so they need no range
    test (which would evaluate a computed column once more per row).
    """
    parts, conds = [], []
    for (column, lo, hi), pid in probes.items():
        v = F.col(column).cast("double")
        inside = _valid(F.col(column))
        if (column, lo, hi) not in full:
            inside = inside & (v >= F.lit(lo)) & (v <= F.lit(hi))
        width = hi - lo
        if math.isfinite(width):
            raw = F.floor((v - F.lit(lo)) / F.lit(width) * F.lit(float(bins)))
            b = F.least(raw, F.lit(bins - 1)).cast("int")
        else:
            # an infinite end: the ends get their own bins, finite values the middle one
            b = (F.when(v == F.lit(lo), F.lit(0)).when(v == F.lit(hi), F.lit(bins - 1))
                  .otherwise(F.lit(1)))
        parts.append((pid, inside, b, v))
        conds.append(inside)
    aggs = [F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")]
    if len(parts) == 1:
        pid, inside, b, v = parts[0]
        hist = (df.where(inside).select(F.lit(pid).alias("p"), b.alias("b"), v.alias("v"))
                  .groupBy("p", "b").agg(*aggs))
    else:
        cond = conds[0]
        for c in conds[1:]:
            cond = cond | c
        # one (p, b, v) triple per open range; a row outside a range gets p = NULL
        # there.  ``stack`` is a code-generated generator (no per-row lambda).
        triples = []
        for pid, inside, b, v in parts:
            triples += [F.when(inside, F.lit(pid)), b, v]
        hist = (df.where(cond)
                  .select(F.stack(F.lit(len(parts)), *triples).alias("p", "b", "v"))
                  .where(F.col("p").isNotNull())
                  .groupBy("p", "b").agg(*aggs))
    return hist.toPandas().sort_values(["p", "b"])


def select_ranks_detail(df: DataFrame, targets: Sequence[tuple[str, Rank]],
                        stats: dict[str, tuple[int | None, float, float]] | None = None,
                        bins: int | None = None) -> list[_Target]:
    """Values at the given ranks; ``stats[c] = (n, lo, hi)`` (n may be None: taken from round 1)."""
    columns = sorted({c for c, _ in targets})
    stats = stats or column_stats(df, columns)
    bins = bins or default_bins(max((s[0] or 0) for s in stats.values()) or None)
    state = [_Target(column, rank, stats[column][1], stats[column][2]) for column, rank in targets]
    return _narrowed(df, state, columns, stats, bins)


def _narrowed(df: DataFrame, state: list[_Target], columns: Sequence[str],
              stats: dict[str, tuple[int | None, float, float]], bins: int) -> list[_Target]:
    """Rounds of histograms over the open ranges until every target has its value."""
    full = frozenset((c, stats[c][1], stats[c][2]) for c in columns)

    def resolve(t: _Target, n: int) -> None:
        if callable(t.rank):
            t.rank = t.rank(n)
        if not 1 <= t.rank <= n:
            raise ValueError(f"rank {t.rank} outside 1..{n} for column {t.column!r}")

    for t in state:
        n = stats[t.column][0]
        if n is not None:
            resolve(t, n)
            if t.lo == t.hi:
                t.value, t.ties = t.lo, n

    for _ in range(MAX_ROUNDS):
        open_targets = [t for t in state if t.value is None]
        if not open_targets:
            return state
        probes: dict[tuple[str, float, float], int] = {}
        for t in open_targets:
            probes.setdefault((t.column, t.lo, t.hi), len(probes))
        round_bins = max(FLOOR_BINS, min(bins, ROUND_BUDGET // len(probes)))
        per_job = max(1, ROUND_BUDGET // round_bins)
        items = list(probes.items())
        hist = pd.concat([_histogram(df, dict(items[i:i + per_job]), round_bins, full)
                          for i in range(0, len(items), per_job)])
        groups = {int(p): g for p, g in hist.groupby("p")}
        for t in open_targets:
            g = groups.get(probes[(t.column, t.lo, t.hi)])
            if g is None:
                raise EmptyInput(f"no valid values in column {t.column!r}")
            counts = g["n"].to_numpy(dtype=np.int64)
            if callable(t.rank):           # first round doubles as the count
                resolve(t, int(counts.sum()))
            cum = t.below + np.cumsum(counts)
            i = int(np.searchsorted(cum, t.rank, side="left"))
            t.below = int(cum[i] - counts[i])
            t.lo, t.hi = float(g["lo"].iloc[i]), float(g["hi"].iloc[i])
            if t.lo == t.hi:
                t.value, t.ties = t.lo, int(counts[i])
            elif counts[i] == 2:
                # two distinct values: they are the bin's min and max, no further round needed
                if t.rank - t.below == 1:
                    t.value, t.ties = t.lo, 1
                else:
                    t.value, t.ties, t.below = t.hi, 1, t.below + 1
    raise RuntimeError("rank selection did not converge")


def select_in_brackets(df: DataFrame, wanted: dict[str, list[tuple[int, float, float]]],
                       stats: dict[str, tuple[int, float, float]], bins: int = MIN_BINS) -> dict[tuple[str, int], float]:
    """Values at ranks that are expected within given brackets ``(rank, lo, hi)`` of a column, by one pass.

    The pass counts, per column, the values before, between and after the
    brackets and in ``bins`` bins of each, so that a rank is known exactly:
    the bin that holds it gives its value, or (where one bin holds several
    values) the open range of a further round.  A rank outside its bracket is
    searched over the whole range.
    """
    triples, spans = [], {}
    for pid, (column, items) in enumerate(sorted(wanted.items())):
        merged: list[list[float]] = []
        for lo, hi in sorted({(lo, hi) for _, lo, hi in items}):
            if merged and lo <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], hi)
            else:
                merged.append([lo, hi])
        spans[pid] = column
        v = F.col(column).cast("double")
        code = F    # F.when first, then the column's own
        for k, (lo, hi) in enumerate(merged):
            raw = F.floor((v - F.lit(lo)) / F.lit(hi - lo) * F.lit(float(bins))) if 0 < hi - lo < math.inf else F.lit(0)
            place = (2 * k + 1) * bins + F.least(raw, F.lit(bins - 1)).cast("int")
            code = code.when(v < F.lit(lo), F.lit(2 * k * bins)).when(v <= F.lit(hi), place)
        triples += [F.when(_valid(F.col(column)), F.lit(pid)), code.otherwise(F.lit(2 * len(merged) * bins)), v]
    found = (df.select(F.stack(F.lit(len(spans)), *triples).alias("p", "b", "v")).where(F.col("p").isNotNull())
             .groupBy("p", "b").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
             .toPandas().sort_values(["p", "b"]))
    out, open_ = {}, []
    for pid, column in spans.items():
        rows = found[found["p"] == pid]
        counts = rows["n"].to_numpy(dtype=np.int64)
        cum = np.cumsum(counts)
        for rank, _, _ in wanted[column]:
            i = int(np.searchsorted(cum, rank, side="left"))
            lo, hi, n, below = float(rows["lo"].iloc[i]), float(rows["hi"].iloc[i]), int(counts[i]), int(cum[i] - counts[i])
            if lo == hi or n == 2:
                out[column, rank] = lo if lo == hi or rank - below == 1 else hi
            else:
                open_.append(_Target(column, rank, lo, hi, below))
    columns = sorted({t.column for t in open_})
    for t in _narrowed(df, open_, columns, {c: stats[c] for c in columns}, bins):
        out[t.column, t.rank] = t.value
    return out


def select_ranks_with_counts(df, targets, stats=None, bins=None) -> list[tuple[float, int]]:
    """(value, number of values strictly below it) per target."""
    return [(t.value, t.below) for t in select_ranks_detail(df, targets, stats, bins)]


def select_ranks(df, targets, stats=None, bins=None) -> list[float]:
    """Values at the given 1-based ranks of the valid values of each column."""
    return [t.value for t in select_ranks_detail(df, targets, stats, bins)]


def quantile_ranks(n: int, q: float) -> tuple[int, int, float]:
    """1-based ranks around position (n-1)q and the interpolation weight."""
    pos = (n - 1) * q
    lower = math.floor(pos)
    return lower + 1, math.ceil(pos) + 1, pos - lower


def exact_quantiles(df: DataFrame, columns: Sequence[str], qs: Sequence[float],
                    stats: dict[str, tuple[int, float, float]] | None = None,
                    brackets: dict[tuple[str, float], tuple[float, float]] | None = None
                    ) -> dict[tuple[str, float], float | None]:
    """Linearly interpolated quantiles (the rule of pandas and ``quantile_cont``).

    ``brackets`` (by column and quantile, from a sketch) say where to look
    first; they change the number of passes, never a value.
    """
    stats = stats or column_stats(df, columns)
    wanted: list[tuple[str, int]] = []
    plan = {}
    for c in columns:
        n = stats[c][0]
        for q in qs:
            if not n:
                plan[(c, q)] = None
                continue
            r_lo, r_hi, w = quantile_ranks(n, q)
            plan[(c, q)] = (r_lo, r_hi, w)
            wanted += [(c, r_lo), (c, r_hi)]
    uniq = sorted(set(wanted))
    if brackets is not None and uniq:
        near: dict[str, list[tuple[int, float, float]]] = {}
        for (c, q), p in plan.items():
            if p is not None:
                near.setdefault(c, []).extend((r, *brackets[c, q]) for r in dict.fromkeys(p[:2]))
        values = select_in_brackets(df, near, stats)
        return {key: None if p is None else values[key[0], p[0]] + (values[key[0], p[1]] - values[key[0], p[0]]) * p[2]
                for key, p in plan.items()}
    values = dict(zip(uniq, select_ranks(df, uniq, {c: stats[c] for c in columns if stats[c][0]}))) if uniq else {}
    out = {}
    for (c, q), p in plan.items():
        if p is None:
            out[(c, q)] = None
            continue
        r_lo, r_hi, w = p
        a, b = values[(c, r_lo)], values[(c, r_hi)]
        out[(c, q)] = a + (b - a) * w
    return out
