"""Hard-negative mining by segment summary filtering.

For each anchor: its nearest rows of the same label (positives), and for each
positive the best rows of other labels whose score lies in a band below the
positive's.  The score is the integer inner product.

Method.  Every vector is cut into segments at several levels (``LEVELS``: one
segment, then four, then sixteen), and the mean and the deviation of each
segment are stored with it.  Over a segment of length L the inner product is
``L * (mean * mean)`` plus at most, and minus at least, ``L * (dev * dev)``;
summed over the segments this bounds the score from both sides.  A block of
anchors meets a batch of rows on the coarsest level first; only pairs whose
bounds can still matter are refined to the next level, and only what is left
then is scored exactly.  What can matter: for positives, an upper bound of at
least the k-th best score known for the anchor (from exact scores, or from
the lower bounds of the batch); for negatives, bounds that meet a band, above
the k-th best score known in it.

Plan.  The summaries are written once, as an index.  Anchors are taken in
chunks of at most ``CHUNK_BYTES``, which is what a chunk broadcasts however
many rows there are; for each chunk one narrow pass over the index finds the
positives of each task and a window keeps the best of all tasks, and a second
pass does the same for the negatives.  A task holds one batch, one block of
bounds and the k best of each anchor of the chunk, and no group of rows is
ever gathered, so equal vectors and frequent labels cost nothing extra.

Defined results: rows with a null label, a null vector, or a null, non-finite
or too large component (``LIMIT`` or more in size: its score would not fit a
long) take no part; vectors of different lengths have no score with each
other, empty ones score 0; equal scores are ordered by smaller id, null ids
last, then by row; rows that repeat an id are rows of their own, and an
anchor's own row is the only one left out of its positives; an anchor without
positives, or a positive without negatives, gives no rows; an empty table
gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame

from tabscore.llm.common import F, T, Window, col, materialise, python_workers
from tabscore.session import scratch_path

SCALE = 256
LIMIT = float(2 ** 19)
LEVELS = (1, 4, 16)
POSITIVES = NEGATIVES = 5
#: The band of a negative's score, in hundredths of the positive's.
LOW, HIGH = 80, 100

CHUNK_BYTES = 16 * 1024 * 1024
#: Anchors whose bounds are held at a time, and pairs refined at a time.
BLOCK, PAIRS = 512, 32768
#: A level is computed for the whole block where more than this share of its pairs is left.
DENSE = 0.1

INDEX = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("label", T.LongType()),
    T.StructField("v", T.ArrayType(T.LongType())),
    T.StructField("means", T.ArrayType(T.DoubleType())), T.StructField("devs", T.ArrayType(T.DoubleType())),
])


def cuts(d: int, segments: int) -> np.ndarray:
    """Where the segments of a vector of length ``d`` start, and its end."""
    return np.unique(np.linspace(0, d, min(segments, max(d, 1)) + 1).astype(np.int64))


def summaries(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of every segment of every level, side by side, of the rows of ``v``."""
    n, d = v.shape
    means, devs = [np.zeros((n, 0))], [np.zeros((n, 0))]
    for segments in LEVELS if d else ():
        at = cuts(d, segments)
        length = np.diff(at)
        mean = np.add.reduceat(v, at[:-1], axis=1) / length
        rest = v - np.repeat(mean, length, axis=1)
        means.append(mean)
        devs.append(np.sqrt(np.add.reduceat(rest * rest, at[:-1], axis=1) / length))
    return np.concatenate(means, axis=1), np.concatenate(devs, axis=1)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    lengths = pc.list_value_length(batch.column("v"))
    for d in pc.unique(lengths).to_pylist():
        part = batch.filter(pc.equal(lengths, d))
        if part.num_rows:
            yield d, part


def _matrix(lists: pa.ListArray, rows: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _lists(matrix: np.ndarray) -> pa.ListArray:
    n, w = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * w), pa.array(matrix.ravel()))


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for d, part in _by_length(batch):
            means, devs = summaries(_matrix(part.column("v"), part.num_rows).astype(np.float64))
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), part.column("v"),
                                              _lists(means), _lists(devs)], INDEX.names)


def index(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding", label: str = "label",
          relabel: Column | None = None) -> DataFrame:
    """The rows that take part, as integers, with their summaries and a number each; written.

    ``relabel``: a label in place of the stored one, over the columns ``vec_id`` and ``label``.
    """
    python_workers(vectors.sparkSession)
    rows = vectors.select(col(ident).cast("long").alias("vec_id"), col(label).cast("long").alias("label"),
                          col(vector).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < LIMIT))     # a NaN is above every limit
    rows = rows.where(F.col("label").isNotNull() & F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)))
    if relabel is not None:
        rows = rows.withColumn("label", relabel.cast("long"))
    whole = rows.withColumn("v", F.transform("v", lambda x: F.floor(x * SCALE)))
    # the number of a row is only used from the written table, where it can no longer change
    return materialise(whole.mapInArrow(_summarise, INDEX).withColumn("row", F.monotonically_increasing_id()),
                       "negatives-index")


class Rows:
    """Rows of one vector length: their integers and, per level, means and deviations times the root of the length."""

    def __init__(self, part: pa.RecordBatch | pa.Table, d: int):
        n = part.num_rows
        get = lambda name: part.column(name).combine_chunks() if isinstance(part, pa.Table) else part.column(name)
        self.row = get("row").to_numpy(zero_copy_only=False)
        self.label = get("label").to_numpy(zero_copy_only=False)
        self.no_id = get("vec_id").is_null().to_numpy(zero_copy_only=False)
        self.vec_id = get("vec_id").fill_null(0).to_numpy(zero_copy_only=False)
        self.v = _matrix(get("v"), n)
        self.top = int(np.abs(self.v).max()) if self.v.size else 0
        self.f = self.v.astype(np.float64)
        self.norm = np.sqrt((self.f * self.f).sum(axis=1))
        means, devs = _matrix(get("means"), n), _matrix(get("devs"), n)
        self.levels, at = [], 0
        for segments in LEVELS if d else ():
            root = np.sqrt(np.diff(cuts(d, segments)))
            self.levels.append((means[:, at:at + len(root)] * root, devs[:, at:at + len(root)] * root))
            at += len(root)


def _exact(a: Rows, x: Rows) -> bool:
    """True where inner products of doubles are exact."""
    return a.top * x.top * max(a.v.shape[1], 1) < 2 ** 53


def scores(a: Rows, x: Rows, block: slice, i: np.ndarray, j: np.ndarray, dense: bool) -> np.ndarray:
    """Exact scores of the pairs (block's ``i``, ``j``)."""
    left, right = (a.f, x.f) if _exact(a, x) else (a.v, x.v)
    if dense:
        return (left[block] @ right.T)[i, j].astype(np.int64)
    out = np.empty(len(i), dtype=np.int64)
    for lo in range(0, len(i), PAIRS):
        s = slice(lo, lo + PAIRS)
        out[s] = np.einsum("ij,ij->i", left[block][i[s]], right[j[s]])
    return out


def refined(a: Rows, x: Rows, block: slice, alive: np.ndarray, least, most=None, best: int = 0):
    """(i, j, dense): the pairs of a block of anchors and a batch that the bounds of all levels leave.

    ``alive`` marks the pairs asked for, ``least`` and ``most`` are what a
    score must reach and must not exceed, per anchor.  With ``best`` the
    threshold also rises to the best-th lower bound of an anchor's pairs.
    """
    slack = 1e-9 * np.outer(a.norm[block], x.norm) + 1e-6
    least = np.array(least, dtype=np.float64)[:, None]
    i = j = None
    for (ma, da), (mx, dx) in zip(a.levels, x.levels):
        if i is None or len(i) > DENSE * alive.size:
            middle, width = ma[block] @ mx.T, da[block] @ dx.T + slack
            if best and alive.shape[1] >= best:
                low = np.where(alive, middle - width, -np.inf)
                least = np.maximum(least, -np.partition(-low, best - 1, axis=1)[:, best - 1:best])
            alive &= middle + width >= least
            if most is not None:
                alive &= middle - width <= most[:, None]
            i, j = np.nonzero(alive)
            continue
        stay = np.ones(len(i), dtype=bool)
        for lo in range(0, len(i), PAIRS):
            s = slice(lo, lo + PAIRS)
            p, q = i[s], j[s]
            middle = np.einsum("ij,ij->i", ma[block][p], mx[q])
            width = np.einsum("ij,ij->i", da[block][p], dx[q]) + slack[p, q]
            stay[s] = middle + width >= least[p, 0]
            if most is not None:
                stay[s] &= middle - width <= most[p]
        i, j = i[stay], j[stay]
    if i is None:
        i, j = np.nonzero(alive)
    return i, j, len(i) > DENSE * alive.size


class Best:
    """The ``k`` best (group, score, id, row) of every group: higher scores, then smaller ids, null ids last."""

    def __init__(self, groups: int, k: int):
        self.k, self.groups = k, groups
        self.kth = np.full(groups, -np.inf)
        self.held = [np.zeros(0, dtype=t) for t in (np.int64, np.int64, bool, np.int64, np.int64)]

    def add(self, *found: np.ndarray) -> None:
        """More (group, score, no_id, vec_id, row)."""
        both = [np.concatenate(p) for p in zip(self.held, found)]
        group, score, no_id, vec_id, row = both
        order = np.lexsort((row, vec_id, no_id, -score, group))
        group = group[order]
        stay = order[np.arange(len(group)) - np.searchsorted(group, group) < self.k]
        self.held = [c[stay] for c in both]
        group = self.held[0]
        kth = np.arange(len(group)) - np.searchsorted(group, group) == self.k - 1
        self.kth[group[kth]] = self.held[1][kth]


def _anchors(table: pa.Table) -> dict[int, Rows]:
    lengths = pc.list_value_length(table.column("v"))
    return {d: Rows(table.filter(pc.equal(lengths, d)), d) for d in pc.unique(lengths).to_pylist()}


FOUND = "anchor long, slot int, score long, vec_id long, row long"


def _found(best: Best, anchors: Rows, slots: int) -> pa.RecordBatch:
    group, score, no_id, vec_id, row = best.held
    return pa.RecordBatch.from_arrays(
        [pa.array(anchors.row[group // slots]), pa.array((group % slots).astype(np.int32)), pa.array(score),
         pa.array(vec_id, mask=no_id), pa.array(row)], ["anchor", "slot", "score", "vec_id", "row"])


def positives_of(rows: DataFrame, shared, k: int) -> DataFrame:
    """Each task's ``k`` best rows of the same label, for every anchor of the chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = _anchors(shared.value)
        best = {d: Best(len(a.row), k) for d, a in anchors.items()}
        for batch in batches:
            for d, part in _by_length(batch):
                if d not in anchors:
                    continue
                a, x, b = anchors[d], Rows(part, d), best[d]
                for lo in range(0, len(a.row), BLOCK):
                    block = slice(lo, min(lo + BLOCK, len(a.row)))
                    alive = (a.label[block, None] == x.label) & (a.row[block, None] != x.row)
                    i, j, dense = refined(a, x, block, alive, b.kth[block], best=k)
                    s = scores(a, x, block, i, j, dense)
                    some = s >= b.kth[i + lo]
                    i, j, s = i[some], j[some], s[some]
                    if len(i):
                        b.add(i + lo, s, x.no_id[j], x.vec_id[j], x.row[j])
        for d, a in anchors.items():
            yield _found(best[d], a, 1)

    return rows.mapInArrow(run, FOUND)


def negatives_of(rows: DataFrame, shared, bands, k: int, slots: int, low: int, high: int) -> DataFrame:
    """Each task's ``k`` best rows of other labels in the band of every positive (``slot``) of every anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = _anchors(shared.value)
        where = bands.value
        limits, best = {}, {}
        for d, a in anchors.items():
            least, most = np.full((len(a.row), slots), np.inf), np.full((len(a.row), slots), -np.inf)
            for n, row in enumerate(a.row.tolist()):
                for slot, score in where.get(row, ()):
                    least[n, slot], most[n, slot] = -((-low * score) // 100), (high * score) // 100
            limits[d], best[d] = (least, most), Best(len(a.row) * slots, k)
        for batch in batches:
            for d, part in _by_length(batch):
                if d not in anchors:
                    continue
                a, x, b = anchors[d], Rows(part, d), best[d]
                least, most = limits[d]
                for lo in range(0, len(a.row), BLOCK):
                    block = slice(lo, min(lo + BLOCK, len(a.row)))
                    floor = np.maximum(least[block], b.kth.reshape(-1, slots)[block])
                    floor[floor > most[block]] = np.inf
                    alive = a.label[block, None] != x.label
                    i, j, dense = refined(a, x, block, alive, floor.min(axis=1), most[block].max(axis=1))
                    s = scores(a, x, block, i, j, dense)
                    group, pick = [], []
                    for slot in range(slots):
                        inside = np.flatnonzero((s >= floor[i, slot]) & (s <= most[block][i, slot]))
                        group.append((i[inside] + lo) * slots + slot)
                        pick.append(inside)
                    group, pick = np.concatenate(group), np.concatenate(pick)
                    if len(group):
                        b.add(group, s[pick], x.no_id[j[pick]], x.vec_id[j[pick]], x.row[j[pick]])
        for d, a in anchors.items():
            yield _found(best[d], a, slots)

    return rows.mapInArrow(run, FOUND)


def ranked(found: DataFrame, k: int, *group: str) -> DataFrame:
    """The ``k`` best of all tasks, numbered from 1 as ``rank``."""
    order = Window.partitionBy(*group).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW,
         high: int = HIGH, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; ``rows`` from ``index``."""
    spark = rows.sparkSession
    asked = rows.where(is_anchor)
    n, widest = asked.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    chunks = max(1, -(-n * (widest * 8 + 2 * 8 * sum(LEVELS) + 64) // chunk_bytes))
    path = scratch_path(spark, "negatives")
    for c in range(chunks):
        some = asked.where(F.pmod(F.xxhash64("row"), F.lit(chunks)) == c)
        table = some.toArrow()
        shared = spark.sparkContext.broadcast(table)
        best = materialise(ranked(positives_of(rows, shared, positives), positives, "anchor"), "negatives-positives")
        bands: dict[int, list] = {}
        for r in best.select("anchor", "rank", "score").toArrow().to_pylist():    # at most ``positives`` an anchor of the chunk
            bands.setdefault(r["anchor"], []).append((r["rank"] - 1, r["score"]))
        wanted = spark.sparkContext.broadcast(bands)
        found = ranked(negatives_of(rows, shared, wanted, negatives, positives, low, high), negatives, "anchor", "slot")
        own = some.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
        of = best.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"),
                         F.col("score").alias("positive_score")).join(own, "anchor")
        found.join(of, ["anchor", "slot"]).select(
            "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score")).write.mode("append").parquet(path)
        shared.unpersist()
        wanted.unpersist()
    return spark.read.schema("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, "
                             "negative_score long").parquet(path)
