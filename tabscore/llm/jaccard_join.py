"""N-gram Jaccard join: chosen-path join over word shingles.

A document is the set of its shingles (``SHINGLE`` words, lower-cased runs of
letters and digits; a shorter text is one shingle).  Documents with equal sets
form a class, represented once from then on.

Candidates.  A set's ``TOKENS`` min-hashes are the tokens sampled from it: two
sets share the token at one coordinate with probability equal to their Jaccard
similarity.  A run sends every set down ``BRANCHES`` chosen coordinates, which
splits the sets by the tokens they share there; a bucket larger than
``BUCKET`` is split again the same way, by coordinates chosen by its own path,
down to ``DEPTH``.  A bucket that kept more than half of the one it came from
is a dense group, which further splits would only copy, and is not split.
Buckets are then compared by brute force on the sampled
tokens.  A pair of similarity ``t`` survives a level with probability
``1 - (1 - t s) ** BRANCHES``, ``s`` being its chance below; ``runs_for``
takes the smallest number of runs whose union reaches the target recall at the
threshold, for the deepest level.

Buckets leave a spanning tree of their candidate pairs, never the pairs.
Connected candidates are brought together once with their texts and compared
exactly, so every reported link has true similarity of ``threshold`` or more.

A bucket or group larger than ``BLOCK`` (texts: or with more than
``BLOCK_SHINGLES`` shingles) is compared block against block, each pair of
blocks a task's work of bounded memory; no member is left out, however large
the group.

Defined results: null, empty and wordless texts have no shingles and link to
nothing; rows repeating an id or a text are separate documents of one class;
a class id is the smallest id of the linked documents, null ids counting as
the largest; ``links`` counts the other documents, copies included, whose
similarity is at least the threshold; texts of any length are compared whole;
an empty table gives an empty result.  Columns beyond id and text, whatever
their names, are not read by ``join`` and are returned as they came by
``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tabscore.llm.common import (python_workers, F, T, col, components, is_file_scan, join_counted, located,
                                 materialise, small, without_rows, words)

SHINGLE = 5
THRESHOLD = 0.8
TARGET = 0.999
TOKENS = 128
BRANCHES = 2
BUCKET = 256
DEPTH = 4
BLOCK = 1024
#: Shingles of a block of texts, so that blocks of long texts hold fewer of them.
BLOCK_SHINGLES = 1 << 20
#: Sets of a block judged at a time.
STRIP = 256
SEED = 11
HIGHEST = 2**63 - 1
_MUL = np.uint64(0x9E3779B97F4A7C15)


def candidate_floor(threshold: float) -> float:
    """Sampled tokens from which a pair is a candidate: four standard errors below the threshold."""
    return (threshold - 4 * (threshold * (1 - threshold) / TOKENS) ** 0.5) * TOKENS


def survival(threshold: float = THRESHOLD, branches: int = BRANCHES, depth: int = DEPTH) -> float:
    """Chance that a pair at the threshold shares a bucket of one run, split down to ``depth``."""
    s = 1.0
    for _ in range(depth):
        s = 1.0 - (1.0 - threshold * s) ** branches
    return s


def runs_for(target: float = TARGET, threshold: float = THRESHOLD, branches: int = BRANCHES, depth: int = DEPTH) -> int:
    """Runs whose union finds a pair at the threshold with probability ``target``."""
    miss, runs = 1.0, 0
    while 1.0 - miss < target:
        miss *= 1.0 - survival(threshold, branches, depth)
        runs += 1
    return runs


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(word_hashes: np.ndarray) -> np.ndarray:
    """The sorted set of shingle hashes of a text's word hashes (fewer words than a shingle: all of them)."""
    w = word_hashes.view(np.uint64)
    n = min(SHINGLE, len(w))
    if not n:
        return np.zeros(0, dtype=np.uint64)
    h = np.full(len(w) - n + 1, n, dtype=np.uint64)
    for j in range(n):
        h = mixed(h * _MUL + w[j:len(w) - n + 1 + j])
    return np.unique(h)


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    a = rng.integers(0, 2**63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 2**63, TOKENS, dtype=np.uint64)


_A, _B = _coefficients()


def sampled_tokens(s: np.ndarray) -> np.ndarray:
    """``TOKENS`` min-hashes of a non-empty set, as 32-bit tokens."""
    best = np.full(TOKENS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(s), 512):
        part = s[k:k + 512, None] * _A + _B
        np.minimum(best, part.min(axis=0), out=best)
    return mixed(best).astype(np.uint32)


def set_key(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit sums that name a set."""
    a = mixed(s).sum(dtype=np.uint64)
    b = mixed(s * _MUL + np.uint64(SEED)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


SIGNED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("file", T.LongType()), T.StructField("pos", T.LongType()),
    T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()),
    T.StructField("n", T.IntegerType()), T.StructField("tokens", T.BinaryType())])


def word_hash_column(text):
    return F.transform(words(text), lambda w: F.xxhash64(w))


def signed(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """(row, doc_id, file, pos, k1, k2, n, tokens) of every document; ``row`` is fixed by writing the table."""
    python_workers(docs.sparkSession)
    rows = located(docs, [col(ident).cast("long").alias("doc_id"), word_hash_column(col(text)).alias("w")],
                   "join-docs").select("doc_id", "file", "pos", "w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w, offsets = b.column(3).values.to_numpy(zero_copy_only=False), b.column(3).offsets.to_numpy()
            k1, k2, n, tokens = [], [], [], []
            for i in range(b.num_rows):
                s = shingles(w[offsets[i]:offsets[i + 1]])
                a, c = set_key(s)
                k1.append(a), k2.append(c), n.append(len(s))
                tokens.append(sampled_tokens(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
                                              pa.array(n, pa.int32()), pa.array(tokens, pa.binary())], SIGNED.names)

    # the id of a row is only used from the written table, where it can no longer change
    return materialise(rows.mapInArrow(run, SIGNED).withColumn("row", F.monotonically_increasing_id()), "join-signed")


def token_at(k) -> "F.Column":
    """The token at coordinate ``k`` (from 0) of the ``tokens`` column."""
    return F.hex(F.substring(F.col("tokens"), k * 4 + 1, F.lit(4)))


def split(rows: DataFrame, branches: int) -> DataFrame:
    """(path, rep, parent: size of the bucket it comes from) of every set sent down the coordinates chosen by its path."""
    chosen = F.array(*[F.pmod(F.xxhash64(F.lit(SEED + j), F.col("path")), F.lit(TOKENS // branches)).cast("int")
                       * F.lit(branches) + F.lit(j) for j in range(branches)])
    down = rows.select("path", "rep", "tokens", F.col("size").alias("parent"), F.explode(chosen).alias("k"))
    return down.select(F.xxhash64("path", "k", token_at(F.col("k"))).alias("path"), "rep", "parent")


def sized(paths: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(final, to be split) buckets as (path, rep, size); buckets of one have no pairs and are left out."""
    count = materialise(paths.groupBy("path").agg(F.count("*").alias("size")).where("size > 1"), f"{name}-sizes")
    all_ = materialise(join_counted(paths, count, "path", "size"), name)
    final = (F.col("size") <= BUCKET) | F.coalesce(2 * F.col("size") > F.col("parent"), F.lit(False))
    return all_.where(final).drop("parent"), all_.where(~final).drop("parent")


def buckets(reps: DataFrame, runs: int, depth: int, branches: int) -> DataFrame:
    """(path, rep, size) of every final bucket with at least two sets, over all runs at once."""
    root = reps.select(F.explode(F.array(*[F.xxhash64(F.lit(SEED), F.lit(r)) for r in range(runs)])).alias("path"),
                       "rep", "tokens", F.lit(None).cast("long").alias("size"))
    done = []
    level = split(root, branches)
    for d in range(1, depth + 1):
        ready, large = sized(level, f"join-level{d}")
        done.append(ready)
        if d == depth or large.isEmpty():
            done.append(large)
            break
        level = split(large.join(reps.select("rep", "tokens"), "rep").select("path", "rep", "tokens", "size"), branches)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def with_blocks(rows: DataFrame, group: str, member: str, size: str = "size") -> DataFrame:
    """Rows with (block_a, block_b, own): a group beyond ``BLOCK`` members is dealt into pairs of blocks.

    A member goes to the pairs its own block takes part in; a group of ``m``
    members in ``g = ceil(m / BLOCK)`` blocks costs ``m * g`` rows, each pair
    of blocks being one unit of work of at most about two blocks.
    """
    g = F.ceil(F.col(size) / F.lit(BLOCK)).cast("int")
    own = F.pmod(F.xxhash64(F.lit(SEED), F.col(member)), g).cast("int")
    rows = rows.withColumn("own", own).withColumn("_g", g)
    pairs = F.transform(F.sequence(F.lit(0), F.col("_g") - 1),
                        lambda o: F.struct(F.least(o, F.col("own")).alias("a"), F.greatest(o, F.col("own")).alias("b")))
    return rows.withColumn("_p", F.explode(pairs)).withColumns(
        {"block_a": F.col("_p.a"), "block_b": F.col("_p.b")}).drop("_p", "_g")


def newly_joined(label: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
    """Join position ``i`` with ``others``: one position of each part that was apart from it (``label`` names the parts)."""
    apart = others[label[others] != label[i]]
    if len(apart):
        parts, first = np.unique(label[apart], return_index=True)
        label[np.isin(label, parts)] = label[i]
        apart = apart[first]
    return apart


def groups_of(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[list, pa.Table]]:
    """Consecutive rows that agree in the first ``n_keys`` columns (the input is sorted by them)."""
    held: list[pa.RecordBatch] = []
    key = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = [b.column(k).to_numpy(zero_copy_only=False) for k in range(n_keys)]
        change = np.zeros(b.num_rows - 1, dtype=bool)
        for k in keys:
            change |= k[1:] != k[:-1]
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), b.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            now = [k[lo] for k in keys]
            if key is not None and now != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = now
            held.append(b.slice(lo, hi - lo))
    if held:
        yield key, pa.Table.from_batches(held)


def candidate_edges(rows: DataFrame, threshold: float) -> DataFrame:
    """A spanning tree (a, b) of the candidate pairs inside every unit of (path, block_a, block_b)."""
    floor = candidate_floor(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, ba, bb), t in groups_of(batches, 3):
            rep = t.column("rep").to_numpy()
            own = t.column("own").to_numpy()
            low = np.frombuffer(b"".join(t.column("tokens").to_pylist()), dtype=np.uint8).reshape(len(rep), TOKENS, 4)
            low = np.ascontiguousarray(low[:, :, 0])   # one byte of each token; chance agreement is made up for below
            at = np.flatnonzero(own == bb)
            side, label, parts = low[at], np.arange(len(rep)), len(rep)
            a, b = [], []
            for n, i in enumerate(np.flatnonzero(own == ba).tolist()):
                if parts == 1:
                    break    # one tree spans the unit: further pairs add nothing
                start = n + 1 if ba == bb else 0
                same = (side[start:] == low[i]).sum(axis=1)
                near = at[start:][(same - TOKENS / 256) / (1 - 1 / 256) >= floor]
                for j in newly_joined(label, i, near).tolist():
                    a.append(rep[i]), b.append(rep[j])
                    parts -= 1
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    units = rows.select("path", "block_a", "block_b", "own", "rep", "tokens")
    # a quarter of the sampled tokens would do to name a bucket; all of them are compared
    return units.repartition("path", "block_a", "block_b").sortWithinPartitions(
        "path", "block_a", "block_b", "rep").mapInArrow(run, "a long, b long")


LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()),
                      T.StructField("links", T.LongType())])


def link_rows(rows: DataFrame, threshold: float) -> DataFrame:
    """Exact comparison inside every unit of (root, block_a, block_b).

    Rows (a, null, links): documents linked to class ``a`` through this unit;
    rows (a, b, null): a spanning tree of the links.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, ba, bb), t in groups_of(batches, 3):
            rep, own = t.column("rep").to_numpy(), t.column("own").to_numpy()
            weight = t.column("copies").to_numpy().astype(np.int64)
            k1, k2 = t.column("k1").to_numpy(), t.column("k2").to_numpy()
            sets = []
            for chunk in t.column("w").chunks:
                v, o = chunk.values.to_numpy(zero_copy_only=False), chunk.offsets.to_numpy()
                sets += [shingles(v[o[i]:o[i + 1]]) for i in range(len(chunk))]
            # a set is compared only as the one it was signed as
            found = {int(rep[i]): i for i in range(len(sets)) if set_key(sets[i]) == (k1[i], k2[i])}
            at = np.array(sorted(found.values()), dtype=np.int64)
            a, b, links = compare_sets(rep[at], own[at], weight[at], [sets[i] for i in at], ba != bb, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                                              pa.array(links, pa.int64())], LINKS.names)

    return rows.select("root", "block_a", "block_b", "own", "rep", "copies", "k1", "k2", "w").repartition(
        "root", "block_a", "block_b").sortWithinPartitions("root", "block_a", "block_b", "rep").mapInArrow(run, LINKS)


def compare_sets(rep: np.ndarray, own: np.ndarray, weight: np.ndarray, sets: list[np.ndarray], crossing: bool,
                 threshold: float) -> tuple[list, list, list]:
    """Links between sets by their exact intersections: within a block, or (``crossing``) of one block with the other.

    Shingles are numbered; those of one set only cannot meet. Intersections
    are products of 0/1 matrices, a bounded number of shingles at a time, and
    are judged ``STRIP`` sets at a time.
    """
    m = len(sets)
    if m < 2:
        return [], [], []
    if crossing:
        order = np.argsort(own, kind="stable")
        rep, own, weight, sets = rep[order], own[order], weight[order], [sets[i] for i in order]
    left = int((own == own[0]).sum())
    start = left if crossing else 0
    if start == m:
        return [], [], []
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(m), sizes)
    _, number, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = df[number] > 1
    owner, number = owner[shared], number[shared]
    _, number = np.unique(number, return_inverse=True)
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    width = int(number[-1]) + 1 if len(number) else 0
    inter = np.zeros((left, m - start), dtype=np.float32)
    step = max(256, (32 << 20) // (4 * m))
    for lo in range(0, width, step):
        i, j = np.searchsorted(number, [lo, lo + step])
        part = np.zeros((m, min(step, width - lo)), dtype=np.float32)
        part[owner[i:j], number[i:j] - lo] = 1.0
        inter += part[:left] @ part[start:].T
    linked = np.zeros(m, dtype=np.int64)
    label, parts = np.arange(m), m
    a, b = [], []
    for lo in range(0, left, STRIP):
        rows = slice(lo, min(lo + STRIP, left))
        first = start if crossing else lo
        both = inter[rows, first - start:]
        union = sizes[rows, None] + sizes[None, first:] - both
        near = (both >= threshold * union - 1e-6) & (union > 0)
        if not crossing:
            near = np.triu(near, 1)
        linked[rows] += near @ weight[first:]
        linked[first:] += weight[rows] @ near
        for i in range(rows.start, rows.stop):
            if parts == 1:
                break
            for j in newly_joined(label, i, np.flatnonzero(near[i - lo]) + first).tolist():
                a.append(int(rep[i])), b.append(int(rep[j]))
                parts -= 1
    some = np.flatnonzero(linked)
    return (a + rep[some].tolist(), b + [None] * len(some), [None] * len(a) + linked[some].tolist())


def join(docs: DataFrame, ident: str = "doc_id", text: str = "text", threshold: float = THRESHOLD,
         target: float = TARGET) -> DataFrame:
    """One row per document: doc_id, class_id, links, copies (documents with the same set, itself included)."""
    return located_classes(docs, ident, text, threshold, target).select("doc_id", "class_id", "links", "copies")


def located_classes(docs: DataFrame, ident: str, text: str, threshold: float = THRESHOLD,
                    target: float = TARGET) -> DataFrame:
    """``join`` with each row's place (file, pos) and whether it is the one row that names its class (``first``)."""
    if not is_file_scan(docs):
        docs = materialise(docs, "join-docs")    # once: texts are found again by their place
    rows = signed(docs, ident, text)
    some = rows.where("n > 0")
    classes = materialise(some.groupBy("k1", "k2").agg(
        F.min("row").alias("rep"), F.count("*").alias("copies"),
        F.min(F.struct(F.coalesce("doc_id", F.lit(HIGHEST)).alias("id"), "row")).alias("first_row")), "join-classes")
    reps = materialise(some.join(classes.select("rep", "copies"), F.col("row") == F.col("rep")).select(
        "rep", "file", "pos", "k1", "k2", "n", "copies", "tokens"), "join-reps")
    found = buckets(reps.select("rep", "tokens"), runs_for(target, threshold), DEPTH, BRANCHES)
    units = with_blocks(found, "path", "rep").join(reps.select("rep", "tokens"), "rep")
    edges = materialise(candidate_edges(units, threshold).distinct(), "join-candidates")
    group = materialise(components(edges), "join-groups")
    links = materialise(link_rows(group_texts(docs, group, reps, text), threshold), "join-links")

    linked = links.where("b IS NULL").groupBy("a").agg(F.sum("links").alias("links"))
    roots = components(links.where("b IS NOT NULL").select("a", "b"))
    root_of = classes.join(roots, classes["rep"] == roots["node"], "left").select(
        "k1", "k2", "rep", "copies", "first_row", F.coalesce("root", "rep").alias("root"))
    # the class is named by its smallest document id, of equal ids by the first row
    named = root_of.groupBy("root").agg(F.min("first_row").alias("named"))
    final = root_of.join(named, "root").join(linked, root_of["rep"] == linked["a"], "left").select(
        "k1", "k2", "copies", F.nullif(F.col("named.id"), F.lit(HIGHEST)).alias("class_id"),
        F.col("named.row").alias("named_row"),
        F.coalesce("links", F.lit(0)).alias("near"))
    final = materialise(final, "join-final")
    out = some.select("doc_id", "file", "pos", "row", "k1", "k2").join(final, ["k1", "k2"]).select(
        "doc_id", "file", "pos", (F.col("row") == F.col("named_row")).alias("first"), "class_id", (F.col("near") + F.col("copies") - 1).alias("links"), "copies")
    alone = rows.where("n = 0").select("doc_id", "file", "pos", F.lit(True).alias("first"), F.col("doc_id").alias("class_id"),
                                       F.lit(0).cast("long").alias("links"), F.lit(1).cast("long").alias("copies"))
    return out.unionByName(alone)


def group_texts(docs: DataFrame, group: DataFrame, reps: DataFrame, text: str) -> DataFrame:
    """(root, rep, copies, w, own, block_a, block_b) of every set that has a candidate.

    Texts are found by their place, so only documents with candidates move.
    """
    members = materialise(group.join(reps.select("rep", "file", "pos", "k1", "k2", "n", "copies"),
                                     F.col("node") == F.col("rep")), "join-members")
    weight = F.ceil(F.sum("n") * F.lit(BLOCK) / F.lit(BLOCK_SHINGLES))
    sizes = members.groupBy("root").agg(F.greatest(F.count("*"), weight).alias("size"))
    wanted = materialise(members.join(sizes, "root").select(
        "root", "size", "rep", "file", "pos", "k1", "k2", "copies"), "join-wanted")
    side, _ = small(wanted, 88)
    texts = located(docs, [col(text).alias("_text")], "join-docs")
    rows = texts.join(side, ["file", "pos"]).select(
        "root", "size", "rep", "k1", "k2", "copies", word_hash_column(F.col("_text")).alias("w"))
    return with_blocks(rows, "root", "rep")


def keep_one(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each class of near copies: that with the smallest id, of equal ids the first.

    Rows are judged one by one, whatever their ids; null ids count as the
    largest, and rows without words are kept.
    """
    if not is_file_scan(docs):
        docs = materialise(docs, "join-docs")    # once, so that both sides see the same files
    found = located_classes(docs, ident, text)
    return without_rows(docs, materialise(found.where("NOT first").select("file", "pos"), "join-dropped"), "join-docs")
