"""Filter interaction audit: what each of five filters removes, in every order they could be applied.

Method: a counting-Bloom prepass in front of the exact duplicate test.

1. One pass over the texts writes a narrow row per document: id, part, the
   bits of filters A to D and a 64-bit hash of the text.
2. From the hashes alone a counting Bloom filter is built: each text adds one
   to ``PROBES`` cells of one 64-cell word.  Tasks count their own cells, the
   counts are merged by cell, and a word keeps the cells counted twice or
   more.  A text with any cell counted once is certainly unique.
3. Only the texts that may repeat are read again and shuffled: grouped by the
   whole text, with the smallest id of each (copies meet in their task first,
   so a text held by a third of the rows sends one row a task).
4. A possible repeat that is not its text's smallest id fails E.  The flags
   join with these ids and the labels on the id, and are summed to counts by
   (part, mask of failed filters).  All 120 orders follow from the at most 32
   counts of a part: what is left after a set of filters is the sum over the
   masks that avoid it.

The filter's size follows the number of documents (``CELLS_PER_TEXT``).  Its
words are broadcast while they measure below the bound of ``common.small``,
else joined by shuffle; either way false alarms only cost a shuffle, never a
count.  Nothing but row counts reaches the driver.

Defined results: null texts are empty texts; a null part is the part ``''``;
a null id sorts after every id and null ids do not precede each other; rows
that repeat id and text are equally first, so none of them fails E for the
other; repeated labels of an id are joined with OR; texts of any length are
taken whole; an empty table gives an empty audit; only the three named
columns of ``docs`` (and of ``labels``) are read, so no other column's name
can clash.  Hashes decide nothing alone: texts are compared whole.  (An id
that two different texts share is told apart by the text's 64-bit hash.)
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame

from tabscore.llm.common import F, col, materialise, small

FILTERS = "ABCDE"
BIT = {f: 1 << i for i, f in enumerate(FILTERS)}

#: Fixed values of the filters.
MIN_WORDS = 200             # A: fewer words
MIN_DISTINCT_PERCENT = 50   # B: fewer distinct words in a hundred
MAX_CAPITAL_PERCENT = 2     # C: more capitals in a hundred code points
SYMBOLS = "[#$%&*|]"        # D: any of these
SPACE = r"[ \t\n\x0B\f\r]+"

#: The counting Bloom filter: cells per text, cells per word (the bits of a long), cells a text counts in.
CELLS_PER_TEXT, WORD_CELLS, PROBES = 16, 64, 3
#: Bytes of one word in a broadcast table (key, bits, hash slot), for the size check.
WORD_BYTES = 48


def flag_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(id, part, mask, h) of each row: the bits of filters A to D it fails, and its text's hash."""
    body = docs.select(col(doc_id).alias("id"), F.coalesce(col(part).cast("string"), F.lit("")).alias("part"),
                       F.coalesce(col(text), F.lit("")).alias("body"))
    body = body.withColumn("words", F.array_remove(F.split("body", SPACE), ""))
    n = F.size("words")
    capitals = F.length(F.regexp_replace("body", "[^A-Z]+", ""))
    fails = {"A": n < MIN_WORDS,
             "B": 100 * F.size(F.array_distinct("words")) < MIN_DISTINCT_PERCENT * n,
             "C": 100 * capitals.cast("long") > MAX_CAPITAL_PERCENT * F.length("body").cast("long"),
             "D": F.col("body").rlike(SYMBOLS)}
    mask = sum((F.when(fails[f], F.lit(BIT[f])).otherwise(F.lit(0)) for f in fails), F.lit(0))
    return body.select("id", "part", mask.cast("int").alias("mask"), F.xxhash64("body").alias("h"))


def _word(h: Column, words: int) -> Column:
    return F.pmod(h, F.lit(words))


def _cells(h: Column) -> list[Column]:
    """The ``PROBES`` cells (0 to 63) a text counts in, from a second hash."""
    g = F.xxhash64(h, F.lit(1))
    return [F.shiftright(g, 6 * i).bitwiseAND(F.lit(WORD_CELLS - 1)).cast("int") for i in range(PROBES)]


def _bits(cells: list[Column]) -> Column:
    out = F.lit(0).cast("long")
    for c in cells:
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), c))
    return out


def bloom_words(texts: int) -> int:
    return max(1, -(-texts * CELLS_PER_TEXT // WORD_CELLS))


def counting_bloom(rows: DataFrame, words: int) -> DataFrame:
    """(word, repeated): of each word the cells that were counted twice or more, as bits.

    ``rows`` has a column ``h`` (one text hash a row).
    """
    counts = (rows.select(_word(F.col("h"), words).alias("word"),
                          F.explode(F.array_distinct(F.array(*_cells(F.col("h"))))).alias("cell"))
              .groupBy("word", "cell").agg(F.count("*").alias("n")))
    return (counts.where("n >= 2").groupBy("word")
            .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("cell"))).alias("repeated")))


def may_repeat(rows: DataFrame, bloom: DataFrame, words: int, keep: bool) -> DataFrame:
    """The rows (column ``h``) whose cells all repeat; with ``keep`` all rows, and a column ``maybe``."""
    asked = _bits(_cells(F.col("h")))
    joined = rows.withColumn("word", _word(F.col("h"), words)).join(bloom, "word", "left" if keep else "inner")
    maybe = F.coalesce(F.col("repeated").bitwiseAND(asked) == asked, F.lit(False))
    if keep:
        return joined.withColumn("maybe", maybe).drop("word", "repeated")
    return joined.where(maybe).drop("word", "repeated")


def failed_filters(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(id, part, mask) of every row: all five filters, each judged on the whole table."""
    flags = materialise(flag_rows(docs, doc_id, text, part), "audit-flags")
    words = bloom_words(flags.count())
    bloom, _ = small(materialise(counting_bloom(flags.select("h"), words), "audit-bloom"), WORD_BYTES)
    body = docs.select(col(doc_id).alias("id"), F.coalesce(col(text), F.lit("")).alias("body"))
    body = body.withColumn("h", F.xxhash64("body"))
    firsts = (may_repeat(body, bloom, words, keep=False).groupBy("h", "body").agg(F.min("id").alias("first_id"))
              .select(F.col("h").alias("first_h"), "first_id"))
    firsts = materialise(firsts, "audit-firsts")
    marked = may_repeat(flags, bloom, words, keep=True)
    repeats = marked.where("maybe").join(
        firsts, (F.col("h") == F.col("first_h")) & F.col("id").eqNullSafe(F.col("first_id")), "left")
    repeated = repeats.select("id", "part", F.when(F.col("first_h").isNull(), F.col("mask") + BIT["E"])
                              .otherwise(F.col("mask")).alias("mask"))
    return marked.where("NOT maybe").select("id", "part", "mask").unionByName(repeated)


def mask_counts(failed: DataFrame, labels: DataFrame, doc_id: str = "doc_id", good: str = "quality",
                toxic: str = "toxic") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the set of filters they fail."""
    marks = (labels.select(col(doc_id).alias("label_id"), (col(good) == 1).alias("g"), (col(toxic) == 1).alias("t"))
             .groupBy("label_id").agg(F.max("g").alias("g"), F.max("t").alias("t")))
    rows = failed.join(marks, F.col("id") == F.col("label_id"), "left")
    return rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("g").alias("good"),
                                            F.count_if("t").alias("toxic"))


def audit(counts: DataFrame) -> DataFrame:
    """Per part, order of the filters and step: what the step's filter does there."""
    sets = F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1))

    def left(field: str) -> Column:
        """By set of filters (as bits): the sum over the documents that fail none of it."""
        return F.transform(sets, lambda s: F.aggregate(
            F.filter("m", lambda x: x["mask"].bitwiseAND(s) == 0), F.lit(0).cast("long"), lambda a, x: a + x[field]))

    parts = (counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("m"))
             .select("part", "m", left("n").alias("left_n"), left("good").alias("left_good"),
                     left("toxic").alias("left_toxic")))
    orders = ",".join("".join(p) for p in permutations(FILTERS))
    rows = parts.withColumn("filter_order", F.explode(F.split(F.lit(orders), ",")))
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))

    def bits(letters: Column) -> Column:
        return sum((F.when(F.contains(letters, F.lit(f)), F.lit(BIT[f])).otherwise(F.lit(0)) for f in FILTERS), F.lit(0))

    rows = rows.withColumn("own", bits(F.substring("filter_order", F.col("step"), F.lit(1))))
    rows = rows.withColumn("before", bits(F.substring("filter_order", F.lit(1), F.col("step") - 1)))
    own, before = F.col("own"), F.col("before")
    after = before.bitwiseOR(own)

    def at(name: str, bitset: Column) -> Column:
        return F.get(name, bitset)

    removed = at("left_n", before) - at("left_n", after)
    zero = F.lit(0).cast("long")
    # of the 120 orders, a document is removed by each filter it fails in equally many (120, 60, 40, 30 or 24)
    share = F.aggregate(F.filter("m", lambda x: x["mask"].bitwiseAND(own) != 0), zero,
                        lambda a, x: a + x["n"] * F.round(F.lit(120) / F.bit_count(x["mask"])).cast("long"))
    return rows.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), at("left_n", after).alias("kept"),
        removed.alias("removed"), (at("left_n", F.lit(0)) - at("left_n", own) - removed).alias("redundant"),
        F.aggregate(F.filter("m", lambda x: x["mask"] == own), zero, lambda a, x: a + x["n"]).alias("unique_fails"),
        (at("left_good", before) - at("left_good", after)).alias("good_lost"),
        (at("left_toxic", before) - at("left_toxic", after)).alias("toxic_lost"), share.alias("shapley"))
