"""URL filters: rules first, then a ratio of two character language models.

Rules name a host (and all its subdomains) and the beginning of a path; the
longest that fits decides.  URLs that a rule accepts train one model, those a
rule rejects the other.  Both are variable-order Markov models over
characters: the probability of a character after its longest context is
smoothed by that after the context one shorter, down to a uniform alphabet:

    P(x | c) = (n(cx) + STRENGTH * P(x | shorter c)) / (n(c) + STRENGTH)

A context is only extended where it was seen ``MIN_CONTEXT`` times in either
model.  A URL no rule fits scores the mean over its characters of
log P(accepted) - log P(rejected), and is allowed from a threshold up that is
calibrated on URLs kept out of the counts.

All work is DataFrame operations.  Counting combines per character sequence in
every task.  Scoring explodes a URL into its positions, looks each up in the
table of resolved ratios (at most ``ORDER`` + 1 equi-joins: broadcast while
the table's measured size is small, shuffled beyond) and adds up per URL.

Defined results: a null URL, or one without ``://``, has empty host and path
and fits no rule; the empty URL scores 0.  Where rules give no URL of one
side, both models are equal, every score is 0 and the threshold is 0, so URLs
without a rule are allowed.  Equal URLs get equal verdicts; an empty table
gives an empty result; URLs of any length are scored whole; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from tabscore.llm.common import F, col, materialise, small

#: (host, path, verdict) in the order they are listed.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))
ORDER = 4               # characters of context
STRENGTH = 4.0          # weight of the shorter context
MIN_CONTEXT = 3
ALPHABET = 1000.0       # uniform floor: 1 / ALPHABET
HELD_OUT = 5            # one URL in so many calibrates
GRID = 2000             # calibration bins
SPAN = 5.0              # of scores in -SPAN .. SPAN
SEED = 4
#: Stands before a URL's first character, so that beginnings have contexts too.
START = "\u0002"


def host_of(url: Column) -> Column:
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def grams(url: Column, n: int) -> Column:
    """The URL's characters, each with up to ``n`` - 1 before it (sequences of ``n`` characters)."""
    padded = F.concat(F.lit(START * ORDER), url)
    k = F.char_length(url)
    return F.when(k > 0, F.transform(F.sequence(F.lit(1), k),
                                     lambda i: F.substring(padded, i + (ORDER - n + 1), F.lit(n)))
                  ).otherwise(F.array().cast("array<string>"))


def model_table(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, ratio): log P(accepted) - log P(rejected) of a sequence's last character after the rest.

    ``urls`` has url, accepted and n (how often it occurs).  Orders are
    resolved from the shortest up; a sequence longer than one character is
    listed where its context is frequent enough.  Each order's table is
    written before the next one joins it.
    """
    table, below = None, None
    for k in range(1, order + 2):
        exploded = urls.select("accepted", "n", F.explode(grams(F.col("url"), k)).alias("gram"))
        count = exploded.groupBy("gram").agg(
            F.sum(F.when(F.col("accepted"), F.col("n")).otherwise(0)).alias("a"),
            F.sum(F.when(F.col("accepted"), 0).otherwise(F.col("n"))).alias("r"))
        count = count.withColumn("context", F.substring("gram", 1, k - 1))
        context = count.groupBy("context").agg(F.sum("a").alias("ca"), F.sum("r").alias("cr"))
        if k == 1:
            # one context: its totals are two sums
            totals = urls.agg(F.coalesce(F.sum(F.when(F.col("accepted"), F.col("n") * F.char_length("url"))), F.lit(0)),
                              F.coalesce(F.sum(F.when(~F.col("accepted"), F.col("n") * F.char_length("url"))),
                                         F.lit(0))).first()
            full = count.withColumns({"ca": F.lit(totals[0]), "cr": F.lit(totals[1]),
                                      "pa0": F.lit(1.0 / ALPHABET), "pr0": F.lit(1.0 / ALPHABET)})
        else:
            context = context.where((F.col("ca") >= MIN_CONTEXT) | (F.col("cr") >= MIN_CONTEXT))
            full = count.join(context, "context").join(
                below.select(F.col("gram").alias("short"), F.col("pa").alias("pa0"), F.col("pr").alias("pr0")),
                F.substring("gram", 2, k - 1) == F.col("short"))
        smooth = lambda n, c, p: (F.col(n) + STRENGTH * F.col(p)) / (F.col(c) + STRENGTH)
        below = materialise(full.select("gram", smooth("a", "ca", "pa0").alias("pa"),
                                        smooth("r", "cr", "pr0").alias("pr")), f"url-order{k}")
        step = below.select("gram", (F.log("pa") - F.log("pr")).alias("ratio"))
        table = step if table is None else table.unionByName(step)
    return materialise(table, "url-model")


def scored(urls: DataFrame, model: DataFrame, order: int = ORDER) -> DataFrame:
    """(url, score) of each distinct URL: the mean ratio of the longest listed sequence ending at each character."""
    side, _ = small(model, 40)
    at = urls.select("url", F.explode(grams(F.col("url"), order + 1)).alias("gram"))
    best = F.lit(None).cast("double")
    for k in range(order + 1, 0, -1):
        key, value = f"_g{k}", f"_r{k}"
        at = at.join(side.where(F.char_length("gram") == k).select(F.col("gram").alias(key), F.col("ratio").alias(value)),
                     F.substring("gram", order + 2 - k, k) == F.col(key), "left")
        best = F.coalesce(best, F.col(value))
    return at.select("url", F.coalesce(best, F.lit(0.0)).alias("ratio")).groupBy("url").agg(
        F.avg("ratio").alias("score"))


def threshold(known: DataFrame) -> float:
    """Where accepted and rejected calibration URLs separate best (share of each kept right, equal weights).

    A histogram of fixed size reaches the driver; of equally good cuts the
    middle one is taken.  Without both kinds the threshold is 0.
    """
    b = F.least(F.greatest(F.floor((F.col("score") + SPAN) / (2 * SPAN / GRID)), F.lit(0)), F.lit(GRID - 1))
    counts = [[0, 0] for _ in range(GRID)]
    for r in known.groupBy(b.cast("int").alias("b"), "accepted").agg(F.sum("n").alias("n")).collect():
        counts[r["b"]][int(r["accepted"])] += r["n"]
    bad, good = (sum(c[i] for c in counts) for i in (0, 1))
    if not bad or not good:
        return 0.0
    gain, best, where = 0.0, -math.inf, []
    for k in range(GRID + 1):
        if gain > best + 1e-12:
            best, where = gain, [k]
        elif abs(gain - best) <= 1e-12:
            where.append(k)
        if k < GRID:
            gain += counts[k][0] / bad - counts[k][1] / good
    # the first run of equally good cuts
    run = [k for i, k in enumerate(where) if k - where[0] == i]
    return -SPAN + 2 * SPAN / GRID * (run[0] + run[-1]) / 2


def judge(pages: DataFrame, ident: str = "page_id", url: str = "url",
          rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score (null where a rule decided) of every row."""
    u = col(url).cast("string")
    rows = pages.select(col(ident).alias("page_id"), F.coalesce(u, F.lit("")).alias("url"), host_of(u).alias("host"),
                        path_of(u).alias("path"))
    rows = rows.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    ruled = rows.where(F.col("r").isNotNull()).groupBy("url").agg(
        F.count("*").alias("n"), F.max(F.col("r.verdict") == "allow").alias("accepted"))
    ruled = materialise(ruled.withColumn("held", F.pmod(F.xxhash64(F.lit(SEED), "url"), F.lit(HELD_OUT)) == 0), "url-ruled")
    model = model_table(ruled.where(~F.col("held")))
    cut = threshold(ruled.where("held").join(scored(ruled.where("held"), model), "url"))
    open_urls = rows.where(F.col("r").isNull()).select("url").distinct()
    found = materialise(scored(open_urls, model), "url-scores")
    side, _ = small(found, 120)
    # an empty URL has no position to score
    return rows.join(side, (rows["url"] == side["url"]) & rows["r"].isNull(), "left").select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"),
        F.coalesce("r.verdict", F.when(F.coalesce("score", F.lit(0.0)) >= cut, "allow").otherwise("block"))
        .alias("verdict"), F.when(F.col("r").isNull(), F.coalesce("score", F.lit(0.0))).alias("score"))
