"""The registered queries of this subpackage: each applies one operator to its whole table.

The operator does the work and has its own outputs; a query only derives the
columns asked for from them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabscore.llm import (bpe, decontaminate, exact_dedup, filter_audit, hard_negatives, jaccard_join, line_rules,
                          quality, sharding, token_rollup, toxicity, url_filter, warc)
from tabscore.llm.common import F, col, crc_mod, table
from tabscore.session import scratch_path


def op1_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op2_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.archive(table(spark, sf_dir, "pages"))
    return warc.records(warc.chunk_table(spark, path, with_payload=False)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN f.first IS NULL OR f.first = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first <> p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 100
"""


def op3_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert all documents, revise the labelled ones, delete those of low quality; one batch is replayed."""
    docs, labels = token_rollup.counted(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")
    path = scratch_path(spark, "token-rollup")
    token_rollup.commit(token_rollup.signed(docs, "words-v1", 1), path, 0)
    labelled = docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    for _ in range(2):
        token_rollup.commit(token_rollup.revised(labelled, "words-v1", "words-v2"), path, 1)
    poor = docs.join(labels.where("quality = 0").select("doc_id").distinct(), "doc_id", "left_semi")
    token_rollup.commit(token_rollup.signed(poor, "words-v2", -1), path, 2)
    return token_rollup.totals(spark, path)


OP3_SQL = r"""
WITH d AS (
  SELECT source, lang, coalesce(text, '') AS t,
         doc_id IN (SELECT doc_id FROM labels) AS labelled,
         doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) AS poor
  FROM documents),
k AS (
  SELECT source, lang, CASE WHEN labelled THEN 'words-v2' ELSE 'words-v1' END AS tokenizer,
         len(list_filter(string_split_regex(t, CASE WHEN labelled THEN '[^\p{L}\p{N}]+' ELSE '[ \t\r\n]+' END),
                         lambda x: x <> '')) AS n
  FROM d WHERE NOT poor)
SELECT source, lang, tokenizer, count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens
FROM k GROUP BY 1, 2, 3
"""


def op4_url_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op5_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"),
                                 any_case=True).select(
        "doc_id", "item_id", "coverage", "first_word", "same_values")


def op6_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold=crc_mod(F.col("doc_id"), 5) != 0)
    return toxicity.passages(docs, model).select(
        "doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("segments").alias("n_passages"))


def op7_two_pass_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards, shard, slot = sharding.shuffle_into_shards(table(spark, sf_dir, "documents"), shards=40)
    body = F.coalesce(F.col("text"), F.lit(""))
    return shards.select(
        "doc_id", (F.octet_length(body).cast("long") + sharding.RECORD_BYTES).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"),
        col(shard).cast("int").alias("shard"), col(slot).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


def op8_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), fold=crc_mod(F.col("doc_id"), 4) != 2)
    return quality.classify(docs.select("doc_id", "text"), model).select(
        "doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), F.col("quality_score").alias("score"),
        F.col("accepted").cast("int").alias("predicted"))


def op9_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = bpe.round_trip(docs)
    return both.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded_text").cast("binary"), 256).alias("decoded_sha256"))


def op10_streaming_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = exact_dedup.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP10_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))
           AS text_sha256
  FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = filter_audit.failed_filters(table(spark, sf_dir, "documents"))
    return filter_audit.audit(filter_audit.mask_counts(failed, table(spark, sf_dir, "labels")))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w
  FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
f AS (
  SELECT d.part, coalesce(l.good, FALSE) AS good, coalesce(l.toxic, FALSE) AS toxic,
         len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
         100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t) AS c,
         regexp_matches(t, '[#$%&*|]') AS e4, d.doc_id > min(d.doc_id) OVER (PARTITION BY t) AS e5
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
m AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * e4::INT + 16 * coalesce(e5, FALSE)::INT AS mask, count(*) AS n,
         count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM f GROUP BY 1, 2),
x AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)),
o AS (
  SELECT [p.letter, q.letter, r.letter, s.letter, t.letter] AS ls, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bs
  FROM x p, x q, x r, x s, x t WHERE p.bit + q.bit + r.bit + s.bit + t.bit = 31
    AND len(list_distinct([p.bit, q.bit, r.bit, s.bit, t.bit])) = 5),
k AS (
  SELECT array_to_string(ls, '') AS filter_order, CAST(g.i AS INTEGER) AS step, bs[g.i] AS own,
         coalesce(list_sum(bs[1:g.i - 1]), 0)::INT AS before
  FROM o, generate_series(1, 5) g(i))
SELECT m.part, k.filter_order, k.step,
       CAST(coalesce(sum(n) FILTER (mask & (before + own) = 0), 0) AS BIGINT) AS kept,
       CAST(coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before = 0), 0) AS BIGINT) AS removed,
       CAST(coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before <> 0), 0) AS BIGINT) AS redundant,
       CAST(coalesce(sum(n) FILTER (mask = own), 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(sum(good) FILTER (mask & own <> 0 AND mask & before = 0), 0) AS BIGINT) AS good_lost,
       CAST(coalesce(sum(toxic) FILTER (mask & own <> 0 AND mask & before = 0), 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) FILTER (mask & own <> 0), 0) AS BIGINT) AS shapley
FROM m, k GROUP BY 1, 2, 3
"""

def op12_line_frequency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.judged(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "words_left", F.size("removed").cast("long").alias("lines_removed"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w
  FROM documents),
g AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS g FROM d, unnest(range(1, len(w) - 6)) u(i) WHERE len(w) > 8),
h AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM h, range(0, 8) x(k) GROUP BY 1),
x AS (
  SELECT r, host, t, line, list_filter(string_split_regex(line, '[ \t\x0B\f\r]+'), lambda x: x <> '') AS lw
  FROM (SELECT r, host, t, unnest(string_split(t, chr(10))) AS line FROM d)),
l AS (
  SELECT r, host, t, line, len(lw) AS n,
         regexp_replace(translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                        '[0-9]+', '0', 'g') AS norm
  FROM x WHERE len(lw) > 0),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM l GROUP BY 1),
lim AS (SELECT host, greatest(10, floor(count(DISTINCT t) * 0.001)) AS most FROM d GROUP BY 1),
often AS (SELECT host, norm, count(DISTINCT t) AS c FROM l GROUP BY 1, 2),
lost AS (
  SELECT l.r, sum(l.n) AS words, count(*) AS lines
  FROM l JOIN often o ON l.norm = o.norm AND l.host IS NOT DISTINCT FROM o.host
    JOIN lim m ON l.host IS NOT DISTINCT FROM m.host WHERE o.c > m.most GROUP BY 1),
b AS (
  SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words, len(w) - coalesce(lost.words, 0) AS words_left,
         coalesce(lost.lines, 0) AS lines_removed
  FROM d LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN lost USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND words_left >= 20 AND words_left >= 0.5 * n_words AS kept,
       CAST(words_left AS BIGINT) AS words_left, lines_removed
FROM b
"""

def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.index(table(spark, sf_dir, "embeddings"), relabel=moved)
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


OP13_SQL = """
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, a.l = e.l AS same, e.r, e.vec_id,
         CAST(list_dot_product(a.v, e.v) AS BIGINT) AS score
  FROM e a JOIN e ON a.r <> e.r WHERE a.vec_id % 100 = 0),
p AS (
  SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id, r) AS k FROM s WHERE same QUALIFY k <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score,
         s.score AS negative_score,
         row_number() OVER (PARTITION BY p.ar, p.k ORDER BY s.score DESC, s.vec_id, s.r) AS rank
  FROM p JOIN s ON p.ar = s.ar AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
  QUALIFY rank <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chosen_path_join": op1_chosen_path_join,
    "op2_warc_chunks": op2_warc_chunks,
    "op3_token_rollups": op3_token_rollups,
    "op4_url_language_model": op4_url_language_model,
    "op5_template_decontamination": op5_template_decontamination,
    "op6_toxic_segments": op6_toxic_segments,
    "op7_two_pass_sharding": op7_two_pass_sharding,
    "op8_fourier_quality": op8_fourier_quality,
    "op9_backtracking_bpe": op9_backtracking_bpe,
    "op10_streaming_exact_dedup": op10_streaming_exact_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_line_frequency_rules": op12_line_frequency_rules,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE: dict[str, str] = {
    "op2_warc_chunks": OP2_SQL,
    "op3_token_rollups": OP3_SQL,
    "op10_streaming_exact_dedup": OP10_SQL,
    "op11_filter_audit": OP11_SQL,
    "op12_line_frequency_rules": OP12_SQL,
    "op13_hard_negatives": OP13_SQL,
}
