"""Queries of the corpus operators: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentscope.llm import bpe, conversations, decontaminate, html_text, langid, line_dedup, lm, merkle, rules, simhash, subspace, substrings, token_store
from rentscope.llm.words import shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op1_simhash_near_dedup")
def op1(spark, sf_dir):
    groups = simhash.near_groups(_documents(spark, sf_dir), width=3, radius=3)
    return groups.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


@query("op6_token_store")
def op6(spark, sf_dir):
    folder = shared_path(spark, "tokens")
    token_store.write(_documents(spark, sf_dir), folder, public_tokenizers.path("word_bpe_49k.json"))
    return token_store.documents(token_store.read(spark, folder)).withColumnRenamed("id", "doc_id")


@query("op7_byte_bpe")
def op7(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(_documents(spark, sf_dir), path, public_tokenizers.PATTERN)
    return bpe.decode(encoded, path).select(
        F.col("id").alias("doc_id"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


@query("op10_language_id")
def op10(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    out = langid.held_out(docs)
    learned = langid.samples(docs.filter(~out))
    return langid.predict(docs.withColumn("held_out", out), learned, ["doc_id", "held_out"])


@query("op9_substring_dedup")
def op9(spark, sf_dir):
    out = substrings.drop_repeats(_documents(spark, sf_dir), width=20)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op3_line_dedup", """
WITH raw AS (SELECT doc_id, text, unnest(str_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(str_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
lines AS (SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM raw),
filled AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS ord FROM lines WHERE line <> ''),
ahead AS (SELECT a.doc_id, a.pos, a.ord, b.ord AS last, sum(length(b.line)) OVER w AS chars, string_agg(b.line, chr(10)) OVER w AS run
  FROM filled a JOIN filled b ON a.doc_id = b.doc_id AND b.ord BETWEEN a.ord AND a.ord + 15
  WINDOW w AS (PARTITION BY a.doc_id, a.ord ORDER BY b.ord)),
later AS (SELECT * FROM ahead WHERE chars >= 16 QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, ord) > 1),
gone AS (SELECT DISTINCT f.doc_id, f.pos FROM later l JOIN filled f ON f.doc_id = l.doc_id AND f.ord BETWEEN l.ord AND l.last)
SELECT r.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed, coalesce(string_agg(r.line, chr(10) ORDER BY r.pos) FILTER (g.pos IS NULL), '') AS text
FROM raw r LEFT JOIN gone g ON g.doc_id = r.doc_id AND g.pos = r.pos GROUP BY r.doc_id
""")
def op3(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    n_lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines")
    out = line_dedup.drop_repeated_lines(docs.select("doc_id", "text", n_lines))
    return out.select("doc_id", "n_lines", F.size("removed_lines").cast("long").alias("n_removed"), "text")


@query("op8_decontaminate")
def op8(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.leaks(_documents(spark, sf_dir), items)
    return found.select(F.col("id").alias("doc_id"), "item_id", "start", "n_words", "similarity")


@query("op5_quality_rules")
def op5(spark, sf_dir):
    rows = rules.judged(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rows.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


@query("op2_html_text")
def op2(spark, sf_dir):
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), ["page_id", "url"])


@query("op4_lm_scores")
def op4(spark, sf_dir):
    out = lm.score(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.withColumnRenamed("id", "doc_id")


@query("op12_merkle_manifest", """
WITH RECURSIVE steps(i, c, k) AS (
  SELECT i, i, 0 FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
bytes AS (SELECT i, c FROM steps WHERE k = 8),
crc(s, idx, c) AS (
  SELECT DISTINCT CAST(doc_id AS VARCHAR), 0, 4294967295 FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT s, idx + 1, xor(crc.c >> 8, bytes.c) FROM crc JOIN bytes ON bytes.i = xor(crc.c & 255, ascii(s[idx + 1])) WHERE idx < length(s)),
even AS (SELECT CAST(s AS BIGINT) AS doc_id FROM crc WHERE idx = length(s) AND xor(c, 4294967295) % 2 = 0),
written AS (
  SELECT doc_id, source, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head, text,
    CASE WHEN doc_id IN (SELECT doc_id FROM even) THEN replace(text, chr(10), '') ELSE text END AS now
  FROM documents),
leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(now) || ':' || now, '-')) AS seen
  FROM written),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaves),
nodes(source, lvl, pos, h, n) AS (
  SELECT source, 0, pos, leaf, n FROM placed
  UNION ALL SELECT source, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM nodes WHERE n > 1 GROUP BY source, lvl, pos // 3, n),
subroots AS (
  SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS seat, count(*) OVER () AS sources FROM nodes WHERE n = 1),
tops(lvl, pos, h, n) AS (
  SELECT 0, seat, subroot, sources FROM subroots
  UNION ALL SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM tops WHERE n > 1 GROUP BY lvl, pos // 3, n),
runs AS (
  SELECT a.source, a.lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS ahead,
    coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS behind
  FROM nodes a JOIN nodes b ON a.source IS NOT DISTINCT FROM b.source AND a.lvl = b.lvl AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY ALL),
top_runs AS (
  SELECT a.lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS ahead,
    coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS behind
  FROM tops a JOIN tops b ON a.lvl = b.lvl AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY ALL),
inner_fold(source, pos, up, lvl, proof, h) AS (
  SELECT source, pos, pos, 0, '', seen FROM placed
  UNION ALL SELECT f.source, f.pos, f.up // 3, f.lvl + 1, f.proof || r.ahead || r.behind, sha256(r.ahead || f.h || r.behind)
  FROM inner_fold f JOIN runs r ON r.source IS NOT DISTINCT FROM f.source AND r.lvl = f.lvl AND r.pos = f.up),
inner_done AS (SELECT * FROM inner_fold QUALIFY row_number() OVER (PARTITION BY source, pos ORDER BY lvl DESC) = 1),
outer_fold(source, pos, up, lvl, proof, h) AS (
  SELECT d.source, d.pos, s.seat, 0, d.proof, d.h FROM inner_done d JOIN subroots s ON s.source IS NOT DISTINCT FROM d.source
  UNION ALL SELECT f.source, f.pos, f.up // 3, f.lvl + 1, f.proof || r.ahead || r.behind, sha256(r.ahead || f.h || r.behind)
  FROM outer_fold f JOIN top_runs r ON r.lvl = f.lvl AND r.pos = f.up),
outer_done AS (SELECT * FROM outer_fold QUALIFY row_number() OVER (PARTITION BY source, pos ORDER BY lvl DESC) = 1)
SELECT p.doc_id, p.leaf, s.subroot, t.h AS root, sha256(o.proof) AS proof_sha256, o.h AS folded_root, o.h = t.h AS verified
FROM placed p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source JOIN outer_done o ON o.source IS NOT DISTINCT FROM p.source AND o.pos = p.pos
CROSS JOIN (SELECT h FROM tops WHERE n = 1) t
""")
def op12(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    now = F.when(tampered, F.translate("text", "\n", "")).otherwise(F.col("text"))
    head = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    rows = docs.select(
        F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("_order"), merkle.group_key(F.col("source")).alias("tree"),
        merkle.leaf_digest(*head, F.col("text")).alias("leaf"), merkle.leaf_digest(*head, now).alias("seen"),
    )
    return merkle.manifest(rows).select(
        F.col("id").cast("long").alias("doc_id"), "leaf", "subroot", "root", F.sha2(F.array_join("others", ""), 256).alias("proof_sha256"), "folded_root",
        "verified",
    )


@query("op13_embedding_near_dedup")
def op13(spark, sf_dir):
    out = subspace.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), least=0.95)
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


@query("op11_conversation_repair")
def op11(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversations.repaired(conversations.damaged(rows), rows)
