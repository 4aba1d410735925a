"""Registered queries of the text operators, with DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from snipflow.llm import (compact_windows, decision_lists, decontaminate, jaccard_join, line_dedup, merkle, minhash_dedup, mixing, quality,
                          ranked_search, secrets, suffix_dedup, toxicity)
from snipflow.sources.tables import table


def _held_out(mod: int, rest: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(mod)) == rest


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex",
                        F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans", "n_layers", "n_oversized")


def _scored(scored, held, threshold):
    return scored.select("doc_id", held.alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _held_out(5, 0)
    scored = quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held)
    return _scored(scored, held, quality.THRESHOLD)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.dedup_lines(docs).select(
        "doc_id", "source", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", F.size("items").cast("long").alias("n_items"), "items")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.shared_passages(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _held_out(4, 2)
    scored = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held)
    return _scored(scored, held, toxicity.THRESHOLD)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = decision_lists.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", *decision_lists.COUNTS, "base_failed", "kept", "rule")


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    altered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, merkle.leaf_hash(*fields[:4], lower))
    out = merkle.manifest(docs, fields, F.col("doc_id"), F.col("lang"), altered)
    out = out.withColumn("folded_root", merkle.folded(F.col("altered"), F.col("path")))
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_hash(F.col("path")).alias("proof_sha256"),
                      "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def queries():
    return {f.__name__: f for f in (
        op1_secret_scan, op2_quality_classifier, op3_line_dedup, op4_suffix_dedup, op5_decontaminate,
        op6_mixing, op7_compact_windows, op8_toxicity, op9_quality_rules, op10_minhash_dedup,
        op11_jaccard_join, op12_ranked_search, op13_merkle_manifest)}


# Site-relative line frequency: the same ratio and least number of pages as line_dedup.
OP3_SQL = r"""
WITH pages AS (SELECT source, count(*) AS host_pages FROM documents GROUP BY source),
held AS (SELECT source, line, count(*) AS pages
         FROM (SELECT DISTINCT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents)
         WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY source, line),
bad AS (SELECT h.source, list(line) AS drops FROM held h JOIN pages p ON h.source IS NOT DISTINCT FROM p.source
        WHERE pages >= 5 AND pages > 0.1 * host_pages GROUP BY h.source),
d AS (SELECT doc_id, d.source, string_split(text, chr(10)) AS lines,
             list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(coalesce(b.drops, []), x)) AS kept
      FROM documents d LEFT JOIN bad b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(lines) - len(kept), 0) AS BIGINT) AS n_dropped,
       sha256(array_to_string(kept, chr(10))) AS kept_sha256
FROM d
"""


# Links by counting common shingles of all pairs that share one; components by recursion.
OP11_SQL = r"""
WITH RECURSIVE
words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM words),
item AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM item a JOIN item b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(b, s.doc_id)) AS component_id
FROM sets s LEFT JOIN low ON low.a = s.doc_id
"""

# Every document scored in full.
OP12_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
docs AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n, w FROM words WHERE len(w) > 0),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM docs),
tf AS (SELECT doc_id, any_value(n) AS n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM docs) GROUP BY doc_id, term),
item AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY item_id, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM tf, corpus WHERE term IN (SELECT term FROM item) GROUP BY term),
scored AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total)))) AS BIGINT) AS score
  FROM item JOIN weights USING (term) JOIN tf USING (term), corpus GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""

# The tree by recursion over its nodes, every proof by joining a leaf's ancestors with their runs.
OP13_SQL = r"""
WITH RECURSIVE
field(doc_id, lang, f1, f2, f3, f4, text) AS (
  SELECT doc_id, lang, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
         coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-'), text FROM documents),
crc_step(i, k, c) AS (
  SELECT i, 0, CAST(i AS BIGINT) FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_step WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc_step WHERE k = 8),
crc(doc_id, crc) AS (
  SELECT doc_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
         lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) FROM (SELECT DISTINCT doc_id FROM documents), crc_table),
leaves AS (
  SELECT f.doc_id, lang, sha256(f1 || f2 || f3 || f4 || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN crc % 3 = 0 THEN sha256(f1 || f2 || f3 || f4 || coalesce(strlen(text) || ':' ||
              translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS altered
  FROM field f LEFT JOIN crc c ON f.doc_id IS NOT DISTINCT FROM c.doc_id),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n,
         dense_rank() OVER (ORDER BY coalesce(hex(lang), '')) - 1 AS g FROM leaves),
low(g, level, pos, n, digest) AS (
  SELECT g, 0, pos, n, leaf FROM placed
  UNION ALL SELECT g, level + 1, pos // 8, (max(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY g, level, pos // 8),
sub AS (SELECT g, digest, count(*) OVER () AS n FROM low WHERE n = 1),
high(level, pos, n, digest) AS (
  SELECT 0, g, n, digest FROM sub
  UNION ALL SELECT level + 1, pos // 8, (max(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY level, pos // 8),
-- a run of siblings per node: level, place, what stands left and right of it
low_beside AS (
  SELECT g, level, pos, n, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM low WINDOW w AS (PARTITION BY g, level, pos // 8 ORDER BY pos)),
high_beside AS (
  SELECT level, pos, n, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM high WINDOW w AS (PARTITION BY level, pos // 8 ORDER BY pos)),
climb(g, leaf_pos, level, pos, done, acc, proof, above) AS (
  SELECT g, pos, 0, pos, n = 1, coalesce(altered, leaf), '', FALSE FROM placed
  UNION ALL
  SELECT c.g, c.leaf_pos, CASE WHEN c.done THEN 0 ELSE c.level + 1 END,
         CASE WHEN c.done THEN c.g ELSE c.pos // 8 END,
         CASE WHEN c.done THEN (SELECT max(n) FROM sub) = 1 WHEN c.above THEN (h.n + 7) // 8 = 1 ELSE (b.n + 7) // 8 = 1 END,
         CASE WHEN c.done THEN c.acc WHEN c.above THEN sha256(h.l || c.acc || h.r) ELSE sha256(b.l || c.acc || b.r) END,
         CASE WHEN c.done THEN c.proof WHEN c.above THEN c.proof || h.l || h.r ELSE c.proof || b.l || b.r END,
         c.above OR c.done
  FROM climb c LEFT JOIN low_beside b ON NOT c.above AND NOT c.done AND b.g = c.g AND b.level = c.level AND b.pos = c.pos
       LEFT JOIN high_beside h ON c.above AND NOT c.done AND h.level = c.level AND h.pos = c.pos
  WHERE NOT (c.above AND c.done))
SELECT p.doc_id, p.leaf, s.digest AS subroot, r.digest AS root, sha256(c.proof) AS proof_sha256, c.acc AS folded_root, c.acc = r.digest AS verified
FROM placed p JOIN climb c ON c.g = p.g AND c.leaf_pos = p.pos AND c.above AND c.done
JOIN sub s ON s.g = p.g JOIN (SELECT digest FROM high WHERE n = 1) r ON TRUE
"""


def oracle() -> dict[str, str]:
    return {"op3_line_dedup": OP3_SQL, "op11_jaccard_join": OP11_SQL, "op12_ranked_search": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
