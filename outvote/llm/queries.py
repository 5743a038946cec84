"""The registered query of each operator, over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outvote.llm.conversation_trie import prefix_trie
from outvote.llm.curriculum_mix import mix
from outvote.llm.hamming_search import sign_code, top_k
from outvote.llm.html_text import extract
from outvote.llm.jaccard_join import jaccard_join
from outvote.llm.kd_shards import shard_documents
from outvote.llm.line_dedup import dedup_lines
from outvote.llm.lm_scoring import score_texts
from outvote.llm.merkle_manifest import manifest
from outvote.llm.packing import pack
from outvote.llm.quality_ratio import judge
from outvote.llm.token_files import document_tokens
from outvote.llm.tokens import default_tokenizer
from outvote.llm.toxicity import score


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def toxicity(spark: SparkSession, folder: str) -> DataFrame:
    scored = score(_table(spark, folder, "documents").select("doc_id", "text"), _table(spark, folder, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def hamming_topk(spark: SparkSession, folder: str) -> DataFrame:
    codes = _table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), sign_code("embedding").alias("code"))
    return top_k(codes, codes.filter("id % 50 = 0"), k=10).withColumnRenamed("id", "vec_id")


def html_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract(_table(spark, folder, "pages").select("page_id", "url", "html"))


def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = judge(_table(spark, folder, "documents").select("doc_id", "text"), _table(spark, folder, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def kd_shards(spark: SparkSession, folder: str) -> DataFrame:
    sharded = shard_documents(_table(spark, folder, "documents"))
    return sharded.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return document_tokens(_table(spark, folder, "documents"), tokenizer=default_tokenizer())


def packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(_table(spark, folder, "documents"), tokenizer=default_tokenizer())


def curriculum_mix(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mix(_table(spark, folder, "documents"))
    result = mixed.select("doc_id", "size", "source_size", "target", "taken", "first_position")
    ordered = result.repartitionByRange("first_position", "doc_id").sortWithinPartitions("first_position", "doc_id")
    return ordered.drop("first_position")


def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = dedup_lines(_table(spark, folder, "documents").select("doc_id", "text"))
    kept = F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256)
    return cleaned.select("doc_id", "n_lines", "n_dropped", kept.alias("kept_sha256"))


def jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join(_table(spark, folder, "documents"))


def conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie(_table(spark, folder, "conversations"))


def merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return manifest(_table(spark, folder, "documents")).withColumn("proof", F.sha2("proof", 256)).withColumnRenamed("proof", "proof_sha256")


def lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return score_texts(_table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": toxicity,
    "op2_hamming_topk": hamming_topk,
    "op3_html_text": html_text,
    "op4_kd_shards": kd_shards,
    "op5_token_counts": token_counts,
    "op6_packing": packing,
    "op7_quality_rules": quality_rules,
    "op8_curriculum_mix": curriculum_mix,
    "op9_line_dedup": line_dedup,
    "op10_jaccard_join": jaccard,
    "op11_conversation_trie": conversation_trie,
    "op12_merkle_manifest": merkle_manifest,
    "op13_lm_scoring": lm_scoring,
}

_MIX = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents),
sums AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM docs GROUP BY source),
-- the level at which the targets of the sources that are not full add up
levels AS (
  SELECT l.source, (max(t.total) - 2 * coalesce(sum(s.source_size) FILTER (s.source_size * l.w < l.source_size * s.w), 0))
         / sum(s.w) FILTER (s.source_size * l.w >= l.source_size * s.w) AS level
  FROM sums l, sums s, (SELECT sum(source_size) * 150 / 100.0 AS total FROM sums) t GROUP BY l.source),
marked AS (
  SELECT s.*, level, s.w * level >= 2 * source_size AS is_full,
         min(level) FILTER (s.w * level < 2 * source_size) OVER (ORDER BY s.source_size / s.w, s.source) AS unused
  FROM sums s JOIN levels l ON s.source IS NOT DISTINCT FROM l.source),
targets AS (
  SELECT source, source_size, w, CASE WHEN is_full THEN 2.0::DOUBLE * source_size
         ELSE w * (SELECT arg_min(level, source_size / w) FROM marked WHERE NOT is_full) END AS target
  FROM marked),
placed AS (
  SELECT doc_id, d.source, size, source_size, target,
         (sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::DOUBLE + size / 2 AS place
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target::DOUBLE AS target,
       (size * ((place <= target)::INT + (place + source_size <= target)::INT))::BIGINT AS taken
FROM placed
"""

_LINES = r"""
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
holders AS (SELECT k, min(doc_id) AS holder FROM keyed WHERE length(k) >= 10 GROUP BY k),
kept AS (SELECT keyed.*, holder IS NULL OR holder >= doc_id AS keeps FROM keyed LEFT JOIN holders ON keyed.k = holders.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT keeps) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (keeps), '')) AS kept_sha256
FROM kept GROUP BY doc_id, text
"""

#: Bits as ones and zeros; the distance of two codes is the ones of their exclusive or.
_HAMMING = """
WITH codes AS (
  SELECT vec_id,
         array_to_string(list_transform(generate_series(1, 64), lambda i: CASE WHEN coalesce(embedding[i], 0) > 0 THEN '1' ELSE '0' END), '')::BIT AS code
  FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
pairs AS (
  SELECT q.vec_id, r.vec_id AS neighbour, bit_count(xor(q.code, r.code))::BIGINT AS distance
  FROM codes q, codes r WHERE q.vec_id % 50 = 0 AND q.vec_id != r.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour)::INT AS rank FROM pairs)
SELECT vec_id, rank, neighbour, distance FROM ranked WHERE rank <= 10
"""

#: crc32 of a text of digits: its table (from the polynomial), then a byte at a time.
_CRC_TABLE = """
crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
         lambda c, x: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))) AS crcs)"""


def _crc32(text: str) -> str:
    codes = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295)"


#: A path is the text of a prefix; nodes are grouped by it and summed over paths that begin so.
_TRIE = f"""
WITH {_CRC_TABLE},
turns AS (
  SELECT conv_id, hex(coalesce(role, '')) || '.' || hex(coalesce(text, '')) || '/' AS t, strlen(coalesce(text, '')) AS bytes,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), text) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_crc32("conv_id::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM turns), crc_table),
mixed AS (
  SELECT c.conv_id, 0 AS own, t.pos, t.t, t.bytes FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos < c.h
  UNION ALL
  SELECT c.conv_id, 1, t.pos, t.t, t.bytes FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos >= c.h),
placed AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth, t, bytes FROM mixed),
lengths AS (SELECT c.conv_id, coalesce(max(depth), 0) AS d FROM convs c LEFT JOIN placed p ON p.conv_id = c.conv_id GROUP BY c.conv_id),
paths AS (
  SELECT conv_id, 0 AS depth, '' AS path, 0 AS bytes FROM convs
  UNION ALL
  SELECT conv_id, depth, string_agg(t, '') OVER (PARTITION BY conv_id ORDER BY depth), bytes FROM placed),
nodes AS (
  SELECT path, p.depth, min(p.conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes,
         coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (l.d = p.depth), '') AS ends
  FROM paths p JOIN lengths l ON l.conv_id = p.conv_id GROUP BY path, p.depth),
links AS (
  SELECT n.*, m.path AS up, m.conv_id AS parent_conv_id
  FROM nodes n JOIN paths o ON o.conv_id = n.conv_id AND o.depth = n.depth
  LEFT JOIN paths u ON u.conv_id = n.conv_id AND u.depth = n.depth - 1 LEFT JOIN nodes m ON m.path = u.path),
children AS (SELECT up, count(*) AS n FROM links WHERE up IS NOT NULL GROUP BY up),
full_nodes AS (SELECT l.*, coalesce(c.n, 0) AS n_children FROM links l LEFT JOIN children c ON c.up = l.path),
sums AS (
  SELECT a.path, count(*) FILTER (f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.bytes) AS saved
  FROM full_nodes f JOIN paths a ON a.conv_id = f.conv_id AND a.depth <= f.depth GROUP BY a.path)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved::BIGINT AS saved_tokens, sha256(ends) AS ends_sha256
FROM full_nodes f JOIN sums s ON s.path = f.path
"""


def _merkle(height: int = 7) -> str:
    """height: levels per tree, enough for 8 ** height leaves."""

    def field(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END"

    def leaf(text: str) -> str:
        return f"sha256(concat({field('doc_id')}, {field('source')}, {field('lang')}, {field('n_chars')}, {field(text)}))"

    def climb(first: str, name: str) -> str:
        """CTEs: levels of trees above `first`, and the siblings of each node on its way up."""
        parts = [f"{name}0 AS ({first})"]
        for k in range(1, height + 1):
            below = f"{name}{k - 1}"
            parts.append(
                f"""{name}{k} AS (
  SELECT tree, idx // 8 AS idx, any_value(n_next) AS n, CASE WHEN any_value(n) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY idx)) END AS d
  FROM (SELECT *, (n + 7) // 8 AS n_next FROM {below}) GROUP BY tree, idx // 8)"""
            )
            parts.append(
                f"""{name}s{k} AS (
  SELECT tree, idx, n, coalesce(string_agg(d, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(d, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {below} WINDOW w AS (PARTITION BY tree, idx // 8 ORDER BY idx))"""
            )
        return ",\n".join(parts)

    def folds(start: str, name: str, index: str) -> str:
        """CTEs that fold `start`'s hash f and proof p through the levels."""
        parts = []
        for k in range(1, height + 1):
            before = start if k == 1 else f"{name}f{k - 1}"
            parts.append(
                f"""{name}f{k} AS (
  SELECT b.* REPLACE (CASE WHEN s.n > 1 THEN sha256(concat(s.l, b.f, s.r)) ELSE b.f END AS f,
         CASE WHEN s.n > 1 THEN concat(b.p, s.l, s.r) ELSE b.p END AS p, b.{index} // 8 AS {index})
  FROM {before} b JOIN {name}s{k} s ON s.tree = b.{'tree' if name == 'g' else 'top'} AND s.idx = b.{index})"""
            )
        return ",\n".join(parts)

    return f"""
WITH {_CRC_TABLE},
changed AS (
  SELECT *, CASE WHEN coalesce({_crc32("doc_id::VARCHAR")} % 3 = 0, false)
            THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS tampered
  FROM documents, crc_table),
hashed AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {leaf("text")} AS leaf, {leaf("tampered")} AS f FROM changed),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n, '/' AS top
  FROM hashed),
{climb("SELECT tree, idx, n, leaf AS d FROM placed", "g")},
subroots AS (SELECT tree, d, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS langs FROM g{height}),
{climb("SELECT '/' AS tree, place AS idx, langs AS n, d FROM subroots", "t")},
started AS (SELECT p.*, s.place, s.d AS subroot, '' AS p FROM placed p JOIN subroots s ON s.tree = p.tree),
{folds("started", "g", "idx")},
{folds(f"gf{height}", "t", "place")}
SELECT doc_id, leaf, subroot, r.d AS root, sha256(p) AS proof_sha256, f AS folded_root, f = r.d AS verified FROM tf{height}, t{height} r
"""


ORACLES: dict[str, str] = {"op11_conversation_trie": _TRIE, "op12_merkle_manifest": _merkle(), "op2_hamming_topk": _HAMMING, "op8_curriculum_mix": _MIX, "op9_line_dedup": _LINES}
