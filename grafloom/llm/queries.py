"""The thin ``opN_<name>`` queries of the ten operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, html_extract, mixing, quality, sharding, simhash, substring_dedup, suffix_dedup, topk, warc
from .common import read_table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).drop("llr")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read_table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(read_table(spark, sf_dir, "pages"))


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(read_table(spark, sf_dir, "pages"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(read_table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(read_table(spark, sf_dir, "documents"), vocabulary_path())


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(read_table(spark, sf_dir, "documents"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k_search(read_table(spark, sf_dir, "embeddings"))


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def queries() -> dict:
    found = (op1_quality_rules, op2_simhash_near_dedup, op3_mix_sources, op4_warc, op5_shard, op6_html_text, op7_suffix_dedup, op8_bpe, op9_substring_dedup, op10_top_k)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_RATIO_BUCKETS = 1 << 16

_JUMP = """
  SELECT id, 0 AS step, key AS k, -1::BIGINT AS at, 0::BIGINT AS nxt FROM base
  UNION ALL
  SELECT id, step + 1, nk, nxt, floor((nxt + 1) * (2147483648.0::DOUBLE / ((nk // 8589934592) + 1)::DOUBLE))::BIGINT
  FROM (SELECT *, ((CASE WHEN k < 0 THEN k + 18446744073709551616::HUGEINT ELSE k END) * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS nk FROM walk{n} WHERE nxt < {n})
"""

ORACLES = {
    "op1_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
tok AS (SELECT id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
win AS (
  SELECT id, i, count(*) OVER (PARTITION BY id, word, w2, w3, w4, w5) AS c
  FROM (SELECT id, i, word, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3, lead(word, 3) OVER o AS w4, lead(word, 4) OVER o AS w5 FROM tok WINDOW o AS (PARTITION BY id ORDER BY i))
  WHERE w5 IS NOT NULL
), rep AS (SELECT id, count(DISTINCT i + k) AS n_repeat_words FROM win, range(5) r(k) WHERE c > 1 GROUP BY id),
lines AS (SELECT id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY id),
base AS (
  SELECT d.id, doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (id) LEFT JOIN lines USING (id)
), trusted AS (
  SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(coalesce(quality, 0)) = 1 AND max(coalesce(toxic, 1)) = 0
  ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 20000
), hashed AS (SELECT id, i, ('0x' || substr(md5(word), 1, 8))::BIGINT AS h FROM tok),
grams AS (
  SELECT id, h % {_RATIO_BUCKETS} AS bucket FROM hashed
  UNION ALL
  SELECT id, (h * 31 + nxt) % {_RATIO_BUCKETS} FROM (SELECT id, h, lead(h) OVER (PARTITION BY id ORDER BY i) AS nxt FROM hashed) WHERE nxt IS NOT NULL
), counted AS (
  SELECT bucket, count(*) AS raw, count(*) FILTER (WHERE d.doc_id IN (SELECT doc_id FROM trusted)) AS target FROM grams JOIN d USING (id) GROUP BY bucket
), total AS (SELECT sum(raw) AS raws, sum(target) AS targets FROM counted),
ratio AS (
  SELECT bucket, CASE WHEN targets = 0 THEN 0 ELSE floor(ln((target::DOUBLE * raws::DOUBLE + 32 * targets::DOUBLE) / (targets::DOUBLE * (raw::DOUBLE + 32))) * 1048576 + 0.5)::BIGINT END AS v
  FROM counted, total
), score AS (SELECT id, sum(v) AS total FROM grams JOIN ratio USING (bucket) GROUP BY id),
judged AS (SELECT base.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, coalesce(total, 0) AS total FROM base LEFT JOIN score USING (id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND total >= -83886 * (CASE WHEN n_words > 0 THEN 2 * n_words - 1 ELSE 0 END + 16) AS kept
FROM judged
""",
    "op10_top_k": """
WITH sound AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.v::DOUBLE[], d.v::DOUBLE[])::BIGINT AS score
  FROM sound q JOIN sound d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
    "op4_warc": """
WITH base AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
keyed AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest FROM base),
last AS (SELECT payload_digest, max(page_id) AS last, count(*) AS n FROM keyed WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, keyed.payload_digest,
  CASE WHEN n > 1 AND last IS NOT NULL AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n > 1 AND last IS NOT NULL AND page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM keyed LEFT JOIN last ON keyed.payload_digest = last.payload_digest AND payload_bytes >= 1000
""",
    "op3_mix_sources": rf"""
WITH d AS (
  SELECT doc_id, source, len({_WORDS})::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, ':' || text, '')) AS h FROM documents
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank, 3 * source_size AS cap FROM s),
w AS (SELECT *, (rank - 1) % 3 + 1 AS weight FROM r),
l AS (
  SELECT *, sum(source_size) OVER ()::BIGINT AS budget,
    ((sum(source_size) OVER ()) - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / (sum(weight) OVER (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM w
), one AS (SELECT level FROM l WHERE cap::DOUBLE / weight >= level ORDER BY cap::DOUBLE / weight, rank LIMIT 1),
t AS (SELECT source, source_size, rank, budget, least(cap::DOUBLE, one.level * weight) AS target FROM l, one),
c AS (
  SELECT d.*, source_size, rank, budget, target,
    sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), items AS (
  SELECT c.*, e.epoch, (cum + e.epoch * source_size)::DOUBLE / target AS finish FROM c, (VALUES (0), (1), (2)) e(epoch) WHERE size > 0 AND cum + e.epoch * source_size - size < target
), cut AS (
  SELECT *, sum(size) OVER (ORDER BY finish, rank, epoch, h, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM items
), taken AS (SELECT doc_id, source, h, size, sum(CASE WHEN used <= budget THEN size ELSE 0 END)::BIGINT AS taken FROM cut GROUP BY ALL)
SELECT c.doc_id, c.size, c.source_size, c.target, coalesce(taken.taken, 0)::BIGINT AS taken
FROM c LEFT JOIN taken ON c.doc_id IS NOT DISTINCT FROM taken.doc_id AND c.source IS NOT DISTINCT FROM taken.source AND c.size = taken.size
""",
    "op5_shard": f"""
WITH RECURSIVE base AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce(doc_id, 0)::HUGEINT AS key, (strlen(coalesce(text, '')) + 1)::BIGINT AS size, hex(encode(coalesce(text, ''))) AS bytes FROM documents
), walk8 AS ({_JUMP.format(n=8)}),
walk9 AS ({_JUMP.format(n=9)}),
crc AS (
  SELECT list(v ORDER BY i) AS tab FROM (
    SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END) AS v FROM range(256) g(i))
), summed AS (
  SELECT id, doc_id, size, xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(0, size - 1), lambda j: ('0x' || substr(bytes, (2 * j + 1)::BIGINT, 2))::BIGINT)),
      lambda a, b: xor(a >> 8, tab[1 + (xor(a, b) & 255)])), 4294967295::BIGINT) AS text_crc32
  FROM base, crc
), placed AS (
  SELECT summed.*, a.at::INTEGER AS shard, b.at::INTEGER AS grown_shard, md5(coalesce(doc_id::VARCHAR, '') || ':' || size::VARCHAR) AS h
  FROM summed JOIN walk8 a USING (id) JOIN walk9 b USING (id) WHERE a.nxt >= 8 AND b.nxt >= 9
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY h, doc_id NULLS FIRST, size, text_crc32) - 1)::BIGINT AS slot, grown_shard FROM placed
""",
    "op9_substring_dedup": rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT id, doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM (SELECT id, doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
marked AS (SELECT id, i, rank() OVER (PARTITION BY md5(k), length(k) ORDER BY doc_id NULLS LAST, i) > 1 AS later FROM win),
gone AS (SELECT id, list(DISTINCT i + k) AS cut FROM marked, range(20) r(k) WHERE later GROUP BY id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(cut), 0)::BIGINT AS n_removed,
  sha256(array_to_string(list_filter(w, lambda x, i: cut IS NULL OR NOT list_contains(cut, i)), ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (id)
""",
    "op7_suffix_dedup": """
WITH d AS (SELECT row_number() OVER () AS id, doc_id, hex(encode(coalesce(text, ''))) AS hx, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
win AS (SELECT id, i, md5(substr(hx, 2 * i + 1, 800)) AS k FROM (SELECT id, hx, unnest(range(0, n - 399)) AS i FROM d)),
hit AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY k) AS c FROM win) WHERE c > 1),
edge AS (SELECT id, i, CASE WHEN i > lag(i) OVER (PARTITION BY id ORDER BY i) + 400 OR lag(i) OVER (PARTITION BY id ORDER BY i) IS NULL THEN 1 ELSE 0 END AS opens FROM hit),
span AS (SELECT id, min(i) AS s, max(i) + 400 AS e FROM (SELECT id, i, sum(opens) OVER (PARTITION BY id ORDER BY i) AS g FROM edge) GROUP BY id, g),
gap AS (SELECT id, s, e, coalesce(lag(e) OVER (PARTITION BY id ORDER BY s), 0) AS was FROM span),
kept AS (SELECT gap.id, string_agg(substr(hx, 2 * was + 1, 2 * (s - was)), '' ORDER BY s) AS front, max(e) AS last, sum(e - s) AS gone, count(*) AS spans FROM gap JOIN d USING (id) GROUP BY gap.id)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN gone IS NULL THEN hx ELSE front || substr(hx, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN kept USING (id)
""",
}
