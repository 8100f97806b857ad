"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann_ivfpq, langid_bloom, toxicity_fm
from .bpe_shuffle import encode_digests
from .common import read_table
from .decontam import contaminated
from .exact_groups import exact_groups
from .line_runs import dedup_lines
from .merkle_manifest import manifest
from .ngram_join import jaccard_components
from .secret_scan import digests as secret_digests
from .secret_scan import scan as secret_scan
from .sharding import shard_documents
from .source_divergence import divergences
from .warc_gzip import round_trip


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark, read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann_ivfpq.search(spark, vectors, vectors.where(F.col("vec_id") % 50 == 0), neighbours=5)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark, read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = secret_digests(secret_scan(spark, docs, repository="doc_id", owner="source"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_digests(spark, docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid_bloom.predict(spark, docs, langid_bloom.learn(spark, docs))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity_fm.learn(spark, docs, read_table(spark, sf_dir, "labels"))
    return toxicity_fm.score_documents(spark, docs, model)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return contaminated(spark, docs, read_table(spark, sf_dir, "benchmark"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark, read_table(spark, sf_dir, "documents").select("doc_id", "text"), 24)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark, read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark, read_table(spark, sf_dir, "documents").select("doc_id", "text"), keep="largest")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark, read_table(spark, sf_dir, "documents"), fanout=16)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(spark, read_table(spark, sf_dir, "documents").select("lang", "source", "text"))


OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents
),
parts AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] END) AS g FROM words
),
sets AS (SELECT DISTINCT doc_id, g FROM parts),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * k >= 80 * (x.n + y.n - k)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS v, a AS r FROM edges UNION SELECT e.b AS v, r.r FROM reach r JOIN edges e ON e.a = r.v)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(m, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN (SELECT v, min(r) AS m FROM reach GROUP BY v) c ON c.v = d.doc_id
"""

OP3_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_page FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_page THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_page THEN first_page END AS refers_to
FROM m
"""

OP10_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM docs)
),
common AS (SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT l.*, c.k IS NOT NULL AND l.doc_id <> c.keeper AS gone FROM lines l LEFT JOIN common c ON l.k = c.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP11_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM documents),
g AS (SELECT k, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY k)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(k) AS text_sha256 FROM t JOIN g USING (k)
"""

#: Trees level by level (n: nodes of a tree's level); a step of a path is the run's other nodes around "@"; crc32 is the bitwise rule.
OP12_SQL = """
WITH RECURSIVE f AS (
  SELECT doc_id, source, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
    || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ord(d)::BIGINT)), lambda crc, d:
      list_reduce([xor(crc, d), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)), 4294967295) AS crc
  FROM documents
),
leaves AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos,
    sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
    CASE WHEN crc % 5 = 0 THEN sha256(head || coalesce(octet_length(encode(low)) || ':' || low, '-')) ELSE leaf END AS tested
  FROM f
),
up AS (
  SELECT tree, 0 AS level, pos, leaf AS node, count(*) OVER (PARTITION BY tree) AS n FROM leaves
  UNION ALL SELECT tree, level + 1, pos // 16, sha256(string_agg(node, '' ORDER BY pos)), any_value((n + 15) // 16) FROM up WHERE n > 1 GROUP BY tree, level, pos // 16
),
subroots AS (SELECT tree, node AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS place FROM up WHERE n = 1),
outer_up AS (
  SELECT 0 AS level, place AS pos, subroot AS node, count(*) OVER () AS n FROM subroots
  UNION ALL SELECT level + 1, pos // 16, sha256(string_agg(node, '' ORDER BY pos)), any_value((n + 15) // 16) FROM outer_up WHERE n > 1 GROUP BY level, pos // 16
),
runs AS (SELECT tree, level, pos // 16 AS run, list(node ORDER BY pos) AS nodes FROM up WHERE n > 1 GROUP BY ALL),
outer_runs AS (SELECT level, pos // 16 AS run, list(node ORDER BY pos) AS nodes FROM outer_up WHERE n > 1 GROUP BY ALL),
steps AS (
  SELECT l.tree, l.pos, level AS step, nodes, (l.pos // (16 ** level)::BIGINT) % 16 AS slot FROM leaves l JOIN runs r ON l.tree = r.tree AND r.run = l.pos // (16 ** (level + 1))::BIGINT
  UNION ALL
  SELECT l.tree, l.pos, 100 + level, nodes, (place // (16 ** level)::BIGINT) % 16 FROM leaves l JOIN subroots s ON l.tree = s.tree JOIN outer_runs r ON r.run = place // (16 ** (level + 1))::BIGINT
),
paths AS (SELECT tree, pos, list(array_to_string(nodes[1:slot], '') || '@' || array_to_string(nodes[slot + 2:], '') ORDER BY step) AS path FROM steps GROUP BY tree, pos),
proofs AS (
  SELECT doc_id, leaf, subroot, (SELECT node FROM outer_up WHERE n = 1) AS root, sha256(replace(array_to_string(coalesce(path, []), ''), '@', '')) AS proof_sha256,
    list_reduce(list_prepend(tested, coalesce(path, [])), lambda below, step: sha256(replace(step, '@', below))) AS folded_root
  FROM leaves JOIN subroots USING (tree) LEFT JOIN paths USING (tree, pos)
)
SELECT *, folded_root = root AS verified FROM proofs
"""

OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
kept AS (SELECT lang, term, count(*) AS all_n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v, sum(all_n) AS lang_n FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
t AS (SELECT lang, source, sum(n) AS group_n FROM c GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (coalesce(group_n, 0) + v) AS p, 1 + (1000000000::HUGEINT * (all_n + 1)) // (lang_n + v) AS q
  FROM g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN t USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
pairs AS (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
summed AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
both_parts AS (
  SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value FROM pairs LEFT JOIN summed USING (lang, source, item)
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)))::INTEGER AS rank
FROM both_parts QUALIFY part = 'pair' OR rank <= 200
"""

QUERIES = {"op1_ngram_join": op1_ngram_join, "op2_ann": op2_ann, "op3_warc": op3_warc, "op4_secrets": op4_secrets, "op5_bpe": op5_bpe, "op6_langid": op6_langid, "op7_toxicity": op7_toxicity, "op8_decontamination": op8_decontamination, "op9_sharding": op9_sharding, "op10_line_dedup": op10_line_dedup, "op11_exact_dedup": op11_exact_dedup, "op12_merkle": op12_merkle, "op13_divergence": op13_divergence}
SQL = {"op1_ngram_join": OP1_SQL, "op3_warc": OP3_SQL, "op10_line_dedup": OP10_SQL, "op11_exact_dedup": OP11_SQL, "op12_merkle": OP12_SQL, "op13_divergence": OP13_SQL}
