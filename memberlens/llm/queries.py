"""Registered queries of the training-data operators: thin wrappers that give the digest columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memberlens.llm import decontamination, kdsearch, language, licenses, lines, near_duplicates, negatives, packing, pii, prefix_trie, repeats, sharding, tokenfile
from memberlens.session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Production parameters that have no other home.
SHARDS = [f"shard-{i:03d}" for i in range(256)]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def run_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query
def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Shard of every document."""
    placed = sharding.place(table(spark, folder, "documents"), "doc_id", SHARDS)
    return placed.select(F.col("key").alias("doc_id"), "slot", "shard")


@query
def op4_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Places of all documents' pieces in sequences of 2048 tokens."""
    return packing.packed_digest(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"))


@query
def op5_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Token files of all documents, written and read back."""
    path = run_folder(spark, "token-files")
    tokenfile.write_token_files(table(spark, folder, "documents"), path, vocabulary("byte_bpe_50k.json"))
    return tokenfile.read_token_files(spark, path).drop("ids")


@query
def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of benchmark items in every document."""
    found = decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return decontamination.digest(found)


ORACLES["op8_decontamination"] = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)),
gram AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT g.doc_id, g.i, g.n, w.item_id FROM gram g JOIN win w ON g.n = w.n AND g.gram = w.gram),
word AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
owner AS (
  SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ks
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(o.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(o.ks, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN word h USING (doc_id) LEFT JOIN owner o USING (doc_id)"""


@query
def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from three quarters of them."""
    docs = table(spark, folder, "documents")
    found = language.predict(docs, language.fit(docs))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op9_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of personal data in every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pii.digest(pii.find(docs, pii.fit(docs)))


@query
def op10_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate component of every document, on four-word shingles."""
    found = near_duplicates.near_duplicates(table(spark, folder, "documents"), words=4)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


ORACLES["op10_minhash_near_dedup"] = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, least(4, len(w)) AS n, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM doc WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM doc UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON r.other = l.a)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, min(r.other) AS component_id, d.doc_id = min(r.other) AS kept
FROM doc d JOIN reach r USING (doc_id) LEFT JOIN size s USING (doc_id) GROUP BY d.doc_id, s.n"""


@query
def op2_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest vectors of every hundredth one."""
    return kdsearch.top_k(table(spark, folder, "embeddings"), F.col("id") % 100 == 0)


ORACLES["op2_exact_top_k"] = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored)
WHERE rank <= 10"""


@query
def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licenses in every document."""
    return licenses.scan(table(spark, folder, "documents"))


@query
def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What stays of every document without 100-byte strings that start earlier too."""
    return repeats.digest(repeats.repeated_spans(table(spark, folder, "documents")))


@query
def op13_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What stays of every document without lines that ten documents share."""
    return lines.digest(lines.without_frequent_lines(table(spark, folder, "documents")))


ORACLES["op13_line_dedup"] = r"""
WITH line AS (
  SELECT doc_id, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM line),
common AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT y.*, c.k IS NOT NULL AS gone FROM keyed y LEFT JOIN common c ON y.k = c.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


@query
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every fiftieth vector; every seventh vector's label counts as the next one."""
    vectors = table(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors, F.col("id") % 50 == 0, label=label)


ORACLES["op12_hard_negatives"] = """
WITH whole AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.id AS anchor_id, c.id AS id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM whole a JOIN whole c ON a.id <> c.id WHERE a.id % 50 = 0),
positive AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS place FROM scored WHERE same) WHERE place <= 5),
negative AS (
  SELECT p.*, s.id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id)::INTEGER AS rank
  FROM positive p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
  WHERE 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negative WHERE rank <= 3"""


@query
def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Every prefix of the rebuilt conversations, with figures of what starts with it."""
    return prefix_trie.digest(prefix_trie.prefix_trie(*prefix_trie.rebuilt(table(spark, folder, "conversations"))))


ORACLES["op11_prefix_trie"] = r"""
WITH o AS (
  SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS p
  FROM (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
hashed AS (
  SELECT c, c - c % 100 AS base, n, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
    lambda a, x: list_reduce(list_concat([xor(a, x)], range(8)), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)), 4294967295::BIGINT) % 6 AS h
  FROM (SELECT c, count(*) AS n FROM o GROUP BY c)),
conv AS (SELECT a.*, least(a.h, coalesce(b.n, 0)) AS taken FROM hashed a LEFT JOIN hashed b ON a.base = b.c),
turn AS (
  SELECT v.c, o.p AS d, role, text FROM conv v JOIN o ON o.c = v.base AND o.p <= v.taken
  UNION ALL SELECT v.c, v.taken + o.p - v.h, role, text FROM conv v JOIN o ON o.c = v.c AND o.p > v.h),
prefix AS (
  SELECT c, 0 AS d, 0 AS chars, '' AS k FROM conv
  UNION ALL SELECT c, d, length(text), md5(string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ORDER BY d) OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING))
  FROM turn),
node AS (SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, max(chars) AS chars FROM prefix GROUP BY d, k),
child AS (
  SELECT n.*, p.k AS parent_k, u.conv_id AS parent_conv_id FROM node n
  LEFT JOIN prefix p ON p.c = n.conv_id AND p.d = n.d - 1 LEFT JOIN node u ON u.d = n.d - 1 AND u.k = p.k),
fan AS (SELECT d - 1 AS d, parent_k AS k, count(*) AS n_children FROM child WHERE d > 0 GROUP BY 1, 2),
whole AS (SELECT c.*, coalesce(f.n_children, 0) AS n_children FROM child c LEFT JOIN fan f USING (d, k)),
below AS (
  SELECT p.d, p.k, sum((w.n_children = 0)::INT) AS n_leaves, sum((w.n_convs - 1) * w.chars) AS saved_tokens
  FROM whole w JOIN prefix p ON p.c = w.conv_id AND p.d <= w.d GROUP BY 1, 2),
ended AS (
  SELECT d, k, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM prefix p
  WHERE d = (SELECT max(q.d) FROM prefix q WHERE q.c = p.c) GROUP BY 1, 2)
SELECT w.conv_id, w.d::BIGINT AS depth, w.parent_conv_id, w.n_convs, w.n_children::BIGINT AS n_children, b.n_leaves::BIGINT AS n_leaves,
  b.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM whole w JOIN below b USING (d, k) LEFT JOIN ended e USING (d, k)"""
