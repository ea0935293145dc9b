"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import read_table
from .exact_top_k import exact_top_k
from .fill_in_middle import fill_in_middle_digest
from .language_id import language_id
from .mixing import mix
from .near_duplicates import near_duplicates
from .neighbours import approximate_neighbours
from .packing import pack
from .preferences import preferences
from .quality import quality
from .repeated_passages import repeated_passages_digest
from .secrets import secrets
from .source_divergence import source_divergence
from .token_files import tokens_round_trip


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(read_table(spark, sf_dir, "documents"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), k=3, percent=90)


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(read_table(spark, sf_dir, "embeddings"), k=5, every=50)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(read_table(spark, sf_dir, "documents"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return approximate_neighbours(read_table(spark, sf_dir, "embeddings"), k=20, every=20)


def op7_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences(read_table(spark, sf_dir, "conversations"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_round_trip(spark, read_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle_digest(read_table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(read_table(spark, sf_dir, "documents"))


def op13_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages_digest(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_language_id, op2_near_duplicates, op3_exact_top_k, op4_mixing, op5_secrets, op6_neighbours, op7_preferences, op8_packing, op9_token_files, op10_quality, op11_fill_in_middle, op12_source_divergence, op13_repeated_passages)
}

ORACLE_SQL: dict[str, str] = {
    "op2_near_duplicates": r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS row, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
  s AS (SELECT row, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
  g AS (SELECT row, len(s) AS n, unnest(s) AS g FROM s),
  links AS (SELECT a.row AS a, b.row AS b FROM g a JOIN g b ON a.g = b.g AND a.row <> b.row AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)
    GROUP BY a.row, b.row, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
  reach(row, other) AS (SELECT row, row FROM s UNION SELECT r.row, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT x.doc_id, CAST(len(x.s) AS BIGINT) AS n_shingles, min(y.doc_id) AS component_id FROM reach r JOIN s x ON r.row = x.row JOIN s y ON r.other = y.row GROUP BY x.row, x.doc_id, x.s""",
    "op3_exact_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op7_preferences": """
WITH t AS (SELECT DISTINCT conv_id, coalesce(turn, -9223372036854775808) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
  f AS (SELECT conv_id, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM t) WHERE n = 1),
  n1 AS (SELECT *, conv_id >> 8 AS block, row_number() OVER (PARTITION BY role, text, conv_id >> 8 ORDER BY conv_id) AS n FROM f),
  p1 AS (SELECT role, text, min(conv_id) AS a, max(conv_id) AS b, count(*) AS c FROM n1 GROUP BY role, text, block, (n - 1) // 2),
  n2 AS (SELECT *, a >> 20 AS block, row_number() OVER (PARTITION BY role, text, a >> 20 ORDER BY a) AS n FROM p1 WHERE c = 1),
  p2 AS (SELECT role, text, min(a) AS a, max(a) AS b, count(*) AS c FROM n2 GROUP BY role, text, block, (n - 1) // 2),
  n3 AS (SELECT *, row_number() OVER (PARTITION BY role, text ORDER BY a) AS n FROM p2 WHERE c = 1),
  p3 AS (SELECT min(a) AS a, max(a) AS b, count(*) AS c FROM n3 GROUP BY role, text, (n - 1) // 2),
  p AS (SELECT a AS chosen_id, b AS rejected_id FROM p1 WHERE c = 2 UNION ALL SELECT a, b FROM p2 WHERE c = 2 UNION ALL SELECT a, b FROM p3 WHERE c = 2),
  e AS (SELECT conv_id, list(DISTINCT turn ORDER BY turn DESC) FILTER (role = 'assistant') AS e FROM t JOIN p3 ON c = 1 AND conv_id = a GROUP BY conv_id),
  s AS (SELECT p.*, t.*, 'chosen' AS side FROM p JOIN t ON t.conv_id = chosen_id UNION ALL SELECT p.*, t.*, 'rejected' FROM p JOIN t ON t.conv_id = rejected_id
    UNION ALL SELECT conv_id, NULL, conv_id, turn, role, text, 'chosen' FROM e JOIN t USING (conv_id) WHERE coalesce(len(e), 0) < 2
    UNION ALL SELECT conv_id, conv_id, conv_id, turn, role, text, 'rejected' FROM e JOIN t USING (conv_id) WHERE turn <= e[2]
    UNION ALL SELECT conv_id, conv_id, conv_id, turn, role, text, 'chosen' FROM e JOIN t USING (conv_id) WHERE turn < e[2] OR turn = e[2] AND role <> 'assistant'
    UNION ALL SELECT conv_id, conv_id, conv_id, e[2], role, text, 'chosen' FROM e JOIN t USING (conv_id) WHERE len(e) > 1 AND turn = e[1] AND role = 'assistant'),
  at_turn AS (SELECT chosen_id, rejected_id, turn, list(role || ' ' || text ORDER BY role, text) FILTER (side = 'chosen') AS x, list(role || ' ' || text ORDER BY role, text) FILTER (side = 'rejected') AS y,
    max(CASE WHEN role = 'assistant' THEN turn END) AS spoken FROM s GROUP BY ALL),
  parting AS (SELECT chosen_id AS c, rejected_id AS r, CASE WHEN rejected_id IS NULL THEN max(spoken) ELSE min(CASE WHEN x IS DISTINCT FROM y THEN turn END) END AS parts FROM at_turn GROUP BY chosen_id, rejected_id)
SELECT chosen_id, rejected_id, CASE WHEN parts IS NULL OR turn < parts THEN 'prompt' ELSE side END AS part, turn, role,
  '<|' || role || '|>' || chr(10) || replace(text, '<|', '< |') || '<|end|>' || chr(10) AS rendered, CAST(NOT (parts IS NULL OR turn < parts) AND role = 'assistant' AS INTEGER) AS loss
FROM s JOIN parting ON chosen_id = c AND rejected_id IS NOT DISTINCT FROM r WHERE side = 'chosen' OR NOT (parts IS NULL OR turn < parts)""",
    "op11_fill_in_middle": """
WITH s AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
  h AS (SELECT doc_id, t, length(t) AS n, CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2, CAST('0x' || s[17:24] AS BIGINT) AS h3, CAST('0x' || s[25:32] AS BIGINT) AS h4 FROM s),
  c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
  p AS (SELECT *, substring(t, 1, a) AS x, substring(t, a + 1, b - a) AS y, substring(t, b + 1) AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y WHEN 'spm' THEN '<S>' || z || '<P>' || x || '<M>' || y ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
    "op12_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
  o AS (SELECT row, lang, source, unnest(w) AS term FROM d),
  k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
  c AS (SELECT lang, source, term, count(*) AS c FROM o SEMI JOIN k USING (lang, term) GROUP BY ALL),
  g AS (SELECT DISTINCT lang, source FROM d),
  v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
  gn AS (SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce(sum(c), 0) AS n FROM g LEFT JOIN c USING (lang, source) LEFT JOIN v ON g.lang = v.lang GROUP BY g.lang, g.source, v),
  p AS (SELECT gn.lang, gn.source, k.term, coalesce(c, 0) AS c, 1 + CAST(1000000000 * CAST(coalesce(c, 0) + 1 AS HUGEINT) // (n + v) AS HUGEINT) AS p FROM gn JOIN k ON gn.lang = k.lang LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
  q AS (SELECT lang, term, 1 + CAST(1000000000 * CAST(sum(c) + 1 AS HUGEINT) // (any_value(n) + any_value(v)) AS HUGEINT) AS q FROM p JOIN (SELECT lang, sum(n) AS n, any_value(v) AS v FROM gn GROUP BY lang) USING (lang) GROUP BY lang, term),
  pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
  parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
    UNION ALL SELECT p.lang, p.source, 'term', p.term, (p - q) * (p - q) // q FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
  r AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts)
SELECT * FROM r WHERE part = 'pair' OR rank <= 200""",
}
