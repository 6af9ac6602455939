"""Registered queries of the operators, one per operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.llm import audit, bpe, fim, licenses, lm, mixing, packing, privacy, quality, repeats, secrets, simhash, vectors
from codesieve.llm.common import read_table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")

QueryFn = Callable[[SparkSession, str], DataFrame]
SPARK: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        SPARK[name] = fn
        return fn
    return deco


@query("op1_mixing")
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, plan = mixing.mix(read_table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, max_repeat=2.0)
    return mixing.taken_words(placed, plan).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken",
                                                   F.element_at("first_slots", 1).alias("first_slot"))


ORACLE["op1_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 16) AS ord
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0::DOUBLE, 1.0, 2.0][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INTEGER] AS w
  FROM d GROUP BY source),
r AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / w AS ratio FROM s),
l AS (
  SELECT *, row_number() OVER o AS k,
         ((SELECT sum(source_size)::DOUBLE * 1.5::DOUBLE FROM s)
            - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / ((SELECT sum(w) FROM s) - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lvl
  FROM r WINDOW o AS (ORDER BY ratio, encode(source) NULLS LAST)),
f AS (SELECT k AS fk, lvl AS fl FROM l WHERE ratio >= lvl ORDER BY k LIMIT 1),
t AS (
  SELECT source, source_size,
         CASE WHEN k >= (SELECT fk FROM f) THEN w * (SELECT fl FROM f) ELSE cap END AS target FROM l),
w AS (
  SELECT source, words, hi, hi - words AS lo FROM (
    SELECT source, words, (sum(words) OVER (ORDER BY encode(source) NULLS LAST ROWS UNBOUNDED PRECEDING))::BIGINT AS hi
    FROM (SELECT source, floor(target)::BIGINT AS words FROM t) WHERE words > 0)),
b AS (SELECT total, least(greatest(total // 1048576, 16), 1024) AS bw FROM (SELECT coalesce(max(hi), 0) AS total FROM w)),
i AS (
  SELECT slot, floor((slot % 2147483648) * 2654435769 % 4294967296 / 4294967296.0::DOUBLE * total::DOUBLE)::BIGINT AS pos
  FROM (SELECT total, unnest(range((total + bw - 1) // bw)) AS slot FROM b)),
h AS (SELECT slot, source FROM i JOIN w ON pos >= lo AND pos < hi),
m AS (
  SELECT (SELECT count(*) FROM i) + row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS slot, source
  FROM w WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.source IS NOT DISTINCT FROM w.source)),
k AS (
  SELECT slot, source, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank
  FROM (SELECT * FROM h UNION ALL SELECT * FROM m)),
g AS (SELECT source, least(count(*) * (SELECT bw FROM b), (SELECT words FROM w WHERE w.source IS NOT DISTINCT FROM k.source)) AS words
      FROM k GROUP BY source),
p AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY ord, doc_id NULLS FIRST, size
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a0 FROM d)
SELECT p.doc_id, p.size, t.source_size, t.target,
       (greatest(0, least(a0 + size, coalesce(words, 0)) - a0)
        + greatest(0, least(a0 + source_size + size, coalesce(words, 0)) - a0 - source_size))::BIGINT AS taken,
       k.slot::BIGINT AS first_slot
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
LEFT JOIN g ON p.source IS NOT DISTINCT FROM g.source
LEFT JOIN k ON p.source IS NOT DISTINCT FROM k.source AND size > 0 AND a0 < words AND rank = a0 // (SELECT bw FROM b)
"""


@query("op2_perplexity")
def op2_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.held_out_scores(read_table(spark, sf_dir, "documents"))


@query("op3_privacy")
def op3_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.private_report(read_table(spark, sf_dir, "documents"))


@query("op4_secrets")
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(read_table(spark, sf_dir, "documents"))


@query("op5_quality")
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(read_table(spark, sf_dir, "documents")).drop("lost_bytes")


@query("op6_licenses")
def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents"))


@query("op7_embeddings")
def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.embedding_groups(read_table(spark, sf_dir, "embeddings"))


ORACLE["op7_embeddings"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (
  SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                    AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b
  ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95::DOUBLE),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""


@query("op8_simhash")
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(read_table(spark, sf_dir, "documents"))


@query("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), VOCABULARY)


@query("op10_repeats")
def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_report(read_table(spark, sf_dir, "documents"))


@query("op11_filter_audit")
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_filters(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


ORACLE["op11_filter_audit"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic
      FROM labels GROUP BY doc_id),
f AS (
  SELECT d.doc_id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         map {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w),
              'C': 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * len(t),
              'D': regexp_matches(t, '[#$%&*|]'),
              'E': coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)} AS fails
  FROM d LEFT JOIN m ON m.doc_id = d.doc_id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
o(filter_order) AS (
  SELECT '' UNION ALL SELECT filter_order || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x)
  WHERE NOT contains(filter_order, x)),
s AS (SELECT filter_order, step::INTEGER AS step, substr(filter_order, step, 1) AS name,
             string_split(substr(filter_order, 1, step - 1), '') AS before
      FROM o, range(1, 6) r(step) WHERE len(filter_order) = 5),
r AS (
  SELECT part, filter_order, step, name, n, good, toxic,
         len(list_filter(before, lambda x: coalesce(fails[x], false))) > 0 AS gone, fails[name] AS failing,
         len(list_filter(map_values(fails), lambda x: x)) AS n_failing
  FROM c, s),
a AS (
  SELECT part, filter_order, step, name,
         coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (NOT gone AND failing), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (gone AND failing), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (failing AND n_failing = 1), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (NOT gone AND failing), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (NOT gone AND failing), 0)::BIGINT AS toxic_lost
  FROM r GROUP BY ALL)
SELECT * EXCLUDE (name), (sum(removed) OVER (PARTITION BY part, name))::BIGINT AS shapley FROM a
"""


@query("op12_fill_in_middle")
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fim_report(read_table(spark, sf_dir, "documents"))


ORACLE["op12_fill_in_middle"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id::VARCHAR) AS h,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents),
g AS (
  SELECT *, len(u)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS c1,
         ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS c2, ('0x' || substr(h, 17, 8))::BIGINT % 100 AS h3,
         ('0x' || substr(h, 25, 8))::BIGINT % 100 AS h4 FROM d),
f AS (
  SELECT *, CASE WHEN h IS NULL OR t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain'
                 WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(u[1:least(c1, c2)], '') AS p, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS m,
         array_to_string(u[greatest(c1, c2) + 1:], '') AS s FROM g)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN len(p)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN len(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM f
"""


@query("op13_bpe")
def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_report(read_table(spark, sf_dir, "documents"), WORD_VOCABULARY)
