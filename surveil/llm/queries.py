"""Registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveil.llm import collocations, html_text, licenses, mixing, mtree, neardup, negatives, ngram_lm, outliers, packing, passages, pii, quality


def tokenizer_path() -> str:
    """The tokenizer that the packing contract names (installed on every machine, never copied)."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(_read(spark, sf_dir, "documents"), text_out=False))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path())


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove(_read(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.judge(_read(spark, sf_dir, "documents"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score(_read(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_read(spark, sf_dir, "pages"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline              # stands at the repository top; it imports this module
    return corpus_pipeline.run(spark, sf_dir)


OPERATORS = {f.__name__: f for f in (
    op1_pii, op2_near_duplicates, op3_mixing, op4_packing, op5_quality, op6_repeated_passages, op7_quality_rules, op8_top_k, op9_licenses, op10_lm_scores,
    op11_hard_negatives, op12_main_text, op13_collocations)}


#: DuckDB SQL where SQL can express an operator over its whole table; the others have brute-force tests.
ORACLES = {
    "op8_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id AND q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op11_hard_negatives": """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same,
         CAST(list_sum(list_transform(list_zip(a.e, v.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v AS a JOIN v ON a.vec_id <> v.vec_id AND a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS i
  FROM s WHERE same),
n AS (
  SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND i <= 5
    AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
""",
    "op13_collocations": r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (
  SELECT lang, row_number() OVER () AS piece, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM p),
u AS (SELECT lang, piece, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
v AS MATERIALIZED (
  SELECT lang, x, lead(x) OVER (PARTITION BY piece ORDER BY i) AS y, lead(x, 2) OVER (PARTITION BY piece ORDER BY i) AS z FROM u),
g AS (
  SELECT lang, 1 AS words, x AS phrase FROM v
  UNION ALL SELECT lang, 2, x || ' ' || y FROM v WHERE y IS NOT NULL
  UNION ALL SELECT lang, 3, x || ' ' || y || ' ' || z FROM v WHERE z IS NOT NULL),
f AS MATERIALIZED (SELECT lang, words, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE words = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE words > 1 AND a >= 10),
h AS MATERIALIZED (SELECT lang || chr(31) || phrase AS part, a FROM f WHERE a >= 10),
k AS (SELECT lang, phrase, a, w, unnest(range(1, words)) AS k FROM c),
m AS MATERIALIZED (
  SELECT lang, phrase, a, k, lang || chr(31) || array_to_string(w[1:k], ' ') AS lp,
         lang || chr(31) || array_to_string(w[k + 1:], ' ') AS rp FROM k),
s AS (
  SELECT m.lang, m.phrase, m.a, m.k, x.a AS l, y.a AS r,
         CAST((1000000::HUGEINT * m.a * m.a) // (x.a::HUGEINT * y.a) AS BIGINT) AS score
  FROM m JOIN h AS x ON x.part = m.lp JOIN h AS y ON y.part = m.rp),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS i FROM s),
inside AS (
  SELECT lang, phrase, max(f) AS f FROM (
    SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase, a AS f FROM c WHERE words = 3) AS t
  GROUP BY ALL),
r AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM b LEFT JOIN inside USING (lang, phrase)
  WHERE i = 1 AND (f IS NULL OR 100 * f < 50 * a))
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, n.n, r.score FROM r JOIN n USING (lang) WHERE r.rank <= 2000
""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return OPERATORS | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return ORACLES
