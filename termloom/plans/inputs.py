"""Views of the test tables as the operators' inputs, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Vectors of one page or session.
PAGE = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_1024ths(a: int, b: int, c: int):
    """A weight that is exact in binary, so that sums don't depend on their order."""
    return ((F.char_length("text") * a + F.col("page_id") * b + F.col("count") * c) % 1024) / F.lit(1024.0)


def document_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ASCII words of documents as terms: a language is a session, a document a page, its source the domain."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    words = docs.select(F.col("lang").alias("session_id"), F.col("doc_id").alias("page_id"), F.col("source").alias("domain"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("text"))
    terms = words.groupBy("session_id", "page_id", "domain", "text").agg(F.count("*").alias("count"))
    n = F.char_length("text")
    return terms.withColumns({
        "weightage": in_1024ths(37, 11, 7), "relevance": in_1024ths(53, 29, 3), "keybert_score": in_1024ths(17, 5, 0),
        "label": F.when(n % 5 == 0, "Topic").when(n % 5 == 1, "Place").when(n % 5 == 2, "Food").when(n % 5 == 3, "Unknown"),
        "source": F.when(F.col("count") % 3 == 0, "KeyBERT").otherwise("gliner"),
        "ord": F.row_number().over(Window.partitionBy("page_id").orderBy("text")),
    })


TERMS = """
w AS (SELECT lang AS session_id, doc_id AS page_id, source AS domain, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS text FROM documents),
terms AS (SELECT session_id, page_id, domain, text, count(*) AS count,
  ((length(text) * 37 + page_id * 11 + count(*) * 7) % 1024) / 1024.0 AS weightage, ((length(text) * 53 + page_id * 29 + count(*) * 3) % 1024) / 1024.0 AS relevance,
  ((length(text) * 17 + page_id * 5) % 1024) / 1024.0 AS keybert_score,
  CASE length(text) % 5 WHEN 0 THEN 'Topic' WHEN 1 THEN 'Place' WHEN 2 THEN 'Food' WHEN 3 THEN 'Unknown' END AS label,
  CASE WHEN count(*) % 3 = 0 THEN 'KeyBERT' ELSE 'gliner' END AS source, row_number() OVER (PARTITION BY page_id ORDER BY text) AS ord
  FROM w GROUP BY session_id, page_id, domain, text)
"""

_CASES = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in X.IRREGULAR_PLURALS.items())


def singular_sql(c: str) -> str:
    n = f"length({c})"
    return (
        f"CASE {c} {_CASES} ELSE CASE WHEN {n} > 3 AND ends_with({c}, 'ies') THEN left({c}, {n} - 3) || 'y' "
        f"WHEN {n} > 3 AND regexp_matches({c}, '(zes|ses|xes|ches|shes)$') THEN left({c}, {n} - 2) WHEN {n} > 3 AND ends_with({c}, 'ves') THEN left({c}, {n} - 3) || 'f' "
        f"WHEN {n} > 3 AND ends_with({c}, 'oes') THEN left({c}, {n} - 2) WHEN {n} > 2 AND regexp_matches({c}, '[^aeiou]s$') AND NOT ends_with({c}, 'ss') THEN left({c}, {n} - 1) ELSE {c} END END"
    )


def part_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts as terms of a session, their brand; the size is the count."""
    part = table(spark, sf_dir, "part")
    return part.select(
        F.col("p_brand").alias("session_id"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("text"), F.col("p_size").alias("combined_count"),
        F.element_at(F.array(F.lit("green"), F.lit("orange"), F.lit("white")), (F.col("p_partkey") % 3 + 1).cast("int")).alias("tier"),
        F.element_at(F.array(F.lit("Dog Breed"), F.lit("Brand"), F.lit("Topic"), F.lit("Dog Breed"), F.lit("Nonsense")), (F.col("p_partkey") % 5 + 1).cast("int")).alias("label"),
        (F.col("p_size") / F.lit(64.0)).alias("average_weightage"),
    )


PARTS = """
parts AS (SELECT p_brand AS session_id, p_partkey AS ord, p_name AS text, p_size AS combined_count, ['green', 'orange', 'white'][p_partkey % 3 + 1] AS tier,
  ['Dog Breed', 'Brand', 'Topic', 'Dog Breed', 'Nonsense'][p_partkey % 5 + 1] AS label, p_size / 64.0 AS average_weightage FROM part)
"""


def vector_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as terms: PAGE neighbours are a session."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.floor(F.col("vec_id") / PAGE).alias("session_id"), (F.col("vec_id") % PAGE).cast("int").alias("ord"), F.concat(F.lit("term "), F.col("vec_id")).alias("text"),
                    F.concat(F.lit("term "), F.col("vec_id")).alias("key"), (F.col("vec_id") * 7 % 13 + 1).alias("count"), F.col("embedding").alias("vector"), "label")


def vector_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three vectors of each session as its anchors."""
    return vector_terms(spark, sf_dir).where("ord < 3").select("session_id", F.col("ord").alias("anchor_ord"), F.concat(F.lit("anchor "), F.col("ord")).alias("anchor"), "vector")


SIMS = f"""
v AS (SELECT vec_id // {PAGE} AS session_id, (vec_id % {PAGE})::INTEGER AS ord, 'term ' || vec_id AS text, embedding::DOUBLE[] AS e FROM embeddings),
sims AS (SELECT t.session_id, 'anchor ' || a.ord AS anchor, a.ord AS anchor_ord, t.ord, t.text,
  round(list_dot_product(t.e, a.e) / (sqrt(list_dot_product(t.e, t.e)) * sqrt(list_dot_product(a.e, a.e))), 4) AS sim
  FROM v t JOIN v a ON t.session_id = a.session_id AND a.ord < 3)
"""
TIERED = """
n AS (SELECT *, row_number() OVER (PARTITION BY session_id, anchor ORDER BY sim DESC, ord) AS r, count(*) OVER (PARTITION BY session_id, anchor) AS n FROM sims),
q AS (SELECT *, greatest(1, floor(n * 0.35)) AS g FROM n),
tiered AS (SELECT session_id, anchor, anchor_ord, ord, text, sim,
  CASE WHEN r <= g THEN 'green' WHEN r > n - least(greatest(1, floor(n * 0.10)), n - g) THEN 'white' ELSE 'orange' END AS tier FROM q)
"""
