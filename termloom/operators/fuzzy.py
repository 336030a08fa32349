"""Fuzzy filters, deduplication and duplicate reports."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fuzzy as Z
from ..functions import text as X

DEDUP, DOMAIN, MOST_REPORTED = 75.0, 60.0, 50


def rank_score(sim: str = "winning_sim", score: str = "final_rank_score", weight: str = "average_weightage") -> Column:
    """The similarity that won; without one the rank score or the weight, where 0 counts as none."""
    return F.coalesce(sim, F.nullif(score, F.lit(0.0)), F.nullif(weight, F.lit(0.0)), F.lit(0.0))


def domain_matches(terms: DataFrame, domains: DataFrame, by: Sequence[str] = ("session_id",), threshold: float = DOMAIN, keyword: str = "", text: str = "text") -> DataFrame:
    """(by, text, domain, similarity): terms that look like a competitor's host name, with the best match, the first in order of equals.

    domains: by, domain. Only pairs whose lengths allow the threshold are compared.
    """
    pairs = terms.select(*by, text).distinct().join(domains.select(*by, "domain").distinct(), list(by)).where(~X.is_exempt(text, [keyword]))
    pairs = pairs.where(Z.length_bound(F.trim(text), F.trim("domain")) >= threshold).withColumn("similarity", Z.similarity(text, "domain"))
    best = F.max_by("domain", F.struct("similarity", F.transform(F.split("domain", ""), lambda c: -F.ascii(c))))
    return pairs.where(F.col("similarity") >= threshold).groupBy(*by, text).agg(best.alias("domain"), F.round(F.max("similarity"), 1).alias("similarity"))


def without_domains(terms: DataFrame, domains: DataFrame, by: Sequence[str] = ("session_id",), threshold: float = DOMAIN, keyword: str = "") -> DataFrame:
    return terms.join(domain_matches(terms, domains, by, threshold, keyword).select(*by, "text"), [*by, "text"], "left_anti")


def tier_survivors(texts: Sequence[str], scores: Sequence[float], keyword: str = "", threshold: float = DEDUP) -> tuple[list[int], list[tuple[int, int, float]]]:
    """(kept, removed): places kept, by score, then length; removed: (place, kept place, similarity).

    The longest comes first, by score among equals; one that is near to a kept
    text is removed in favour of the nearest. The keyword always stays.
    """
    order = sorted(range(len(texts)), key=lambda i: (-len(texts[i]), -scores[i]))
    kept, removed = [], []
    for i in order:
        near = (0.0, -1)
        if texts[i].lower() != keyword.strip().lower() or not keyword.strip():
            for k in kept:
                s = Z.token_sort_ratio(texts[i], texts[k])
                if s >= threshold and s > near[0]:
                    near = (s, k)
        if near[1] >= 0:
            removed.append((i, near[1], near[0]))
        else:
            kept.append(i)
    return sorted(kept, key=lambda i: (-scores[i], -len(texts[i]))), removed


def dedup_tiers(terms: DataFrame, by: Sequence[str] = ("session_id", "tier"), order: str = "ord", keyword: str = "", threshold: float = DEDUP) -> tuple[DataFrame, DataFrame]:
    """(kept, pairs). kept: terms (by, order, text, rank_score, ...) without near-repeats inside a tier; pairs: by, keep, remove, similarity.

    A tier's terms are one Arrow group; tiers are bounded by their slots.
    """
    fields = {f.name: f for f in terms.schema}
    pair_schema = T.StructType([*(fields[c] for c in by), T.StructField("keep", T.StringType()), T.StructField("remove", T.StringType()), T.StructField("similarity", T.DoubleType())])

    def split(pdf: pd.DataFrame) -> tuple[pd.DataFrame, list[int], list]:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        texts = pdf["text"].fillna("").str.strip()
        pdf, texts = pdf[texts != ""].reset_index(drop=True), texts[texts != ""].tolist()
        return (pdf, *tier_survivors(texts, pdf["rank_score"].fillna(0.0).tolist(), keyword, threshold))

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, kept, _ = split(pdf)
        return pdf.iloc[kept]

    def report(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, _, removed = split(pdf)
        rows = [(*(pdf[c].iloc[i] for c in by), pdf["text"].iloc[k].strip(), pdf["text"].iloc[i].strip(), round(s, 1)) for i, k, s in removed]
        return pd.DataFrame(rows, columns=[*by, "keep", "remove", "similarity"])

    grouped = terms.groupBy(*by)
    return grouped.applyInPandas(keep, terms.schema), terms.groupBy(*by).applyInPandas(report, pair_schema)


def duplicate_pairs(entities: DataFrame, by: Sequence[str] = ("session_id",), order: str = "ord", threshold: float = DEDUP) -> DataFrame:
    """(by, similarity_percent, keep, remove): pairs of a session's entities that look alike; the more relevant one is kept.

    entities: by, order, text, average_relevance, adjusted_weightage,
    combined_count. Texts are compared by their distinct normal forms, and
    only pairs whose lengths allow the threshold. Two texts above it share
    many letters, but no exact key, so a session's distinct forms are
    compared with each other; sessions are spread over tasks.
    """
    best = F.struct(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("average_relevance", "adjusted_weightage", "combined_count")), (-F.col(order)).alias("o"))
    rows = entities.where(F.coalesce(F.col("text"), F.lit("")) != "").select(*by, F.col(order).alias("__o"), "text", best.alias("__best"))
    low = F.regexp_replace(F.lower(X.trimmed("text")), r"[-_\s]+", " ")
    rows = rows.withColumn("__form", low)
    left = rows.select(*by, *(F.col(c).alias(f"{c}_l") for c in ("__o", "text", "__best", "__form")))
    right = rows.select(*by, *(F.col(c).alias(f"{c}_r") for c in ("__o", "text", "__best", "__form")))
    pairs = left.join(right, list(by)).where((F.col("__o_l") < F.col("__o_r")) & (Z.length_bound("__form_l", "__form_r") >= threshold))
    pairs = pairs.withColumn("s", Z.report_similarity("text_l", "text_r")).where(F.col("s") >= threshold)
    first = F.col("__best_l") >= F.col("__best_r")
    return pairs.select(*by, F.round("s", 1).alias("similarity_percent"), F.when(first, F.col("text_l")).otherwise(F.col("text_r")).alias("keep"), F.when(first, F.col("text_r")).otherwise(F.col("text_l")).alias("remove"))


def report_head(pairs: DataFrame, by: Sequence[str], most: int = MOST_REPORTED) -> DataFrame:
    """The first pairs of each report, the most similar first."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("similarity_percent"), "keep", "remove"))
    return pairs.withColumn("__rank", rank).where(F.col("__rank") <= most).drop("__rank")
