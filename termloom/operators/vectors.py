"""Operators on term vectors: ranking, greedy deduplication, spherical k-means, title clusters, anchors.

What compares all terms of one page or session runs in one Arrow group for
each page, whose terms are bounded by the page's term limit.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V

DUPLICATE, MAX_ROUNDS = 0.85, 50
SEED_HIT, SEED_HITS, SEED_ALONE = 0.55, 2, 0.70
GREEN_FLOOR, WHITE_CEILING, ALL_RELEVANT = 0.55, 0.35, 0.80
ANCHOR_DUPLICATE, ANCHOR_MIN = 0.95, 0.75


def cosine_rank(terms: DataFrame, query: Column, by: Sequence[str], order: Sequence, vector: str = "embedding") -> DataFrame:
    """Columns biencoder_score (cosine to the query, four decimals) and rank."""
    rows = terms.withColumn("biencoder_score", F.round(V.cosine(vector, query), 4))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("biencoder_score"), *order)))


def rerank(terms: DataFrame, by: Sequence[str], order: Sequence) -> DataFrame:
    """rank by crossencoder_score; relevance is that score, or else the other one, where 0 counts as none."""
    relevance = F.coalesce(F.nullif("crossencoder_score", F.lit(0.0)), F.nullif("biencoder_score", F.lit(0.0)), F.lit(0.0))
    return terms.withColumns({"relevance": relevance, "rank": F.row_number().over(Window.partitionBy(*by).orderBy(F.desc_nulls_last("crossencoder_score"), *order))})


def similarities(anchors: DataFrame, terms: DataFrame, by: Sequence[str] = ("session_id",)) -> DataFrame:
    """(by, anchor, anchor_ord, term columns, sim): every anchor of a session against its terms; a session has few anchors.

    anchors: by, anchor, anchor_ord, vector; terms: by, vector and others.
    The anchors of a session, variants of one keyword, are gathered into one
    array and joined to the terms by session, so no pair is shuffled.
    """
    own = anchors.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("anchor_ord", "anchor", F.col("vector").alias("v")))).alias("__a"))
    rows = terms.join(own, list(by)).withColumn("__a", F.explode("__a"))
    return rows.select(*by, F.col("__a.anchor").alias("anchor"), F.col("__a.anchor_ord").alias("anchor_ord"), *(c for c in terms.columns if c not in (*by, "vector")), F.round(V.cosine("vector", "__a.v"), 4).alias("sim"))


def seed_relevance(terms: DataFrame, seeds: DataFrame, by: Sequence[str] = ("page_id",)) -> DataFrame:
    """Columns seed_hits, seed_max and relevant: near to two seeds, or very near to one. The full title (seed_ord 0) counts only if it is alone."""
    only = F.max("seed_ord").over(Window.partitionBy(*by)) == 0
    used = seeds.withColumn("__only", only).where(F.col("__only") | (F.col("seed_ord") > 0)).groupBy(*by).agg(F.collect_list("vector").alias("__s"))
    rows = terms.join(used, list(by)).withColumn("__sims", F.transform("__s", lambda s: V.cosine("vector", s)))
    hits = F.size(F.filter("__sims", lambda s: s >= SEED_HIT))
    return rows.withColumns({"seed_hits": hits, "seed_max": F.array_max("__sims")}).withColumn("relevant", (F.col("seed_hits") >= SEED_HITS) | (F.col("seed_max") >= SEED_ALONE)).drop("__s", "__sims")


def _units(column: pd.Series) -> np.ndarray:
    m = np.array(column.tolist(), np.float32).reshape(len(column), -1)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)


def greedy_survivors(sims: np.ndarray, counts: Sequence[int], threshold: float = DUPLICATE, rounds: int = MAX_ROUNDS, one_each: bool = True) -> list[int]:
    """Places that remain when near terms give way to the more frequent one, the earlier of equals.

    In a round each term, in order, meets the first later one above the
    threshold. one_each: it removes one at most in a round; else all it can,
    until it is removed itself. Rounds end where one by which a term removed a later one doesn't occur.
    """
    alive = list(range(len(counts)))
    for _ in range(rounds):
        gone, won = set(), False
        for at, i in enumerate(alive):
            if i in gone:
                continue
            for j in alive[at + 1 :]:
                if j in gone or not sims[i, j] > threshold:
                    continue
                if counts[i] < counts[j]:
                    gone.add(i)
                    won = won or not one_each
                    break
                gone.add(j)
                won = True
                if one_each:
                    break
        alive = [i for i in alive if i not in gone]
        if not won:
            break
    return alive


def greedy_dedup(terms: DataFrame, by: Sequence[str] = ("page_id",), order: str = "ord", threshold: float = DUPLICATE, one_each: bool = True, rounds: int = MAX_ROUNDS) -> DataFrame:
    """terms (by, order, count, vector, ...) without near-duplicates of a page."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        unit = _units(pdf["vector"])
        return pdf.iloc[greedy_survivors(unit @ unit.T, pdf["count"].tolist(), threshold, rounds, one_each)]

    return terms.groupBy(*by).applyInPandas(run, terms.schema)


def spherical_kmeans(x: np.ndarray, centres: np.ndarray, pinned: Sequence[int] = (), rounds: int = 100, tolerance: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """(labels, centres) of unit rows: nearest centre by cosine, the first of equals; pinned and empty centres stay."""
    centres = centres.astype(np.float32).copy()
    centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    labels = None
    for _ in range(rounds):
        nearest = np.argmax(x @ centres.T, axis=1)
        if labels is not None and (nearest == labels).all():
            break
        labels, moved = nearest, centres.copy()
        for k in set(labels.tolist()) - set(pinned):
            mean = x[labels == k].mean(axis=0, dtype=np.float64)
            if (length := np.linalg.norm(mean)) >= tolerance:
                moved[k] = mean / length
        shift = np.linalg.norm(moved - centres, axis=1).max()
        centres = moved
        if shift < tolerance:
            break
    return labels, centres


def title_clusters(terms: DataFrame, by: Sequence[str] = ("page_id",), order: str = "ord", size: int = 5, seed: int = 123, carry: Sequence[str] = ()) -> DataFrame:
    """(by, order, carry, cluster, sim_to_cluster_1, sim_to_title): relevant terms are cluster 1; the others are clustered, about size in each, by nearness to it.

    terms: by, order, vector, title_vector, relevant (of seed_relevance), and
    columns to carry along.
    """
    fields = [terms.schema[c] for c in (*by, order, *carry)]
    schema = T.StructType([*fields, T.StructField("cluster", T.IntegerType()), T.StructField("sim_to_cluster_1", T.DoubleType()), T.StructField("sim_to_title", T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        x, title, near = _units(pdf["vector"]), _units(pdf["title_vector"].iloc[:1])[0], pdf["relevant"].to_numpy(bool)
        centre = lambda rows: (m := rows.mean(axis=0)) / max(1e-9, float(np.linalg.norm(m)))
        main = centre(x[near]) if near.any() else title
        cluster, to_main, to_title = np.ones(len(x), np.int32), np.ones(len(x)), np.full(len(x), float(title @ main))
        rest = np.flatnonzero(~near)
        if len(rest):
            k = math.ceil(len(rest) / size)
            labels, _ = spherical_kmeans(x[rest], x[rest][np.random.default_rng(seed).choice(len(rest), size=k, replace=False)])
            means = {int(c): centre(x[rest][labels == c]) for c in dict.fromkeys(labels.tolist())}
            ranked = sorted(means, key=lambda c: -float(main @ means[c]))
            for place, c in enumerate(ranked, 2):
                own = rest[labels == c]
                cluster[own], to_main[own], to_title[own] = place, float(main @ means[c]), float(title @ means[c])
        return pdf[[*by, order, *carry]].assign(cluster=cluster, sim_to_cluster_1=to_main, sim_to_title=to_title)

    return terms.select(*by, order, *carry, "vector", "title_vector", "relevant").groupBy(*by).applyInPandas(run, schema)


def top_up(terms: DataFrame, by: Sequence[str], order: Sequence, least: int = 40, most: int = 50) -> DataFrame:
    """Terms of cluster 1 and, cluster by cluster, more until there are least; never over most."""
    at = Window.partitionBy(*by).orderBy("cluster", *order)
    ranked = terms.withColumn("__n", F.row_number().over(at))
    return ranked.where((F.col("__n") <= most) & ((F.col("cluster") == 1) | (F.col("__n") <= least))).drop("__n")


def triplet(vector: Sequence[float], strength: float = 0.1, side: str = "original") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The unit vector, its opposite, and one on the circle between them, nearer to one side by strength (0 to 1)."""
    e = np.asarray(vector, np.float64).ravel()
    length = np.linalg.norm(e)
    if length < 1e-9:
        raise ValueError("a zero vector has no direction")
    if side not in ("original", "opposite"):
        raise ValueError("side is original or opposite")
    e = (e / length).astype(np.float32)
    axis = np.zeros(len(e))
    axis[int(np.argmin(np.abs(e)))] = 1.0
    across = axis - float(axis @ e) * e
    across /= np.linalg.norm(across)
    angle = math.pi / 2 * (1 + min(1.0, max(0.0, strength)) * (-1 if side == "original" else 1))
    middle = math.cos(angle) * e + math.sin(angle) * across
    return e, -e, (middle / np.linalg.norm(middle)).astype(np.float32)


def anchored_tiers(terms: DataFrame, by: Sequence[str] = ("session_id", "anchor"), order: str = "ord", strength: float = 0.1, side: str = "original") -> DataFrame:
    """(by, order, tier, sim, adjusted): three clusters around an anchor, pinned to it, as tiers by nearness; floors of similarity correct them.

    terms: by, order, vector, anchor_vector.
    """
    fields = [f for f in terms.schema if f.name in (*by, order)]
    schema = T.StructType([*fields, T.StructField("tier", T.StringType()), T.StructField("sim", T.DoubleType()), T.StructField("adjusted", T.BooleanType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        x = _units(pdf["vector"])
        own, opposite, middle = triplet(pdf["anchor_vector"].iloc[0], strength, side)
        sims = x @ own
        labels, centres = spherical_kmeans(x, np.stack([own, middle, opposite])[: min(3, len(x))], pinned=(0,))
        ranked = sorted(range(len(centres)), key=lambda k: -float(centres[k] @ own))
        name = dict(zip(ranked, ("green", "orange", "white"), strict=False))
        all_near = len(x) >= 10 and float(np.percentile(sims, 10)) >= ALL_RELEVANT
        tiers, changed = [], []
        for label, s in zip(labels.tolist(), sims.tolist(), strict=True):
            was = tier = name[label]
            if tier == "green" and s < GREEN_FLOOR:
                tier = "orange" if s >= WHITE_CEILING else "white"
            elif tier == "white" and s > WHITE_CEILING:
                tier = "orange"
            if all_near and tier == "white":
                tier = "orange"
            tiers.append(tier)
            changed.append(tier != was)
        return pdf[[*by, order]].assign(tier=tiers, sim=np.round(sims.astype(np.float64), 4), adjusted=changed)

    return terms.select(*by, order, "vector", "anchor_vector").groupBy(*by).applyInPandas(run, schema)


def validate_anchors(candidates: DataFrame, by: Sequence[str] = ("session_id",), order: str = "ord", duplicate: float = ANCHOR_DUPLICATE, least: float = ANCHOR_MIN) -> DataFrame:
    """(by, order, text, status, role, sim): candidates in order, the first being the original query.

    A candidate as near as duplicate to an accepted one is a duplicate; else it is
    accepted if it is near enough to the original or an extracted entity
    (is_entity). candidates: by, order, text, vector, is_entity.
    """
    fields = [f for f in candidates.schema if f.name in (*by, order)]
    schema = T.StructType([*fields, *(T.StructField(n, t) for n, t in (("text", T.StringType()), ("status", T.StringType()), ("role", T.StringType()), ("sim", T.DoubleType())))])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        x, accepted, seen, out = _units(pdf["vector"]), [], set(), []
        for i, (text, entity) in enumerate(zip(pdf["text"].str.strip(), pdf["is_entity"], strict=True)):
            sim = float(x[i] @ x[0])
            if i == 0:
                status, role = ("accepted", "original") if text else ("rejected", None)
            elif not text:
                status, role = "rejected", None
            elif any(float(x[i] @ x[k]) >= duplicate for k in accepted):
                status, role = "duplicate", None
            elif sim < least and not entity:
                status, role = "below_min_sim", None
            elif text.lower() in seen:
                status, role = "repeated", None
            else:
                status, role = "accepted", f"{'gliner_entity' if entity else 'variant'}_{len(accepted)}"
            if status == "accepted":
                accepted.append(i)
                seen.add(text.lower())
            out.append((text, status, role, round(sim, 4)))
            if i == 0 and not text:
                break
        return pd.concat([pdf[[*by, order]].iloc[: len(out)], pd.DataFrame(out, columns=["text", "status", "role", "sim"])], axis=1)

    return candidates.select(*by, order, "text", "vector", "is_entity").groupBy(*by).applyInPandas(run, schema)


def missing_vectors(terms: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Terms whose key has no vector in the cache yet."""
    return terms.join(cache.where("vector is not null").select(key), key, "left_anti")


def with_vectors(terms: DataFrame, cache: DataFrame, embedder=None, key: str = "key", text: str = "text") -> DataFrame:
    """terms with vector from the cache; the others from the embedder, if there is one."""
    known = terms.join(cache.select(key, "vector"), key)
    if embedder is None:
        return known
    new = missing_vectors(terms, cache, key)
    return known.unionByName(new.withColumn("vector", embedder(text)))
