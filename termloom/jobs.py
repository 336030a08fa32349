"""Whole jobs: pages to ranked terms; sessions to merged, tiered and grouped documents."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import providers as P
from .functions import chunks as K
from .functions import html as H
from .functions import text as X
from .functions import urls as U
from .operators import consensus as C
from .operators import grouping as G
from .operators import merge as M
from .operators import ranking as R
from .operators import stores as O
from .operators import vectors as W
from .scratch import written
from .sources import files as S


def page_terms(pages: DataFrame, keyword: str = "", extractor: Callable = P.StubExtractor, embedder: Callable = P.StubEmbedder, labels: Sequence[str] = G.LABELS, threshold: float = W.DUPLICATE) -> DataFrame:
    """Terms of pages (page_id, url, html): parsed, gated, cut into windows, extracted, ranked by the title, deduplicated, limited and clustered.

    Pages that pass are parsed once and written; their terms go through one branch.
    """
    parsed = H.parse_pages(pages)
    skip, most = X.gate("content", "title")
    good = written(parsed.withColumns({"skip": skip, "most": most}).where("skip IS NULL").select("page_id", "url", "domain", "title", "most", X.truncated("content").alias("content")))
    windows = good.select("page_id", F.explode(K.chunks("content")).alias("c")).select("page_id", F.col("c.begin").alias("begin"), F.col("c.text").alias("text"))
    spans = P.extract(windows, extractor, labels, ["page_id", "begin"])
    spans = M.aggregate_spans(spans.withColumn("ord", F.struct("begin", "ord")))
    vectors = P.embedding(embedder)
    titles = good.select("page_id", "most", vectors("title").alias("title_vector"))
    terms = spans.select("page_id", "key", "text", "label", "count", "first").withColumn("vector", vectors("text")).join(titles, "page_id")
    ranked = W.cosine_rank(terms, F.col("title_vector"), ["page_id"], [F.desc("count"), "first"], "vector").withColumn("ord", F.col("rank")).drop("first")
    kept = W.greedy_dedup(ranked, ["page_id"], threshold=threshold).where(X.within_word_limit("text", [keyword]))
    kept = R.top_n(kept, ["page_id"], ["ord"], F.col("most"))
    seeds = good.select("page_id", F.posexplode(X.seed_texts("title")).alias("seed_ord", "seed")).select("page_id", "seed_ord", vectors("seed").alias("vector"))
    relevant = W.seed_relevance(kept, seeds)
    return W.title_clusters(relevant, carry=[c for c in relevant.columns if c not in ("page_id", "ord", "vector", "title_vector", "relevant")]).withColumn("relevance", F.col("biencoder_score"))


def merged_session(terms: DataFrame, pages: DataFrame, ratio: float = 0.8, by: Sequence[str] = ("session_id",), selected: DataFrame | None = None) -> DataFrame:
    """Merged entities with tiers and word ranges, over all pages or the selected ones (page_id)."""
    if selected is not None:
        terms, pages = (x.join(selected.select("page_id").distinct(), "page_id", "left_semi") for x in (terms, pages))
    stats = M.page_statistics(pages, by, ["word_count"])
    rows = M.word_range(M.merge_terms(terms, by, ratio).join(stats, list(by)), "avg_word_count", by)
    return R.percentile_tiers(rows, by, [F.desc("average_weightage"), "first_seen"])


def tiered_session(entities: DataFrame, anchors: DataFrame, vectors: DataFrame, keyword: str, by: Sequence[str] = ("session_id",), method: str = "proportional_instance_v1", domains: DataFrame | None = None, average_words: Column | None = None, variants: Sequence[str] | None = None) -> DataFrame:
    """Final tiers of merged entities (by, key, text, ...). method: proportional_instance_v1 or percentile.

    anchors: by, anchor, anchor_ord, vector; vectors: by, key, vector. A
    session without anchors, or without a vector for any of its terms, falls
    back to percentile tiers; the method that was used is in the column
    tiering_method. Terms of too many words leave first; the keyword, its
    variants and the session's anchors are exempt.
    """
    by, names = list(by), [keyword, *(variants or ())]
    if method not in ("percentile", "proportional_instance_v1"):
        raise ValueError(f"no tiering method {method!r}")
    exempt = anchors.select(*by, X.text_key("anchor").alias("__key")).distinct().withColumn("__anchor", F.lit(True))
    short = entities.withColumn("__key", X.text_key("text")).join(exempt, [*by, "__key"], "left")
    short = short.where(X.within_word_limit("text", names) | F.coalesce("__anchor", F.lit(False)))

    def percentile(rows: DataFrame) -> DataFrame:
        out = R.percentile_tiers(rows, by, [F.desc("average_weightage"), "key"]).withColumn("ord", F.row_number().over(Window.partitionBy(*by, "tier").orderBy(F.desc("average_weightage"), "key")))
        anchor = X.is_exempt("text", names) | F.coalesce("__anchor", F.lit(False))
        return R.numeric_cap(out, [*by, "tier"], ["ord"], exempt=anchor).drop("__key", "__anchor").withColumn("tiering_method", F.lit("percentile"))

    if method == "percentile":
        return percentile(short)
    kept = short.drop("__key", "__anchor")
    terms = kept.select(*by, "key", "text").join(vectors, [*by, "key"]).withColumn("ord", F.col("key"))
    order = C.anchor_order(anchors.withColumn("ord", F.col("anchor_ord")), keyword, by, variants=variants)
    assigned = written(C.anchor_tiers(W.similarities(anchors, terms, by), [*by, "anchor"]).join(order, [*by, "anchor"]))
    out = C.final_tiers(assigned, kept, keyword, by, domains, average_words, variants or ()).withColumn("tiering_method", F.lit(method))
    rest = percentile(short.join(assigned.select(*by).distinct(), by, "left_anti"))
    return out.unionByName(rest, allowMissingColumns=True)


def session_document(tiered: DataFrame, by: Sequence[str] = ("session_id",)) -> DataFrame:
    """(by, document): tiers, word buckets and label groups of sessions as JSON."""
    by = list(by)
    tiers = tiered.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("tier", "ord", "text", "combined_count"))).alias("tiers"))
    buckets = G.word_buckets(tiered, [*by, "tier"], ["ord"]).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("tier", (-F.col("nlp_count")).alias("n"), "word", "nlps"))).alias("buckets"))
    labels = tiered.groupBy(*by, G.resolved_label("label").alias("label")).agg(F.sort_array(F.collect_set("text")).alias("texts")).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("label", "texts"))).alias("labels"))
    out = tiers.join(buckets, by, "left").join(labels, by, "left")
    return out.select(*by, F.to_json(F.struct("tiers", "buckets", "labels")).alias("document"))


def merge_response(tiered: DataFrame, selections: DataFrame, cache: DataFrame | None = None, by: Sequence[str] = ("session_id",)) -> DataFrame:
    """(by, selection_key, document, from_cache): the document of each session's selection, of the cache where that has it.

    selections: by, urls; cache: selection_key, document, of which one of
    several equal keys counts. Only sessions that the cache lacks are worked out.
    """
    by = list(by)
    keyed = selections.select(*by, O.selection_key("urls").alias("selection_key"))
    if cache is None:
        return keyed.join(session_document(tiered, by), by).select(*by, "selection_key", "document", F.lit(False).alias("from_cache"))
    known = cache.groupBy("selection_key").agg(F.min("document").alias("document"))
    found = keyed.join(known, "selection_key").select(*by, "selection_key", "document", F.lit(True).alias("from_cache"))
    new = keyed.join(known, "selection_key", "left_anti")
    made = session_document(tiered.join(new.select(*by), by, "left_semi"), by)
    return found.unionByName(new.join(made, by).select(*by, "selection_key", "document", F.lit(False).alias("from_cache")))


def offline_run(steps: dict[str, DataFrame], folder: str, by: Sequence[str] = ("session_id",)) -> DataFrame:
    """(by, step, n): writes each step's table below folder, in order, and gives the batch's summary from what was written."""
    parts = []
    for name, step in steps.items():
        S.write_artifact(step, folder, name)
        stored = step.sparkSession.read.schema(step.schema).json(f"{folder}/{name}")
        parts.append(stored.groupBy(*by).agg(F.count("*").alias("n")).select(*by, F.lit(name).alias("step"), "n"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def organic_pages(results: DataFrame, limit: int, by: Sequence[str] = ("session_id",), order: str = "pos") -> DataFrame:
    """The first limit results of a search that are pages of their own, each normalised URL once."""
    rows = R.top_n(results.where(U.is_organic("url")), by, [order], limit).withColumn("url", U.normalized("url"))
    return R.first_of(rows, [*by, "url"], [order])


def ensured(stored: DataFrame, stale: Column, recompute: Callable[[DataFrame], DataFrame], force: bool = False) -> DataFrame:
    """stored with its stale rows, or with force all of them, computed anew; column changed tells which. Doing it again changes nothing."""
    flag = F.lit(True) if force else F.coalesce(stale, F.lit(False))
    marked = stored.withColumn("changed", flag)
    again = recompute(marked.where("changed").drop("changed")).withColumn("changed", F.lit(True))
    return marked.where("NOT changed").unionByName(again, allowMissingColumns=True)


def anchor_bundle(keywords: DataFrame, extractor: Callable = P.StubExtractor, embedder: Callable = P.StubEmbedder, labels: Sequence[str] = G.LABELS, by: Sequence[str] = ("session_id",), threshold: float = 0.05) -> DataFrame:
    """(by, anchor, anchor_ord, role, sim, vector): the anchors of each session, its keyword first, then the entities found in it that validation accepts.

    keywords: by, keyword; blank ones have no anchors. Entities come by
    frequency, then in order; one that is the keyword itself is none.
    """
    by = list(by)
    own = keywords.select(*by, X.trimmed("keyword").alias("text")).where("text <> ''")
    spans = P.extract(own, extractor, labels, by, threshold=threshold)
    found = M.aggregate_spans(spans, by).join(own.select(*by, F.lower("text").alias("key")), [*by, "key"], "left_anti")
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("count"), "key"))
    candidates = own.select(*by, F.lit(0).alias("ord"), "text", F.lit(False).alias("is_entity")).unionByName(found.select(*by, place.alias("ord"), "text", F.lit(True).alias("is_entity")))
    vectors = written(candidates.withColumn("vector", P.embedding(embedder, is_query=True)("text")))
    valid = W.validate_anchors(vectors, by).where("status = 'accepted'")
    kept = valid.join(vectors.select(*by, "ord", "vector"), [*by, "ord"])
    return kept.select(*by, F.col("text").alias("anchor"), F.row_number().over(Window.partitionBy(*by).orderBy("ord")).alias("n"), "role", "sim", "vector").withColumn("anchor_ord", F.col("n") - 1).drop("n")


def refill(stored: DataFrame, recompute: Callable[[DataFrame], DataFrame], keys: Sequence[str], stale: Column, dry_run: bool = False) -> DataFrame:
    """Stored rows with the stale ones computed anew; dry_run gives the stale rows only."""
    old = stored.where(stale)
    return old if dry_run else stored.where(~stale).unionByName(recompute(old), allowMissingColumns=True)
