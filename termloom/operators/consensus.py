"""From tiers of each anchor to final tiers: slots, redistribution, one tier for each term, order, post-processing."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from .fuzzy import dedup_tiers, without_domains
from .merge import multiplier, word_range
from .ranking import first_of, numeric_cap, quota_counts, quota_tiers, tier_rank

POINTS = {"green": 3, "orange": 2, "white": 1}
VOTE_RATIO = 0.6


def anchor_order(anchors: DataFrame, keyword: str, by: Sequence[str] = ("session_id",), order: str = "ord", variants: Iterable[str] | None = None) -> DataFrame:
    """(by, anchor, instance_index): the keyword, then extracted variants, as they came, each text of any case once.

    variants: None takes all anchors as variants.
    """
    key = X.text_key("anchor")
    original = (key == keyword.strip().lower()) & F.lit(bool(keyword.strip()))
    rows = anchors.withColumn("anchor", X.trimmed("anchor")).where("anchor <> ''")
    if variants is not None:
        rows = rows.where(original | X.is_exempt("anchor", variants))
    rows = first_of(rows, [*by, F.lower("anchor")], [order])
    index = F.row_number().over(Window.partitionBy(*by).orderBy(original.desc(), order))
    return rows.withColumn("instance_index", index).select(*by, "anchor", "instance_index")


def anchor_tiers(similar: DataFrame, by: Sequence[str] = ("session_id", "anchor"), text: str = "text", order: Sequence = ("ord",)) -> DataFrame:
    """Column tier of every term for every anchor, by similarity quota."""
    return quota_tiers(similar, by, "sim", X.text_key(text), order)


def tier_summary(assigned: DataFrame, by: Sequence[str] = ("session_id", "anchor")) -> DataFrame:
    """Sizes of the tiers and the 10th, 50th and 90th percentile of similarity, four decimals."""
    p = F.percentile("sim", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    sizes = [F.count_if(F.col("tier") == t).alias(t) for t in ("green", "orange", "white")]
    return assigned.groupBy(*by).agg(*sizes, p.alias("p")).select(*by, "green", "orange", "white", *(F.round(F.col("p")[i], 4).alias(n) for i, n in enumerate(("p10", "p50", "p90"))))


def votes(assigned: DataFrame, by: Sequence[str] = ("session_id",), key: str = "key", ratio: float = VOTE_RATIO, floor: float = 0.55, ceiling: float = 0.35) -> DataFrame:
    """Votes of all anchors for each term: counts by tier, points, stability, mean similarity, final tier and confidence."""
    anchors = assigned.groupBy(*by).agg(F.count_distinct("anchor").alias("n"))
    sums = assigned.groupBy(*by, key).agg(*(F.count_if(F.col("tier") == t).alias(f"{t}_votes") for t in POINTS), F.avg("sim").alias("m"))
    rows = sums.join(anchors, list(by))
    need = F.greatest(F.lit(1), F.ceil(F.col("n") * ratio))
    green = (F.col("green_votes") >= need) & (F.col("m") >= floor)
    white = ~green & (F.col("white_votes") >= need) & (F.col("m") <= ceiling)
    points = sum((F.col(f"{t}_votes") * p for t, p in POINTS.items()), F.lit(0))
    most = F.greatest(*(F.col(f"{t}_votes") for t in POINTS))
    sure = F.when((green & (F.col("green_votes") == F.col("n"))) | (white & (F.col("white_votes") == F.col("n"))), "high").when(~green & ~white & (most <= F.floor(F.col("n") / 2)), "low").otherwise("medium")
    return rows.select(*by, key, *(f"{t}_votes" for t in POINTS), F.round(F.col("green_votes") / F.col("n"), 4).alias("stability"), F.round("m", 4).alias("mean_sim"), points.alias("tier_points"),
                       F.round(points + F.col("m"), 4).alias("final_rank_score"), F.when(green, "green").when(white, "white").otherwise("orange").alias("final_tier"), sure.alias("confidence"))


def fill_slots(buckets: Sequence[Sequence[str]], shares: Sequence[int]) -> list[tuple[int, int, int]]:
    """(anchor, place in its bucket, rank in the anchor) of terms taken, for one tier.

    buckets: each anchor's terms (keys), best first. Anchors in order take
    their share, passing over terms that are taken already. What they lack is
    dealt out in rounds: anchors with the most terms left come first and take
    one each, until nothing is lacking or nobody finds a term.
    """
    rest = [iter(enumerate(b)) for b in buckets]
    left = [len(b) for b in buckets]
    taken: set[str] = set()
    ranks, out = [0] * len(buckets), []

    def take(a: int, n: int) -> int:
        before = n
        while n:
            place, key = next(rest[a], (0, None))
            if key is None:
                break
            left[a] -= 1
            if key and key not in taken:
                taken.add(key)
                ranks[a] += 1
                out.append((a, place, ranks[a]))
                n -= 1
        return before - n

    lacking = sum(share - take(a, share) for a, share in enumerate(shares))
    moved = True
    while lacking and moved:
        moved = False
        for a in sorted(range(len(buckets)), key=lambda a: -left[a]):
            if lacking and left[a] and take(a, 1):
                lacking, moved = lacking - 1, True
    return out


def select_slots(assigned: DataFrame, by: Sequence[str] = ("session_id",)) -> DataFrame:
    """(by, key, text, tier, anchor, instance_index, instance_rank, sim): terms taken into each tier's slots.

    assigned: by, instance_index, anchor, key, text, sim, tier, ord. The slots
    come from the number of distinct keys of a session. A session's
    assignments are one Arrow group: anchors times terms of one search.
    """
    fields = {f.name: f for f in assigned.schema}
    schema = T.StructType([*(fields[c] for c in (*by, "key", "text", "tier", "anchor", "instance_index")), T.StructField("instance_rank", T.IntegerType()), T.StructField("sim", T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf["key"].nunique()
        green = max(1, int(n * 0.35))
        white = min(max(1, int(n * 0.10)), n - green)
        slots = {"green": green, "white": white, "orange": n - green - white}
        indexes = sorted(pdf["instance_index"].unique())
        out = []
        for tier, total in slots.items():
            own = pdf[pdf["tier"] == tier]
            rows = [own[own["instance_index"] == i].sort_values(["sim", "ord"], ascending=[tier == "white", True], kind="stable") for i in indexes]
            share, more = divmod(total, len(indexes))
            for a, place, rank in fill_slots([r["key"].tolist() for r in rows], [share + (i < more) for i in range(len(indexes))]):
                r = rows[a].iloc[place]
                out.append((*(r[c] for c in (*by, "key", "text", "tier", "anchor", "instance_index")), rank, float(r["sim"])))
        return pd.DataFrame(out, columns=[f.name for f in schema])

    return assigned.groupBy(*by).applyInPandas(run, schema)


def one_tier_each(taken: DataFrame, by: Sequence[str] = ("session_id",)) -> DataFrame:
    """Each term in the tier of its highest similarity; green before orange before white among equals."""
    return first_of(taken, [*by, "key"], [F.desc("sim"), tier_rank("tier"), "instance_index"])


def instance_order(terms: DataFrame, by: Sequence[str] = ("session_id", "tier")) -> DataFrame:
    """Column ord: the place in a tier, all first ranks before all second ones."""
    at = Window.partitionBy(*by).orderBy(F.coalesce("instance_rank", F.lit(9999)), F.coalesce("instance_index", F.lit(9999)), F.desc("sim"), "key")
    return terms.withColumn("ord", F.row_number().over(at))


def final_tiers(assigned: DataFrame, entities: DataFrame, keyword: str, by: Sequence[str] = ("session_id",), domains: DataFrame | None = None, average_words: Column | None = None, exempt: Iterable[str] = ()) -> DataFrame:
    """Final tiers: slots, one tier each, caps, then fuzzy filters, the word limit, the cap of terms with digits, order and word ranges.

    assigned: as for select_slots; entities: by, key, average_weightage,
    combined_count, competitor_count and others.
    """
    by, exempt = list(by), [keyword, *exempt]
    total = assigned.groupBy(*by).agg(F.count_distinct("key").alias("__n"))
    picked = one_tier_each(select_slots(assigned, by), by).join(total, by)
    green, white, orange = quota_counts(F.col("__n"))
    cap = F.when(F.col("tier") == "green", green).when(F.col("tier") == "white", white).otherwise(orange)
    best = F.row_number().over(Window.partitionBy(*by, "tier").orderBy(F.desc("sim"), "instance_index", "instance_rank"))
    picked = picked.withColumn("__best", best).where(F.col("__best") <= cap).drop("__best", "__n")
    rows = instance_order(picked, [*by, "tier"]).join(entities.drop("text"), [*by, "key"], "left")
    rows = rows.withColumns({"rank_score": F.col("sim"), "winning_sim": F.round("sim", 4)})
    if domains is not None:
        rows = without_domains(rows, domains, by, keyword=keyword)
    kept, _ = dedup_tiers(rows, [*by, "tier"], "ord", keyword)
    kept = kept.where(X.within_word_limit("text", exempt))
    kept = numeric_cap(kept, [*by, "tier"], [F.desc("rank_score"), F.char_length("text").desc(), "ord"], exempt=exempt)
    kept = instance_order(kept, [*by, "tier"])
    kept = kept.withColumn("adjusted_weightage", F.coalesce("average_weightage", F.lit(0.0)) * multiplier(F.coalesce("competitor_count", F.lit(1))))
    return word_range(kept, F.lit(0.0) if average_words is None else average_words, by)


def span_metadata(spans: DataFrame, by: Sequence[str] = ("session_id",), order: str = "ord") -> DataFrame:
    """(by, key, label, score): of each span text of any case the one of the highest score, the first of equals."""
    rows = spans.where(X.trimmed("text") != "").withColumn("key", X.text_key("text"))
    return first_of(rows, [*by, "key"], [F.desc_nulls_last("score"), order]).select(*by, "key", "label", "score")


def keyword_instances(anchors: DataFrame, assigned: DataFrame, entities: DataFrame, spans: DataFrame, keyword: str, by: Sequence[str] = ("session_id",), variants: Iterable[str] | None = None) -> DataFrame:
    """One row for each anchor in order: role, label, score, tier sizes and its terms, the nearest first.

    A term list is bounded by the session's terms.
    """
    by = list(by)
    ordered = anchor_order(anchors, keyword, by, variants=variants)
    names = [keyword, *(variants or ())]
    rows = assigned.join(ordered.select(*by, "anchor"), [*by, "anchor"]).join(entities.select(*by, "key", "combined_count"), [*by, "key"], "left")
    sizes = rows.groupBy(*by, "anchor").agg(*(F.count_if(F.col("tier") == t).alias(t) for t in ("green", "orange", "white")))
    nlps = rows.where(X.within_word_limit("text", names) | (X.text_key("text") == X.text_key("anchor"))).groupBy(*by, "anchor").agg(
        F.count("*").alias("nlp_count"),
        F.sort_array(F.collect_list(F.struct((-F.col("sim")).alias("s"), (-F.coalesce("combined_count", F.lit(0))).alias("c"), "text", "tier"))).alias("nlps"),
    )
    nlps = nlps.withColumn("nlps", F.transform("nlps", lambda x: F.struct(x["text"].alias("text"), x["tier"].alias("tier"), (-x["s"]).alias("sim"), (-x["c"]).alias("combined_count"))))
    role = F.when(X.text_key("anchor") == keyword.strip().lower(), "original").otherwise("gliner_entity")
    out = ordered.withColumns({"role": role, "key": X.text_key("anchor")}).join(span_metadata(spans, by), [*by, "key"], "left").join(sizes, [*by, "anchor"], "left").join(nlps, [*by, "anchor"], "left")
    extracted = F.col("role") == "gliner_entity"
    return out.select(*by, "instance_index", "anchor", "role", F.when(extracted, F.col("label")).alias("label"), F.when(extracted, F.col("score")).alias("score"),
                      *(F.coalesce(t, F.lit(0)).alias(t) for t in ("green", "orange", "white")), F.coalesce("nlp_count", F.lit(0)).alias("nlp_count"), "nlps")


def tier_comparison(old: DataFrame, new: DataFrame, by: Sequence[str] = ("session_id",)) -> DataFrame:
    """(by, key, old_tier, new_tier) of all terms of either side."""
    return old.select(*by, "key", F.col("tier").alias("old_tier")).join(new.select(*by, "key", F.col("tier").alias("new_tier")), [*by, "key"], "full")


def evaluation(old: DataFrame, new: DataFrame, by: Sequence[str] = ("session_id",), keyword: str = "") -> DataFrame:
    """Sizes of tiers before and after, mean similarities, moves between tiers and repeats across tiers. new: by, key, tier, sim."""
    by = list(by)
    moves = tier_comparison(old, new, by).groupBy(*by).agg(
        *(F.count_if(F.col("old_tier") == t).alias(f"{t}_old") for t in POINTS), *(F.count_if(F.col("new_tier") == t).alias(f"{t}_new") for t in POINTS),
        F.count_if(F.col("old_tier") != F.col("new_tier")).alias("moved"),
        F.count_if((F.col("old_tier") == "green") & (F.col("new_tier") == "white")).alias("green_to_white"),
        F.count_if((F.col("old_tier") == "white") & (F.col("new_tier") == "green")).alias("white_to_green"),
    )
    sims = new.groupBy(*by).agg(
        *(F.round(F.coalesce(F.avg(F.when(F.col("tier") == t, F.col("sim"))), F.lit(0.0)), 4).alias(f"{t}_sim") for t in POINTS),
        F.coalesce(F.bool_or((F.col("key") == keyword.strip().lower()) & (F.col("tier") == "green")), F.lit(False)).alias("keyword_in_green"),
        (F.count("*") - F.count_distinct("key")).alias("repeated_across_tiers"),
    )
    return moves.join(sims, by, "left")
