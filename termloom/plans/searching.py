"""Queries of vectors, anchors, consensus, fuzzy matching, HTML and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chunks as K
from ..functions import html as H
from ..functions import text as X
from ..functions import vectors as V
from ..operators import consensus as C
from ..operators import fuzzy as Z
from ..operators import merge as M
from ..operators import vectors as W
from .inputs import PAGE, PARTS, SIMS, TIERED, part_terms, table, vector_anchors, vector_terms


def _sims(spark, d):
    return W.similarities(vector_anchors(spark, d), vector_terms(spark, d))


def _tiered(spark, d):
    return C.anchor_tiers(_sims(spark, d))


def _with_first(spark, d):
    """Terms with the vector of the session's first term."""
    t = vector_terms(spark, d)
    return t.join(t.where("ord = 0").select("session_id", F.col("vector").alias("first_vector")), "session_id")


def vector_norms(spark, d):
    e = table(spark, d, "embeddings").withColumn("v", F.transform("embedding", lambda x: x * 3))
    return e.select("vec_id", F.round(V.norm("v"), 4).alias("norm"), F.round(V.norm(V.unit("v")), 4).alias("unit_norm"))


def cosine_rank(spark, d):
    return W.cosine_rank(_with_first(spark, d), F.col("first_vector"), ["session_id"], ["ord"], "vector").select("session_id", "ord", "biencoder_score", "rank")


def rerank(spark, d):
    rows = W.cosine_rank(_with_first(spark, d), F.col("first_vector"), ["session_id"], ["ord"], "vector")
    rows = rows.withColumn("crossencoder_score", F.when(F.col("ord") % 4 == 0, F.lit(0.0)).when(F.col("ord") % 4 == 1, F.col("count") / 16.0))
    return W.rerank(rows, ["session_id"], ["ord"]).select("session_id", "ord", "relevance", "rank")


def anchor_matrix(spark, d):
    return _sims(spark, d).select("session_id", "anchor", "ord", "sim")


def tiers_sim_quota(spark, d):
    return _tiered(spark, d).select("session_id", "anchor", "ord", "sim", "tier")


def sim_percentiles(spark, d):
    return C.tier_summary(_tiered(spark, d).withColumn("sim", F.col("sim") + 0.000003))  # no percentile ends in a half of the last decimal


def seed_relevance(spark, d):
    t, a = vector_terms(spark, d).withColumnRenamed("session_id", "page_id"), vector_anchors(spark, d)
    seeds = a.select(F.col("session_id").alias("page_id"), F.col("anchor_ord").alias("seed_ord"), "vector")
    return W.seed_relevance(t, seeds).select("page_id", "ord", F.col("seed_hits").cast("long").alias("seed_hits"), F.round("seed_max", 4).alias("seed_max"), "relevant")


def votes(spark, d):
    return C.votes(_tiered(spark, d)).select("session_id", "key", "green_votes", "orange_votes", "white_votes", "stability", "mean_sim", "tier_points", "final_tier", "confidence")


def anchor_order(spark, d):
    a = vector_anchors(spark, d).select("session_id", F.concat("anchor", F.when(F.col("anchor_ord") == 1, F.lit(" ")).otherwise("")).alias("anchor"), F.col("anchor_ord").alias("ord"))
    return C.anchor_order(a, "Anchor 2", variants=["ANCHOR 1"])


def greedy_dedup(spark, d):
    return W.greedy_dedup(vector_terms(spark, d), ["session_id"], threshold=0.3).select("session_id", "ord", "text", "count")


def greedy_dedup_legacy(spark, d):
    return W.greedy_dedup(vector_terms(spark, d), ["session_id"], threshold=0.3, one_each=False, rounds=1000).select("session_id", "ord", "text", "count")


def _clusters(spark, d):
    t, a = vector_terms(spark, d), vector_anchors(spark, d)
    seeds = a.select("session_id", F.col("anchor_ord").alias("seed_ord"), "vector")
    rows = W.seed_relevance(t, seeds, ["session_id"])
    title = a.where("anchor_ord = 0").select("session_id", F.col("vector").alias("title_vector"))
    return W.title_clusters(rows.join(title, "session_id"), ["session_id"])


def title_clusters(spark, d):
    return _clusters(spark, d)


def top_up(spark, d):
    return W.top_up(_clusters(spark, d), ["session_id"], ["ord"], least=20, most=25).select("session_id", "ord", "cluster")


def anchored_tiers(spark, d):
    rows = vector_terms(spark, d).join(vector_anchors(spark, d).select("session_id", "anchor", F.col("vector").alias("anchor_vector")), "session_id")
    return W.anchored_tiers(rows)


def validate_anchors(spark, d):
    t = vector_terms(spark, d).withColumn("is_entity", F.col("ord") % 3 == 1)
    return W.validate_anchors(t, duplicate=0.9, least=0.2).withColumn("sim", F.round("sim", 3))


def _entities(spark, d):
    return vector_terms(spark, d).select("session_id", "key", "text", F.col("count").alias("combined_count"), (F.col("count") % 4).alias("competitor_count"), (F.col("count") / 16.0).alias("average_weightage"))


def _assigned(spark, d):
    return _tiered(spark, d).withColumn("instance_index", F.col("anchor_ord") + 1)


def slot_fill(spark, d):
    return C.select_slots(_assigned(spark, d))


def slot_fill_consensus(spark, d):
    out = C.final_tiers(_assigned(spark, d), _entities(spark, d), "term 1", average_words=F.lit(500.0))
    return out.select("session_id", "tier", "ord", "text", "anchor", "instance_index", "instance_rank", "winning_sim", "word_range")


def tier_eval(spark, d):
    t = _tiered(spark, d)
    old = t.where("anchor_ord = 0").select("session_id", "key", "tier")
    new = t.where("anchor_ord = 1 AND sim > -0.1").select("session_id", "key", "tier", "sim")
    return C.evaluation(old, new, keyword="term 1").select("session_id", "green_old", "green_new", "white_new", "moved", "green_to_white", "white_to_green", "green_sim", "repeated_across_tiers")


def span_metadata(spark, d):
    p = part_terms(spark, d)
    return C.span_metadata(p.select("session_id", F.upper("text").alias("text"), "label", (F.col("combined_count") / 64.0).alias("score"), "ord"))


def keyword_instances(spark, d):
    t = _tiered(spark, d)
    anchors = vector_anchors(spark, d).select("session_id", "anchor", F.col("anchor_ord").alias("ord"))
    spans = anchors.select("session_id", F.col("anchor").alias("text"), F.lit("Topic").alias("label"), F.lit(0.5).alias("score"), "ord")
    out = C.keyword_instances(anchors, t, _entities(spark, d), spans, "anchor 0")
    return out.select("session_id", "instance_index", "anchor", "role", "label", "score", "green", "orange", "white", "nlp_count", F.col("nlps")[0]["text"].alias("nearest"))


def missing_vectors(spark, d):
    """Documents without a label stand for terms without a vector."""
    return W.missing_vectors(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").select("doc_id", F.col("quality").alias("vector")), "doc_id")


def fuzzy_pairs(spark, d):
    p = part_terms(spark, d).select("session_id", "ord", "text", F.col("average_weightage").alias("average_relevance"), "average_weightage", "combined_count").withColumnRenamed("average_weightage", "adjusted_weightage")
    distinct = p.groupBy("session_id", "text").agg(F.min("ord").alias("ord"), F.max("average_relevance").alias("average_relevance"), F.max("adjusted_weightage").alias("adjusted_weightage"), F.max("combined_count").alias("combined_count"))
    return Z.duplicate_pairs(distinct)


def fuzzy_tier_dedup(spark, d):
    p = part_terms(spark, d).withColumn("rank_score", F.col("average_weightage"))
    kept, _ = Z.dedup_tiers(p, keyword="hot gear")
    return kept.select("session_id", "tier", "ord", "text", "rank_score")


def fuzzy_domains(spark, d):
    p = part_terms(spark, d)
    domains = p.select("session_id", F.concat(F.replace("text", F.lit(" "), F.lit("")), F.lit(".com")).alias("domain"))
    return Z.domain_matches(p, domains)


def html_parse(spark, d):
    p = H.parse_pages(table(spark, d, "pages"))
    return p.select("page_id", "domain", "title", "description", F.array_join("headings", "|").alias("headings"), "word_count", "heading_count", "para_count", F.sha2("content", 256).alias("content"), F.size("links").alias("links"))


def html_probe(spark, d):
    p = table(spark, d, "pages").select("page_id", "url", *(c.alias(n) for n, c in H.page_probe().items()))
    return p.withColumn("reason", H.block_reason("url", F.col("page_id") % 3)).drop("url")


def chunk_windows(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.explode(K.chunks(X.truncated("text"))).alias("c"))
    return docs.select("doc_id", "c.begin", "c.end", F.sha2("c.text", 256).alias("chunk"))


def page_pipeline(spark, d):
    """From pages to ranked, deduplicated and clustered terms, with the stand-in models."""
    from ..jobs import page_terms

    return page_terms(table(spark, d, "pages"), keyword="the").select("page_id", "text", "label", "count", "relevance", "cluster")


# Longest common subsequences: a row of the table for each character of y, of the pairs (x, y) of a relation `forms`.
LCS = """
lcs(x, y, k, r) AS (SELECT x, y, 0, list_transform(range(length(x)), lambda j: 0) FROM forms UNION ALL
  SELECT x, y, k + 1, list_transform(range(1, length(x) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda i: CASE WHEN x[i] = y[k + 1] THEN CASE WHEN i = 1 THEN 0 ELSE r[i - 1] END + 1 ELSE r[i] END)))
  FROM lcs WHERE k < length(y)),
alike AS (SELECT x, y, CASE WHEN length(x) + length(y) = 0 THEN 100.0 ELSE 200.0 * coalesce(list_max(r), 0) / (length(x) + length(y)) END AS s FROM lcs WHERE k = length(y))
"""
_SORTED = "array_to_string(list_sort(list_filter(string_split_regex({}, '\\s+'), lambda w: w <> '')), ' ')"
_FORM = _SORTED.format("regexp_replace(lower(trim({})), '[-_]+', ' ', 'g')")
FUZZY_PAIRS = f"""
WITH RECURSIVE {PARTS}, d AS (SELECT session_id, text, min(ord) AS ord, max(average_weightage) AS w, max(combined_count) AS c FROM parts GROUP BY 1, 2), n AS (SELECT *, {_FORM.format("text")} AS form FROM d),
p AS (SELECT a.session_id, a.text AS t1, b.text AS t2, a.form AS x, b.form AS y, (a.w, a.c, -a.ord) >= (b.w, b.c, -b.ord) AS first FROM n a JOIN n b ON a.session_id = b.session_id AND a.ord < b.ord),
forms AS (SELECT DISTINCT x, y FROM p), {LCS}
SELECT session_id, round(s, 1) AS similarity_percent, CASE WHEN first THEN t1 ELSE t2 END AS keep, CASE WHEN first THEN t2 ELSE t1 END AS remove FROM p JOIN alike USING (x, y) WHERE s >= 75
"""
FUZZY_TIERS = f"""
WITH RECURSIVE {PARTS}, n AS (SELECT *, row_number() OVER (PARTITION BY session_id, tier ORDER BY length(text) DESC, average_weightage DESC, ord)::INTEGER AS i, {_SORTED.format("text")} AS x FROM parts),
pairs AS (SELECT a.session_id, a.tier, a.i, b.i AS k, a.x, b.x AS y, lower(a.text) = 'hot gear' AS own FROM n a JOIN n b ON a.session_id = b.session_id AND a.tier = b.tier AND b.i < a.i),
forms AS (SELECT DISTINCT x, y FROM pairs), {LCS},
near AS (SELECT session_id, tier, i, list(k) AS near FROM pairs JOIN alike USING (x, y) WHERE s >= 75 AND NOT own GROUP BY ALL), item AS (SELECT n.*, coalesce(near, []) AS near FROM n LEFT JOIN near USING (session_id, tier, i)),
walk(session_id, tier, i, kept) AS (SELECT session_id, tier, 1, [1] FROM item WHERE i = 1 UNION ALL
  SELECT w.session_id, w.tier, item.i, CASE WHEN list_has_any(w.kept, item.near) THEN w.kept ELSE list_append(w.kept, item.i) END FROM walk w JOIN item ON w.session_id = item.session_id AND w.tier = item.tier AND item.i = w.i + 1),
last AS (SELECT session_id, tier, arg_max(kept, i) AS kept FROM walk GROUP BY 1, 2)
SELECT n.session_id, n.tier, ord, text, average_weightage AS rank_score FROM n JOIN last ON n.session_id = last.session_id AND n.tier = last.tier AND list_contains(kept, i)
"""
FUZZY_DOMAINS = f"""
WITH RECURSIVE {PARTS}, t AS (SELECT DISTINCT session_id, text FROM parts), d AS (SELECT DISTINCT session_id, replace(text, ' ', '') || '.com' AS domain FROM parts),
p AS (SELECT session_id, text, domain, {_SORTED.format("text")} AS x, domain AS y FROM t JOIN d USING (session_id)), forms AS (SELECT DISTINCT x, y FROM p), {LCS}
SELECT session_id, text, first(domain ORDER BY s DESC, domain) AS domain, round(max(s), 1) AS similarity FROM p JOIN alike USING (x, y) WHERE s >= 60 GROUP BY 1, 2
"""
CHUNKS = r"""
WITH RECURSIVE t AS (SELECT doc_id, left(text, 18000) AS s FROM documents), w(doc_id, s, b) AS (SELECT doc_id, s, 0 FROM t WHERE length(s) > 0 UNION ALL
  SELECT doc_id, s, n FROM (SELECT doc_id, s, b + 400 + CASE WHEN b + 400 < length(s) AND substr(s, b + 401, 1) NOT IN (' ', chr(10), chr(9)) THEN strpos(substr(s, b + 401, 80), ' ') ELSE 0 END AS n FROM w) WHERE n < length(s)),
e AS (SELECT doc_id, s, b, CASE WHEN b + 600 >= length(s) THEN length(s) WHEN contains(substr(s, b + 2, 600), ' ') THEN b + 2 + length(substr(s, b + 2, 600)) - strpos(reverse(substr(s, b + 2, 600)), ' ') ELSE b + 600 END AS e FROM w),
c AS (SELECT doc_id, b, e, substr(s, b + 1, e - b) AS c FROM e)
SELECT doc_id, b::INTEGER AS "begin", e::INTEGER AS "end", sha256(c) AS chunk FROM c WHERE regexp_matches(c, '\S')
"""
_NEAR = f"""
v AS (SELECT vec_id // {PAGE} AS g, (vec_id % {PAGE})::INTEGER AS i, vec_id * 7 % 13 + 1 AS n, embedding::DOUBLE[] AS e FROM embeddings),
sims AS (SELECT a.g, a.i, b.i AS j, list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS s FROM v a JOIN v b ON a.g = b.g AND a.i < b.i),
near AS (SELECT g, i, list(j ORDER BY j) AS near FROM sims WHERE s > 0.3 GROUP BY 1, 2), item AS (SELECT v.g, v.i, n, coalesce(near, []) AS near FROM v LEFT JOIN near USING (g, i)),
whole AS (SELECT g, list(n ORDER BY i) AS ns, list(near ORDER BY i) AS nears, list(i ORDER BY i) AS every FROM item GROUP BY g)
"""


def _greedy(one_each: bool, rounds: int) -> str:
    """A step for each place of each round; what a round has removed leaves at its end, and rounds end with one that nobody won."""
    later = "list_filter(nears[alive[pos] + 1], lambda j: list_contains(alive, j) AND NOT list_contains(gone, j))"
    if one_each:
        lost = "CASE WHEN len(l) = 0 THEN [] WHEN ns[alive[pos] + 1] < ns[l[1] + 1] THEN [alive[pos]] ELSE [l[1]] END"
        wins = "len(l) > 0 AND ns[alive[pos] + 1] >= ns[l[1] + 1]"
    else:
        stop = "list_position(list_transform(l, lambda j: ns[j + 1] > ns[alive[pos] + 1]), true)"
        lost = f"CASE WHEN {stop} IS NULL OR {stop} = 0 THEN l ELSE list_concat(l[1:{stop} - 1], [alive[pos]]) END"
        wins = "len(l) > 0"
    return f"""
WITH RECURSIVE {_NEAR},
walk(g, ns, nears, alive, gone, pos, round, won) AS (SELECT g, ns, nears, every, [-1], 1, 1, false FROM whole UNION ALL
  SELECT g, ns, nears, CASE WHEN pos > len(alive) THEN list_filter(alive, lambda i: NOT list_contains(gone, i)) ELSE alive END,
    CASE WHEN pos > len(alive) THEN [-1] WHEN list_contains(gone, alive[pos]) THEN gone ELSE list_concat(gone, {lost}) END,
    CASE WHEN pos > len(alive) THEN 1 ELSE pos + 1 END, CASE WHEN pos > len(alive) THEN round + 1 ELSE round END,
    CASE WHEN pos > len(alive) THEN false ELSE won OR (NOT list_contains(gone, alive[pos]) AND {wins}) END
  FROM (SELECT *, CASE WHEN pos <= len(alive) THEN {later} END AS l FROM walk) WHERE pos <= len(alive) OR (won AND round < {rounds})),
last AS (SELECT g, list_filter(alive, lambda i: NOT list_contains(gone, i)) AS alive FROM walk WHERE pos > len(alive) AND (NOT won OR round = {rounds}))
SELECT v.g AS session_id, v.i AS ord, 'term ' || (v.g * {PAGE} + v.i) AS text, n AS count FROM v JOIN last ON v.g = last.g AND list_contains(alive, v.i)
"""


# Slots: a step for each anchor's share, then one for each anchor of each round of what is lacking. b: the anchors' terms, best first; ptr: how far each has got.
SLOTS = f"""
WITH RECURSIVE {SIMS}, {TIERED},
own AS (SELECT session_id, tier, anchor_ord, list(ord ORDER BY CASE WHEN tier = 'white' THEN sim ELSE -sim END, ord) AS b FROM tiered GROUP BY ALL),
size AS (SELECT session_id, count(DISTINCT text)::INTEGER AS n FROM tiered GROUP BY 1), tiers AS (SELECT session_id, unnest(['green', 'white', 'orange']) AS tier, n, greatest(1, floor(n * 0.35))::INTEGER AS g FROM size),
slots AS (SELECT session_id, tier, CASE tier WHEN 'green' THEN g WHEN 'white' THEN least(greatest(1, floor(n * 0.10)), n - g) ELSE n - g - least(greatest(1, floor(n * 0.10)), n - g) END::INTEGER AS total FROM tiers),
start AS (SELECT session_id, tier, list_transform([0, 1, 2], lambda a: total // 3 + CASE WHEN a < total % 3 THEN 1 ELSE 0 END) AS share,
  [coalesce((SELECT b FROM own o WHERE o.session_id = s.session_id AND o.tier = s.tier AND anchor_ord = 0), []), coalesce((SELECT b FROM own o WHERE o.session_id = s.session_id AND o.tier = s.tier AND anchor_ord = 1), []),
   coalesce((SELECT b FROM own o WHERE o.session_id = s.session_id AND o.tier = s.tier AND anchor_ord = 2), [])] AS b FROM slots s),
walk(session_id, tier, share, b, ptr, taken, picks, lacking, k, turn, before_) AS (
  SELECT session_id, tier, share, b, [0, 0, 0], [-1], [{{'a': 0, 'o': 0, 'r': 0}}], 0, 1, [1, 2, 3], 0 FROM start UNION ALL
  SELECT session_id, tier, share, b, list_transform(ptr, lambda x, i: CASE WHEN i = a THEN to_ ELSE x END), list_concat(taken, p),
    list_concat(picks, list_transform(p, lambda o, i: {{'a': a, 'o': o, 'r': i + had}})), CASE WHEN k <= 3 THEN lacking + share[a] - len(p) ELSE lacking - len(p) END, k + 1,
    CASE WHEN k % 3 = 0 THEN list_transform(list_sort(list_transform([1, 2, 3], lambda i: [CASE WHEN i = a THEN to_ ELSE ptr[i] END - len(b[i]), i])), lambda x: x[2]) ELSE turn END,
    CASE WHEN k % 3 = 1 THEN len(taken) ELSE before_ END
  FROM (SELECT *, CASE WHEN len(p) < want AND want > 0 THEN len(b[a]) WHEN want = 0 THEN ptr[a] ELSE list_position(b[a], p[len(p)]) END AS to_, len(list_filter(picks, lambda x: x.a = a)) AS had
    FROM (SELECT *, list_filter(b[a][ptr[a] + 1:], lambda o: NOT list_contains(taken, o))[1:want] AS p FROM (SELECT *, turn[(k - 1) % 3 + 1] AS a, CASE WHEN k <= 3 THEN share[turn[(k - 1) % 3 + 1]] WHEN lacking > 0 THEN 1 ELSE 0 END AS want FROM walk)))
  WHERE k <= 3 OR lacking > 0 AND (k % 3 <> 1 OR k = 4 OR len(taken) > before_)),
last AS (SELECT session_id, tier, arg_max(picks, k) AS picks FROM walk GROUP BY 1, 2), picked AS (SELECT session_id, tier, unnest(picks) AS x FROM last)
SELECT p.session_id, t.text AS key, t.text, p.tier, t.anchor, (t.anchor_ord + 1)::INTEGER AS instance_index, x.r::INTEGER AS instance_rank, t.sim FROM picked p JOIN tiered t ON p.session_id = t.session_id AND t.ord = x.o AND t.anchor_ord = x.a - 1 WHERE x.a > 0
"""
VALIDATED = f"""
WITH RECURSIVE v AS (SELECT vec_id // {PAGE} AS session_id, (vec_id % {PAGE})::INTEGER AS ord, embedding::DOUBLE[] AS e FROM embeddings),
sims AS (SELECT a.session_id, a.ord, b.ord AS j, list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS s FROM v a JOIN v b ON a.session_id = b.session_id AND b.ord <= a.ord),
near AS (SELECT session_id, ord, coalesce(list(j) FILTER (s >= 0.9 AND j < ord), []) AS near, max(s) FILTER (j = 0) AS sim FROM sims GROUP BY 1, 2),
walk(session_id, ord, accepted, status, role, sim) AS (SELECT session_id, 0, [0], 'accepted', 'original', sim FROM near WHERE ord = 0 UNION ALL
  SELECT session_id, ord, CASE WHEN status = 'accepted' THEN list_append(accepted, ord) ELSE accepted END, status, CASE WHEN status = 'accepted' THEN CASE WHEN ord % 3 = 1 THEN 'gliner_entity_' ELSE 'variant_' END || len(accepted) END, sim
  FROM (SELECT n.session_id, n.ord, w.accepted, n.sim, CASE WHEN list_has_any(w.accepted, n.near) THEN 'duplicate' WHEN n.sim < 0.2 AND n.ord % 3 <> 1 THEN 'below_min_sim' ELSE 'accepted' END AS status FROM walk w JOIN near n ON w.session_id = n.session_id AND n.ord = w.ord + 1))
SELECT session_id, ord, 'term ' || (session_id * {PAGE} + ord) AS text, status, role, round(round(sim, 4), 3) AS sim FROM walk
"""

QUERIES = {
    "vector_norms": (vector_norms, "SELECT vec_id, round(3 * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS norm, 1.0::DOUBLE AS unit_norm FROM embeddings"),
    "cosine_rank": (cosine_rank, f"WITH {SIMS} SELECT session_id, ord, sim AS biencoder_score, row_number() OVER (PARTITION BY session_id ORDER BY sim DESC, ord)::INTEGER AS rank FROM sims WHERE anchor_ord = 0"),
    "rerank": (
        rerank,
        f"""WITH {SIMS}, c AS (SELECT session_id, ord, sim, CASE ord % 4 WHEN 0 THEN 0.0 WHEN 1 THEN (({PAGE} * session_id + ord) * 7 % 13 + 1) / 16.0 END AS x FROM sims WHERE anchor_ord = 0)
        SELECT session_id, ord, coalesce(nullif(x, 0), nullif(sim, 0), 0) AS relevance, row_number() OVER (PARTITION BY session_id ORDER BY x DESC NULLS LAST, ord)::INTEGER AS rank FROM c""",
    ),
    "anchor_matrix": (anchor_matrix, f"WITH {SIMS} SELECT session_id, anchor, ord, sim FROM sims"),
    "tiers_sim_quota": (tiers_sim_quota, f"WITH {SIMS}, {TIERED} SELECT session_id, anchor, ord, sim, tier FROM tiered"),
    "sim_percentiles": (
        sim_percentiles,
        f"""WITH {SIMS}, {TIERED} SELECT session_id, anchor, count(*) FILTER (tier = 'green') AS green, count(*) FILTER (tier = 'orange') AS orange, count(*) FILTER (tier = 'white') AS white,
        round(quantile_cont(sim + 0.000003, 0.1), 4) AS p10, round(quantile_cont(sim + 0.000003, 0.5), 4) AS p50, round(quantile_cont(sim + 0.000003, 0.9), 4) AS p90 FROM tiered GROUP BY 1, 2""",
    ),
    "seed_relevance": (
        seed_relevance,
        f"""WITH {SIMS}, r AS (SELECT t.session_id AS page_id, t.ord, list_dot_product(t.e, a.e) / (sqrt(list_dot_product(t.e, t.e)) * sqrt(list_dot_product(a.e, a.e))) AS s FROM v t JOIN v a ON t.session_id = a.session_id AND a.ord IN (1, 2))
        SELECT page_id, ord, count(*) FILTER (s >= 0.55) AS seed_hits, round(max(s), 4) AS seed_max, count(*) FILTER (s >= 0.55) >= 2 OR max(s) >= 0.70 AS relevant FROM r GROUP BY 1, 2""",
    ),
    "votes": (
        votes,
        f"""WITH {SIMS}, {TIERED}, c AS (SELECT session_id, text AS key, count(*) FILTER (tier = 'green') AS g, count(*) FILTER (tier = 'orange') AS o, count(*) FILTER (tier = 'white') AS w, avg(sim) AS m FROM tiered GROUP BY 1, 2)
        SELECT session_id, key, g AS green_votes, o AS orange_votes, w AS white_votes, round(g / 3, 4) AS stability, round(m, 4) AS mean_sim, 3 * g + 2 * o + w AS tier_points,
        CASE WHEN g >= 2 AND m >= 0.55 THEN 'green' WHEN w >= 2 AND m <= 0.35 THEN 'white' ELSE 'orange' END AS final_tier,
        CASE WHEN g >= 2 AND m >= 0.55 THEN CASE WHEN g = 3 THEN 'high' ELSE 'medium' END WHEN w >= 2 AND m <= 0.35 THEN CASE WHEN w = 3 THEN 'high' ELSE 'medium' END WHEN greatest(g, o, w) <= 1 THEN 'low' ELSE 'medium' END AS confidence FROM c""",
    ),
    "anchor_order": (
        anchor_order,
        f"SELECT DISTINCT vec_id // {PAGE} AS session_id, unnest(['anchor 2', 'anchor 1']) AS anchor, unnest([1, 2])::INTEGER AS instance_index FROM embeddings WHERE vec_id % {PAGE} = 2",
    ),
    "greedy_dedup": (greedy_dedup, _greedy(True, 50)),
    "greedy_dedup_legacy": (greedy_dedup_legacy, _greedy(False, 1000)),
    "title_clusters": (title_clusters, None),
    "top_up": (top_up, None),
    "anchored_tiers": (anchored_tiers, None),
    "validate_anchors": (validate_anchors, VALIDATED),
    "slot_fill": (slot_fill, SLOTS),
    "slot_fill_consensus": (slot_fill_consensus, None),
    "tier_eval": (
        tier_eval,
        f"""WITH {SIMS}, {TIERED}, old AS (SELECT session_id, text, tier AS o FROM tiered WHERE anchor_ord = 0), fresh AS (SELECT session_id, text, tier AS n, sim FROM tiered WHERE anchor_ord = 1 AND sim > -0.1)
        SELECT old.session_id, count(*) FILTER (o = 'green') AS green_old, count(*) FILTER (n = 'green') AS green_new, count(*) FILTER (n = 'white') AS white_new, count(*) FILTER (o <> n) AS moved, count(*) FILTER (o = 'green' AND n = 'white') AS green_to_white,
        count(*) FILTER (o = 'white' AND n = 'green') AS white_to_green, round(avg(sim) FILTER (n = 'green'), 4) AS green_sim, 0::BIGINT AS repeated_across_tiers FROM old LEFT JOIN fresh ON old.session_id = fresh.session_id AND old.text = fresh.text GROUP BY 1""",
    ),
    "span_metadata": (
        span_metadata,
        "SELECT p_brand AS session_id, lower(p_name) AS key, first(['Dog Breed', 'Brand', 'Topic', 'Dog Breed', 'Nonsense'][p_partkey % 5 + 1] ORDER BY p_size DESC, p_partkey) AS label, max(p_size) / 64.0 AS score FROM part GROUP BY 1, 2",
    ),
    "keyword_instances": (
        keyword_instances,
        f"""WITH {SIMS}, {TIERED} SELECT session_id, (anchor_ord + 1)::INTEGER AS instance_index, anchor, CASE WHEN anchor_ord = 0 THEN 'original' ELSE 'gliner_entity' END AS role, CASE WHEN anchor_ord > 0 THEN 'Topic' END AS label, CASE WHEN anchor_ord > 0 THEN 0.5 END::DOUBLE AS score,
        count(*) FILTER (tier = 'green') AS green, count(*) FILTER (tier = 'orange') AS orange, count(*) FILTER (tier = 'white') AS white, count(*) AS nlp_count,
        first(text ORDER BY sim DESC, ({PAGE} * session_id + ord) * 7 % 13 DESC, text) AS nearest FROM tiered GROUP BY session_id, anchor_ord, anchor""",
    ),
    "missing_vectors": (missing_vectors, "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL)"),
    "fuzzy_pairs": (fuzzy_pairs, FUZZY_PAIRS),
    "fuzzy_tier_dedup": (fuzzy_tier_dedup, FUZZY_TIERS),
    "fuzzy_domains": (fuzzy_domains, FUZZY_DOMAINS),
    "html_parse": (html_parse, None),
    "html_probe": (
        html_probe,
        """WITH p AS (SELECT page_id, lower(left(coalesce(html, ''), 8000)) AS low, url FROM pages), t AS (SELECT *, CASE WHEN contains(low, '<title') THEN substr(low, strpos(low, '<title')) END AS tag FROM p),
        i AS (SELECT *, CASE WHEN contains(tag, '>') THEN substr(tag, strpos(tag, '>') + 1) END AS inner_ FROM t),
        r AS (SELECT page_id, url, CASE WHEN contains(inner_, '</title') THEN left(left(inner_, strpos(inner_, '</title') - 1), 200) ELSE '' END AS page_title,
          contains(low, 'id="search"') OR contains(low, 'id=' || chr(39) || 'search' || chr(39)) OR contains(low, 'id="rso"') OR contains(low, 'id="main"') AS has_search_root,
          contains(low, 'unusual traffic') OR contains(low, 'not a robot') OR contains(low, 'before you continue') OR contains(low, 'verify you are human') OR contains(low, 'captcha') AS is_blocked FROM i)
        SELECT page_id, page_title, has_search_root, is_blocked, CASE WHEN contains(url, '/sorry/') THEN 'sorry' WHEN is_blocked THEN 'block_text' WHEN page_id % 3 = 0 AND NOT has_search_root THEN 'empty' END AS reason FROM r""",
    ),
    "chunk_windows": (chunk_windows, CHUNKS),
    "page_pipeline": (page_pipeline, None),
}
