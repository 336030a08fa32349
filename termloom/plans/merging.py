"""Queries of merging, tiers, buckets, labels and display."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import grouping as G
from ..operators import merge as M
from ..operators import ranking as R
from ..scratch import written
from .inputs import PARTS, TERMS, document_terms, part_terms, singular_sql, table

RATIO = 0.8


def merged(spark, d):
    return M.merge_terms(document_terms(spark, d), ratio=RATIO)


KEPT = f"""
{TERMS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY coalesce(nullif(weightage, 0), nullif(relevance, 0), keybert_score) DESC, count DESC, ord) AS r, count(*) OVER (PARTITION BY page_id) AS n FROM terms),
kept AS (SELECT * FROM ranked WHERE r <= greatest(1, ceil(n * {RATIO}))),
keyed AS (SELECT *, {singular_sql("text")} AS key, lower(source) AS src FROM kept WHERE text <> domain)
"""
MERGED = f"""
{KEPT},
form AS (SELECT session_id, key, first(text ORDER BY k DESC, length(text) DESC, text) AS form FROM (SELECT session_id, key, text, count(*) AS k FROM keyed GROUP BY ALL) GROUP BY ALL),
lab AS (SELECT session_id, key, first(label ORDER BY k DESC, f) AS label FROM (SELECT session_id, key, label, sum(count) AS k, min((page_id, ord)) AS f FROM keyed WHERE label IS NOT NULL GROUP BY ALL) GROUP BY ALL),
agg AS (SELECT session_id, key, sum(count)::BIGINT AS combined_count, array_to_string(list_sort(list(DISTINCT src)), ',') AS sources,
  round(sum(relevance * count) / sum(count), 4) AS average_relevance, round(sum(weightage * count) / sum(count), 4) AS average_weightage,
  round(coalesce(sum(keybert_score * count) FILTER (src = 'keybert') / sum(count) FILTER (src = 'keybert'), 0), 4) AS average_keybert_score,
  count(DISTINCT domain) AS competitor_count, array_to_string(list_sort(list(DISTINCT domain)), ',') AS found_in_files,
  coalesce(sum(count) FILTER (src = 'gliner'), 0)::BIGINT AS gliner_count FROM keyed GROUP BY session_id, key),
ent AS (SELECT agg.*, form AS text, coalesce(label, CASE WHEN contains(sources, 'keybert') THEN 'Keyphrase' ELSE 'Other' END) AS label,
  least(greatest(competitor_count, 1), 3)::INTEGER AS competitor_multiplier, average_weightage * least(greatest(competitor_count, 1), 3) AS adjusted_weightage
  FROM agg JOIN form USING (session_id, key) LEFT JOIN lab USING (session_id, key))
"""


def keep_ratio(spark, d):
    kept = R.keep_ratio(document_terms(spark, d), RATIO, ["page_id"], F.coalesce(F.nullif("weightage", F.lit(0)), F.nullif("relevance", F.lit(0)), F.col("keybert_score")), [F.desc("count"), "ord"])
    return kept.select("page_id", "text", "count", "weightage")


def merge_entities(spark, d):
    m = merged(spark, d)
    return m.select("session_id", "key", "text", "label", "combined_count", F.array_join("sources", ",").alias("sources"), F.coalesce(F.element_at("source_counts", "gliner"), F.lit(0)).alias("gliner_count"), "average_relevance", "average_weightage",
                    "average_keybert_score", "competitor_count", F.array_join("found_in_files", ",").alias("found_in_files"), "competitor_multiplier", "adjusted_weightage")


def word_range(spark, d):
    pages = M.page_statistics(table(spark, d, "documents").select(F.col("lang").alias("session_id"), X.word_count("text").alias("words")), ["session_id"], ["words"])
    rows = written(merged(spark, d)).join(pages, "session_id")
    return M.word_range(rows, "avg_words", ["session_id"]).select("session_id", "key", "word_range")


def page_stats(spark, d):
    docs = table(spark, d, "documents").select(F.col("lang").alias("session_id"), X.word_count("text").alias("word_count"), F.size(F.split("text", "\n")).alias("para_count"))
    return M.page_statistics(docs, ["session_id"], ["word_count", "para_count"])


def display_form(spark, d):
    p = table(spark, d, "part")
    return M.best_form(p.select(F.lower("p_name").alias("key"), F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, "s").otherwise("")).alias("form"), F.lit(1).alias("n")), ["key"], "form")


def label_vote(spark, d):
    e = table(spark, d, "events").withColumn("one", F.lit(1))
    return M.vote(e, ["user_id"], "event_type", "one", "event_id")


def merge_by_occurrence(spark, d):
    m = M.merge_by_occurrence(document_terms(spark, d))
    return m.select("session_id", "key", "text", "label", "combined_count", "average_relevance", "average_weightage", "competitor_count", "adjusted_weightage")


def competitor_domains(spark, d):
    p = table(spark, d, "pages")
    from ..functions.urls import netloc

    return M.competitor_domains(p.select((F.col("page_id") % 5).alias("session_id"), "page_id", netloc("url").alias("domain")), ["session_id"], "page_id")


def entity_texts(spark, d):
    t = part_terms(spark, d).withColumn("text", F.when(F.col("ord") % 2 == 0, F.upper("text")).otherwise(F.col("text")))
    return M.entity_texts(t, ["session_id"], ["ord"]).select("session_id", "ord", "text")


def embedding_map(spark, d):
    e = table(spark, d, "embeddings").select(F.lit(1).alias("session_id"), F.concat(F.lit("Terms "), F.col("vec_id") % 100, F.lit(" homes")).alias("text"), "vec_id", "embedding")
    m = M.embedding_map(e, ["session_id"], "vec_id")
    return m.select("key", F.element_at("embedding", 1).cast("double").alias("first"))


def tiers_percentile(spark, d):
    """The flagship: merged terms of a session, their tier and how often each is to be used."""
    rows = word_range_rows(spark, d)
    return R.percentile_tiers(rows, ["session_id"], [F.desc("average_weightage"), "key"], large=True).select("session_id", "key", "tier", "competitor_count", "word_range")


def word_range_rows(spark, d):
    pages = M.page_statistics(table(spark, d, "documents").select(F.col("lang").alias("session_id"), X.word_count("text").alias("words")), ["session_id"], ["words"])
    return M.word_range(written(merged(spark, d)).join(pages, "session_id"), "avg_words", ["session_id"])


_RANGE = f"""
WITH {MERGED}, st AS (SELECT lang AS session_id, round(avg(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))), 2) AS avg_words FROM documents GROUP BY 1),
ranged AS (SELECT ent.*, CASE WHEN sum(adjusted_weightage) OVER (PARTITION BY session_id) > 0 AND avg_words > 0
  THEN ceil(adjusted_weightage / sum(adjusted_weightage) OVER (PARTITION BY session_id) * (avg_words * 0.60)) ELSE 0 END::BIGINT AS word_range FROM ent JOIN st USING (session_id))
"""


def slot_counts(spark, d):
    rows = table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    g, w, o = R.quota_counts(F.col("n"))
    return rows.select("label", g.alias("green"), w.alias("white"), o.alias("orange"), *(R.slot_share(g, F.lit(3), F.lit(i)).alias(f"share_{i}") for i in range(3)))


def numeric_cap(spark, d):
    t = part_terms(spark, d).withColumn("text", F.when(F.col("ord") % 2 == 0, F.concat("text", F.lit(" "), "ord")).otherwise(F.col("text")))
    return R.numeric_cap(t, ["session_id", "tier"], ["ord"], exempt=["hot gear 4"]).select("session_id", "tier", "ord", "text")


def word_buckets(spark, d):
    b = G.word_buckets(part_terms(spark, d), ["session_id", "tier"], ["ord"])
    return b.select("session_id", "tier", "word", "nlp_count", F.array_join(F.transform("nlps", lambda x: x["text"]), "|").alias("nlps"))


def label_groups(spark, d):
    g = G.label_groups(part_terms(spark, d), ["ord"])
    return g.select("label", "n", F.array_join("texts", "|").alias("texts"))


def label_cap(spark, d):
    return R.label_cap(part_terms(spark, d), G.LABEL_CAPS, ["session_id"], ["ord"]).select("session_id", "tier", "ord", "text", "label")


def display_dedupe(spark, d):
    t = part_terms(spark, d).withColumn("text", F.when(F.col("ord") % 3 == 0, F.concat(F.lit("The "), "text")).otherwise(F.col("text")))
    return G.display_terms(t, ["session_id", "tier"], ["ord"]).select("session_id", "tier", "text", "combined_count", "place")


def visible_tiers(spark, d):
    t = part_terms(spark, d)
    allowed = t.where("combined_count > 25").select("text")
    return G.visible_statistics(G.visible_terms(t, ["session_id"], ["ord"], allowed), ["session_id"])


def tier_sizes(spark, d):
    return G.tier_counts(part_terms(spark, d), ["session_id"])


def source_filter(spark, d):
    m = G.source_filter(merged(spark, d), ["KeyBERT"])
    return m.groupBy("session_id").agg(F.count("*").alias("n"), F.sum("combined_count").alias("total"))


def pick_labels(spark, d):
    """Labels of phrases from spans; names of parts stand for both."""
    t = part_terms(spark, d)
    spans = t.select(F.col("text").alias("phrase"), F.when(F.col("ord") % 4 == 0, F.col("text")).otherwise(F.lit("other")).alias("text"), "label", (F.col("ord") / 1024.0).alias("score"))
    return G.pick_labels(t.select("text"), spans, keyword="Hot Gear")


def enrich_page(spark, d):
    t = document_terms(spark, d)
    pages = table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.col("source").alias("domain"))
    out = M.enrich_page_terms(t, pages, "the")
    return out.select("page_id", "ord", "text", "count", "relevance")


def export_view(spark, d):
    """Parts as terms of an export: middle of the range, tier, totals of each brand."""
    p = table(spark, d, "part").select("p_brand", X.midpoint(F.col("p_size") % 9, "p_size").alias("n"), (F.col("p_partkey") % 3 > 0).alias("included"), (F.col("p_partkey") % 2 == 0).alias("is_nlp"))
    out = G.export_filter(p, nlp_only=True)
    return out.groupBy("p_brand").agg(F.count("*").alias("terms"), F.count_if("included").alias("green"), F.sum("n").alias("occurrences"))


QUERIES = {
    "keep_ratio": (keep_ratio, f"WITH {KEPT} SELECT page_id, text, count, weightage FROM kept"),
    "merge_entities": (merge_entities, f"WITH {MERGED} SELECT * FROM ent"),
    "word_range": (word_range, f"{_RANGE} SELECT session_id, key, word_range FROM ranged"),
    "page_stats": (
        page_stats,
        """SELECT lang AS session_id, count(*) AS total_files, round(avg(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))), 2) AS avg_word_count, round(avg(len(string_split(text, chr(10)))), 2) AS avg_para_count FROM documents GROUP BY 1""",
    ),
    "display_form": (
        display_form,
        """WITH f AS (SELECT lower(p_name) AS key, p_name || CASE WHEN p_partkey % 3 = 0 THEN 's' ELSE '' END AS form, count(*) AS k FROM part GROUP BY 1, 2) SELECT key, first(form ORDER BY k DESC, length(form) DESC, form) AS form FROM f GROUP BY key""",
    ),
    "label_vote": (
        label_vote,
        "WITH v AS (SELECT user_id, event_type, count(*) AS k, min(event_id) AS f FROM events GROUP BY 1, 2) SELECT user_id, first(event_type ORDER BY k DESC, f) AS event_type FROM v GROUP BY 1",
    ),
    "merge_by_occurrence": (
        merge_by_occurrence,
        f"""WITH {TERMS}, k AS (SELECT *, {singular_sql("text")} AS key FROM terms),
        f AS (SELECT session_id, key, first(text ORDER BY n DESC, length(text) DESC, text) AS text FROM (SELECT session_id, key, text, count(*) AS n FROM k GROUP BY ALL) GROUP BY ALL),
        a AS (SELECT session_id, key, count(*) AS combined_count, first(label ORDER BY page_id, ord) AS label, round(avg(relevance), 4) AS average_relevance, round(avg(weightage), 4) AS average_weightage, count(DISTINCT domain) AS competitor_count FROM k GROUP BY ALL)
        SELECT a.*, text, average_weightage * least(greatest(competitor_count, 1), 3) AS adjusted_weightage FROM a JOIN f USING (session_id, key)""",
    ),
    "competitor_domains": (
        competitor_domains,
        """SELECT page_id % 5 AS session_id, regexp_replace(split_part(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), ':', 1), '^(www|m|amp)\\.', '') AS domain, min(page_id) AS first FROM pages GROUP BY 1, 2 HAVING domain <> ''""",
    ),
    "entity_texts": (
        entity_texts,
        f"""WITH {PARTS} SELECT session_id, ord, CASE WHEN ord % 2 = 0 THEN upper(text) ELSE text END AS text FROM (SELECT *, row_number() OVER (PARTITION BY session_id, lower(text) ORDER BY ord) AS r FROM parts) WHERE r = 1""",
    ),
    "embedding_map": (
        embedding_map,
        "SELECT 'terms ' || vec_id % 100 || ' home' AS key, first(embedding[1] ORDER BY vec_id DESC)::DOUBLE AS first FROM embeddings GROUP BY 1",
    ),
    "tiers_percentile": (
        tiers_percentile,
        f"""{_RANGE}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY average_weightage DESC, key) AS r, count(*) OVER (PARTITION BY session_id) AS n FROM ranged),
        g AS (SELECT *, greatest(1, floor(n * 0.35)) AS g FROM r)
        SELECT session_id, key, CASE WHEN r <= g THEN 'green' WHEN r <= g + greatest(1, floor((n - g) * 0.1)) THEN 'white' ELSE 'orange' END AS tier, competitor_count, word_range FROM g""",
    ),
    "slot_counts": (
        slot_counts,
        """WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), g AS (SELECT *, greatest(1, floor(n * 0.35))::BIGINT AS green FROM c), w AS (SELECT *, least(greatest(1, floor(n * 0.10)), n - green)::BIGINT AS white FROM g)
        SELECT label, green, white, (n - green - white)::BIGINT AS orange, (green // 3 + CASE WHEN green % 3 > 0 THEN 1 ELSE 0 END)::BIGINT AS share_0, (green // 3 + CASE WHEN green % 3 > 1 THEN 1 ELSE 0 END)::BIGINT AS share_1, (green // 3)::BIGINT AS share_2 FROM w""",
    ),
    "numeric_cap": (
        numeric_cap,
        f"""WITH {PARTS}, t AS (SELECT session_id, tier, ord, CASE WHEN ord % 2 = 0 THEN text || ' ' || ord ELSE text END AS text FROM parts), c AS (SELECT *, (regexp_matches(text, '\\d') AND lower(text) <> 'hot gear 4')::INTEGER AS c FROM t)
        SELECT session_id, tier, ord, text FROM (SELECT *, sum(c) OVER (PARTITION BY session_id, tier ORDER BY ord ROWS UNBOUNDED PRECEDING) AS s FROM c) WHERE c = 0 OR s <= 2""",
    ),
    "word_buckets": (
        word_buckets,
        f"""WITH {PARTS}, u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, tier, lower(text) ORDER BY ord) AS r FROM parts) WHERE r = 1),
        k AS (SELECT session_id, tier, text, list_distinct(list_transform(regexp_extract_all(lower(text), '[a-z]+'), lambda x: {singular_sql("x")})) AS ts FROM u),
        b AS (SELECT DISTINCT session_id, tier, unnest(ts) AS word FROM k),
        m AS (SELECT k.session_id, k.tier, word, text FROM k JOIN b ON k.session_id = b.session_id AND k.tier = b.tier WHERE word NOT IN ({", ".join(f"'{w}'" for w in X.BUCKET_STOP_WORDS)}) AND len(list_filter(ts, lambda t: t = word OR (length(word) >= 3 AND contains(t, word)))) > 0)
        SELECT session_id, tier, word, count(*) AS nlp_count, string_agg(text, '|' ORDER BY text) AS nlps FROM m GROUP BY 1, 2, 3 HAVING count(*) >= 2""",
    ),
    "label_groups": (
        label_groups,
        f"""WITH {PARTS}, c AS (SELECT unnest([{", ".join(f"'{x}'" for x in G.LABELS)}]) AS label), r AS (SELECT CASE WHEN label IN (SELECT label FROM c) THEN label ELSE 'Other' END AS label, text, ord FROM parts),
        u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label, lower(text) ORDER BY ord) AS k FROM r) WHERE k = 1)
        SELECT c.label, count(u.text) AS n, coalesce(string_agg(u.text, '|' ORDER BY u.text), '') AS texts FROM c LEFT JOIN u ON c.label = u.label GROUP BY c.label""",
    ),
    "label_cap": (
        label_cap,
        f"""WITH {PARTS}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id, label ORDER BY CASE tier WHEN 'green' THEN 0 WHEN 'orange' THEN 1 ELSE 2 END, ord) AS r FROM parts), b AS (SELECT *, min(r) OVER (PARTITION BY session_id, label, lower(text)) AS b FROM r)
        SELECT session_id, tier, ord, text, label FROM b WHERE label <> 'Dog Breed' OR b <= 4""",
    ),
    "display_dedupe": (
        display_dedupe,
        f"""WITH {PARTS}, v AS (SELECT *, row_number() OVER (PARTITION BY session_id, tier ORDER BY ord) AS p FROM parts WHERE label NOT IN ('Brand', 'Address', 'Language', 'Company'))
        SELECT session_id, tier, first(text ORDER BY combined_count DESC, p) AS text, max(combined_count) AS combined_count, min(p)::INTEGER AS place FROM v GROUP BY session_id, tier, lower(text)""",
    ),
    "visible_tiers": (
        visible_tiers,
        f"""WITH {PARTS}, a AS (SELECT * FROM parts WHERE lower(text) IN (SELECT lower(text) FROM parts WHERE combined_count > 25)),
        r AS (SELECT *, row_number() OVER (PARTITION BY session_id, label ORDER BY CASE tier WHEN 'green' THEN 0 WHEN 'orange' THEN 1 ELSE 2 END, ord) AS r FROM a), b AS (SELECT *, min(r) OVER (PARTITION BY session_id, label, lower(text)) AS b FROM r),
        s AS (SELECT session_id, tier, lower(text) AS k, max(combined_count) AS c FROM b WHERE (label <> 'Dog Breed' OR b <= 4) AND label NOT IN ('Brand', 'Address', 'Language', 'Company') GROUP BY 1, 2, 3)
        SELECT session_id, count(*) AS unique_count, sum(c)::BIGINT AS occurrence_count FROM s GROUP BY 1""",
    ),
    "tier_sizes": (
        tier_sizes,
        f"WITH {PARTS} SELECT session_id, count(*) FILTER (tier = 'green') AS green, count(*) FILTER (tier = 'orange') AS orange, count(*) FILTER (tier = 'white') AS white FROM parts GROUP BY 1",
    ),
    "source_filter": (source_filter, f"WITH {MERGED} SELECT session_id, count(*) AS n, sum(combined_count)::BIGINT AS total FROM ent WHERE contains(sources, 'keybert') GROUP BY 1"),
    "pick_labels": (
        pick_labels,
        f"""WITH {PARTS} SELECT lower(text) AS text, CASE WHEN lower(text) = 'hot gear' THEN 'Phrase' ELSE first(CASE WHEN label = 'Nonsense' THEN 'Other' ELSE label END ORDER BY ord % 4 = 0 DESC, ord DESC) END AS label FROM parts GROUP BY lower(text)""",
    ),
    "enrich_page": (
        enrich_page,
        f"""WITH {TERMS} SELECT doc_id AS page_id, -1::BIGINT AS ord, 'the' AS text, 1::BIGINT AS count, 1.0::DOUBLE AS relevance FROM documents UNION ALL SELECT page_id, ord, text, count, relevance FROM terms WHERE text <> 'the' AND text <> domain""",
    ),
    "export_view": (
        export_view,
        """WITH p AS (SELECT *, CASE WHEN (p_size % 9 + p_size) % 4 = 1 THEN (p_size % 9 + p_size) // 2 ELSE (p_size % 9 + p_size + 1) // 2 END AS n FROM part WHERE p_partkey % 2 = 0)
        SELECT p_brand, count(*) AS terms, count(*) FILTER (p_partkey % 3 > 0) AS green, sum(n)::BIGINT AS occurrences FROM p GROUP BY 1""",
    ),
}
