"""Merging terms over competing pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from .ranking import keep_ratio

WORD_SHARE = 0.60


def multiplier(competitors: Column | str) -> Column:
    c = F.col(competitors) if isinstance(competitors, str) else competitors
    return F.least(F.greatest(c, F.lit(1)), F.lit(3)).cast("int")


def page_statistics(pages: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Number of pages and averages of the columns, two decimals."""
    return pages.groupBy(*by).agg(F.count("*").alias("total_files"), *(F.round(F.avg(c), 2).alias(f"avg_{c}") for c in columns))


def best_form(forms: DataFrame, by: Sequence[str], form: str, n: str = "n") -> DataFrame:
    """(by, form): of each group the form with the highest count, then the longest, then the first in order."""
    each = forms.groupBy(*by, form).agg(F.sum(n).alias("__n"))
    return each.groupBy(*by).agg(F.min_by(form, F.struct(-F.col("__n"), -F.char_length(form), F.col(form))).alias(form))


def vote(rows: DataFrame, by: Sequence[str], value: str, weight: str, first: str) -> DataFrame:
    """(by, value): of each group the value with the highest weight, then the one seen first."""
    each = rows.where(F.coalesce(F.col(value), F.lit("")) != "").groupBy(*by, value).agg(F.sum(weight).alias("__w"), F.min(first).alias("__first"))
    return each.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("__w"), F.col("__first"))).alias(value))


def clean_terms(terms: DataFrame, text: str = "text", domain: str = "domain", count: str = "count") -> DataFrame:
    """Terms that can be merged, with key and form: no blanks, n/a, bare numbers or labels of the page's own host; counts are one at least."""
    ok = ~U.is_banned(text, U.domain_tokens(domain)) & (F.lower(F.col(text)) != "n/a")
    counted = F.greatest(F.coalesce(F.col(count).cast("long"), F.lit(1)), F.lit(1))
    return terms.where(ok).withColumns({count: counted, "key": T.entity_key(text), "form": F.lower(T.trimmed(text))})


def merge_terms(terms: DataFrame, by: Sequence[str] = ("session_id",), ratio: float = 1.0, page: Sequence[str] = ("page_id",)) -> DataFrame:
    """One row for each merged entity of a session.

    terms: by, page, domain, text, label, source, count, relevance, weightage,
    keybert_score, ord (the term's place in its page). Of each page the best
    ratio of terms takes part. Averages are weighted by count; the label is
    voted for by count. Sums combine on the map side; nothing of a key is
    gathered but its distinct sources and domains, which are columns of the
    result: so many strings as sites have the term.
    """
    by, page = list(by), list(page)
    score = F.coalesce(F.nullif("weightage", F.lit(0)), F.nullif("relevance", F.lit(0)), F.col("keybert_score"), F.lit(0.0))
    top = keep_ratio(terms, ratio, [*by, *page], score, [F.coalesce("count", F.lit(1)).desc(), F.col("ord")])
    rows = clean_terms(top).withColumn("source", F.lower(F.coalesce(F.nullif("source", F.lit("")), F.lit("gliner"))))
    keys = [*by, "key"]
    weighted = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0.0)) * F.col("count"))
    bert = F.col("source") == "keybert"
    # one row for each combination that occurs, then sums of these for several groupings at once: rows are read and shuffled once
    each = rows.groupBy(*keys, "source", "form", "label", "domain").agg(
        F.count("*").alias("rows"), F.sum("count").alias("count"), weighted("relevance").alias("relevance"), weighted("weightage").alias("weightage"),
        F.coalesce(F.sum(F.when(bert, F.coalesce("keybert_score", F.lit(0.0)) * F.col("count"))), F.lit(0.0)).alias("keybert"), F.min(F.struct(*page, "ord")).alias("first"),
    )
    kinds = ("source", "form", "label", "domain")
    sets = [[F.col(c) for c in (*keys, *kind)] for kind in ((), *((k,) for k in kinds))]
    sums = each.groupingSets(sets, *keys, *kinds).agg(F.grouping_id().alias("g"), *(F.sum(c).alias(c) for c in ("rows", "count", "relevance", "weightage", "keybert")), F.min("first").alias("first"))
    of = {kind: F.col("g") == 15 - (8 >> i) for i, kind in enumerate(kinds)}  # the bit of a column that is grouped by is 0
    whole = lambda c: F.max(F.when(F.col("g") == 15, F.col(c)))
    bert_count = F.sum(F.when(of["source"] & bert, F.col("count")))
    named = of["label"] & (F.coalesce("label", F.lit("")) != "")
    out = sums.groupBy(*keys).agg(
        whole("count").alias("combined_count"),
        F.sort_array(F.collect_list(F.when(of["source"], F.struct("source", F.col("count").alias("n"))))).alias("by_source"),
        F.round(whole("relevance") / whole("count"), 4).alias("average_relevance"),
        F.round(whole("weightage") / whole("count"), 4).alias("average_weightage"),
        F.round(F.coalesce(F.sum(F.when(of["source"] & bert, F.col("keybert"))) / bert_count, F.lit(0.0)), 4).alias("average_keybert_score"),
        F.count_if(of["domain"] & F.col("domain").isNotNull()).alias("competitor_count"),
        F.sort_array(F.collect_list(F.when(of["domain"], F.col("domain")))).alias("found_in_files"),
        whole("first").alias("first_seen"),
        F.min_by("form", F.when(of["form"], F.struct(-F.col("rows"), -F.char_length("form"), F.col("form")))).alias("form"),
        F.min_by("label", F.when(named, F.struct(-F.col("count"), F.col("first")))).alias("label"),
    ).withColumns({"sources": F.transform("by_source", lambda x: x["source"]), "source_counts": F.map_from_entries("by_source")})
    other = F.when(F.array_contains("sources", "keybert"), "Keyphrase").otherwise("Other")
    return out.select(
        *keys,
        T.display_form("form").alias("text"),
        F.coalesce("label", other).alias("label"),
        "combined_count", "sources", "source_counts", "average_relevance", "average_weightage", "average_keybert_score",
        "competitor_count", "found_in_files", "first_seen",
        multiplier("competitor_count").alias("competitor_multiplier"),
        (F.col("average_weightage") * multiplier("competitor_count")).alias("adjusted_weightage"),
    )


def word_range(entities: DataFrame, average_words: Column | str, by: Sequence[str], weight: str = "adjusted_weightage") -> DataFrame:
    """Column word_range: an entity's share of the weight, of 60 % of the average words of a page, rounded up; 0 without words."""
    x = (F.col(average_words) if isinstance(average_words, str) else average_words) * WORD_SHARE
    totals = entities.groupBy(*by).agg(F.sum(weight).alias("__total"))
    share = F.when((F.col("__total") > 0) & (x > 0), F.ceil(F.col(weight) / F.col("__total") * x)).otherwise(0).cast("long")
    return entities.join(totals, list(by)).withColumn("word_range", share).drop("__total")


def merge_by_occurrence(terms: DataFrame, by: Sequence[str] = ("session_id",), page: Sequence[str] = ("page_id",)) -> DataFrame:
    """The variant that counts rows instead of adding up counts, and takes the label seen first."""
    keys = [*by, "key"]
    rows = terms.where(T.trimmed("text") != "").withColumns({"key": T.entity_key("text"), "form": F.lower(T.trimmed("text")), "seen": F.struct(*page, "ord")})
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("combined_count"), F.min_by("label", "seen").alias("label"), F.round(F.avg("relevance"), 4).alias("average_relevance"),
        F.round(F.avg("weightage"), 4).alias("average_weightage"), F.count_distinct("domain").alias("competitor_count"),
    )
    out = sums.join(best_form(rows.withColumn("n", F.lit(1)), keys, "form"), keys)
    return out.withColumn("adjusted_weightage", F.col("average_weightage") * multiplier("competitor_count")).withColumn("text", T.display_form("form")).drop("form")


def competitor_domains(pages: DataFrame, by: Sequence[str], order: str, domain: str = "domain") -> DataFrame:
    """(by, domain, first): distinct normalised host names and where each comes first."""
    host = U.competitor_host(domain)
    return pages.withColumn("domain", host).where("domain <> ''").groupBy(*by, "domain").agg(F.min(order).alias("first"))


def entity_texts(terms: DataFrame, by: Sequence[str], order: Sequence) -> DataFrame:
    """Distinct texts of any case, the first of each, without blanks and n/a."""
    from .ranking import first_of

    rows = terms.withColumn("text", T.trimmed("text")).where("text <> '' AND lower(text) <> 'n/a'")
    return first_of(rows, [*by, F.lower("text")], order)


def embedding_map(terms: DataFrame, by: Sequence[str], order: str, vector: str = "embedding") -> DataFrame:
    """(by, key, vector): the last vector of each merged key."""
    rows = terms.where(F.col(vector).isNotNull()).withColumn("key", T.entity_key("text"))
    return rows.groupBy(*by, "key").agg(F.max_by(vector, order).alias(vector))


def aggregate_spans(spans: DataFrame, by: Sequence[str] = ("page_id",), order: str = "ord") -> DataFrame:
    """Extracted spans by text of any case: count, and the most frequent spelling and label, the first of equals."""
    rows = spans.where(T.valid_span("text")).withColumns({"text": T.trimmed("text"), "label": F.coalesce(F.nullif(F.trim("label"), F.lit("")), F.lit("Other"))}).withColumn("key", F.lower("text"))
    keys = [*by, "key"]
    sets = [[F.col(c) for c in (*keys, *kind)] for kind in ((), ("text",), ("label",))]
    sums = rows.groupingSets(sets, *keys, "text", "label").agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.min(order).alias("first"))
    best = lambda c, g: F.min_by(c, F.when(F.col("g") == g, F.struct(-F.col("n"), F.col("first")))).alias(c)
    whole = F.col("g") == 3
    return sums.groupBy(*keys).agg(F.max(F.when(whole, F.col("n"))).alias("count"), F.min(F.when(whole, F.col("first"))).alias("first"), best("text", 1), best("label", 2))


def enrich_page_terms(terms: DataFrame, pages: DataFrame, keyword: str, by: Sequence[str] = ("page_id",)) -> DataFrame:
    """A page's terms behind the keyword itself, without banned, long and repeated ones.

    terms: by, ord, text, label, count, relevance; pages: by, domain.
    """
    from .ranking import first_of

    own = pages.select(*by, F.lit(-1).cast("long").alias("ord"), F.lit(keyword.strip()).alias("text"), F.lit("Phrase").alias("label"), F.lit(1).cast("long").alias("count"), F.lit(1.0).alias("relevance"))
    rows = own.where("text <> ''").unionByName(terms.select(*by, F.col("ord").cast("long"), "text", "label", F.col("count").cast("long"), F.col("relevance").cast("double")))
    rows = rows.join(pages.select(*by, "domain"), list(by)).where(T.within_word_limit("text", [keyword]))
    rows = rows.where((F.col("ord") < 0) | ~U.is_banned("text", U.domain_tokens("domain"))).drop("domain")
    return first_of(rows, [*by, T.text_key("text")], ["ord"])


def weightage(terms: DataFrame, by: Sequence[str] = ("page_id",), authority: str = "authority") -> DataFrame:
    """Column weightage: 60 % relevance, 25 % authority, 10 % tf-idf and 5 % count, the last two by the page's maximum."""
    page = Window.partitionBy(*by)
    share = lambda c: F.when(F.max(c).over(page) > 0, F.col(c) / F.max(c).over(page)).otherwise(0.0)
    trust = F.when(F.col(authority) > 0, F.least(F.col(authority) / 10, F.lit(1.0))).otherwise(0.0)
    return terms.withColumn("weightage", F.round(F.col("relevance") * 0.60 + trust * 0.25 + share("tfidf") * 0.10 + share("count") * 0.05, 4))
