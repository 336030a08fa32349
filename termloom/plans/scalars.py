"""Queries of scalar functions over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import text as X
from ..functions import urls as U
from ..operators import stores as O
from ..operators.merge import clean_terms, weightage
from ..operators.ranking import first_of
from .inputs import TERMS, document_terms, part_terms, singular_sql, table


def _quoted(items) -> str:
    return ", ".join(f"'{x}'" for x in items)


def url_normalize(spark, d):
    return table(spark, d, "pages").select("page_id", U.normalized("url").alias("normalized"))


_NORMAL = f"""(split_part(url, '#', 1).split_part('?', 1).regexp_replace('/+$', '') ||
  CASE WHEN len(list_filter(string_split(CASE WHEN contains(split_part(url, '#', 1), '?') THEN regexp_extract(split_part(url, '#', 1), '\\?(.*)$', 1) ELSE '' END, '&'),
                lambda p: split_part(p, '=', 1) NOT IN ('', {_quoted(U.TRACKING)}))) = 0 THEN ''
  ELSE '?' || array_to_string(list_transform(list_filter(string_split(regexp_extract(split_part(url, '#', 1), '\\?(.*)$', 1), '&'),
                lambda p: split_part(p, '=', 1) NOT IN ('', {_quoted(U.TRACKING)})), lambda p: split_part(p, '=', 1) || '=' || regexp_extract(p, '^[^=]*=(.*)$', 1)), '&') END)"""


def url_dedup_first(spark, d):
    """Each URL once, at its first place, of the first rows of each host."""
    rows = table(spark, d, "pages").select("page_id", U.normalized("url").alias("normalized"), U.bare_host("url").alias("host"))
    from ..operators.ranking import top_n

    return first_of(top_n(rows, ["host"], ["page_id"], 20), ["normalized"], ["page_id"])


def organic_hosts(spark, d):
    return table(spark, d, "pages").select("page_id", U.bare_host("url").alias("host"), U.is_organic("url").alias("organic"), U.is_social("url").alias("social"))


def host_normalize(spark, d):
    p = table(spark, d, "pages").select("page_id", U.netloc("url").alias("n"))
    return p.select("page_id", U.competitor_host("n").alias("host"), F.array_join(F.array_sort(U.domain_tokens("n")), ",").alias("tokens"))


def domain_tokens_ban(spark, d):
    """Terms of documents that a page on a host of their own name would drop."""
    t = document_terms(spark, d)
    host = F.concat(F.lit("www."), F.col("domain"), F.lit("."), F.substring("text", 1, 3), F.lit(".com"))
    kept = clean_terms(t.withColumn("domain", host))
    return t.groupBy("session_id").agg(F.count("*").alias("n_terms")).join(kept.groupBy("session_id").agg(F.count("*").alias("n_kept")), "session_id", "left")


def answer_json(spark, d):
    """Answers about suppliers: a final part with an object, one in a fence, an object in prose, none."""
    s, n = table(spark, d, "supplier"), F.col("s_suppkey") % 4
    told = F.concat(F.lit('{"descriptions": ["'), F.col("s_name"), F.lit('"]}'))
    text = (
        F.when(n == 0, F.concat(F.lit('thinking {"a": 1} assistantfinal so: '), told, F.lit(' and {"b": {}} done')))
        .when(n == 1, F.concat(F.lit("here\n```json\n"), told, F.lit("\n```\nbye")))
        .when(n == 2, F.concat(F.lit('first {"x": 2}, then {"y": '), F.col("s_suppkey"), F.lit("}.")))
        .otherwise(F.lit("no {object here"))
    )
    return s.select("s_suppkey", A.answer_json(text).alias("answer"))


def undescribed(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("title"), "o_orderstatus")
    done = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("title"), F.when(F.col("l_linenumber") > 3, " x").otherwise(" ").alias("description"))
    return O.undescribed(o, done)


def english_documents(spark, d):
    return table(spark, d, "documents").where(X.is_english("lang")).select("doc_id")


def token_tf(spark, d):
    return document_terms(spark, d).select("page_id", "text", "count")


def bucket_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(X.bucket_words("text")), " ").alias("words"))


def singularize_keys(spark, d):
    return document_terms(spark, d).groupBy(X.entity_key("text").alias("key")).agg(F.sum("count").alias("n"), F.count_distinct("text").alias("forms"))


def content_gate(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", F.substring("text", 1, 40).alias("title"))
    skip, most = X.gate("text", "title")
    return docs.select("doc_id", X.word_count("text").cast("long").alias("word_count"), skip.alias("skip_reason"), most.cast("long").alias("max_terms"), F.char_length(X.truncated("text")).cast("long").alias("chars"), X.truncated("text", X.PREVIEW_CHARS).alias("preview"))


def nlp_word_count(spark, d):
    p = table(spark, d, "part")
    name = F.concat_ws("-", "p_name", "p_brand")
    return p.select("p_partkey", X.nlp_word_count(name).cast("long").alias("words"), X.within_word_limit(name, ["hot gear-Brand#3"]).alias("kept"), X.is_numeric("p_name").alias("numeric"))


def valid_spans(spark, d):
    return document_terms(spark, d).groupBy("text").agg(F.sum("count").alias("n")).where(X.valid_span("text"))


def display_text(spark, d):
    p = table(spark, d, "part")
    name = F.concat(F.element_at(F.array(F.lit("The "), F.lit("your the "), F.lit(""), F.lit("for the "), F.lit("The")), (F.col("p_partkey") % 5 + 1).cast("int")), F.when(F.col("p_partkey") % 5 == 4, "").otherwise(F.col("p_name")))
    return p.select("p_partkey", X.display_text(name).alias("shown"))


def title_case(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", X.display_form(F.concat_ws("-", "p_name", F.lower("p_type"))).alias("shown"), X.display_form(F.lower("p_type")).alias("single"))


def proximity(spark, d):
    """Documents at whose head, or in whose first sixty characters, the first two words of a benchmark item stand; joined by the first of them."""
    items = table(spark, d, "benchmark").select("item_id", F.array_join(F.slice(X.words("text"), 1, 2), " ").alias("term"))
    items = items.where("term <> ''").withColumn("word", F.element_at(X.words(F.lower("term")), 1))
    docs = table(spark, d, "documents").select("doc_id", "text", F.substring("text", 1, 60).alias("title"))
    w = X.words(F.lower("text"))
    head = F.array_union(F.slice(w, F.lit(1), F.greatest(F.lit(1), F.floor(F.size(w) / 10).cast("int"))), X.words(F.lower("title")))
    near = docs.select("doc_id", F.explode(head).alias("word")).join(items, "word").select("doc_id", "item_id", "term")
    return docs.join(near, "doc_id").where(X.in_proximity("term", "title", F.lit(""), "text")).groupBy("item_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


def tfidf_weightage(spark, d):
    from pyspark.sql import Window

    page = Window.partitionBy("page_id")
    t = document_terms(spark, d).withColumns({"words": F.sum("count").over(page), "n": F.count("*").over(page), "authority": (F.col("page_id") % 11).cast("int")})
    t = t.withColumn("relevance", F.col("relevance") + 0.000037)  # no sum ends in a half of the last decimal
    return weightage(t.withColumn("tfidf", X.tfidf("count", "words", "n"))).select("page_id", "text", "tfidf", "weightage")


def target_midpoint(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", X.midpoint(F.col("p_size") % 7, "p_size").alias("mid"), X.midpoint(F.lit(0), F.lit(None).cast("int")).alias("none"))


def safe_file_names(spark, d):
    return table(spark, d, "pages").select("page_id", X.file_name("url").alias("name"))


def keyword_batch(spark, d):
    c = table(spark, d, "conversations")
    lines = X.keyword_list("text")
    parsed = X.keyword_list(F.to_json(F.array(F.lit(" a "), "role", F.lit(""))))
    return c.select("conv_id", "turn", F.size(lines).cast("long").alias("n"), F.array_join(lines, "|").alias("keywords"), F.array_join(parsed, "|").alias("parsed"))


def authority_lookup(spark, d):
    """Ratings of hosts, joined to pages; hosts without one have the middle."""
    pages = table(spark, d, "pages").select("page_id", U.bare_host("url").alias("domain"))
    rated = table(spark, d, "supplier").select(F.concat(F.lit("ththan.example."), F.element_at(F.array(F.lit("com"), F.lit("net"), F.lit("org")), (F.col("s_suppkey") % 3 + 1).cast("int"))).alias("domain"), (F.col("s_suppkey") % 100).alias("dr"))
    dr = rated.groupBy("domain").agg(F.max("dr").alias("dr"))
    return pages.join(dr, "domain", "left").select("page_id", "domain", U.authority("dr").alias("authority"))


def selection_key(spark, d):
    rows = table(spark, d, "pages").groupBy(F.floor(F.col("page_id") / 10).alias("batch")).agg(F.collect_list("url").alias("urls"))
    return rows.select("batch", O.selection_key("urls").alias("selection_key"))


QUERIES = {
    "answer_json": (
        answer_json,
        """SELECT s_suppkey, CASE WHEN s_suppkey % 4 < 2 THEN '{"descriptions": ["' || s_name || '"]}' WHEN s_suppkey % 4 = 2 THEN '{"y": ' || s_suppkey || '}' END AS answer FROM supplier""",
    ),
    "undescribed": (undescribed, "SELECT o_orderkey AS title, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber > 3)"),
    "english_documents": (english_documents, "SELECT doc_id FROM documents WHERE lang = 'en'"),
    "url_normalize": (url_normalize, f"SELECT page_id, {_NORMAL} AS normalized FROM pages"),
    "url_dedup_first": (
        url_dedup_first,
        f"""WITH h AS (SELECT page_id, {_NORMAL} AS normalized, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '') AS host FROM pages),
        t AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) AS r FROM h)
        SELECT page_id, normalized, host FROM (SELECT *, row_number() OVER (PARTITION BY normalized ORDER BY page_id) AS k FROM t WHERE r <= 20) WHERE k = 1""",
    ),
    "organic_hosts": (
        organic_hosts,
        f"""WITH h AS (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS n FROM pages), b AS (SELECT *, regexp_replace(n, '^www\\.', '') AS host FROM h)
        SELECT page_id, host, starts_with(url, 'http') AND NOT list_bool_or(list_transform([{_quoted(U.BLOCKED_HOSTS)}], lambda x: host = x OR ends_with(host, '.' || x))) AS organic,
        list_bool_or(list_transform([{_quoted(U.SOCIAL)}], lambda x: contains(n, x))) AS social FROM b""",
    ),
    "host_normalize": (
        host_normalize,
        """WITH h AS (SELECT page_id, split_part(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), ':', 1) AS n FROM pages)
        SELECT page_id, regexp_replace(n, '^(www|m|amp)\\.', '') AS host, array_to_string(list_sort(list_distinct(list_filter(string_split(n, '.'), lambda x: x NOT IN ('', 'www', 'm', 'amp')))), ',') AS tokens FROM h""",
    ),
    "domain_tokens_ban": (
        domain_tokens_ban,
        f"""WITH {TERMS} SELECT session_id, count(*) AS n_terms, count(*) FILTER (text NOT IN (domain, left(text, 3), 'com')) AS n_kept FROM terms GROUP BY session_id""",
    ),
    "token_tf": (token_tf, f"WITH {TERMS} SELECT page_id, text, count FROM terms"),
    "bucket_tokens": (
        bucket_tokens,
        f"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(lower(text), '[a-z]+'), lambda x: {singular_sql("x")}), lambda y: y NOT IN ({_quoted(X.BUCKET_STOP_WORDS)})))), ' ') AS words FROM documents""",
    ),
    "singularize_keys": (singularize_keys, f"WITH {TERMS} SELECT {singular_sql('text')} AS key, sum(count)::BIGINT AS n, count(DISTINCT text) AS forms FROM terms GROUP BY 1"),
    "content_gate": (
        content_gate,
        f"""WITH c AS (SELECT doc_id, text, lower(left(text, 40)) AS t, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))::BIGINT AS n FROM documents)
        SELECT doc_id, n AS word_count, CASE WHEN trim(text) = '' THEN 'empty_content' WHEN n < 30 THEN 'too_short' WHEN list_bool_or(list_transform([{_quoted(X.ERROR_TITLES)}], lambda x: contains(t, x))) THEN 'error_like_title' END AS skip_reason,
        CASE WHEN n < 80 THEN 60 WHEN n < 250 THEN 80 ELSE 100 END::BIGINT AS max_terms, least(length(text), 18000)::BIGINT AS chars, left(text, 500) AS preview FROM c""",
    ),
    "nlp_word_count": (
        nlp_word_count,
        """WITH c AS (SELECT p_partkey, p_name, p_name || '-' || p_brand AS t FROM part), n AS (SELECT *, len(list_filter(string_split_regex(trim(t), '[\\s\\-/_.]+|\\W+'), lambda x: x <> ''))::BIGINT AS words FROM c)
        SELECT p_partkey, words, words <= 3 OR lower(t) = 'hot gear-brand#3' AS kept, regexp_matches(p_name, '\\d') AS numeric FROM n""",
    ),
    "valid_spans": (
        valid_spans,
        f"""WITH {TERMS} SELECT text, sum(count)::BIGINT AS n FROM terms WHERE length(text) > 2 AND text NOT IN ({_quoted(X.WEAK_TOKENS + X.FRAGMENTS)})
        AND NOT (length(text) <= 5 AND (regexp_matches(text, '({"|".join(X.FRAGMENT_SUFFIXES)})$') OR regexp_matches(text, '^({"|".join(X.FRAGMENT_PREFIXES)})'))) GROUP BY text""",
    ),
    "display_text": (
        display_text,
        f"SELECT p_partkey, CASE p_partkey % 5 WHEN 4 THEN '' WHEN 3 THEN 'for the ' || p_name ELSE regexp_replace(p_name, '^(({'|'.join(X.WEAK_TOKENS)}) +)+', '', 'i') END AS shown FROM part",
    ),
    "title_case": (
        title_case,
        """SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(p_name || '-' || lower(p_type), '[a-zA-Z]+|[^a-zA-Z]+'), lambda x: upper(left(x, 1)) || lower(substr(x, 2))), '') AS shown, lower(p_type) AS single FROM part
        WHERE contains(p_name, ' ') UNION ALL SELECT p_partkey, p_name || '-' || lower(p_type), lower(p_type) FROM part WHERE NOT contains(p_name, ' ')""",
    ),
    "proximity": (
        proximity,
        """WITH b AS (SELECT item_id, ' ' || array_to_string(list_transform(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')[1:2], lambda x: lower(x)), ' ') || ' ' AS term FROM benchmark),
        w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS w, list_filter(string_split_regex(lower(left(text, 60)), '\\s+'), lambda x: x <> '') AS t FROM documents)
        SELECT item_id, count(*) AS n, min(doc_id) AS first FROM w, b WHERE contains(' ' || array_to_string(t, ' ') || ' ', term) OR contains(' ' || array_to_string(w[1:greatest(1, len(w) // 10)], ' ') || ' ', term) GROUP BY item_id""",
    ),
    "tfidf_weightage": (
        tfidf_weightage,
        f"""WITH {TERMS}, a AS (SELECT *, round(count / sum(count) OVER p * ln(count(*) OVER p + 1), 4) AS tfidf, least(page_id % 11 / 10.0, 1.0) AS au FROM terms WINDOW p AS (PARTITION BY page_id))
        SELECT page_id, text, tfidf, round((relevance + 0.000037) * 0.60 + au * 0.25 + (CASE WHEN max(tfidf) OVER p > 0 THEN tfidf / max(tfidf) OVER p ELSE 0 END) * 0.10 + count / max(count) OVER p * 0.05, 4) AS weightage FROM a WINDOW p AS (PARTITION BY page_id)""",
    ),
    "target_midpoint": (
        target_midpoint,
        "SELECT p_partkey, CASE WHEN (p_size % 7 + p_size) % 4 = 1 THEN (p_size % 7 + p_size) // 2 ELSE (p_size % 7 + p_size + 1) // 2 END::INTEGER AS mid, 0 AS none FROM part",
    ),
    "safe_file_names": (safe_file_names, """SELECT page_id, left(replace(regexp_replace(url, '[\\\\/*?:"<>|]', '', 'g'), ' ', '_'), 50) AS name FROM pages"""),
    "keyword_batch": (
        keyword_batch,
        """WITH c AS (SELECT conv_id, turn, role, list_filter(list_transform(string_split_regex(text, '\\r?\\n'), lambda x: trim(x, ' ' || chr(9))), lambda x: x <> '')[1:50] AS k FROM conversations)
        SELECT conv_id, turn, len(k)::BIGINT AS n, array_to_string(k, '|') AS keywords, 'a|' || role AS parsed FROM c""",
    ),
    "authority_lookup": (
        authority_lookup,
        """WITH r AS (SELECT 'ththan.example.' || ['com', 'net', 'org'][s_suppkey % 3 + 1] AS domain, max(s_suppkey % 100) AS dr FROM supplier GROUP BY 1),
        p AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '') AS domain FROM pages)
        SELECT page_id, p.domain, (CASE WHEN dr IS NULL THEN 5 ELSE least(greatest(round_even(dr / 10, 0), 0), 10) END)::INTEGER AS authority FROM p LEFT JOIN r ON p.domain = r.domain""",
    ),
    "selection_key": (
        selection_key,
        """SELECT page_id // 10 AS batch, left(sha256('["' || array_to_string(list_sort(list_distinct(list(trim(url)))), '", "') || '"]'), 16) AS selection_key FROM pages GROUP BY 1""",
    ),
}
