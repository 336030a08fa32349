"""Queries of stored relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking as R
from ..operators import stores as O
from ..sources.files import keyword_tier_document
from .inputs import PARTS, part_terms, table


def session_list(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list("turn").alias("results"), F.max(F.when(F.col("role") == "system", F.col("text"))).alias("merge_output"))
    return O.page(O.session_list(c), [F.desc("result_count"), "conv_id"], 50, 10)


def latest_30(spark, d):
    return O.latest(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 30).select("user_id", "event_id", "ts")


def upsert_merge(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    new = o.where("o_orderstatus = 'P'").select((F.col("o_orderkey") + 1).alias("o_orderkey"), F.lit(None).cast("long").alias("o_custkey"), F.lit("X").alias("o_orderstatus"))
    return O.upsert(o, new, ["o_orderkey"])


def delete_rows(spark, d):
    return O.delete(table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "customer").where("c_acctbal < 0").withColumnRenamed("c_custkey", "o_custkey"), ["o_custkey"])


def selected_rows(spark, d):
    return O.select_keys(table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").withColumnRenamed("c_custkey", "o_custkey"), ["o_custkey"])


def history_join(spark, d):
    o, c = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate"), table(spark, d, "customer").select("c_custkey", "c_name")
    return O.history(o, c, "c_custkey", [F.desc("o_orderdate"), "o_orderkey"], 100)


def left_join_distinct(spark, d):
    items = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    granted = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("user"))
    return O.accessible(items, granted, "o_orderkey", "o_custkey", "user", 7)


def keyword_outputs(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return O.keyword_outputs(s.select("s_suppkey", "s_name", "n_name"), F.col("n_name").like("NATION_1%"), [F.desc("n_name"), "s_name"])


def needs_refresh(spark, d):
    p = part_terms(spark, d).withColumns({"tiering_method": F.when(F.col("ord") % 3 == 0, "proportional_instance_v1").when(F.col("ord") % 3 == 1, "percentile"), "instance_rank": F.when(F.col("ord") % 2 == 0, F.col("ord")), "instance_index": F.lit(1)})
    return p.select("ord", O.needs_refresh().alias("stale"))


def timing_summary(spark, d):
    e = table(spark, d, "events").withColumn("ms", F.floor(F.col("value") * 64) / 64)
    return O.timing_summary(e, ["event_type"], ["ms"])


def rate_summary(spark, d):
    e = table(spark, d, "events").withColumns({"is_view": F.col("event_type") == "view", "user": F.col("user_id") % 5})
    return O.rate_summary(e, ["user"], ["is_view"], "value")


def timing_rows(spark, d):
    e = table(spark, d, "events").select("event_id", "ts")
    return O.numbered(e, ["ts", "event_id"], start=100)


def tier_document(spark, d):
    t = part_terms(spark, d).select(F.concat("session_id", F.lit(" a/b?")).alias("keyword"), "tier", "text", "ord")
    return keyword_tier_document(t)


def page_order(spark, d):
    """Pages by rank, those without one last; the first terms of each by its limit."""
    p = part_terms(spark, d).withColumns({"rank": F.when(F.col("ord") % 4 > 0, F.col("ord") % 17), "most": (F.col("combined_count") % 3 + 1)})
    return R.top_n(p, ["session_id"], [F.asc_nulls_last("rank"), "ord"], F.lit(20)).select("session_id", "ord", "rank")


def max_terms(spark, d):
    c = table(spark, d, "customer")
    o = table(spark, d, "orders").join(c.select(F.col("c_custkey").alias("o_custkey"), (F.col("c_nationkey") % 3 + 1).alias("most")), "o_custkey")
    return R.top_n(o, ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], F.col("most")).select("o_custkey", "o_orderkey", "o_totalprice")


QUERIES = {
    "session_list": (session_list, "SELECT conv_id, count(*)::INTEGER AS result_count, max(CASE WHEN role = 'system' THEN text END) IS NOT NULL AS has_merge FROM conversations GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50 OFFSET 10"),
    "latest_30": (latest_30, "SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 30"),
    "upsert_merge": (
        upsert_merge,
        """WITH n AS (SELECT o_orderkey + 1 AS o_orderkey FROM orders WHERE o_orderstatus = 'P')
        SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, o_custkey, CASE WHEN n.o_orderkey IS NOT NULL THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders o FULL JOIN n ON o.o_orderkey = n.o_orderkey""",
    ),
    "delete_rows": (delete_rows, "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)"),
    "selected_rows": (selected_rows, "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"),
    "history_join": (history_join, "SELECT o_custkey AS c_custkey, o_orderkey, o_orderdate, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 100"),
    "left_join_distinct": (left_join_distinct, "SELECT DISTINCT o_orderkey, o_custkey FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey = 7 OR l_suppkey = 7"),
    "keyword_outputs": (keyword_outputs, "SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name LIKE 'NATION_1%' ORDER BY n_name DESC, s_name"),
    "needs_refresh": (needs_refresh, "SELECT p_partkey AS ord, p_partkey % 3 <> 0 OR p_partkey % 2 <> 0 AS stale FROM part"),
    "timing_summary": (timing_summary, "SELECT event_type, sum(floor(value * 64) / 64) AS ms_sum, round(avg(floor(value * 64) / 64), 4) AS ms_avg FROM events GROUP BY 1"),
    "rate_summary": (
        rate_summary,
        """WITH e AS (SELECT user_id % 5 AS "user", (event_type = 'view')::INTEGER AS v, value FROM events)
        SELECT "user", count(*) AS n, avg(v)::DOUBLE AS is_view_rate, quantile_cont(value, 0.5) AS median, list_sort(list(value))[greatest(1, floor(count(*) * 0.95))::BIGINT] AS p95 FROM e GROUP BY 1""",
    ),
    "timing_rows": (timing_rows, "SELECT event_id, ts, (row_number() OVER (ORDER BY ts, event_id) + 100)::INTEGER AS sr_no FROM events"),
    "tier_document": (
        tier_document,
        f"""WITH {PARTS}, l AS (SELECT session_id, [x.t FOR x IN list_sort(list(struct_pack(o := ord, t := text, k := tier))) IF x.k = 'green'] AS g, [x.t FOR x IN list_sort(list(struct_pack(o := ord, t := text, k := tier))) IF x.k = 'orange'] AS o,
        [x.t FOR x IN list_sort(list(struct_pack(o := ord, t := text, k := tier))) IF x.k = 'white'] AS w FROM parts GROUP BY 1)
        SELECT session_id || ' a/b?' AS keyword, replace(session_id || ' ab', ' ', '_') || '.json' AS file, to_json(struct_pack("Green" := g, "Orange" := o, "White" := w))::VARCHAR AS document FROM l""",
    ),
    "page_order": (
        page_order,
        f"""WITH {PARTS} SELECT session_id, ord, r AS rank FROM (SELECT session_id, ord, CASE WHEN ord % 4 > 0 THEN ord % 17 END AS r, row_number() OVER (PARTITION BY session_id ORDER BY CASE WHEN ord % 4 > 0 THEN ord % 17 END NULLS LAST, ord) AS k FROM parts) WHERE k <= 20""",
    ),
    "max_terms": (
        max_terms,
        "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT orders.*, c_nationkey % 3 + 1 AS most, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders JOIN customer ON o_custkey = c_custkey) WHERE r <= most",
    ),
}
