"""Queries of files: rows of the test tables are written to the scratch folder as the records that the sources read, and read back."""

from __future__ import annotations

import json
import os
import shutil
import tempfile

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import jobs
from .. import providers as P
from ..operators import ranking as R
from ..operators import stores as O
from ..operators.grouping import LABELS
from ..scratch import folder
from ..sources import files as S
from .inputs import PARTS, part_terms, table, vector_anchors, vector_terms


def _put(spark: SparkSession, path: str, texts: dict[str, str]) -> str:
    """Writes a few small files below a path of any store that Spark knows; a row of nation or region is one."""
    jvm = spark.sparkContext._jvm
    for name, text in texts.items():
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
        out.write(bytearray(text.encode()))
        out.close()
    return path


def _nations(spark: SparkSession, d: str) -> list:
    """The 25 nations, whose number doesn't grow."""
    return table(spark, d, "nation").orderBy("n_nationkey").collect()


def page_results_scan(spark, d):
    rows = _nations(spark, d)
    page = lambda r: {"url": f"http://x/{r.n_nationkey}", "domain": f"d{r.n_regionkey}.com", "nlp_terms": [{"text": f"{r.n_name} {k}", "count": k, "relevance": k / 4} for k in range(r.n_regionkey)]}
    path = _put(spark, folder(spark), {f"{r.n_nationkey}.json": json.dumps(page(r)) for r in rows} | {"_meta.json": "{}", "notes.json": json.dumps({"url": "http://x/1"})})
    some = S.page_results(spark, path, [f" http://x/{r.n_nationkey} " for r in rows if r.n_nationkey % 2] + ["http://y"])
    return S.page_terms(some, "s").select("session_id", "page_id", "domain", "ord", "text", "count", "relevance")


def session_export_scan(spark, d):
    """Only files of the report's name form count."""
    name = lambda r: f"{r.n_nationkey:02d}_20260610_095640_{r.n_name}.json" if r.n_nationkey % 3 else f"{r.n_name}.json"
    body = lambda r: {"session_id": f"s{r.n_nationkey}", "keyword": r.n_name, "merge_output": {"entities": [{"text": r.n_name, "combined_count": k} for k in range(r.n_regionkey)]}}
    path = _put(spark, folder(spark), {name(r): json.dumps(body(r), indent=1) for r in _nations(spark, d)})
    return S.session_exports(spark, path).select("session_id", "keyword", "ord", "text", "combined_count")


def _exports(spark, d) -> str:
    term = lambda r, k: {"term": f" {r.n_name} {k} ", "included": k % 2 == 0, "is_nlp": True, "target_range": {"min": k, "max": r.n_nationkey}}
    body = lambda r: {"keyword": r.n_name, "nlp_terms": {"terms": [*(term(r, k) for k in range(r.n_regionkey)), {"term": "  "}]}}
    return _put(spark, folder(spark), {f"k{r.n_nationkey}.json": json.dumps(body(r)) for r in _nations(spark, d)} | {"_summary.json": "{}"})


def keyword_export_listing(spark, d):
    """Exports that a summary names and that exist, beside all that exist."""
    path = _exports(spark, d)
    lines = [f"word {k},i{k},l{k},{'done' if k % 2 else 'failed'},out/k{k}.json" for k in range(10, 40)]
    _put(spark, f"{path}/sums", {"summary.csv": "\n".join(["keyword,surfer_id,surfer_link,status,json_file", *lines])})
    listed = S.keyword_exports(spark, path, S.export_summary(spark, f"{path}/sums/summary.csv"))
    return S.keyword_exports(spark, path).select("slug").join(listed, "slug", "left").select("slug", "keyword", "status")


def keyword_export_load(spark, d):
    return S.export_terms(S.keyword_export(spark, _exports(spark, d), " k9 ")).select("keyword", "ord", "text", "combined_count", "included", "tier", "low", "high")


def cli_folder_scan(spark, d):
    body = lambda r: json.dumps({"entities": [{"text": r.n_name}] * r.n_regionkey}) if r.n_nationkey != 7 else "{broken"
    return S.cli_exports(spark, _put(spark, folder(spark), {f"{r.n_name}.json": body(r) for r in _nations(spark, d)})).select("file", F.size("entities").alias("n"))


def authority_csv(spark, d):
    rating = lambda r: str(r.n_nationkey * 4) if r.n_nationkey % 4 else "none"
    lines = ["domain,dr", *(f" {r.n_name}.COM ,{rating(r)}" for r in _nations(spark, d)), ",50"]
    return S.authority(spark, _put(spark, folder(spark), {"dr.csv": "\n".join(lines)}) + "/dr.csv")


def keyword_import(spark, d):
    """Files by their stem over stored outputs; those stored alone stay."""
    rows = _nations(spark, d)
    path = _put(spark, folder(spark), {f"{r.n_name}.json": json.dumps({"n": r.n_nationkey}) for r in rows if r.n_nationkey % 2})
    old = table(spark, d, "nation").select(F.col("n_name").alias("source_keyword"), F.lit("old").alias("payload"))
    return O.upsert(old, S.keyword_outputs(spark, path), ["source_keyword"])


def vector_cache(spark, d):
    """Vectors of sessions written to the cache; a session that is written again replaces its own vectors only."""
    path = folder(spark)
    rows = vector_terms(spark, d).select(F.col("session_id").cast("string").alias("session_id"), "key", "text", F.col("vector").cast("array<float>").alias("vector"))
    S.write_cache(rows, path)
    S.write_cache(rows.where("session_id = '3'").withColumn("text", F.lit("again")), path)
    return S.read_cache(spark, path).select("session_id", "key", "text", F.size("vector").alias("width"), F.element_at("vector", 1).cast("double").alias("first"))


def page_result_sink(spark, d):
    path, p = folder(spark), table(spark, d, "pages").select((F.col("page_id") % 5).alias("session_id"), "page_id", "url")
    S.write_page_results(p, path)
    S.write_page_results(p.where("session_id = 2").withColumn("url", F.lit("new")), path)
    return spark.read.schema("page_id long, url string, session_id long").parquet(path)


def artifact_sink(spark, d):
    path, t = folder(spark), part_terms(spark, d).select("session_id", "ord", "text", "average_weightage")
    for step in (t, t.where("ord % 2 = 0")):
        S.write_artifact(step, path, "03_terms")
    return spark.read.schema(t.schema).json(f"{path}/03_terms")


def timing_append(spark, d):
    path, e = folder(spark), table(spark, d, "events").select("event_id", "event_type", "value")
    first = O.numbered(e.where("event_id % 2 = 0"), ["event_id"])
    S.append_timings(first, path)
    S.append_timings(O.numbered(e.where("event_id % 2 = 1"), ["event_id"], start=first.count()), path)
    return spark.read.parquet(path)


def csv_report(spark, d):
    path, t = folder(spark), part_terms(spark, d).select("session_id", "ord", F.concat("text", F.lit(', "x"')).alias("text"), "combined_count")
    S.write_report(t, path)
    return spark.read.schema("session_id string, ord long, text string, combined_count int").csv(path, header=True, escape='"')


def result_lines(spark, d):
    """Results as JSON lines with a line of their summary."""
    path, e = folder(spark), table(spark, d, "events").select("event_id", "event_type")
    S.write_results(e, e.groupBy("event_type").agg(F.count("*").alias("n")), path)
    lines = spark.read.schema("event_id long, event_type string, summary struct<event_type: string, n: long>").json(path)
    return lines.select("event_id", F.coalesce("event_type", "summary.event_type").alias("event_type"), "summary.n")


def jdbc_relation(spark, d):
    """A relation written to a database by JDBC and read from it: the one that comes with Spark, packed into a file of the shared folder that every machine opens for itself."""
    return S.jdbc(spark, _database(spark, _nations(spark, d)), '(SELECT "n_nationkey", "n_regionkey", "n" FROM nations WHERE "n_regionkey" > 1) t', driver="org.apache.derby.jdbc.EmbeddedDriver")


def _database(spark: SparkSession, nations: list) -> str:
    """URL of a database with the table nations, which the driver fills. It is read-only, so several processes may have it open."""
    jvm = spark.sparkContext._jvm
    jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    derby, none = jvm.org.apache.derby.jdbc.EmbeddedDriver(), jvm.java.util.Properties()
    at = jvm.org.apache.hadoop.fs.Path(f"{folder(spark)}/nations.jar")
    with tempfile.TemporaryDirectory() as own:
        own = os.path.realpath(own)
        con = derby.connect(f"jdbc:derby:directory:{own}/nations;create=true", none)
        con.createStatement().execute('CREATE TABLE nations ("n_nationkey" INTEGER, "n_regionkey" INTEGER, "n" INTEGER)')
        put = con.prepareStatement("INSERT INTO nations VALUES (?, ?, ?)")
        for r in nations:
            for i, x in enumerate((r.n_nationkey, r.n_regionkey, None if r.n_name is None else len(r.n_name)), 1):
                put.setNull(i, jvm.java.sql.Types.INTEGER) if x is None else put.setInt(i, x)
            put.addBatch()
        put.executeBatch()
        con.close()
        try:
            derby.connect(f"jdbc:derby:directory:{own}/nations;shutdown=true", none)
        except Py4JJavaError as e:
            if e.java_exception.getSQLState() != "08006":  # the state of a database that has shut down
                raise
        packed = shutil.make_archive(f"{own}/packed", "zip", own, "nations")
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).copyFromLocalFile(jvm.org.apache.hadoop.fs.Path(f"file://{packed}"), at)
    return f"jdbc:derby:jar:({at.toUri().getPath()})nations"


class _Lengths:
    """A reranker for the query: longer is better; every third text has no score."""

    def scores(self, query, texts):
        return [None if len(t) % 3 == 0 else (len(t) + len(query)) / 64 for t in texts]


def rerank_scores(spark, d):
    return part_terms(spark, d).select("session_id", "ord", P.rerank_scores(_Lengths, "dogs", batch=7)("text").alias("score"))


def tiering_fallback(spark, d):
    """Sessions without anchors, the odd ones, fall back to percentile tiers; the others don't."""
    t = vector_terms(spark, d)
    entities = t.select("session_id", "key", "text", F.col("count").alias("combined_count"), (F.col("count") % 4).alias("competitor_count"), (F.col("count") / 16.0).alias("average_weightage"))
    out = jobs.tiered_session(entities, vector_anchors(spark, d).where("session_id % 2 = 0"), t.select("session_id", "key", "vector"), "term 1", average_words=F.lit(500.0))
    return out.where("tiering_method = 'percentile'").select("session_id", "key", "tier", "tiering_method")


def refilled(spark, d):
    """Stored tiers of another method are worked out anew, the others stay."""
    t = part_terms(spark, d).select("session_id", "ord", "text", "average_weightage", F.lit("old").alias("tier"), F.when(F.col("session_id").endswith("1"), "percentile").otherwise("none").alias("tiering_method"))
    again = lambda rows: R.percentile_tiers(rows.drop("tier"), ["session_id"], [F.desc("average_weightage"), "ord"]).withColumn("tiering_method", F.lit("percentile"))
    return jobs.refill(t, again, ["session_id"], F.col("tiering_method") != "percentile").select("session_id", "ord", "tier", "tiering_method")


def offline_run(spark, d):
    """The steps of a run, each written, and the run's summary."""
    t = part_terms(spark, d)
    top = R.keep_ratio(t, 0.5, ["session_id"], F.col("average_weightage"), ["ord"])
    return jobs.offline_run({"00_entities": t, "03_kept": top, "07_tiers": R.percentile_tiers(top, ["session_id"], [F.desc("average_weightage"), "ord"])}, folder(spark), ["session_id"])


def merge_response(spark, d):
    """Documents of sessions, from the cache where it has the selection; the sizes of their parts."""
    t = part_terms(spark, d).withColumn("key", F.lower("text"))
    urls = t.select("session_id").distinct().withColumn("urls", F.array(F.concat(F.lit("http://"), F.col("session_id")), F.lit(" http://b "), F.lit("")))
    cached = S.with_selection_key(urls.where(F.col("session_id").endswith("2"))).select("selection_key", F.lit('{"tiers":[],"buckets":[],"labels":{}}').alias("document"))
    out = jobs.merge_response(t, urls, cached)
    parsed = F.from_json("document", "tiers array<struct<text: string>>, buckets array<struct<word: string>>, labels map<string, array<string>>")
    return out.select("session_id", "from_cache", parsed.alias("p")).select("session_id", "from_cache", F.size("p.tiers").alias("terms"), F.size("p.labels").alias("labels"))


def stale_documents(spark, d):
    """What stored documents lack; a supplier stands for one."""
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier").select(
        k, F.when(k % 5 > 0, F.array_repeat(F.lit("x"), (k % 4).cast("int"))).alias("instances"),
        F.when(k % 3 > 0, F.array(F.struct((k % 3).cast("int").alias("nlp_count"), F.array(F.lit("a")).alias("nlps")), F.struct(F.lit(None).cast("int").alias("nlp_count"), F.array_repeat(F.lit("b"), (k % 4).cast("int")).alias("nlps")))).alias("buckets"),
        F.when(k % 2 > 0, F.create_map(F.lit("Topic"), F.lit(1))).alias("groups"), F.array(F.lit(" Topic"), F.when(k % 7 > 0, F.lit("Food")).otherwise(F.lit("?"))).alias("labels"),
    )
    return s.select("s_suppkey", O.needs_instances("instances", 1 + k % 3).alias("instances"), O.needs_buckets("buckets", k % 6).alias("buckets"), O.needs_labels("groups", F.col("labels"), LABELS).alias("labels"))


def ensured(spark, d):
    """Parts whose tier is missing get the tier of their session's order; it is done twice, the second time for nothing."""
    t = part_terms(spark, d).select("session_id", "ord", "average_weightage", F.when(F.col("session_id").endswith("1"), "old").alias("tier"))
    again = lambda rows: R.percentile_tiers(rows.drop("tier"), ["session_id"], [F.desc("average_weightage"), "ord"])
    first = jobs.ensured(t, F.col("tier").isNull(), again)
    return jobs.ensured(first.withColumnRenamed("changed", "first"), F.col("tier").isNull(), again).select("session_id", "ord", "tier", "first", "changed")


QUERIES = {
    "stale_documents": (
        stale_documents,
        """SELECT s_suppkey, s_suppkey % 5 = 0 OR s_suppkey % 4 = 0 OR s_suppkey % 4 < 1 + s_suppkey % 3 AS instances,
        s_suppkey % 6 > 0 AND (s_suppkey % 3 = 0 OR s_suppkey % 3 < 2 OR s_suppkey % 4 < 2) AS buckets, s_suppkey % 2 = 0 OR s_suppkey % 7 = 0 AS labels FROM supplier""",
    ),
    "ensured": (
        ensured,
        f"""WITH {PARTS}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY average_weightage DESC, ord) AS r, count(*) OVER (PARTITION BY session_id) AS n FROM parts), g AS (SELECT *, greatest(1, floor(n * 0.35)) AS g FROM r)
        SELECT session_id, ord, CASE WHEN ends_with(session_id, '1') THEN 'old' WHEN r <= g THEN 'green' WHEN r <= g + greatest(1, floor((n - g) * 0.1)) THEN 'white' ELSE 'orange' END AS tier, NOT ends_with(session_id, '1') AS first, false AS changed FROM g""",
    ),
    "page_results_scan": (
        page_results_scan,
        "SELECT 's' AS session_id, n_nationkey::INTEGER AS page_id, 'd' || n_regionkey || '.com' AS domain, k::INTEGER AS ord, n_name || ' ' || k AS text, k::INTEGER AS count, k / 4.0::DOUBLE AS relevance FROM (SELECT *, unnest(range(n_regionkey)) AS k FROM nation WHERE n_nationkey % 2 = 1)",
    ),
    "session_export_scan": (
        session_export_scan,
        "SELECT 's' || n_nationkey AS session_id, n_name AS keyword, k::INTEGER AS ord, n_name AS text, k::INTEGER AS combined_count FROM (SELECT *, unnest(range(n_regionkey)) AS k FROM nation WHERE n_nationkey % 3 > 0)",
    ),
    "keyword_export_listing": (
        keyword_export_listing,
        "SELECT 'k' || n_nationkey AS slug, CASE WHEN n_nationkey >= 10 THEN 'word ' || n_nationkey END AS keyword, CASE WHEN n_nationkey >= 10 THEN CASE WHEN n_nationkey % 2 = 1 THEN 'done' ELSE 'failed' END END AS status FROM nation",
    ),
    "keyword_export_load": (
        keyword_export_load,
        """SELECT n_name AS keyword, k::INTEGER AS ord, n_name || ' ' || k AS text, round_even((k + n_nationkey) / 2.0, 0)::INTEGER AS combined_count, k % 2 = 0 AS included, CASE WHEN k % 2 = 0 THEN 'green' ELSE 'white' END AS tier, k::INTEGER AS low, n_nationkey::INTEGER AS high
        FROM (SELECT *, unnest(range(n_regionkey)) AS k FROM nation WHERE n_nationkey = 9)""",
    ),
    "cli_folder_scan": (cli_folder_scan, "SELECT n_name || '.json' AS file, n_regionkey::INTEGER AS n FROM nation WHERE n_regionkey > 0 AND n_nationkey <> 7"),
    "authority_csv": (authority_csv, "SELECT lower(n_name) || '.com' AS domain, (n_nationkey * 4)::DOUBLE AS dr FROM nation WHERE n_nationkey % 4 > 0"),
    "keyword_import": (keyword_import, """SELECT n_name AS source_keyword, CASE WHEN n_nationkey % 2 = 1 THEN '{"n": ' || n_nationkey || '}' ELSE 'old' END AS payload FROM nation"""),
    "vector_cache": (
        vector_cache,
        "SELECT (vec_id // 50)::VARCHAR AS session_id, 'term ' || vec_id AS key, CASE WHEN vec_id // 50 = 3 THEN 'again' ELSE 'term ' || vec_id END AS text, len(embedding)::INTEGER AS width, embedding[1]::FLOAT::DOUBLE AS first FROM embeddings",
    ),
    "page_result_sink": (page_result_sink, "SELECT page_id % 5 AS session_id, page_id, CASE WHEN page_id % 5 = 2 THEN 'new' ELSE url END AS url FROM pages"),
    "artifact_sink": (artifact_sink, f"WITH {PARTS} SELECT session_id, ord, text, average_weightage FROM parts WHERE ord % 2 = 0"),
    "timing_append": (
        timing_append,
        "SELECT event_id, event_type, value, (row_number() OVER (ORDER BY event_id % 2, event_id))::INTEGER AS sr_no FROM events",
    ),
    "csv_report": (csv_report, f"""WITH {PARTS} SELECT session_id, ord, text || ', "x"' AS text, combined_count::INTEGER AS combined_count FROM parts"""),
    "result_lines": (result_lines, "SELECT event_id, event_type, NULL::BIGINT AS n FROM events UNION ALL SELECT NULL, event_type, count(*) FROM events GROUP BY event_type"),
    "jdbc_relation": (jdbc_relation, "SELECT n_nationkey, n_regionkey, length(n_name)::INTEGER AS n FROM nation WHERE n_regionkey > 1"),
    "rerank_scores": (rerank_scores, f"WITH {PARTS} SELECT session_id, ord, CASE WHEN length(text) % 3 = 0 THEN 0.0 ELSE (length(text) + 4) / 64.0 END::DOUBLE AS score FROM parts"),
    "tiering_fallback": (
        tiering_fallback,
        """WITH v AS (SELECT vec_id // 50 AS session_id, 'term ' || vec_id AS key, (vec_id * 7 % 13 + 1) / 16.0 AS w FROM embeddings WHERE vec_id // 50 % 2 = 1), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY w DESC, key) AS r, count(*) OVER (PARTITION BY session_id) AS n FROM v),
        t AS (SELECT *, CASE WHEN r <= greatest(1, floor(n * 0.35)) THEN 'green' WHEN r <= greatest(1, floor(n * 0.35)) + greatest(1, floor((n - greatest(1, floor(n * 0.35))) * 0.1)) THEN 'white' ELSE 'orange' END AS tier FROM r),
        c AS (SELECT *, sum((key <> 'term 1' AND key NOT IN ('anchor 0'))::INTEGER) OVER (PARTITION BY session_id, tier ORDER BY w DESC, key ROWS UNBOUNDED PRECEDING) AS s FROM t)
        SELECT session_id, key, tier, 'percentile' AS tiering_method FROM c WHERE key = 'term 1' OR s <= 2""",
    ),
    "refilled": (
        refilled,
        f"""WITH {PARTS}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY average_weightage DESC, ord) AS r, count(*) OVER (PARTITION BY session_id) AS n FROM parts), g AS (SELECT *, greatest(1, floor(n * 0.35)) AS g FROM r)
        SELECT session_id, ord, CASE WHEN ends_with(session_id, '1') THEN 'old' WHEN r <= g THEN 'green' WHEN r <= g + greatest(1, floor((n - g) * 0.1)) THEN 'white' ELSE 'orange' END AS tier, 'percentile' AS tiering_method FROM g""",
    ),
    "offline_run": (
        offline_run,
        f"""WITH {PARTS}, n AS (SELECT session_id, count(*) AS n FROM parts GROUP BY 1), k AS (SELECT session_id, greatest(1, ceil(n * 0.5))::BIGINT AS k, n FROM n)
        SELECT session_id, '00_entities' AS step, n AS n FROM k UNION ALL SELECT session_id, '03_kept', k FROM k UNION ALL SELECT session_id, '07_tiers', k FROM k""",
    ),
    "merge_response": (
        merge_response,
        f"""WITH {PARTS}, l AS (SELECT *, CASE WHEN label = 'Nonsense' THEN 'Other' ELSE label END AS lab FROM parts)
        SELECT session_id, ends_with(session_id, '2') AS from_cache, CASE WHEN ends_with(session_id, '2') THEN 0 ELSE count(*) END::INTEGER AS terms, CASE WHEN ends_with(session_id, '2') THEN 0 ELSE count(DISTINCT lab) END::INTEGER AS labels FROM l GROUP BY 1""",
    ),
}
