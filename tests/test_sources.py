"""Reading and writing files, streams, the entry module."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from termloom import streaming
from termloom.sources import files, schemas


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(data if isinstance(data, str) else json.dumps(data))


def test_page_results(spark, tmp_path):
    for n, url in ((1, "http://a"), (2, "http://b"), (10, "http://c")):
        put(tmp_path / f"{n}.json", {"url": url, "domain": "a", "nlp_terms": [{"text": "dog", "count": 2, "embedding_unit": [0.5, 1]}]})
    put(tmp_path / "_meta.json", {"url": "http://no"})
    rows = files.page_results(spark, str(tmp_path))
    assert [r.url for r in rows.orderBy("page_ord").collect()] == ["http://a", "http://b", "http://c"]
    some = files.page_results(spark, str(tmp_path), ["http://c ", "http://x"])
    assert [(t.page_id, t.text, t["count"]) for t in files.page_terms(some, "s").collect()] == [(10, "dog", 2)]
    empty = files.page_results(spark, str(tmp_path), ["http://x"], fallback=rows.limit(0))
    assert empty.count() == 0


def test_keyword_export(spark, tmp_path):
    term = {"term": " dog ", "included": True, "is_nlp": True, "ignored": False, "target_range": {"min": 11, "max": 19}}
    other = {"term": "cat", "included": False, "target_range": {"min": 2, "max": 4}}
    put(tmp_path / "dogs.json", {"keyword": "dogs", "nlp_terms": {"terms": [term, other, {"term": " "}]}})
    put(tmp_path / "_skip.json", {})
    got = files.export_terms(files.keyword_export(spark, str(tmp_path), "dogs")).orderBy("ord").collect()
    assert [(r.text, r.combined_count, r.tier, r.is_nlp) for r in got] == [("dog", 15, "green", True), ("cat", 3, "white", False)]
    assert [r.slug for r in files.keyword_exports(spark, str(tmp_path)).collect()] == ["dogs"]
    put(tmp_path / "summary.csv", "keyword,surfer_id,surfer_link,status,json_file\ndogs,1,x,done,out/dogs.json\ncats,2,x,done,cats.json\n")
    assert [(r.slug, r.keyword) for r in files.keyword_exports(spark, str(tmp_path), files.export_summary(spark, f"{tmp_path}/summary.csv")).collect()] == [("dogs", "dogs")]
    for bad in ("../escape", "a/b", "a\\b", "", ".."):
        with pytest.raises(ValueError, match="name"):
            files.keyword_export(spark, str(tmp_path), bad)
    assert {r.source_keyword for r in files.keyword_outputs(spark, str(tmp_path)).collect()} >= {"dogs"}


def test_authority(spark, tmp_path):
    put(tmp_path / "dr.csv", "domain,dr\na.com,45\nb.com,none\n,3\nB.org, 96\n")
    assert {r.domain: r.dr for r in files.authority(spark, str(tmp_path / "dr.csv")).collect()} == {"a.com": 45.0, "b.org": 96.0}
    assert files.authority(spark, str(tmp_path / "missing.csv")).collect() == []


def test_exports(spark, tmp_path):
    put(tmp_path / "01_20260610_095640_dogs.json", {"session_id": "x", "keyword": "dogs", "merge_output": {"entities": [{"text": "a"}, {"text": "b"}]}})
    put(tmp_path / "other.json", {"session_id": "y", "merge_output": {"entities": [{"text": "c"}]}})
    assert [(r.ord, r.text) for r in files.session_exports(spark, str(tmp_path)).orderBy("ord").collect()] == [(0, "a"), (1, "b")]
    put(tmp_path / "cli" / "1.json", {"entities": [{"text": "a"}]})
    put(tmp_path / "cli" / "2.json", {"entities": []})
    put(tmp_path / "cli" / "3.json", "{broken")
    assert [r.file for r in files.cli_exports(spark, str(tmp_path / "cli")).collect()] == ["1.json"]


def test_sinks(spark, tmp_path):
    vectors = spark.createDataFrame([("s1", "dog", "Dog", [1.0, 2.0])], schemas.TERM_VECTORS)
    files.write_cache(vectors, f"{tmp_path}/v")
    files.write_cache(vectors.withColumn("session_id", F.lit("s2")), f"{tmp_path}/v")
    assert sorted(r.session_id for r in files.read_cache(spark, f"{tmp_path}/v").collect()) == ["s1", "s2"]
    tiers = spark.createDataFrame([("k w/x", "green", "a", 2), ("k w/x", "green", "b", 1), ("k w/x", "white", "c", 3)], "keyword string, tier string, text string, ord int")
    row = files.keyword_tier_document(tiers).first()
    assert (row.file, json.loads(row.document)) == ("k_wx.json", {"Green": ["b", "a"], "Orange": [], "White": ["c"]})
    files.write_artifact(tiers, str(tmp_path), "step")
    files.append_timings(tiers, f"{tmp_path}/t")
    files.append_timings(tiers, f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 6
    assert spark.read.json(f"{tmp_path}/step").count() == 3


def test_stream(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.com", "<title>A</title><p>x y</p>"), (2, "http://b.com", "<p>z</p>")], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/in")
    streaming.each_batch(streaming.parsed_pages(spark, f"{tmp_path}/in"), lambda df, _: df.write.mode("append").parquet(f"{tmp_path}/out"), f"{tmp_path}/cp").awaitTermination()
    assert {r.page_id: r.word_count for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {1: 3, 2: 1}
    events = spark.createDataFrame([(i, f"2024-01-01 0{i}:10:00", "view", 1.0) for i in range(5)], "event_id long, t string, event_type string, value double").select("event_id", F.to_timestamp("t").alias("ts"), "event_type", "value")
    events.write.parquet(f"{tmp_path}/ev")
    counts = streaming.event_counts(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/ev"))
    counts.writeStream.format("memory").queryName("counts").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("counts").count() == 4


def test_entry(spark):
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert len(queries) > 80
    assert entry.entry(spark).columns == ["session_id", "key", "tier", "competitor_count", "word_range"]


def test_jdbc_relation_is_read_by_other_processes(tmp_path):
    """On executors of their own, which share a folder with the driver but no memory."""
    run = f"""
from pyspark.sql import SparkSession
from termloom.plans import storage
spark = SparkSession.builder.master("local-cluster[2,1,600]").config("spark.executor.memory", "500m").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
spark.createDataFrame([(1, "AB", 2), (2, "ABC", 1), (3, "", 4), (4, None, 3)], "n_nationkey int, n_name string, n_regionkey int").write.parquet("{tmp_path}/nation.parquet")
print("rows", sorted(tuple(r) for r in storage.jdbc_relation(spark, "{tmp_path}").collect()))
spark.stop()
"""
    out = subprocess.run([sys.executable, "-c", run], capture_output=True, text=True, timeout=300, cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(Path(__file__).parent.parent), "SPARK_SCALA_VERSION": "2.13", "PYSPARK_PYTHON": sys.executable})
    assert "rows [(1, 2, 2), (3, 4, 0), (4, 3, None)]" in out.stdout, out.stderr[-2000:]
