"""Reading and writing sessions, exports, ratings and caches."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.ranking import first_of
from ..operators.stores import selection_key
from . import schemas as S

REPORT_NAME = r"^\d{2}_\d{8}_\d{6}_.+\.json$"


def _name(path=None):
    return F.regexp_extract(F.col("_metadata.file_path") if path is None else path, "([^/]+)$", 1)


def page_results(spark: SparkSession, path: str, selected: Sequence[str] | None = None, fallback: DataFrame | None = None) -> DataFrame:
    """Stored results of a session with page_ord, the number in the file's name; only selected URLs, if any are given.

    fallback: rows of the same schema, taken where the folder has none.
    """
    rows = spark.read.schema(S.PAGE_RESULT).json(path, multiLine=True, pathGlobFilter="[0-9]*.json")
    rows = rows.withColumn("page_ord", F.regexp_extract(_name(), r"^(\d+)", 1).cast("int"))
    if selected is not None:
        wanted = spark.createDataFrame([(u.strip(),) for u in selected], "url string").distinct()
        rows = rows.join(wanted, "url", "left_semi")
        fallback = fallback.join(wanted, "url", "left_semi") if fallback is not None else None
    return rows if fallback is None or not rows.isEmpty() else fallback


def page_terms(results: DataFrame, session_id: str) -> DataFrame:
    """A row for each term of stored results, as merge_terms() reads them."""
    rows = results.select(F.lit(session_id).alias("session_id"), F.col("page_ord").alias("page_id"), "domain", F.posexplode("nlp_terms").alias("ord", "t"))
    return rows.select("session_id", "page_id", "domain", "ord", "t.text", "t.label", "t.source", F.col("t.count").alias("count"), "t.relevance", "t.weightage", "t.keybert_score")


def session_exports(spark: SparkSession, path: str) -> DataFrame:
    """Entities of exported sessions with file and ord; only files of the report's name form."""
    rows = spark.read.schema(S.SESSION_EXPORT).json(path, multiLine=True).withColumn("file", _name())
    rows = rows.where(F.col("file").rlike(REPORT_NAME))
    return rows.select("file", "session_id", "keyword", F.posexplode("merge_output.entities").alias("ord", "e")).select("file", "session_id", "keyword", "ord", "e.*")


def cli_exports(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder that have entities; others, and broken ones, are passed over."""
    return spark.read.schema(S.CLI_EXPORT).json(path, multiLine=True, mode="PERMISSIVE").withColumn("file", _name()).where(F.size("entities") > 0)


def authority(spark: SparkSession, path: str) -> DataFrame:
    """(domain, dr): ratings that are numbers, the last of a domain; none where the file is missing."""
    try:
        rows = spark.read.schema(S.AUTHORITY).csv(path, header=True)
        rows = rows.select(F.lower(F.trim("domain")).alias("domain"), F.expr("try_cast(dr AS DOUBLE)").alias("dr"))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], "domain string, dr double")
    return rows.where("dr is not null AND domain <> ''").groupBy("domain").agg(F.last("dr").alias("dr"))


def checked_slug(slug: str) -> str:
    """A slug that stays inside its folder."""
    slug = slug.strip()
    if not slug or "/" in slug or "\\" in slug or ".." in slug:
        raise ValueError(f"no export has the name {slug!r}")
    return slug


def keyword_export(spark: SparkSession, folder: str, slug: str) -> DataFrame:
    return spark.read.schema(S.KEYWORD_EXPORT).json(f"{folder}/{checked_slug(slug)}.json", multiLine=True)


def export_terms(export: DataFrame) -> DataFrame:
    """A row for each term of keyword exports: text, combined_count (the middle of its range), flags, tier (green if included, else white)."""
    rows = export.select("keyword", F.posexplode("nlp_terms.terms").alias("ord", "t"))
    low, high = F.coalesce("t.target_range.min", F.lit(0)), F.coalesce("t.target_range.max", F.lit(0))
    flag = lambda c: F.coalesce(f"t.{c}", F.lit(False)).alias(c)
    rows = rows.select("keyword", "ord", X.trimmed("t.term").alias("text"), X.midpoint(low, high).alias("combined_count"), flag("included"), flag("ignored"), flag("is_nlp"), low.alias("low"), high.alias("high"), flag("use_in_heading"))
    return rows.where("text <> ''").withColumn("tier", F.when(F.col("included"), "green").otherwise("white"))


def keyword_exports(spark: SparkSession, folder: str, summary: DataFrame | None = None) -> DataFrame:
    """(slug, keyword, status): exports of the summary that exist; without a summary, all JSON files but those with a leading underscore.

    summary: rows of export_summary().
    """
    files = spark.read.format("binaryFile").load(folder, pathGlobFilter="*.json").select(_name("path").alias("json_file")).where(~F.col("json_file").startswith("_"))
    slug = F.regexp_replace("json_file", r"\.json$", "").alias("slug")
    if summary is None:
        return files.select(slug, F.lit(None).cast("string").alias("keyword"), F.lit(None).cast("string").alias("status"))
    return summary.withColumn("json_file", _name("json_file")).join(files, "json_file").select(slug, "keyword", "status")


def export_summary(spark: SparkSession, path: str) -> DataFrame:
    """The summary of a batch of exports. Spark's readers pass over names with a leading underscore, so the file must have another."""
    return spark.read.schema(S.EXPORT_SUMMARY).csv(path, header=True)


def keyword_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """(source_keyword, payload): JSON files by their stem, to be put into the keyword outputs with upsert()."""
    rows = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").withColumn("file", _name())
    return rows.select(F.regexp_replace("file", r"\.json$", "").alias("source_keyword"), F.col("value").alias("payload"))


def write_page_results(results: DataFrame, path: str) -> None:
    """Stored results, a folder for each session; sessions that are written again are replaced."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id").parquet(path)


def keyword_tier_document(tiers: DataFrame, by: str = "keyword") -> DataFrame:
    """(by, file, document): the texts of the tiers as JSON."""
    texts = lambda t: F.transform(F.filter(F.sort_array(F.collect_list(F.struct("ord", "text", "tier"))), lambda x: x["tier"] == t), lambda x: x["text"])
    rows = tiers.groupBy(by).agg(*(texts(t).alias(t.title()) for t in ("green", "orange", "white")))
    return rows.select(by, F.concat(X.file_name(by), F.lit(".json")).alias("file"), F.to_json(F.struct("Green", "Orange", "White")).alias("document"))


def with_selection_key(rows: DataFrame, urls: str = "urls") -> DataFrame:
    return rows.withColumn("selection_key", selection_key(urls))


def write_artifact(step: DataFrame, folder: str, name: str) -> None:
    """A step's table of an offline run."""
    step.write.mode("overwrite").json(f"{folder}/{checked_slug(name)}")


def append_timings(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True, escape='"')


def write_results(rows: DataFrame, summary: DataFrame, path: str) -> None:
    """Results as JSON lines, and lines of their summary, each in an object of that name."""
    lines = rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))
    last = summary.select(F.to_json(F.struct(F.struct(*summary.columns).alias("summary"))).alias("value"))
    lines.unionByName(last).write.mode("overwrite").text(path)


def write_cache(vectors: DataFrame, path: str) -> None:
    """Term vectors or anchors of sessions, a folder for each."""
    vectors.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id").parquet(path)


def read_cache(spark: SparkSession, path: str, schema: str = S.TERM_VECTORS) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def jdbc(spark: SparkSession, url: str, relation: str, **options: str) -> DataFrame:
    """A relation of a database, for which the driver's jar must be on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=relation, **options).load()


def stored_first(stored: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """One stored row for each key."""
    return first_of(stored, keys, order)


def is_report_file(name: str) -> bool:
    return re.match(REPORT_NAME, name) is not None
