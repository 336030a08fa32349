"""Stored relations: upserts, deletions, latest rows, session lists, cache keys. Plain Parquet: writers rewrite what they change."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import first_of, ranked, top_n


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence | None = None) -> DataFrame:
    """old with the rows of new: by key, each column of new where it isn't null, else of old. Of several new rows of a key the first by order counts."""
    new = first_of(new, keys, order or [F.lit(1)]) if order is not None else new
    rest = [c for c in old.columns if c not in keys]
    a = old.select(*keys, F.struct(*rest).alias("__old"))
    b = new.select(*keys, F.struct(*(c if c in new.columns else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in rest)).alias("__new"))
    return a.join(b, list(keys), "full").select(*keys, *(F.coalesce(f"__new.{c}", f"__old.{c}").alias(c) for c in rest))


def delete(rows: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def select_keys(rows: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(wanted.select(*keys).distinct(), list(keys), "left_semi")


def latest(rows: DataFrame, by: Sequence[str], order: Sequence, n: int = 30) -> DataFrame:
    """The newest n rows of each group."""
    return top_n(rows, by, order, n)


def page(rows: DataFrame, order: Sequence, limit: int, offset: int = 0) -> DataFrame:
    """A page of an ordered list."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def undescribed(titles: DataFrame, described: DataFrame, key: str = "title", text: str = "description") -> DataFrame:
    """Titles that have no description yet: what is left of a batch that is taken up again. Blank descriptions don't count."""
    return titles.join(described.where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "").select(key).distinct(), key, "left_anti")


def keyword_outputs(rows: DataFrame, wanted: Column | None = None, order: Sequence = ()) -> DataFrame:
    """A list of stored outputs in order, all or those that are wanted."""
    rows = rows if wanted is None else rows.where(wanted)
    return rows.orderBy(*order) if order else rows


def history(revisions: DataFrame, users: DataFrame, key: str, order: Sequence, limit: int = 100) -> DataFrame:
    """Revisions with their users, if known, the newest first."""
    return revisions.join(users, key, "left").orderBy(*order).limit(limit)


def accessible(items: DataFrame, permissions: DataFrame, item: str, owner: str, user: str, who) -> DataFrame:
    """Items that a user owns or has a permission for, once each. A permission is looked up, so items don't multiply."""
    granted = permissions.where(F.col(user) == who).select(item).distinct().withColumn("__granted", F.lit(True))
    return items.join(granted, item, "left").where((F.col(owner) == who) | F.col("__granted")).drop("__granted")


def selection_key(urls: Column | str) -> Column:
    """A key of a set of URLs: 16 hex digits of the SHA-256 of their sorted, distinct, trimmed JSON list."""
    c = F.col(urls) if isinstance(urls, str) else urls
    clean = F.array_sort(F.array_distinct(F.filter(F.transform(c, lambda u: F.trim(u)), lambda u: u != "")))
    quoted = F.transform(clean, lambda u: F.replace(F.replace(u, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')))
    text = F.when(F.size(clean) == 0, "[]").otherwise(F.concat(F.lit('["'), F.array_join(quoted, '", "'), F.lit('"]')))
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def session_list(sessions: DataFrame, results: str = "results", merged: str = "merge_output") -> DataFrame:
    """Sessions without their documents: how many results they have, and whether a merge."""
    n = F.when(F.col(results).isNull(), 0).otherwise(F.size(results))
    return sessions.withColumns({"result_count": n, "has_merge": F.col(merged).isNotNull()}).drop(results, merged)


def needs_refresh(method: str = "tiering_method", rank: str = "instance_rank", index: str = "instance_index", current: str = "proportional_instance_v1") -> Column:
    """Whether stored tiers are of another method or without instance order."""
    return (F.coalesce(F.col(method), F.lit("")) != current) | F.col(rank).isNull() | F.col(index).isNull()


def needs_instances(instances: Column | str, expected: Column) -> Column:
    """Whether stored anchors are missing, or fewer than expected."""
    n = F.size(F.coalesce(F.col(instances) if isinstance(instances, str) else instances, F.array()))
    return (n == 0) | (n < expected)


def needs_buckets(buckets: Column | str, terms: Column, least: int = 2) -> Column:
    """Whether a session with terms has no word buckets, or has buckets (nlp_count, nlps) of fewer terms than least."""
    b = F.col(buckets) if isinstance(buckets, str) else buckets
    small = F.exists(b, lambda x: F.coalesce(x["nlp_count"], F.size(x["nlps"])) < least)
    return (terms > 0) & (b.isNull() | small)


def needs_labels(groups: Column | str, labels: Column, catalogue: Sequence[str]) -> Column:
    """Whether there are no label groups, or a term's label is none of the catalogue."""
    g = F.col(groups) if isinstance(groups, str) else groups
    unknown = F.exists(labels, lambda x: ~F.trim(F.coalesce(x, F.lit(""))).isin(*catalogue))
    return F.coalesce(F.size(g), F.lit(0)).isin(0, -1) | F.coalesce(unknown, F.lit(False))


def numbered(rows: DataFrame, order: Sequence, start: int = 0, name: str = "sr_no") -> DataFrame:
    """Rows to be appended, numbered on from start; they are ranked over all tasks."""
    return ranked(rows, [], order, name).withColumn(name, F.col(name) + start)


def timing_summary(rows: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return rows.groupBy(*by).agg(*(F.sum(c).alias(f"{c}_sum") for c in columns), *(F.round(F.avg(c), 4).alias(f"{c}_avg") for c in columns))


def rate_summary(rows: DataFrame, by: Sequence[str], flags: Sequence[str], seconds: str) -> DataFrame:
    """Shares of flags, and median and 95th percentile (the value at place int(0.95 n), from 1) of seconds."""
    exact = F.percentile(seconds, F.lit(0.5)).alias("median")
    ordered = F.row_number().over(Window.partitionBy(*by).orderBy(seconds))
    at = F.greatest(F.lit(1), F.floor(F.count("*").over(Window.partitionBy(*by)) * 0.95))
    p95 = F.max(F.when(F.col("__rank") == F.col("__at"), F.col(seconds))).alias("p95")
    return rows.withColumns({"__rank": ordered, "__at": at}).groupBy(*by).agg(F.count("*").alias("n"), *(F.avg(F.col(f).cast("double")).alias(f"{f}_rate") for f in flags), exact, p95)
