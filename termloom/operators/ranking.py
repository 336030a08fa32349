"""Ranks, caps and slots inside groups."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..scratch import written

GREEN, WHITE_OF_REST, WHITE_BOTTOM = 0.35, 0.1, 0.10
TIER_RANK = {"green": 0, "orange": 1, "white": 2}


def tier_rank(tier: Column | str) -> Column:
    c = F.lower(F.col(tier) if isinstance(tier, str) else tier)
    return F.when(c == "green", 0).when(c == "white", 2).otherwise(1)


def first_of(df: DataFrame, by: Sequence, order: Sequence) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__rank = 1").drop("__rank")


def top_n(df: DataFrame, by: Sequence, order: Sequence, n) -> DataFrame:
    """The first n rows of each group; n: a number or a column."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__rank") <= n).drop("__rank")


def ranked(df: DataFrame, by: Sequence[str], order: Sequence, name: str = "rank") -> DataFrame:
    """Column name: the place of each row in its group, from 1, for groups that may be too large for one task.

    Rows are dealt by ranges of (by, order) and sorted there, so a group, or a
    table without groups, is spread over tasks; a row's place is its place in
    the task and the number of the group's rows in tasks before, of which
    there is one figure a task and group. The dealt rows are written once.
    """
    by = list(by)
    dealt = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, *order).sortWithinPartitions(*by, *order)
    rows = written(dealt.withColumns({"__task": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}))
    sizes = rows.groupBy(*by, "__task").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = sizes.select(*(F.col(c).alias(f"__by{i}") for i, c in enumerate(by)), F.col("__task").alias("__of"), "__first", before.alias("__before"))
    same = F.col("__task") == F.col("__of")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__by{i}"))
    return rows.join(own, same).withColumn(name, (F.col("__before") + F.col("__at") - F.col("__first") + 1).cast("int")).select(*df.columns, name)


def keep_ratio(terms: DataFrame, ratio: float, by: Sequence[str], score: Column, order: Sequence) -> DataFrame:
    """The best terms of each page: at least one, and the ratio of all, rounded up. A ratio of 0 keeps all."""
    ratio = min(1.0, max(0.0, ratio or 1.0))
    if ratio == 1.0:
        return terms
    page = Window.partitionBy(*by)
    ranked = terms.withColumn("__rank", F.row_number().over(page.orderBy(score.desc(), *order))).withColumn("__n", F.count("*").over(page))
    return ranked.where(F.col("__rank") <= F.greatest(F.lit(1), F.ceil(F.col("__n") * ratio))).drop("__rank", "__n")


def percentile_tiers(terms: DataFrame, by: Sequence[str], order: Sequence, large: bool = False) -> DataFrame:
    """Column tier: green for the first 35 %, white for the first tenth of the rest, at least one each, orange for what is left.

    large: groups may be too large for one task; they are ranked by ranked() and counted apart.
    """
    if large:
        out = ranked(terms, by, order, "__rank")
        out = out.join(out.groupBy(*by).agg(F.count("*").alias("__n")), list(by))
    else:
        group = Window.partitionBy(*by)
        out = terms.withColumn("__rank", F.row_number().over(group.orderBy(*order))).withColumn("__n", F.count("*").over(group))
    green = F.greatest(F.lit(1), F.floor(F.col("__n") * GREEN))
    white = F.greatest(F.lit(1), F.floor((F.col("__n") - green) * WHITE_OF_REST))
    tier = F.when(F.col("__rank") <= green, "green").when(F.col("__rank") <= green + white, "white").otherwise("orange")
    return out.withColumn("tier", tier).drop("__rank", "__n")


def quota_counts(n: Column) -> tuple[Column, Column, Column]:
    """Green, white and orange counts of n: 35 % and 10 %, at least one each as far as there are rows, and the rest."""
    green = F.when(n > 0, F.greatest(F.lit(1), F.floor(n * GREEN))).otherwise(0)
    white = F.when(n > 0, F.least(F.greatest(F.lit(1), F.floor(n * WHITE_BOTTOM)), n - green)).otherwise(0)
    return green.cast("long"), white.cast("long"), (n - green - white).cast("long")


def quota_tiers(assigned: DataFrame, by: Sequence[str], sim: str = "sim", key: Column | None = None, order: Sequence = ()) -> DataFrame:
    """Column tier by similarity: green for the top 35 %, white for the bottom 10 %, orange between.

    Rows of a group with an equal key all have the tier of the last of them.
    """
    group = Window.partitionBy(*by)
    out = assigned.withColumn("__rank", F.row_number().over(group.orderBy(F.col(sim).desc(), *order))).withColumn("__n", F.count("*").over(group))
    green, white, _ = quota_counts(F.col("__n"))
    rank = F.col("__rank") if key is None else F.max("__rank").over(Window.partitionBy(*by, key))
    tier = F.when(rank <= green, "green").when(rank > F.col("__n") - white, "white").otherwise("orange")
    return out.withColumn("tier", tier).drop("__rank", "__n")


def slot_share(slots: Column, anchors: Column, index: Column) -> Column:
    """Slots of the anchor at a place (from 0): an even split, one more for the first ones."""
    base = F.floor(slots / anchors)
    return F.when((anchors > 0) & (slots > 0), base + F.when(index < slots - base * anchors, 1).otherwise(0)).otherwise(0).cast("long")


def numeric_cap(terms: DataFrame, by: Sequence[str], order: Sequence, text: str = "text", most: int = 2, exempt: Iterable[str] | Column = ()) -> DataFrame:
    """Without the terms with digits after the first `most` of each group; exempt anchors (texts, or a condition) stay and don't count."""
    free = exempt if isinstance(exempt, Column) else T.is_exempt(text, exempt)
    counted = (T.is_numeric(text) & ~free).cast("int")
    running = F.sum(counted).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return terms.withColumn("__c", counted).withColumn("__n", running).where((F.col("__c") == 0) | (F.col("__n") <= most)).drop("__c", "__n")


def label_cap(terms: DataFrame, caps: dict[str, int], by: Sequence[str], order: Sequence, label: str = "label", tier: str = "tier", text: str = "text") -> DataFrame:
    """At most so many terms of a capped label in each group, by tier, then order; terms of equal text stay or go together."""
    if not caps:
        return terms
    own = F.trim(F.coalesce(F.col(label), F.lit("")))
    cap = F.lit(None).cast("int")
    for name, n in caps.items():
        cap = F.when(own == name, n).otherwise(cap)
    ranked = terms.withColumn("__rank", F.row_number().over(Window.partitionBy(*by, own).orderBy(tier_rank(tier), *order)))
    best = F.min("__rank").over(Window.partitionBy(*by, own, T.text_key(text)))
    return ranked.withColumn("__best", best).where(cap.isNull() | (F.col("__best") <= cap)).drop("__rank", "__best")
