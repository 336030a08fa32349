"""Quality rules as a short-circuit cascade, ordered by rejections per cost measured on a sample."""

from __future__ import annotations

import re
import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: About how many rows are in the sample that costs and selectivities are estimated on; how often each counts when a step is timed, and how often that is done.
SAMPLE_ROWS, COPIES, TIMES = 2000, 2, 2
MIN_WORDS, MAX_REPEAT = 50, 50

_LINES = r"filter(split(text, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')"
#: What a rule may name: SQL on text and its words, worked out only where the rule is reached.
FEATURES = {
    "n_words": "size(__words)",
    "word_chars": r"char_length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', ''))",
    "n_symbols": r"regexp_count(text, '[#*$%&|<>]')",
    "n_lines": f"size({_LINES})",
    "n_dup_lines": f"get(transform(array({_LINES}), l -> size(l) - size(array_distinct(l))), 0)",
    "n_letters": r"(char_length(text) - char_length(regexp_replace(text, '\\p{L}+', '')))",
    "n_capitals": r"(char_length(text) - char_length(regexp_replace(text, '\\p{Lu}+', '')))",
    "n_shouts": "regexp_count(text, '!!')",
}

#: Rules: name, and a SQL condition on FEATURES that rejects a document.
RULES = (
    ("symbols", "10 * n_symbols > n_words"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    ("duplicate_lines", "10 * n_dup_lines > 3 * greatest(1, n_lines)"),
    ("shouting", "n_shouts > 0.1D * n_words"),
    ("capitals", "n_capitals > 0.5D * n_letters"),
    ("letters", "n_letters < 0.5D * word_chars"),
)
#: The two steps of the base, which come into the cascade's order like any rule. The second needs the sorted windows.
FEW, REPEATS = "few_words", "repeats"


def _words(text: str = "text") -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _grams(words: str) -> Column:
    """A hash of each 3-word window; null for fewer words."""
    n = F.size(words)
    return F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))))


def _spare(grams: str) -> Column:
    """How many windows more there are than different ones; null without windows."""
    return F.size(grams) - F.size(F.array_distinct(grams))


def _sorted(words: str, wanted: Column) -> Column:
    """The windows by 128-bit hash, which are equal where the windows are; null where they aren't wanted."""
    at = lambda i, k: F.get(words, i + k)
    pair = lambda i: F.struct(F.xxhash64(at(i, 0), at(i, 1), at(i, 2)).alias("a"), F.xxhash64(F.lit(1), at(i, 2), at(i, 1), at(i, 0)).alias("b"), i.alias("i"))
    return F.when(wanted, F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 3), pair)))


def _covered(windows: str) -> Column:
    """Number of words in windows that are found twice or more."""
    same = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"])
    twice = F.filter(windows, lambda x, j: same(x, F.get(windows, j - 1)) | same(x, F.get(windows, j + 1)))
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    return F.when(F.col(windows).isNull(), 0).otherwise(F.size(covered)).cast("long")


def _packed(docs: DataFrame, text_col: str) -> DataFrame:
    """(__row, text, __words): all columns of docs in a struct, the text with null as empty, its words."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return rows.select("*", _words().alias("__words"))


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of docs under their own names in the struct __row, with text and the statistics beside it.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words: long.
    """
    rows = _packed(docs, text_col).select("*", _grams("__words").alias("__grams"))
    rows = rows.select("*", _sorted("__words", _spare("__grams") > 0).alias("__sorted"))
    named = (F.expr(FEATURES[x]).cast("long").alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines"))
    return held(rows.select("__row", "text", *named, _covered("__sorted").alias("n_repeat_words")))


def base_failed(min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT) -> Column:
    return (F.col("n_words") < min_words) | (F.lit(100) * F.col("n_repeat_words") > F.lit(max_repeat) * F.col("n_words"))


def _inlined(condition: str, known: Sequence[str] = ()) -> str:
    """The condition with features written out, but for those that are columns already."""
    names = [x for x in FEATURES if x not in known]
    return re.sub(rf"\b({'|'.join(names)})\b", lambda m: FEATURES[m[0]], condition)


def verdict(rules: Sequence[tuple[str, str]], known: Sequence[str] = ()) -> Column:
    """The name of the first rule that rejects, null for none: a CASE, so a later rule's features are worked out only where all earlier ones pass."""
    chain = None
    for name, condition in rules:
        condition = F.expr(_inlined(condition, known))
        chain = F.when(condition, name) if chain is None else chain.when(condition, name)
    return chain if chain is not None else F.lit(None).cast("string")


def cascade(rows: DataFrame, steps: Sequence[tuple[str, str]], max_repeat: int = MAX_REPEAT) -> DataFrame:
    """rows (text, __words, ...) with __why, the first step that rejects; steps: rules, and REPEATS at its place.

    The windows of REPEATS are hashed only for texts that no step before has
    rejected, and sorted only if enough of them repeat: of n windows of which d
    differ at most 2 (n - d) are found twice, and each covers three words.
    """
    at = next((i for i, (name, _) in enumerate(steps) if name == REPEATS), None)
    if at is None:
        return held(rows.withColumn("__why", verdict(steps)))
    left = F.col("__before").isNull()
    out = rows.withColumn("__before", verdict(steps[:at])).withColumn("__grams", F.when(left, _grams("__words")))
    out = out.withColumn("__sorted", _sorted("__words", F.lit(600) * _spare("__grams") > F.lit(max_repeat) * F.size("__words")))
    failed = F.lit(100) * F.when(F.col("__sorted").isNull(), 0).otherwise(_covered("__sorted")) > F.lit(max_repeat) * F.size("__words")
    after = verdict(steps[at + 1 :])
    return held(out.withColumn("__why", F.when(~left, F.col("__before")).when(failed, REPEATS).otherwise(after)).drop("__before", "__grams", "__sorted"))


def greedy(costs: Sequence[float], masks: dict[int, int]) -> list[int]:
    """Places of steps, the next one always that of the most rejections per cost among rows that are still in. masks: bits of the steps that reject -> rows."""
    left, out = set(range(len(costs))), []
    while left:
        rate = {k: sum(n for m, n in masks.items() if m >> k & 1) / max(costs[k], 1e-9) for k in left}
        best = min(left, key=lambda k: (-rate[k], k))
        out.append(best)
        left.remove(best)
        masks = {m: n for m, n in masks.items() if not m >> best & 1}
    return out


def ordered(sample: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> list[tuple[str, str]]:
    """The steps by rejections per cost on sample, rows with text, the best first.

    A step's cost is the least time that it alone takes on the cached sample,
    several copies of each row, less that of a step that does nothing. Its
    rejections are those among rows that the steps before it leave in. The
    order decides how much work a document takes, never its verdict.
    """
    rows = sample.select(F.coalesce("text", F.lit("")).alias("text")).select("text", _words().alias("__words")).repartition(1).cache()
    try:
        if not rows.count():
            return list(rules)
        copies = rows.select("text", "__words", F.explode(F.sequence(F.lit(1), F.lit(COPIES))).alias("__copy"))

        def cost(step: tuple[str, str]) -> float:
            least = float("inf")
            for _ in range(TIMES):
                began = time.perf_counter()
                cascade(copies, [step]).agg(F.count("__why")).first()
                least = min(least, time.perf_counter() - began)
            return least

        nothing = cost(("nothing", "n_words < 0"))
        costs = [cost(x) - nothing for x in rules]
        flags = rows
        for i, step in enumerate(rules):
            flags = cascade(flags, [step]).withColumn(f"__{i}", F.col("__why").isNotNull().cast("long")).drop("__why")
        bits = sum((F.shiftleft(f"__{i}", i) for i in range(len(rules))), F.lit(0).cast("long"))
        masks = {r.m: r["count"] for r in flags.select(bits.alias("m")).groupBy("m").count().collect()}
        return [rules[i] for i in greedy([max(c, 0.02 * nothing) for c in costs], masks)]
    finally:
        rows.unpersist()


def _sample(docs: DataFrame, text_col: str, sample_rows: int) -> DataFrame:
    share = min(1.0, sample_rows / max(1, docs.count()))
    return docs.select(F.col(f"`{text_col}`").alias("text")).sample(share, seed=0)


def quality_rules(docs: DataFrame, text_col: str = "text", rules: Sequence[tuple[str, str]] = RULES, sample_rows: int = SAMPLE_ROWS, estimate: DataFrame | None = None) -> DataFrame:
    """The rows of statistics() with base_failed and kept, for reports: every statistic of every row is worked out.

    A document is kept if it has enough words, few repeated ones, and no rule
    rejects it. A null text is empty, so rejected. estimate: rows with the
    text column to estimate the rules' costs on, docs if not given; about
    sample_rows of them are used. Rows stay one for one, with repeated
    rows and null ids.
    """
    stats = statistics(docs, text_col)
    best = ordered(_sample(docs if estimate is None else estimate, text_col, sample_rows), rules)
    base = base_failed()
    known = ("n_words", "word_chars", "n_symbols", "n_dup_lines")
    return stats.select("*", base.alias("base_failed"), F.when(base, False).otherwise(verdict(best, known).isNull()).alias("kept"))


def keep(docs: DataFrame, text_col: str = "text", rules: Sequence[tuple[str, str]] = RULES, sample_rows: int = SAMPLE_ROWS, min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The rows of docs that quality_rules() keeps, as they are: the whole cascade, base included, in order of rejections per cost.

    Of a text only what is needed to reject it is worked out. A null or
    empty text is rejected; repeated rows, null ids and columns of any name stay
    as they are, and an empty table stays empty.
    """
    steps = [(FEW, f"n_words < {min_words}"), (REPEATS, f"n_repeat_words > {max_repeat}"), *rules]
    best = ordered(_sample(docs, text_col, sample_rows), steps)
    return cascade(_packed(docs, text_col), best, max_repeat).where("__why IS NULL").select("__row.*")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM h WHERE n >= 2) GROUP BY doc_id),
s AS (SELECT doc_id, text, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             len(ls) AS n_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS letters, length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS upper,
             (length(text) - length(replace(text, '!!', ''))) / 2 AS shouts
      FROM w LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR 10 * n_dup_lines > 3 * greatest(1, n_lines) OR shouts > 0.1 * n_words OR upper > 0.5 * letters OR letters < 0.5 * word_chars) AS kept
FROM s
"""


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs).select("__row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
