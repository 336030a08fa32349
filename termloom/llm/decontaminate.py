"""Benchmark decontamination: a hash set of normalised test n-grams, scanned over the words of every text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, held, written

WINDOW = 10
#: A word after lower-casing, and before.
WORD, RAW_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Most windows whose hashes and words every task gets as a set. Of more, every task gets a Bloom filter, and what passes it is joined.
MAX_SET = 100_000
#: Bits of the Bloom filter for each window, as far as it has no more than MOST_BITS (8 MB) in all. Fewer bits cost work, never hits.
BITS, MOST_BITS = 16, 1 << 26


def _words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def _hash(words: str, i: Column, length: int) -> Column:
    return F.xxhash64(*(F.get(words, i + k) for k in range(length)))


def _text(words: str, i: Column, length: int) -> Column:
    return F.concat_ws(" ", *(F.get(words, i + k) for k in range(length)))


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(length, hash, words, items): the distinct windows of the items; an item of fewer words than window is one."""
    rows = benchmark.select(F.col(id_col).alias("item"), _words(F.coalesce(text_col, F.lit(""))).alias("w")).select("item", "w", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    n = F.size("w")
    kinds = [F.when(n >= window, F.transform(F.sequence(F.lit(0), n - window), lambda i: F.struct(F.lit(window).alias("length"), _hash("h", i, window).alias("hash"), _text("w", i, window).alias("words"))))]
    kinds += [F.when(n == k, F.array(F.struct(F.lit(k).alias("length"), _hash("h", F.lit(0), k).alias("hash"), _text("w", F.lit(0), k).alias("words")))) for k in range(1, window)]
    return rows.select("item", F.explode(F.coalesce(*kinds)).alias("x")).groupBy("x.length", "x.hash", "x.words").agg(F.sort_array(F.collect_set("item")).alias("items"))


_FOUND = "array<struct<begin: int, length: int, words: string>>"


def _occurrences(length: int, hashed, said) -> Column:
    """The windows of a length as (begin, length, words): those whose hash passes hashed and whose words pass said, both functions of a column."""
    at = F.when(F.size("words") >= length, F.sequence(F.lit(0), F.size("words") - length))
    at = F.filter(F.filter(at, lambda i: hashed(_hash("__h", i, length))), lambda i: said(_text("words", i, length)))
    entries = F.transform(at, lambda i: F.struct(i.alias("begin"), F.lit(length).alias("length"), _text("words", i, length).alias("words")))
    return F.coalesce(entries, F.array().cast(_FOUND))


def _bloom(windows: DataFrame, n: int):
    """A function of a hash column: false for hashes that no window has, true for those of windows and, by chance, some others.

    Two bits of each window's hash are set in one array of longs, at most
    MOST_BITS / 64 of them, which becomes a constant of the plan.
    """
    size = min(MOST_BITS, max(1 << 10, 1 << (BITS * n - 1).bit_length()))
    places = lambda h: (h.bitwiseAND(F.lit(size - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(size - 1)))
    bits = windows.select(F.explode(F.array(*places(F.col("hash")))).alias("p")).groupBy(F.shiftright("p", 6).alias("i")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 AS int)))").alias("x"))
    found = bits.toArrow()
    filled = [0] * (size // 64)
    for i, x in zip(found["i"].to_pylist(), found["x"].to_pylist(), strict=True):
        filled[i] = x
    table = F.from_json(F.lit(str(filled)), "array<long>")  # folded into a constant
    bit = lambda p: F.getbit(F.get(table, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1

    def passes(h: Column) -> Column:
        a, b = places(h)
        return bit(a) & bit(b)

    return passes


def scan(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", item_text_col: str = "text", window: int = WINDOW, max_set: int = MAX_SET) -> tuple[DataFrame, DataFrame]:
    """(hits, windows). hits: for each row of docs its columns in the struct __row, text, words, and found: (begin, length, words) of the windows that occur.

    Up to max_set windows, a count that is taken first, each task tests the
    window hashes of its rows against a hash set in its own memory, and then
    the words themselves, so texts are not shuffled. For more windows the hash
    set is a Bloom filter of bounded size; only windows that pass it become
    rows, which are joined to the benchmark's words and then, by number, to a
    written copy of docs.
    """
    windows = benchmark_windows(benchmark, item_col, item_text_col, window)
    known = windows.select("length", "hash", "words").limit(max_set + 1).collect()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    small = len(known) <= max_set
    if not small:
        windows = written(windows)
        lengths = {x["length"]: x["count"] for x in windows.groupBy("length").count().collect()}
        passes = _bloom(windows, sum(lengths.values()))
        rows = written(rows.withColumn("__n", F.monotonically_increasing_id()))
    rows = rows.select("*", _words(F.col("text")).alias("words"))
    rows = rows.select("*", F.transform("words", lambda w: F.xxhash64(w)).alias("__h"))
    found = []
    for length in sorted({x.length for x in known} if small else lengths):
        own = [x for x in known if x.length == length]
        if small:
            found.append(_occurrences(length, lambda h, own=own: h.isin([x.hash for x in own]), lambda t, own=own: t.isin([x.words for x in own])))
        else:
            found.append(_occurrences(length, passes, lambda t: F.lit(True)))
    found = F.concat(*found) if found else F.array().cast(_FOUND)
    if small:
        return held(rows.select("__row", "text", "words", found.alias("found"))), windows
    every = held(rows.select("__n", found.alias("found"))).select("__n", F.explode("found").alias("x")).select("__n", "x.*")
    hit = every.join(windows.select("length", "words"), ["length", "words"], "left_semi").groupBy("__n").agg(F.sort_array(F.collect_list(F.struct("begin", "length", "words"))).alias("found"))
    out = rows.join(hit, "__n", "left").select("__row", "text", "words", F.coalesce("found", F.array().cast(_FOUND)).alias("found"))
    return out, windows


def covered(found: str = "found") -> Column:
    """The distinct positions of words inside a window that occurs."""
    return F.array_distinct(F.flatten(F.transform(found, lambda x: F.sequence(x["begin"], x["begin"] + x["length"] - 1))))


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "spans", item_col: str = "item_id", text_col: str = "text", item_text_col: str = "text", window: int = WINDOW, max_set: int = MAX_SET) -> DataFrame:
    """docs without what it shares with the benchmark: mode "spans" cuts the words of windows that occur, "documents" whole rows.

    A cut word goes with the signs behind it. Columns and other rows stay as
    they are, repeated rows and null ids too; a null text has no words.
    """
    hits, _ = scan(docs, benchmark, item_col, text_col, item_text_col, window, max_set)
    if mode == "documents":
        return hits.where(F.size("found") == 0).select("__row.*")
    raw = hits.select("__row", "text", "found", covered().alias("__cut")).select(
        "__row", "text", "__cut", F.when(F.size("__cut") > 0, F.split("text", RAW_WORD, -1)).alias("__gaps"), F.when(F.size("__cut") > 0, F.regexp_extract_all("text", F.lit(RAW_WORD), F.lit(0))).alias("__raw")
    )
    kept = F.array_except(F.sequence(F.lit(0), F.size("__raw") - 1), F.col("__cut"))
    clean = F.concat(F.get("__gaps", F.lit(0)), F.array_join(F.transform(kept, lambda i: F.concat(F.get("__raw", i), F.get("__gaps", i + 1))), ""))
    own = F.when(F.size("__cut") > 0, clean).otherwise(F.col(f"__row.`{text_col}`"))
    return held(raw.select(*(own.alias(c) if c == text_col else F.col(f"__row.`{c}`") for c in docs.columns)))


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", max_set: int = MAX_SET, **options) -> DataFrame:
    """(id, n_words, n_hit, items) for each row: words, words inside windows that occur, sorted ids of the items they are from (as strings)."""
    hits, windows = scan(docs, benchmark, item_col, max_set=max_set, **options)
    rows = hits.select(F.monotonically_increasing_id().alias("__n"), F.col(f"__row.`{id_col}`").alias("id"), F.size("words").cast("long").alias("n_words"), F.size(covered()).cast("long").alias("n_hit"), F.array_distinct(F.transform("found", lambda x: x["words"])).alias("w"))
    names = windows.select("words", F.transform("items", lambda x: x.cast("string")).alias("items"))
    if names.limit(max_set + 1).count() <= max_set:
        names = F.broadcast(names)
    each = rows.select("__n", "id", "n_words", "n_hit", F.explode_outer("w").alias("words")).join(names, "words", "left")
    found = each.groupBy("__n", "id", "n_words", "n_hit").agg(F.flatten(F.collect_set("items")).alias("items"))
    return found.select(F.col("id").alias(id_col), "n_words", "n_hit", F.sort_array(F.array_distinct("items")).alias("items"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS t
       FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS t
       FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT doc_id, dw.k, i, item_id FROM dw JOIN bw ON dw.t = bw.t AND dw.k = bw.k),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = report(docs, table(spark, sf_dir, "benchmark"))
    ids = F.array_join("items", ",")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
