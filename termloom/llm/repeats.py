"""Removal of byte strings that occur twice: depth-limited radix passes over the windows of the whole corpus."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, partitions, scratch, written

#: Bytes of a window, of its first digit, and of the digits of later passes.
WINDOW, FIRST, DIGIT = 400, 64, 100
#: Bytes that anchors are looked for in at once; their positions take 20 bits.
BUFFER = 1 << 19
#: Windows sorted together in a task.
TOGETHER = 1 << 20
#: Different surroundings of one anchor beyond which its windows are counted one by one across tasks.
HOT = 20_000
#: An anchor is frequent that starts more runs than this, and than this share of all; so there are 100,000 of these at most. Their rows are dealt to SALTS tasks.
FREQUENT_RUNS, FREQUENT_SHARE, SALTS = 10_000, 1e-5, 64
#: Words of a passage that is reported beside the bytes, and of its first digit; different words that a task keeps at hand.
PASSAGE, PASSAGE_FIRST, CACHE = 51, 10, 500_000
_ONE, _TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _table() -> np.ndarray:
    """A random number for each byte, by a fixed rule."""
    x = (np.arange(1, 257, dtype=np.uint64)) * _ONE
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _ONE + b
    x ^= x >> np.uint64(29)
    x *= _TWO
    return x


def gram_hashes(text: np.ndarray, width: int, table: np.ndarray | None) -> np.ndarray:
    """The hash of the width tokens from each position on; doubling, with one overlap for what is no power of two.

    Tokens are bytes, which table gives numbers for, or without table 64-bit hashes already.
    """
    h, have = text if table is None else table[text], 1
    if len(h) < width:
        return h[:0]
    while 2 * have <= width:
        h = _join(h[:-have], h[have:])
        have *= 2
    return _join(h[: len(h) - (width - have)], h[width - have :]) if have < width else h


def runs(text: np.ndarray, ends: np.ndarray, table: np.ndarray | None, window: int = WINDOW, first: int = FIRST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, number, digit): runs of windows that share their anchor, and the anchor's hash.

    text: up to BUFFER tokens of texts that end at ends; windows do not cross
    an end. A window's anchor is its run of `first` tokens of the smallest
    hash, the leftmost of equals, so equal windows have equal anchors.
    """
    n = len(text) - window + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    h = gram_hashes(text, first, table)
    key = (h & ~np.uint64((1 << 20) - 1)) | np.arange(len(h), dtype=np.uint64)
    have, width = 1, window - first + 1
    while 2 * have <= width:
        key = np.minimum(key[:-have], key[have:])
        have *= 2
    if have < width:
        key = np.minimum(key[: len(key) - (width - have)], key[width - have :])
    at = (key & np.uint64((1 << 20) - 1)).astype(np.int64)
    end = np.repeat(ends, np.diff(ends, prepend=0))[:n]
    ok = end - np.arange(n) >= window
    change = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (end[1:] != end[:-1])]))
    begin, number = change, np.diff(np.append(change, n))
    # the windows of a text that do not fit into it are its last, so a run is cut short at most
    valid = np.add.reduceat(ok.astype(np.int64), begin)
    some = valid > 0
    return begin[some], np.minimum(number, valid)[some], h[at[begin[some]]]


def _pieces(texts: Iterator[tuple[int, np.ndarray]], window: int) -> Iterator[tuple[list[int], list[int], np.ndarray, np.ndarray]]:
    """Buffers of texts: numbers of the texts, where in them the buffer's parts begin, bytes, ends. A long text is cut, with overlaps."""
    which, begins, parts, size = [], [], [], 0
    for i, text in texts:
        for lo in range(0, max(1, len(text) - window + 1), BUFFER - window):
            part = text[lo : lo + BUFFER - 1]
            if size + len(part) > BUFFER:
                yield which, begins, np.concatenate(parts), np.cumsum(list(map(len, parts)))
                which, begins, parts, size = [], [], [], 0
            which.append(i)
            begins.append(lo)
            parts.append(part)
            size += len(part)
    if parts:
        yield which, begins, np.concatenate(parts), np.cumsum(list(map(len, parts)))


def _bytes(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    for i, x in enumerate(column):
        if x.is_valid:
            yield i, np.frombuffer(x.as_buffer(), np.uint8)


def _anchors(window: int, first: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table()
        for batch in batches:
            k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for which, begins, text, ends in _pieces(_bytes(batch.column(2)), window):
                begin, number, digit = runs(text, ends, table, window, first)
                part = np.searchsorted(ends, begin, side="right")
                i = np.array(which)[part]
                lo = begin - (ends - np.diff(ends, prepend=0))[part] + np.array(begins)[part]
                # a window that both of two overlapping parts hold is the earlier's
                cols = [digit.view(np.int64), k1[i], k2[i], lo.astype(np.int32), number.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["h", "k1", "k2", "lo", "n"])

    return run


def _surroundings(window: int, with_bytes: bool):
    """The bytes that a run's windows span, under their 128-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_intdigest

        low = (1 << 64) - 1
        for batch in batches:
            k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_buffer()
                h = batch.column(3)[i].values.to_numpy()
                lo, n = batch.column(4)[i].values.to_numpy(), batch.column(5)[i].values.to_numpy()
                spans = [bytes(text[a : a + b + window - 1]) for a, b in zip(lo.tolist(), n.tolist(), strict=True)]
                c = [xxh3_128_intdigest(x) for x in spans]
                c1, c2 = np.array([x >> 64 for x in c], np.uint64).view(np.int64), np.array([x & low for x in c], np.uint64).view(np.int64)
                if with_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c1), pa.array(c2), pa.array(spans, pa.binary())], ["h", "c1", "c2", "span"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c1), pa.array(c2), pa.array(np.full(len(h), k1[i])), pa.array(np.full(len(h), k2[i])), pa.array(lo)], ["h", "c1", "c2", "k1", "k2", "lo"])

    return run


def repeated_windows(spans: list[np.ndarray], groups: np.ndarray, several: np.ndarray, window: int = WINDOW, digit: int = DIGIT) -> np.ndarray:
    """For every window of the spans, one after the other, whether it is equal to another of its group, or its span occurs several times.

    Most-significant-digit passes: windows are ordered by group and digit, and
    those alone in theirs leave; after the last digit, at the depth of the
    window, the groups that are left are exactly the repeated windows.
    """
    size = np.array([len(s) for s in spans])
    number = size - window + 1
    text = np.concatenate(spans)
    start = np.repeat(np.cumsum(size) - size - np.cumsum(number) + number, number) + np.arange(number.sum())
    h = gram_hashes(text, digit, _table())
    left, group = np.arange(len(start)), np.repeat(groups, number).astype(np.uint64)
    for depth in [*range(0, window - digit, digit), window - digit]:
        key = _join(h[start[left] + depth], group * _TWO + np.uint64(depth))
        order = np.argsort(key)
        left, key, group = left[order], key[order], group[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        alone = new & np.append(new[1:], True)
        group = np.cumsum(new).astype(np.uint64)[~alone]
        left = left[~alone]
        if not len(left):
            break
    out = np.repeat(several, number)
    out[left] = True
    return out


def _ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return edge[::2], edge[1::2] - edge[::2]


def _resolve(window: int, digit: int):
    """Rows (h, c1, c2, span, m) come sorted by h: gives (c1, c2, at, n), the runs of repeated windows of each span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def out(rows) -> Iterator[pa.RecordBatch]:
            if not rows:
                return
            h = np.array([r[0] for r in rows])
            group = np.cumsum(np.concatenate([[True], h[1:] != h[:-1]]))
            spans = [np.frombuffer(r[3], np.uint8) for r in rows]
            flags = repeated_windows(spans, group, np.array([r[4] > 1 for r in rows]), window, digit)
            c1, c2, at, n, lo = [], [], [], [], 0
            for r, s in zip(rows, spans, strict=True):
                a, b = _ranges(flags[lo : lo + len(s) - window + 1])
                lo += len(s) - window + 1
                if len(a):
                    c1.append(r[1])
                    c2.append(r[2])
                    at.append(a.astype(np.int32))
                    n.append(b.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int32()))], ["c1", "c2", "at", "n"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if count > TOGETHER and row[0] != held[-1][0]:
                    yield from out(held)
                    held, count = [], 0
                held.append(row)
                count += len(row[3]) - window + 1
        yield from out(held)

    return run


def _each_window(window: int, digit: int):
    """Every window of the spans under its 128-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table()
        for batch in batches:
            for c1, c2, span, m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = np.frombuffer(span, np.uint8)
                w1, w2 = gram_hashes(text, window, table), gram_hashes(text, window, np.roll(table, 7))
                n = len(w1)
                cols = [np.full(n, c1), np.full(n, c2), np.arange(n, dtype=np.int32), w1.view(np.int64), w2.view(np.int64), np.full(n, m)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["c1", "c2", "i", "w1", "w2", "m"])

    return run


class WordHashes:
    """64-bit hashes of the words of texts, A-Z lower-cased; keeps words at hand, up to a bound."""

    def __init__(self):
        self.at: dict[bytes, int] = {}

    def __call__(self, text: bytes) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        words = text.lower().split()  # of bytes: only A-Z, only ASCII white space
        if len(self.at) > CACHE:
            self.at.clear()
        self.at.update((w, xxh3_64_intdigest(w)) for w in set(words).difference(self.at))
        return np.fromiter(map(self.at.__getitem__, words), np.uint64, len(words))


def _passage_anchors(window: int, first: int):
    """As _anchors, with words for bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts = ((i, hashes(x.as_py())) for i, x in enumerate(batch.column(2)) if x.is_valid)
            for which, begins, text, ends in _pieces(((i, t) for i, t in texts if len(t) >= window), window):
                begin, number, digit = runs(text, ends, None, window, first)
                part = np.searchsorted(ends, begin, side="right")
                i = np.array(which)[part]
                lo = begin - (ends - np.diff(ends, prepend=0))[part] + np.array(begins)[part]
                cols = [digit.view(np.int64), k1[i], k2[i], lo.astype(np.int32), number.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["h", "k1", "k2", "lo", "n"])

    return run


def _passage_windows(window: int):
    """Of rows (k1, k2, t, h, lo, n) the hashes of each run's windows, under a hash of them all.

    Equal windows have equal anchors, so anchor and hash, of 64 bits each, tell windows apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        hashes = WordHashes()
        for batch in batches:
            for k1, k2, text, h, lo, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), *(batch.column(i).to_pylist() for i in (3, 4, 5)), strict=True):
                w = gram_hashes(hashes(text.as_py()), window, None)
                own = [w[a : a + b] for a, b in zip(lo, n, strict=True)]
                c = np.array([xxh3_64_intdigest(x.tobytes()) for x in own], np.uint64).view(np.int64)
                listed = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]).astype(np.int32)), pa.array(np.concatenate(own).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(c), pa.array(np.full(len(lo), k1)), pa.array(np.full(len(lo), k2)), pa.array(lo, pa.int32()), listed], ["h", "c", "k1", "k2", "lo", "w"])

    return run


def _shared_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, c, a, b, w) come sorted by h: gives (h, c, at), the places in w of windows that runs of other texts have too.

    a and b: the smallest and the largest text that has the run.
    """
    held: list[pa.RecordBatch] = []
    count = 0

    def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
        h, c, a, b = (t.column(i).to_numpy() for i in range(4))
        w = t.column(4).combine_chunks()
        n = w.value_lengths().to_numpy()
        own, flat = np.repeat(np.arange(len(h)), n), w.flatten().to_numpy()
        order = np.lexsort((flat, h[own]))
        new = np.flatnonzero(np.concatenate([[True], (flat[order][1:] != flat[order][:-1]) | (h[own][order][1:] != h[own][order][:-1])]))
        several = np.minimum.reduceat(a[own][order], new) != np.maximum.reduceat(b[own][order], new)
        hit = np.zeros(len(flat), bool)
        hit[order] = np.repeat(several, np.diff(np.append(new, len(flat))))
        at = (np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n))[hit].astype(np.int32)
        size = np.bincount(own[hit], minlength=len(h))
        some = size > 0
        yield pa.RecordBatch.from_arrays([pa.array(h[some]), pa.array(c[some]), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size[some])]).astype(np.int32)), pa.array(at))], ["h", "c", "at"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            count += batch.num_rows
        if count > TOGETHER >> 4:
            t = pa.Table.from_batches(held)
            h = t.column(0).to_numpy()
            cut = int(np.argmax(h == h[-1]))
            if cut:
                yield from out(t.slice(0, cut))
            held = t.slice(cut).combine_chunks().to_batches()
            count = t.num_rows - cut
    if count:
        yield from out(pa.Table.from_batches(held))


def _repeated_runs(anchors: DataFrame, another) -> DataFrame:
    """The rows of anchors (h, k1, k2, lo, n) whose anchor starts runs at different values of another.

    The rows of frequent anchors are dealt to several tasks; these anchors, a
    bounded number, are broadcast for that.
    """
    counted = written(anchors.groupBy("h").agg(F.min(another).alias("a"), F.max(another).alias("b"), F.count("*").alias("m")).where("a <> b").select("h", "m"))
    most = max(FREQUENT_RUNS, int(FREQUENT_SHARE * (counted.agg(F.sum("m")).first()[0] or 0)))
    frequent = counted.where(F.col("m") > most).select("h", F.lit(True).alias("often"))
    salt = F.when(F.col("often"), F.pmod(F.xxhash64("k1", "k2", "lo"), F.lit(SALTS))).otherwise(0).cast("long").alias("salt")
    rows = anchors.join(F.broadcast(frequent), "h", "left").select("h", "k1", "k2", "lo", "n", salt)
    wanted = counted.select("h", F.explode(F.expr(f"CASE WHEN m > {most} THEN sequence(0L, {SALTS - 1}L) ELSE array(0L) END")).alias("salt"))
    return rows.join(wanted, ["h", "salt"], "left_semi").select("h", "k1", "k2", "lo", "n")


def _with_runs(unique: DataFrame, found: DataFrame) -> DataFrame:
    """(k1, k2, t, h, lo, n): texts with their runs."""
    by_text = found.groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "lo", "n")).alias("r"))
    return unique.select("k1", "k2", "t").join(by_text, ["k1", "k2"]).select("k1", "k2", "t", F.col("r.h").alias("h"), F.col("r.lo").alias("lo"), F.col("r.n").alias("n"))


def passages(unique: DataFrame, window: int = PASSAGE, first: int | None = None, hot: int = HOT) -> DataFrame:
    """(k1, k2, n_words) of texts, distinct, that share a passage of window words with another: how many words stand in such passages.

    Words are what white space separates, A-Z lower-cased. Digits are words:
    windows whose anchor stands in one text only leave first; runs whose
    windows are all equal are taken once; what is left of an anchor is
    ordered in one task, or counted over all tasks if that is over `hot` runs.
    """
    spark, text = unique.sparkSession, F.xxhash64("k1", "k2")
    some = unique.where(F.octet_length("t") >= 2 * window - 1).select("k1", "k2", "t")
    anchors = written(some.mapInArrow(_passage_anchors(window, first or PASSAGE_FIRST), "h long, k1 long, k2 long, lo int, n int"))
    rows = _with_runs(unique, _repeated_runs(anchors, text)).select("k1", "k2", "t", "h", "lo", "n")
    rows = written(rows.mapInArrow(_passage_windows(window), "h long, c long, k1 long, k2 long, lo int, w array<long>"))
    spans = rows.groupBy("h", "c").agg(F.min(text).alias("a"), F.max(text).alias("b"), F.first("w").alias("w"))
    crowded = written(rows.select("h", "c").distinct().groupBy("h").count().where(F.col("count") > hot).select("h"))
    hit = None
    if not crowded.isEmpty():
        each = spans.join(crowded, "h", "left_semi").select("h", "c", "a", "b", F.posexplode("w").alias("i", "w"))
        twice = each.groupBy("h", "w").agg(F.min("a").alias("a"), F.max("b").alias("b")).where("a <> b").select("h", "w")
        hit = each.join(twice, ["h", "w"], "left_semi").groupBy("h", "c").agg(F.collect_list("i").alias("at"))
        spans = spans.join(crowded, "h", "left_anti")
    resolved = spans.select("h", "c", "a", "b", "w").repartition(partitions(spark), "h").sortWithinPartitions("h").mapInArrow(_shared_windows, "h long, c long, at array<int>")
    hit = resolved if hit is None else resolved.unionByName(hit)
    places = rows.select("h", "c", "k1", "k2", "lo").join(hit, ["h", "c"]).select("k1", "k2", F.transform("at", lambda i: F.col("lo") + i).alias("at"))
    at = F.array_sort(F.flatten(F.collect_list("at")))
    # a window adds the words that the one before it doesn't cover
    new = F.aggregate("at", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window).alias("last")), lambda acc, i: F.struct((acc["n"] + F.least(F.lit(window), i - acc["last"])).alias("n"), i.alias("last")))
    return places.groupBy("k1", "k2").agg(at.alias("at")).select("k1", "k2", new["n"].alias("n_words"))


def _cut(window: int, texts: bool, passage: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            size, removed, spans, kept, words = [], [], [], [], []
            for text, copies, found, shared in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4), batch.column(5).to_pylist(), strict=True):
                n = len(text.as_py().split()) if passage and copies > 1 else 0
                words.append(n if n >= passage > 0 else shared or 0)
                buffer = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid else np.zeros(0, np.uint8)
                size.append(len(buffer))
                gone = np.zeros(len(buffer) + 1, np.int32)
                if copies > 1 and len(buffer) >= window:
                    gone[0] += 1
                    gone[-1] -= 1
                for x in found.as_py() or ():
                    for a, n in zip(x["at"], x["n"], strict=True):
                        gone[x["lo"] + a] += 1
                        gone[x["lo"] + a + n - 1 + window] -= 1
                mask = np.cumsum(gone[:-1]) > 0
                removed.append(int(mask.sum()))
                spans.append(len(_ranges(mask)[0]))
                rest = buffer[~mask].tobytes()
                kept.append(rest if texts else hashlib.sha256(rest).hexdigest().encode())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary()), pa.array(words, pa.int64())], ["k1", "k2", "n_bytes", "n_removed", "n_spans", "kept", "n_passage_words"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, texts: bool = True, first: int = FIRST, digit: int = DIGIT, hot: int = HOT, passage: int = 0) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept, n_passage_words) for each row: the text without each byte inside a string of window bytes that starts anywhere else too.

    kept: the remaining bytes (binary, as a cut may split a character), or
    with texts=False their SHA-256 as hex digits in binary.

    Equal texts are taken once, with their number: all of a text that has
    copies is repeated. The windows of the others go through radix passes. The
    first digit is the anchor inside a window: windows whose anchor occurs once
    leave before anything else of them is moved. What is left is grouped by
    anchor; surroundings that are equal to the last byte are counted before
    the shuffle and sent once. Tasks order the windows of their groups by
    digits down to the full depth. An anchor with over `hot` different
    surroundings has its windows counted by hash over all tasks instead.

    n_passage_words: with passage, the number of words in passages of that
    many words that another document holds too (passages()), whatever bytes
    they have; without, 0. It removes nothing.

    A null text is empty. Rows of null or equal ids are texts like any other;
    other columns are ignored.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    keyed = docs.select(F.col(id_col).alias("id"), text.alias("t")).select("id", F.xxhash64("t").alias("k1"), F.xxhash64(F.lit(7), "t", F.octet_length("t")).alias("k2"), "t")
    distinct = keyed.groupBy("k1", "k2").agg(F.first("t").alias("t"), F.count("*").alias("copies"))
    name = f"termloom_{uuid.uuid4().hex}"
    distinct.write.bucketBy(partitions(spark), "k1", "k2").option("path", scratch(spark)).option("compression", "zstd").format("parquet").saveAsTable(name)
    unique = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # from the catalogue; the files are scratch

    anchors = written(unique.where(F.octet_length("t") >= window).select("k1", "k2", "t").mapInArrow(_anchors(window, first), "h long, k1 long, k2 long, lo int, n int"))
    joined = _with_runs(unique, written(_repeated_runs(anchors, F.xxhash64("k1", "k2", "lo"))))
    members = written(joined.mapInArrow(_surroundings(window, False), "h long, c1 long, c2 long, k1 long, k2 long, lo int"))
    spans = joined.mapInArrow(_surroundings(window, True), "h long, c1 long, c2 long, span binary")
    spans = spans.groupBy("h", "c1", "c2").agg(F.first("span").alias("span"), F.count("*").alias("m"))
    crowded = written(members.select("h", "c1", "c2").distinct().groupBy("h").count().where(F.col("count") > hot).select("h"))
    found = None
    if not crowded.isEmpty():
        each = spans.join(crowded, "h", "left_semi").select("c1", "c2", "span", "m").mapInArrow(_each_window(window, digit), "c1 long, c2 long, i int, w1 long, w2 long, m long")
        twice = each.groupBy("w1", "w2").agg(F.sum("m").alias("s")).where("s > 1").select("w1", "w2")
        found = each.join(twice, ["w1", "w2"], "left_semi").groupBy("c1", "c2").agg(F.sort_array(F.collect_list("i")).alias("at"))
        found = found.select("c1", "c2", "at", F.transform("at", lambda _: F.lit(1)).alias("n"))
        spans = spans.join(crowded, "h", "left_anti")
    sorted_ = spans.select("h", "c1", "c2", "span", "m").repartition(partitions(spark), "h").sortWithinPartitions("h")
    resolved = sorted_.mapInArrow(_resolve(window, digit), "c1 long, c2 long, at array<int>, n array<int>")
    found = resolved if found is None else resolved.unionByName(found)
    cuts = members.join(found, ["c1", "c2"]).groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "at", "n")).alias("found"))
    shared = passages(unique, passage, hot=hot).select("k1", "k2", "n_words") if passage else unique.select("k1", "k2", F.lit(0).cast("long").alias("n_words")).limit(0)
    done = unique.join(cuts, ["k1", "k2"], "left").join(shared, ["k1", "k2"], "left").select("k1", "k2", "t", "copies", "found", "n_words")
    done = done.mapInArrow(_cut(window, texts, passage), "k1 long, k2 long, n_bytes long, n_removed long, n_spans long, kept binary, n_passage_words long")
    return keyed.select("id", "k1", "k2").join(done, ["k1", "k2"]).select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept", "n_passage_words")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return remove_repeats(table(spark, sf_dir, "documents"), texts=False, passage=PASSAGE).withColumn("kept", F.col("kept").cast("string")).withColumnRenamed("kept", "kept_sha256")
