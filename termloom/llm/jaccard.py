"""Pairs of texts by the exact Jaccard index of their shingle sets: a prefix filter for candidates, then a comparison of the whole sets."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, written
from .graph import components
from .simhash import _shingles

#: About how many texts tell which shingles are common, and the most common ones that every task gets. They change the work, never the links.
SAMPLE, COMMON = 40_000, 200_000
#: Members of a group of one shingle beyond which the group's whole sets are compared in one task, for a spanning forest of its links only.
GROUP = 256
#: Members of a large group that are dealt into one block; every two blocks of a group meet in one task, which holds their sets.
BLOCK = 2000
#: Share of the texts, at least, that tells which shingles are common.
SHARE = 1 / 16
#: Pairs compared at once.
PAIRS = 1 << 19


def shingle_set(text: bytes, width: int, seed: int) -> np.ndarray:
    """The distinct shingles of a text as sorted XXH64 hashes."""
    from xxhash import xxh64_intdigest

    found = set(_shingles(text, width))
    return np.sort(np.fromiter((xxh64_intdigest(x, seed) for x in found), np.uint64, len(found)))


def digest(shingles: np.ndarray) -> int:
    """A set's node: texts of equal sets are one."""
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def _sets(batches: Iterator[pa.RecordBatch], width: int, seed: int):
    for batch in batches:
        yield batch, [shingle_set(x.as_py() or b"", width, seed) for x in batch.column(0)]


def _all(width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches, width, seed):
            for lo in range(0, len(sets), 50):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets[lo : lo + 50]).view(np.int64))], ["h"])

    return run


def nodes_of(width: int, seed: int):
    """(n, id, node) of rows (text, n, id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sets(batches, width, seed):
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([digest(x) for x in sets], pa.int64())], ["n", "id", "node"])

    return run


def only(rows: DataFrame, ns: DataFrame) -> DataFrame:
    """The rows whose n is among ns. One bit for each n is broadcast, in longs, so rows, with their texts, are not shuffled."""
    words = ns.groupBy(F.shiftright("n", 6).alias("k")).agg(F.expr("bit_or(shiftleft(1L, cast(n & 63 AS int)))").alias("word"))
    return rows.join(F.broadcast(words), F.expr("shiftright(n, 6) = k AND getbit(word, cast(n & 63 AS int)) = 1"), "left_semi")


def _with_sets(width: int, seed: int):
    """(node, shingles) of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches, width, seed):
            yield pa.RecordBatch.from_arrays([pa.array([digest(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "shingles"])

    return run


def sketch(shingles: np.ndarray) -> bytes:
    """Whether the number of shingles is odd, for each of as many classes of hashes as there are shingles, or up to twice as many."""
    m = max(64, 1 << max(0, len(shingles) - 1).bit_length())
    at = (shingles & np.uint64(m - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=m) & 1, bitorder="little").tobytes()


def apart(x: bytes, y: bytes) -> int:
    """At most the number of shingles that only one of two sets has: each changes one bit of the sketches."""
    x, y = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _with_sketches(width: int, seed: int):
    """(node, size, sketch) of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches, width, seed):
            yield pa.RecordBatch.from_arrays([pa.array([digest(x) for x in sets], pa.int64()), pa.array(list(map(len, sets)), pa.int32()), pa.array(list(map(sketch, sets)), pa.binary())], ["node", "size", "sketch"])

    return run


def _possible(least: Fraction):
    """(a, b) of rows (a, b, size of a, its sketch, size of b, its sketch) that the sketches don't show to be unlike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [apart(x, y) * (least.numerator + least.denominator) <= (least.denominator - least.numerator) * (m + n) for m, x, n, y in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def prefix(shingles: np.ndarray, common: np.ndarray, rank: np.ndarray, least: Fraction) -> np.ndarray:
    """The first shingles, the rarest first: two sets of an index of at least `least` have one in common there.

    They have at least that share of the larger set in common, so not all of
    what they have in common can lie behind either's prefix.
    """
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        shingles = shingles[np.lexsort((shingles, np.where(common[at] == shingles, rank[at], 0)))]
    return shingles[: len(shingles) - -(-least.numerator * len(shingles) // least.denominator) + 1]


def _prefixes(width: int, seed: int, common: np.ndarray, rank: np.ndarray, least: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, sets in _sets(batches, width, seed):
            for lo in range(0, len(sets), 200):
                new = {digest(x): x for x in sets[lo : lo + 200] if len(x)}
                new = {k: x for k, x in new.items() if k not in seen}
                if not new:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.update(new)
                first = [prefix(x, common, rank, least) for x in new.values()]
                n = np.array(list(map(len, first)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(first).view(np.int64)),
                        pa.array(np.repeat(np.array(list(new), np.int64), n)),
                        pa.array(np.repeat(np.array(list(map(len, new.values())), np.int32), n)),
                        pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in n])),
                    ],
                    ["h", "node", "size", "pos"],
                )

    return run


def group_pairs(h: np.ndarray, node: np.ndarray, size: np.ndarray, pos: np.ndarray, least: Fraction, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """(a, b, None): pairs of small groups that can reach the index by their sizes and places; (node, node, h): members of large groups."""
    order = np.lexsort((node, h))
    h, node, size, pos = h[order], node[order], size[order].astype(np.int64), pos[order].astype(np.int64)
    once = np.concatenate([[True], (h[1:] != h[:-1]) | (node[1:] != node[:-1])])
    h, node, size, pos = h[once], node[once], size[once], pos[once]
    new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    n = np.diff(np.append(new, len(h)))
    group = np.repeat(np.arange(len(new)), n)
    large = n[group] > most
    if large.any():
        yield node[large], node[large], h[large]
    rows = np.flatnonzero((n[group] > 1) & ~large)
    after = (new + n)[group[rows]] - rows - 1
    ends, lo = np.cumsum(after), 0
    while lo < len(rows):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS)))
        k = after[lo:hi]
        i = np.repeat(rows[lo:hi], k)
        j = i + 1 + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        a, b = size[i], size[j]
        ok = least.denominator * np.minimum(a, b) >= least.numerator * np.maximum(a, b)
        # of the first shingle in common, only those behind it can be in common too
        ok &= (least.numerator + least.denominator) * np.minimum(a - pos[i], b - pos[j]) >= least.numerator * (a + b)
        yield node[i[ok]], node[j[ok]], None
        lo = hi


def _candidates(least: Fraction, group: int, most: int = 1 << 18):
    """Rows come sorted by h; whole groups are handled as soon as there are enough rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def out(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for a, b, h in group_pairs(*cols, least, group):
                if h is None and len(a):
                    a, b = np.unique(np.stack([a, b], axis=1), axis=0).T
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a)), pa.array(np.ascontiguousarray(b)), pa.nulls(len(a), pa.int64()) if h is None else pa.array(h)], ["a", "b", "h"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows > most:
                t = pa.Table.from_batches(held)
                cols = [c.to_numpy() for c in t.columns]
                cut = int(np.argmax(cols[0] == cols[0][-1]))
                if cut:
                    yield from out([c[:cut] for c in cols])
                held = t.slice(cut).combine_chunks().to_batches()
                rows = t.num_rows - cut
        if rows:
            yield from out([c.to_numpy() for c in pa.Table.from_batches(held).columns])

    return run


def alike(common: int | np.ndarray, a: int, b: int | np.ndarray, least: Fraction):
    """Whether sets of a and b members with so many in common have an index of at least `least`."""
    return common * (least.numerator + least.denominator) >= least.numerator * (a + b)


def _verified(least: Fraction):
    """(a, b) of rows (a, b, x, y) whose sets x and y are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                ok.append(bool(alike(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), least)))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def forest(node: np.ndarray, sets: list[np.ndarray], least: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever alike sets connect: each one reached is compared with those of like size not yet reached."""
    order = np.argsort([len(x) for x in sets], kind="stable")
    node, sets = node[order], [sets[i] for i in order]
    size = np.array([len(x) for x in sets], np.int64)
    at = np.unique(np.concatenate(sets), return_inverse=True)[1]
    start = np.concatenate([[0], np.cumsum(size)])
    mark, left, a, b = np.zeros(int(at.max()) + 1, np.int64), np.ones(len(sets), bool), [], []
    for first in range(len(sets)):
        if not left[first]:
            continue
        left[first] = False
        front = [first]
        while front:
            x = front.pop()
            n = int(size[x])
            lo = np.searchsorted(size, -(-least.numerator * n // least.denominator))
            hi = np.searchsorted(size, n * least.denominator // least.numerator, side="right")
            some = lo + np.flatnonzero(left[lo:hi])
            if not len(some):
                continue
            own = at[start[x] : start[x + 1]]
            mark[own] = 1
            shared = np.add.reduceat(mark[at[start[lo] : start[hi]]], start[lo:hi] - start[lo])[some - lo]
            mark[own] = 0
            near = some[alike(shared, n, size[some], least)]
            left[near] = False
            a += [x] * len(near)
            b += near.tolist()
            front += near.tolist()
    return node[np.array(a, np.int64)], node[np.array(b, np.int64)]


def _crowds(least: Fraction):
    """Links of rows (h, node, shingles) that come sorted by h."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, node, sets = None, [], []

        def out() -> Iterator[pa.RecordBatch]:
            if node:
                a, b = forest(np.array(node, np.int64), sets, least)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            for h, k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if h != now:
                    yield from out()
                    now, node, sets = h, [], []
                node.append(k)
                sets.append(np.frombuffer(x.as_py(), np.uint64))
        yield from out()

    return run


def checked(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, least: Fraction, width: int, seed: int) -> DataFrame:
    """(a, b): the pairs whose sets are alike. Sketches, 64 times smaller than the sets, rule out nearly all others before sets are joined."""
    pairs = written(pairs)
    own = lambda found, make, kind: written(only(rows, found.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node").select("n")).select("t").mapInArrow(make(width, seed), kind))
    small = own(pairs, _with_sketches, "node long, size int, sketch binary")
    of = lambda name: small.select(F.col("node").alias(name), F.col("size").alias(f"size_{name}"), F.col("sketch").alias(f"sketch_{name}"))
    left = written(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "size_a", "sketch_a", "size_b", "sketch_b").mapInArrow(_possible(least), "a long, b long"))
    whole = own(left, _with_sets, "node long, shingles binary")
    side = lambda name, x: whole.select(F.col("node").alias(name), F.col("shingles").alias(x))
    return left.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(_verified(least), "a long, b long")


def links(rows: DataFrame, nodes: DataFrame, near: DataFrame, similarity: float, width: int, seed: int) -> DataFrame:
    """(a, b): links between nodes that connect all whose sets have a Jaccard index of at least similarity, and no others.

    rows: n, t (binary); nodes: node, n (that of one of its rows); near:
    candidate pairs (a, b) of another method, which are checked first. What
    these connect is not compared again. Sets that reach the similarity share
    one of the rarest shingles (prefix()), so whatever near has missed meets
    in a group of one shingle. Pairs of a group, or the members of a large
    one, are compared by their whole sets; a large group is dealt into
    blocks, so that no task holds more than two of them. Shingles are 64-bit hashes.
    """
    spark, least = rows.sparkSession, Fraction(similarity).limit_denominator(1000)
    share = min(1.0, max(SHARE, SAMPLE / max(1, rows.count())))
    some = rows.where(F.shiftrightunsigned(F.xxhash64("n"), 2) <= int(share * (1 << 62)))
    often = some.select("t").mapInArrow(_all(width, seed), "h long").groupBy("h").agg(F.count("*").alias("c")).where("c > 1").orderBy(F.desc("c"), "h").limit(COMMON).toArrow()
    common, rank = (often.column(c).to_numpy() for c in ("h", "c"))
    common = common.astype(np.int64).view(np.uint64)
    order = np.argsort(common)
    common, rank = common[order], rank[order].astype(np.int32)
    first = rows.select("t").mapInArrow(_prefixes(width, seed, common, rank, least), "h long, node long, size int, pos int")
    found = written(first.repartition(partitions(spark), "h").sortWithinPartitions("h").mapInArrow(_candidates(least, GROUP), "a long, b long, h long"))
    known = written(checked(near, rows, nodes, least, width, seed))
    roots = written(components(known))
    root = lambda name: roots.select(F.col("node").alias(name), F.col("root").alias(f"root_{name}"))
    pairs = found.where("h is null").select("a", "b").distinct().join(root("a"), "a", "left").join(root("b"), "b", "left")
    pairs = checked(pairs.where("root_a is null or root_b is null or root_a <> root_b").select("a", "b"), rows, nodes, least, width, seed)
    members = found.where("h is not null").select("h", F.col("a").alias("node"))
    sets = written(only(rows, members.select("node").distinct().join(nodes, "node").select("n")).select("t").mapInArrow(_with_sets(width, seed), "node long, shingles binary"))
    blocks = members.groupBy("h").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("k"))
    dealt = members.join(blocks, "h").withColumn("i", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    met = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).where("k = 1 OR i <> j")
    crowds = met.select(F.xxhash64("h", F.least("i", "j"), F.greatest("i", "j")).alias("h"), "node").join(sets, "node").select("h", "node", "shingles")
    return known.unionByName(pairs).unionByName(crowds.repartition(partitions(spark), "h").sortWithinPartitions("h").mapInArrow(_crowds(least), "a long, b long"))
