"""SimHash near-duplicates with the generalised pigeonhole principle."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, partitions, written
from .graph import components

WIDTH, SEED, DISTANCE = 4, 42, 4
#: Distinct fingerprints that correlations and candidate counts are estimated on.
SAMPLE = 2000
#: Fingerprints with one value of a partition beyond which they are linked through points between them.
HOT = 2000
#: Members of a crowd that are compared in one task, where points between them are too many.
BLOCK = 20_000
#: Largest distance at which crowds meet at points between them.
NEAR = 4
#: Parts are planned for so many fingerprints at least, so that smaller tables get the same.
LEAST = 1_000_000
#: Pairs compared at once, and members of a group beyond which only a spanning forest of its links is given.
PAIRS, GROUP = 1 << 19, 64
_BIT = np.uint64(1) << np.arange(64, dtype=np.uint64)


def _shingles(text: bytes, width: int) -> list[bytes]:
    """Runs of words, repeats included; of fewer words, all of them."""
    words = text.lower().split()  # of bytes: only A-Z, only ASCII white space
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)))


def fingerprint(text: bytes, width: int = WIDTH, seed: int = SEED) -> int:
    """A bit is 1 if set in over half of the shingles' XXH64; 0 without words."""
    from xxhash import xxh64_intdigest

    if not (found := _shingles(text, width)):
        return 0
    h = np.fromiter((xxh64_intdigest(x, seed) for x in found), np.uint64, len(found))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(_BIT[2 * ones > len(h)].sum(dtype=np.uint64))


def _fingerprints(width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py() or b"", width, seed) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    return run


def grouped_bits(sample: np.ndarray, m: int) -> list[int]:
    """m masks of nearly equal width that put correlated bits together: each part grows by the bit most correlated with it."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    bits -= bits.mean(axis=0)
    norm = np.sqrt((bits**2).sum(axis=0))
    close = np.abs(bits.T @ bits) / np.maximum(np.outer(norm, norm), 1e-9)
    np.fill_diagonal(close, 0)
    left, masks = list(range(64)), []
    for k in range(m):
        want = 64 // m + (k < 64 % m)
        part = [max(left, key=lambda i: close[i, left].max(initial=0))]
        left.remove(part[0])
        while len(part) < want:
            part.append(max(left, key=lambda i: close[i, part].sum()))
            left.remove(part[-1])
        masks.append(sum(1 << i for i in part))
    return masks


def plan(sample: np.ndarray, n: int, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Parts of the bits as (mask, threshold), by the least estimated work for n fingerprints.

    Two fingerprints within distance are within the threshold of one part at
    least if the thresholds, each plus one, sum up to distance + 1. For every
    number of parts, dynamic programming deals them out; the work of a part at
    a threshold is its signatures and the candidate pairs, carried on from the
    pairs of the sample and, below what these can show, from an even spread.
    """
    sample, best = sample[:SAMPLE], None
    i, j = np.triu_indices(len(sample), 1)
    differ = sample[i] ^ sample[j]
    far = np.bitwise_count(differ) > distance  # near-duplicates are candidates under any plan
    differ = differ[far]
    for m in range(1, distance + 2):
        masks = grouped_bits(sample, m) if len(sample) > 1 else [sum(1 << i for i in range(64) if i % m == k) for k in range(m)]
        work = []
        for mask in masks:
            wide = mask.bit_count()
            seen = np.bincount(np.bitwise_count(differ & np.uint64(mask)), minlength=distance + 1)[: distance + 1].cumsum() / max(1, len(differ))
            even = np.cumsum([comb(wide, k) for k in range(distance + 1)]) / 2.0**wide
            rows = [1 + wide / 2 if t == 1 else sum(comb(wide, k) for k in range(t - t // 2 + 1)) for t in range(distance + 1)]
            work.append([0.0] + [n * r + n * n / 2 * max(s, e) * 0.05 for r, s, e in zip(rows, seen, even, strict=True)])
        # table[u]: least work, and thresholds + 1, of the parts so far that sum up to u
        table = {0: (0.0, ())}
        for w in work:
            new = {}
            for u, (total, own) in table.items():
                for t in range(distance + 2 - u):
                    if u + t not in new or total + w[t] < new[u + t][0]:
                        new[u + t] = (total + w[t], (*own, t))
            table = new
        total, own = table[distance + 1]
        if best is None or total < best[0]:
            best = (total, [(mask, t - 1) for mask, t in zip(masks, own, strict=True) if t])
    return best[1]


def flips(mask: int, radius: int) -> np.ndarray:
    """What to xor to reach every value within radius in the bits of mask, nothing first."""
    bits = [1 << i for i in range(64) if mask >> i & 1]
    return np.array([sum(x) for r in range(radius + 1) for x in combinations(bits, r)], np.uint64)


def _signatures(parts: Sequence[tuple[int, int]]):
    """For each node and part, its fingerprint's values within half the threshold, and as a probe those within the other half.

    At threshold 1 a probe only clears bits: of two values that differ in one
    bit, the one that has it reaches the other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = [(k, np.uint64(mask), t, flips(mask, t // 2), flips(mask, t - t // 2)) for k, (mask, t) in enumerate(parts)]
        for batch in batches:
            node, fp, check, closed = (c.to_numpy() for c in batch.columns)
            for k, mask, t, own, probe in near:
                some = np.flatnonzero((closed >> k & 1) == 0)
                for lo in range(0, len(some), 1 << 14):
                    at = some[lo : lo + (1 << 14)]
                    value = fp[at].view(np.uint64) & mask
                    if t == 1:
                        i, j = np.nonzero(np.concatenate([np.ones((len(at), 1), bool), (value[:, None] & probe[1:]) > 0], axis=1))
                    else:
                        i, j = np.repeat(np.arange(len(at)), len(probe)), np.tile(np.arange(len(probe)), len(at))
                    # the nearest values come first
                    yield _rows(np.full(len(i), k, np.int32), (value[i] ^ probe[j]).view(np.int64), node[at[i]], fp[at[i]], check[at[i]], j < len(own))

    return run


def _rows(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["part", "value", "node", "fp", "ck", "own"])


_ROWS = "part int, value long, node long, fp long, ck long, own boolean"


def _forest(node: np.ndarray, fp: np.ndarray, check: np.ndarray, linked) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever links connect: each member reached is compared with those not yet reached."""
    left, a, b = np.arange(len(node)), [], []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = linked(fp[left] ^ fp[x], check[left] ^ check[x])
            if near.any():
                b.append(left[near])
                a.append(np.full(len(b[-1]), x))
                front, left = front + b[-1].tolist(), left[~near]
    none = np.zeros(0, np.int64)
    return (node[np.concatenate(a)], node[np.concatenate(b)]) if a else (none, none)


def group_links(part: np.ndarray, value: np.ndarray, node: np.ndarray, fp: np.ndarray, check: np.ndarray, own: np.ndarray, distance: int, check_distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified links inside groups of equal part and value, between a member's own value and another's probe."""
    linked = lambda x, y: (np.bitwise_count(x) <= distance) & (np.bitwise_count(y) <= check_distance)
    order = np.lexsort((node, value, part))
    part, value, node, own = part[order], value[order], node[order], own[order]
    fp, check = fp[order].view(np.uint64), check[order].view(np.uint64)
    new = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (value[1:] != value[:-1])])) if len(fp) else np.zeros(0, np.int64)
    size = np.diff(np.append(new, len(fp)))
    for first, n in zip(new[size > GROUP].tolist(), size[size > GROUP].tolist(), strict=True):
        if own[first : first + n].any():
            some = first + np.unique(node[first : first + n], return_index=True)[1]
            yield _forest(node[some], fp[some], check[some], linked)
    group = np.repeat(np.arange(len(new)), size)
    rows = np.flatnonzero(own & (size[group] > 1) & (size[group] <= GROUP))
    lo, ends = 0, np.cumsum(size[group[rows]])
    while lo < len(rows):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS)))
        some = rows[lo:hi]
        n = size[group[some]]
        i = np.repeat(some, n)
        j = np.repeat(new[group[some]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        ok = (node[i] != node[j]) & linked(fp[i] ^ fp[j], check[i] ^ check[j])
        yield node[i[ok]], node[j[ok]]
        lo = hi


class Forest:
    """Joined sets of nodes."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether the two were apart."""
        a, b = self.root(a), self.root(b)
        self.up[a] = b
        return a != b


def _links(distance: int, check_distance: int, most: int = 1 << 18):
    """Rows come sorted by part and value; whole groups are handled as soon as there are enough rows.

    A task gives a link only if it joins what the task's links before it don't join yet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, forest = 0, Forest()

        def out(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for a, b in group_links(*cols, distance, check_distance):
                pair = np.unique(np.sort(np.stack([a, b], axis=1), axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
                pair = pair[[forest.join(x, y) for x, y in pair.tolist()]] if len(pair) else pair
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows > most:
                t = pa.Table.from_batches(held)
                cols = [c.to_numpy() for c in t.columns]
                cut = int(np.argmax((cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])))
                if cut:
                    yield from out([c[:cut] for c in cols])
                held = t.slice(cut).combine_chunks().to_batches()
                rows = t.num_rows - cut
        if rows:
            yield from out([c.to_numpy() for c in pa.Table.from_batches(held).columns])

    return run


def _ball(distance: int):
    """Every point within half of distance, rounded up, of each fingerprint; own: within half rounded down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = flips((1 << 64) - 1, distance - distance // 2)
        own = np.bitwise_count(step) <= distance // 2
        for batch in batches:
            node, fp, check = (c.to_numpy() for c in batch.columns)
            for lo in range(0, len(fp), max(1, (1 << 20) // len(step))):
                i = np.repeat(np.arange(lo, min(len(fp), lo + max(1, (1 << 20) // len(step)))), len(step))
                point = fp[i].view(np.uint64) ^ np.tile(step, len(i) // len(step))
                yield _rows(np.full(len(i), -1, np.int32), point.view(np.int64), node[i], fp[i], check[i], np.tile(own, len(i) // len(step)))

    return run


def _blocks(crowd: DataFrame) -> DataFrame:
    """Rows (_ROWS) that bring every two blocks of a crowd together; crowd: part, centre, value, node, fp, ck."""
    blocks = crowd.groupBy("part", "centre").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("k"))
    dealt = crowd.join(blocks, ["part", "centre"]).withColumn("i", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    each = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    pair = F.xxhash64("centre", F.least("i", "j"), F.greatest("i", "j"))
    return each.select((-1 - F.col("part")).alias("part"), pair.alias("value"), "node", "fp", "ck", (F.col("value") == F.col("centre")).alias("own"))


def links(nodes: DataFrame, distance: int = DISTANCE, check_distance: int = 64, hot: int = HOT, sample: int = SAMPLE) -> DataFrame:
    """(a, b): links between nodes (node, fp, ck) that connect all whose fp are at most distance bits apart and ck at most check_distance.

    Fingerprints are grouped by their values in the parts of plan(), probed at
    the part's threshold, and compared inside each group; a large group gives
    a spanning forest of its links only. Where over `hot` nodes have one
    value, they and those within the threshold of it meet instead at the
    points halfway between them: two that are at most distance apart have a
    point within half of it, rounded down, of one and rounded up of the other.
    For a distance above 4, which has too many such points, a crowd of one
    value and its surroundings are dealt into blocks instead, and every two
    blocks are compared in one task.
    """
    spark = nodes.sparkSession
    some = [r.fp for r in nodes.orderBy(F.xxhash64("fp", "node")).limit(sample).collect()]
    parts = plan(np.array(some, np.int64).view(np.uint64), max(LEAST, nodes.count()), distance)
    masks = [int(np.array([m], np.uint64).view(np.int64)[0]) for m, _ in parts]
    values = F.explode(F.array(*(F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("value")) for k, m in enumerate(masks))))
    crowded = written(nodes.select(values.alias("x")).groupBy("x.part", "x.value").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("part", "value"))
    rows, met = nodes.select("node", "fp", "ck", F.lit(0).alias("closed")), None
    if not crowded.isEmpty():
        own = nodes.select("node", "fp", "ck", values.alias("x")).select("node", "fp", "ck", "x.part", "x.value")
        inside = own.join(crowded, ["part", "value"], "left_semi").groupBy("node").agg(F.expr("bit_or(shiftleft(1, part))").alias("closed"))
        rows = nodes.join(inside, "node", "left").select("node", "fp", "ck", F.coalesce("closed", F.lit(0)).alias("closed"))
        around = crowded.select("part", F.col("value").alias("centre"), F.explode(_around(parts)).alias("step")).select("part", "centre", F.col("centre").bitwiseXOR(F.col("step")).alias("value"))
        crowd = own.join(around, ["part", "value"])
        if distance <= NEAR:
            met = crowd.select("node", "fp", "ck").distinct().mapInArrow(_ball(distance), _ROWS)
        else:
            met = _blocks(crowd)
    out = rows.repartition(partitions(spark)).mapInArrow(_signatures(parts), _ROWS)
    out = out if met is None else out.unionByName(met)
    return out.repartition(partitions(spark), "part", "value").sortWithinPartitions("part", "value").mapInArrow(_links(distance, check_distance), "a long, b long")


def _around(parts: Sequence[tuple[int, int]]):
    """Column: what to xor to a part's value to reach all values within its threshold."""
    steps = [flips(mask, t).view(np.int64).tolist() for mask, t in parts]
    out = F.array(*map(F.lit, steps[-1]))
    for k, s in reversed(list(enumerate(steps[:-1]))):
        out = F.when(F.col("part") == k, F.array(*map(F.lit, s))).otherwise(out)
    return out


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, distance: int = DISTANCE, seed: int = SEED, hot: int = HOT) -> DataFrame:
    """(id, fp, component) for each row: fingerprint as a signed long, and the smallest id reachable over links of at most distance bits.

    Null and empty texts have fingerprint zero, linked like any other. Equal
    fingerprints are one node, so copies cost no links. Rows of a null id take
    part; component is null only where all ids of a component are. Repeated
    rows stay; other columns are ignored.
    """
    arrow_limits(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(_fingerprints(width, seed), f"id {kind}, fp long")
    rows = written(rows)
    fps = written(rows.groupBy("fp").agg(F.min("id").alias("first")))
    roots = components(links(fps.select(F.col("fp").alias("node"), "fp", F.lit(0).cast("long").alias("ck")), distance, hot=hot))
    linked = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = linked.groupBy("root").agg(F.min("first").alias("component"))
    final = linked.join(least, "root").select("fp", "component")
    return rows.join(final, "fp").select(F.col("id").alias(id_col), "fp", "component")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, seed: int = SEED) -> DataFrame:
    """docs with one row of each group of near-duplicates, that of the smallest id.

    SimHash comes first, as simhash() has it by default: the texts of one of
    its components are candidates, each with the component's first. Two texts
    are linked if their sets of five-word shingles have a Jaccard index of at
    least similarity, computed on the whole sets. A prefix filter then finds
    every such pair that SimHash has not connected, wherever the texts differ.
    Groups are connected components. A null text counts as empty, a null id
    comes after all others, and of repeated rows one stays.
    """
    from . import jaccard

    spark = docs.sparkSession
    arrow_limits(spark)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")  # columns of any name
    rows = written(docs.select(row, F.monotonically_increasing_id().alias("n")))
    kind, text = docs.schema[id_col].dataType.simpleString(), F.col(f"row.`{text_col}`").cast("binary").alias("t")
    own = rows.select(text, "n", F.col(f"row.`{id_col}`").alias("id")).mapInArrow(jaccard.nodes_of(width, seed), f"n long, id {kind}, node long")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "n"))
    nodes = written(own.groupBy("node").agg(first.alias("first")))
    one = nodes.select("node", F.col("first.n").alias("n"))
    alike = simhash(jaccard.only(rows, one).select("n", text), "n", "t", seed=seed).select("n", "component")
    near = written(one.join(alike, "n").select("node", "n", "component"))
    near = near.join(near.where("n = component").select("component", F.col("node").alias("b")), "component").where("node <> b").select(F.col("node").alias("a"), "b")
    roots = components(jaccard.links(rows.select("n", text), one, near, similarity, width, seed))
    grouped = nodes.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "first")
    kept = grouped.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.n").alias("n"))
    return jaccard.only(rows, kept).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = simhash(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
