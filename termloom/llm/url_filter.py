"""URL filters: domain and path rules, then a likelihood ratio of two character language models."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_limits, written

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Words in a host that mark a rejected URL for training.
SEEDS = ("spam", "pills", "casino", "porn", "viagra", "xxx", "malware", "phish", "warez", "torrent")
#: Longest context in characters.
ORDER = 4
#: Longest URL that the models are fitted on: what a string in Arrow holds, so none is left out.
MAX_CHARS = (1 << 31) - 3
#: Characters that are worked on together, and rows of counts that a task adds up before it hands them on.
CHUNK, COUNTS = 1 << 16, 1 << 19
#: Code points below 1 << BITS are packed into a string's key, up to KEPT of them; other strings have a hash.
BITS, KEPT = 12, 5
#: Parts that hosts are dealt into: a URL is judged by models that have not seen its host.
FOLDS = 5
#: Weight of a host that rules block beside one with a seed word. Rules block domains for what they are, not for how their URLs look.
RULED = 0.2
#: How often unlabelled URLs that look rejected are taken out of the accepted ones and the models fitted again.
ROUNDS = 3


def parts(url: str | None) -> tuple[str, str]:
    """Host and path of a URL; both are empty for null and where there is no ://."""
    rest = (url or "").partition("://")[2]
    host = re.match("[^/?#]*", rest)[0]
    return re.sub("[A-Z]+", lambda m: m[0].lower(), host), re.match("[^?#]*", rest[len(host) :])[0]


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        urls = batch.column(1).to_pylist()
        found = [parts(x) for x in urls]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h for h, _ in found], pa.string()), pa.array([p for _, p in found], pa.string()), pa.array(list(map(shape, urls)), pa.string())], ["id", "host", "path", "shape"])


def matched(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule = verdict = None
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule = F.when(fits, F.lit(text)) if rule is None else F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)) if verdict is None else F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def shape(url: str | None) -> str:
    """What the models read: the whole URL in lower case, each run of digits as 0."""
    return f"^{re.sub('[0-9]+', '0', (url or '').lower())}$"


def _keys(codes: np.ndarray, longest: int) -> list[np.ndarray]:
    """Of each place the keys of the strings of 1 to longest characters that end there; places too near the beginning have any.

    A string of up to KEPT code points below 1 << BITS is its own key, others have 63 bits of a hash.
    """
    packed, hashed, large = np.zeros(len(codes), np.uint64), np.full(len(codes), 7, np.uint64), np.zeros(len(codes), bool)
    rare, out = bool(longest > KEPT or (codes >= 1 << BITS).any()), []
    for k in range(longest):
        c = np.concatenate([np.zeros(min(k, len(codes)), np.uint64), codes[: max(0, len(codes) - k)]])
        packed = packed | (c << np.uint64(BITS * k)) if k < KEPT else packed
        key = packed | np.uint64(min(k + 1, 7) << BITS * KEPT)
        if rare:
            large |= (c >= 1 << BITS) | (k >= KEPT)
            hashed = (hashed ^ (c + np.uint64(k + 1))) * np.uint64(0x9E3779B97F4A7C15)
            hashed ^= hashed >> np.uint64(29)
            hashed *= np.uint64(0xBF58476D1CE4E5B9)
            hashed ^= hashed >> np.uint64(32)
            key = np.where(large, hashed | np.uint64(1 << 63), key)
        out.append(key.view(np.int64))
    return out


def _places(texts: Sequence[str], order: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """(text, i, [(key, context) for each order]): of all characters but the first of each text, a bounded number together.

    text and i: of which text it is which character. context: the key of the
    characters before it, 0 where there are none; it and key are of use where i is no less than the order.
    """
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    for lo in range(0, len(codes), CHUNK):
        first, hi = max(0, lo - order), min(lo + CHUNK, len(codes))
        keys = _keys(codes[first:hi].astype(np.uint64), order + 1)
        at = np.arange(lo, hi)
        text = np.searchsorted(ends, at, side="right")
        i = at - np.concatenate([[0], ends])[text]
        own = np.flatnonzero(i > 0)
        j = own + (lo - first)
        yield text[own], i[own], [(keys[k][j], keys[k - 1][j - 1] if k else np.zeros(len(j), np.int64)) for k in range(order + 1)]


def _added(key: np.ndarray, context: np.ndarray, fold: np.ndarray, weight: np.ndarray, times: np.ndarray) -> tuple:
    """The same, with the weights and times of equal strings in a fold added up."""
    by = np.lexsort((fold, key))
    key, context, fold = key[by], context[by], fold[by]
    new = np.ones(len(key), bool)
    new[1:] = (np.diff(key) != 0) | (np.diff(fold) != 0)
    some = np.flatnonzero(new)
    add = lambda x: np.add.reduceat(x[by], some) if len(some) else x
    return key[some], context[some], fold[some], add(weight), add(times)


def _counted(texts: Sequence[str], weights: np.ndarray, folds: np.ndarray, order: int) -> tuple:
    """(key, context, fold, weight, times) of all strings of up to order + 1 characters but those that are a text's first one."""
    found = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0), np.zeros(0, np.int64))]
    for text, i, keys in _places(texts, order):
        for k, (key, context) in enumerate(keys):
            use = i >= k
            found.append(_added(key[use], context[use], folds[text[use]], weights[text[use]], np.ones(int(use.sum()), np.int64)))
    return _added(*map(np.concatenate, zip(*found, strict=True)))


class Markov:
    """A variable-order Markov model: Witten-Bell smoothing from the longest context seen down to a uniform order.

    Texts may have weights and belong to folds, 0 to FOLDS - 1; log10() can leave a fold's texts out.
    """

    def __init__(self, order: int = ORDER, alphabet: int = 256):
        self.order, self.alphabet = order, alphabet
        self.counts(*_counted([], np.zeros(0), np.zeros(0, np.int64), order))

    def fit(self, texts, weights=None, folds=None) -> Markov:
        texts = list(texts)
        weights = np.ones(len(texts)) if weights is None else np.array(weights, float)
        return self.counts(*_counted(texts, weights, np.zeros(len(texts), np.int64) if folds is None else np.array(folds, np.int64), self.order))

    def counts(self, key: np.ndarray, context: np.ndarray, fold: np.ndarray, weight: np.ndarray, times: np.ndarray) -> Markov:
        """Fits to counts of strings, each string once for a fold."""
        self.keys, first, at = np.unique(key, return_index=True, return_inverse=True)
        own, seen = np.zeros((FOLDS, len(self.keys))), np.zeros((FOLDS, len(self.keys)), np.int64)
        own[fold, at], seen[fold, at] = weight, times
        #: Of each string its weight without each fold's texts, and, in the last row, with all.
        self.weight = np.stack([np.delete(own, f, 0).sum(axis=0) for f in range(FOLDS)] + [own.sum(axis=0)])
        seen = np.concatenate([seen.sum(axis=0) - seen, seen.sum(axis=0)[None]]) > 0
        #: Of each context the weight of what follows, and how many different characters do.
        self.contexts, at = np.unique(context[first], return_inverse=True)
        many = len(self.contexts)
        self.total = np.stack([np.bincount(at, w, many) for w in self.weight])
        self.kinds = np.stack([np.bincount(at, s, many).astype(np.int32) for s in seen])
        return self

    def log10s(self, texts: Sequence[str], without: np.ndarray) -> np.ndarray:
        """Log10 probabilities of texts, each by the model without a fold; FOLDS: with all."""
        out = np.zeros(len(texts))
        if not len(self.keys):
            return np.array([max(0, len(t) - 1) for t in texts]) * -math.log10(self.alphabet)
        for text, i, keys in _places(texts, self.order):
            fold, p, seen = without[text], np.full(len(i), 1 / self.alphabet), np.ones(len(i), bool)
            for k, (key, context) in enumerate(keys):
                c = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
                other = self.kinds[fold, c]
                seen &= (i >= k) & (self.contexts[c] == context) & (other > 0)
                g = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                w = np.where(self.keys[g] == key, self.weight[fold, g], 0)
                p = np.where(seen, (w + other * p) / np.where(seen, self.total[fold, c] + other, 1), p)
            out += np.bincount(text, np.log10(p), len(texts))
        return out

    def log10(self, t: str, without: int | None = None) -> float:
        return float(self.log10s([t], np.array([FOLDS if without is None else without]))[0])


def ratios(models: tuple[Markov, Markov], texts: Sequence[str], without: np.ndarray) -> np.ndarray:
    """Log10 likelihood under the accepted model less that under the rejected one, for each character."""
    return (models[0].log10s(texts, without) - models[1].log10s(texts, without)) / np.maximum(1, np.array([len(t) for t in texts], np.int64) - 1)


def _best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's scores in order: the first, the last, the sum of their shares; the largest sum of shares up to one of them but the last, and the cut behind it."""
    first = last = None
    total, best = 0.0, (-math.inf, -math.inf)
    for batch in batches:
        for s, share in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if last is None:
                first = s
            else:
                best = max(best, (round(total, 9), (last + s) / 2))
            last, total = s, total + share
    if last is not None:
        yield pa.RecordBatch.from_pydict({"first": [first], "last": [last], "total": [total], "gain": [best[0]], "cut": [best[1]]})


def threshold(scored: DataFrame) -> float:
    """The cut between scores (score, weight, good) that gets the largest share of both sides right, in the middle of its gap; -inf without either.

    All scores are put in order, over as many partitions as there are.
    """
    sides = {r.good: r.w for r in scored.groupBy("good").agg(F.sum("weight").alias("w")).collect()}
    if not sides.get(True) or not sides.get(False):
        return -math.inf
    share = F.when(F.col("good"), -F.col("weight") / sides[True]).otherwise(F.col("weight") / sides[False])
    shares = scored.groupBy("score").agg(F.sum(share).alias("share"))
    found = shares.repartitionByRange("score").sortWithinPartitions("score").mapInArrow(_best, "first double, last double, total double, gain double, cut double").collect()
    gain, last, best = 0.0, None, (0.0, -math.inf)
    for r in sorted(found, key=lambda r: r.first):
        if last is not None:
            best = max(best, (round(gain, 9), (last + r.first) / 2))
        best = max(best, (round(gain + r.gain, 9) if r.gain > -math.inf else r.gain, r.cut))
        gain, last = gain + r.total, r.last
    return best[1]


class Urls:
    """A table of labelled URLs (label, host, shape), each once."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def __iter__(self) -> Iterator[tuple[str, str, str]]:
        return map(tuple, self.rows.toLocalIterator())


def _dealt(hosts: DataFrame) -> DataFrame:
    """(host, fold) for rows (host, rank): hosts in the order of rank and name, dealt out in turn."""
    hosts = written(hosts.repartitionByRange("rank", "host").withColumn("part", F.spark_partition_id()))
    before, n = {}, 0
    for r in sorted(hosts.groupBy("part").count().collect()):
        before[r.part], n = n % FOLDS, n + r["count"]
    start = F.element_at(F.array(*(F.lit(before.get(i, 0)) for i in range(max(before, default=0) + 1))), F.col("part") + 1)
    number = F.row_number().over(Window.partitionBy("part").orderBy("rank", "host")) - 1
    return hosts.select("host", ((start + number) % FOLDS).cast("int").alias("fold"))


def _tally(order: int):
    """Counts of strings, of rows (shape, weight, fold)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size, names = [], 0, ["key", "context", "fold", "weight", "times"]
        for batch in batches:
            kept.append(_counted(batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(np.int64), order))
            size += len(kept[-1][0])
            if size > COUNTS:
                kept = [_added(*map(np.concatenate, zip(*kept, strict=True)))]
                size = len(kept[0][0])
                if size > COUNTS // 2:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, kept[0])), names)
                    kept, size = [], 0
        if kept:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, _added(*map(np.concatenate, zip(*kept, strict=True))))), names)

    return run


def _fitted(rows: DataFrame, order: int) -> Markov:
    """The model of all rows (shape, weight, fold). It takes memory by the number of different strings, not by rows."""
    counts = rows.select("shape", "weight", "fold").mapInArrow(_tally(order), "key long, context long, fold long, weight double, times long")
    found = counts.groupBy("key", "context", "fold").agg(F.sum("weight").alias("weight"), F.sum("times").alias("times")).toArrow()
    return Markov(order).counts(*(found.column(i).to_numpy() for i in range(5)))


def _scored(models: tuple[Markov, Markov] | None):
    """Appends to rows, which end in shape and fold (null: none), the score: 0 without models. Equal rows of a batch are scored once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.zeros(len(batch))
            if models:
                at: dict[tuple[str, int | None], int] = {}
                of = [at.setdefault(x, len(at)) for x in zip(*(batch.column(i).to_pylist() for i in (-2, -1)), strict=True)]
                scores = ratios(models, [t for t, _ in at], np.array([FOLDS if f is None else f for _, f in at], np.int64))[of]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    return run


class Judge:
    """Two models and a threshold, learned from labelled URLs."""

    def __init__(self, urls: Urls | Iterable[tuple[str, str, str]], order: int = ORDER, ruled: float = RULED, rounds: int = ROUNDS):
        """urls: distinct (label, host, shape); label: seed, block, allow or none.

        Rejected: seed and, with the weight ruled, block. Accepted: allow, and
        none as far as it doesn't look rejected. The URLs of a host weigh as
        much as one. Hosts are dealt into FOLDS, label by label, and a URL is
        scored by models without its host's fold, in calibration too: what a
        model has learned by heart tells nothing of new hosts. The threshold
        is calibrated on accepted URLs and those with a seed word, or without any
        such on those that rules block.

        Counts, scores and the order of scores are worked out by Spark's tasks
        over all URLs; the driver holds the counts of the models' strings.
        """
        if not isinstance(urls, Urls):
            urls = Urls(SparkSession.active().createDataFrame(list(urls), "label string, host string, shape string"))
        rank = F.when(F.col("label") == "seed", 0).when(F.col("label") == "block", 1).when(F.col("label") == "allow", 2).otherwise(3)
        sizes = written(urls.rows.groupBy("label", "host").agg(F.count("*").alias("n")))
        #: (host, fold)
        self.hosts = written(_dealt(sizes.groupBy("host").agg(F.min(rank).alias("rank"))))
        weight = F.when(F.col("label") == "block", F.lit(float(ruled))).otherwise(F.lit(1.0)) / F.col("n")
        each = sizes.join(self.hosts, "host").select("label", "host", weight.alias("weight"), "fold")
        rows = written(urls.rows.join(each, ["label", "host"]).select("label", "weight", "shape", "fold"))
        many = {r.label: r.n for r in sizes.groupBy("label").agg(F.sum("n").alias("n")).collect()}
        self.threshold, self.models = -math.inf, None
        rejected = F.col("label").isin("seed", "block")
        bad = F.col("label") == "seed" if many.get("seed") else rejected
        if not many.get("seed") and not many.get("block"):
            return
        other, left, accepted, scored = _fitted(rows.where(rejected), order), many.get("none", 0), ~rejected, rows
        for _ in range(rounds):
            self.models = (_fitted(scored.where(accepted), order), other)
            # what was accepted in this round is kept beside the new scores
            mapped = scored.select("label", "weight", accepted.alias("good"), "shape", "fold").mapInArrow(_scored(self.models), "label string, weight double, good boolean, shape string, fold int, score double")
            scored = written(mapped)
            self.threshold = threshold(scored.where(F.col("good") | bad))
            accepted = (F.col("label") == "allow") | ((F.col("label") == "none") & (F.col("score") >= self.threshold))
            if (again := scored.where((F.col("label") == "none") & accepted).count()) == left:
                break
            left = again

    @cached_property
    def folds(self) -> dict[str, int]:
        """Of each host its fold, for looking at small tables."""
        return {r.host: r.fold for r in self.hosts.collect()}


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, seeds=SEEDS, order: int = ORDER) -> DataFrame:
    """(id, host, path, rule, verdict, score) for each row.

    A URL that a rule fits has the rule's verdict. The others are judged by
    the models of Judge, which read whole URLs: rejected are those with a word
    of seeds in the host and those that rules block, accepted those that rules
    allow and, where they don't look rejected, those that no rule fits. The
    models and the threshold are learned from all different URLs that have a
    host, of any number and length. The models hold the counts of all different
    strings of up to order + 1 characters, here and in each task. score: the
    log10 likelihood ratio for each character.

    A null URL, or one without ://, has an empty host and path and no rule;
    it is judged like any other. Without rejected URLs all are allowed. Repeated
    rows and null ids stay; other columns are ignored.
    """
    spark = pages.sparkSession
    arrow_limits(spark)
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).mapInArrow(_split, f"id {kind}, host string, path string, shape string")
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("verdict"))
    bad = F.col("host").rlike("|".join(map(re.escape, seeds))) if seeds else F.lit(False)
    label = F.when(bad, "seed").otherwise(F.coalesce("verdict", F.lit("none")))
    judge = Judge(Urls(written(rows.where(F.col("host") != "").select(label.alias("label"), "host", "shape").distinct())), order)
    rows = rows.join(judge.hosts, "host", "left").select("id", "host", "path", "rule", "verdict", "shape", "fold")
    out = rows.mapInArrow(_scored(judge.models), f"id {kind}, host string, path string, rule string, verdict string, shape string, fold int, score double")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.when(F.col("score") >= judge.threshold, "allow").otherwise("block")).alias("verdict"), "score")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return url_filter(table(spark, sf_dir, "pages"))
