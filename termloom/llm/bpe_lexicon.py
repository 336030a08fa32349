"""BPE encoding and decoding through a minimal acyclic transducer of frequent words, with exact merges for the rest."""

from __future__ import annotations

import gc
import hashlib
import json
import os
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_limits, written

#: Fixed value: what byte-level BPE splits a text by before it merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Most words in the lexicon, and bytes of the longest.
LEXICON_WORDS, LEXICON_BYTES = 100_000, 48
#: Distinct words that a task keeps before it starts anew.
CACHE = 400_000
#: Code points that a task handles together.
BATCH = 1 << 20


class Merges:
    """The merges of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # bytes are written as printable characters: themselves where printable, else from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        sign = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        vocab, self.normalizer, self.split_by = spec["model"]["vocab"], spec["normalizer"], spec["pre_tokenizer"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of = {i: bytes(sign[c] for c in s) for s, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.byte_id = [0] * 256
        for i, b in self.bytes_of.items():
            if len(b) == 1:
                self.byte_id[b[0]] = i
        self.rank = {}
        for n, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a], vocab[b]] = (n, vocab[a + b])
        self.find = regex.compile(PATTERN).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None

    def words(self, text: str) -> list[str]:
        """The pieces that are merged one by one, and special strings as they are."""
        if self.split is None or not any(s in text for s in self.special):
            return self.find(text)
        return [w for i, part in enumerate(self.split(text)) for w in ([part] if i % 2 else self.find(part))]

    def merge(self, word: bytes) -> list[int]:
        """The ids of a word: the pair of the lowest rank is merged, everywhere, until none has a rank."""
        ids, rank = [self.byte_id[b] for b in word], self.rank
        none = (1 << 30, 0)
        while len(ids) > 1:
            n, new = min(rank.get(p, none) for p in zip(ids, ids[1:]))
            if n == none[0]:
                break
            out, i, last = [], 0, len(ids) - 1
            while i <= last:
                if i < last and rank.get((ids[i], ids[i + 1]), none)[0] == n:
                    out.append(new)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids


def by_ranks(path: str, merges: Merges | None = None):
    """A faster encoder of the same file, for whole texts without offsets; None where it isn't certain to agree.

    It merges the pair that makes the piece of the smallest id, so the ids must
    follow the order of the merges.
    """
    import tiktoken

    m = merges or Merges(path)
    if m.normalizer or m.split_by != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
        return None
    made = [new for _, new in m.rank.values()]
    if made != list(range(256, 256 + len(made))) or sorted(m.byte_id) != list(range(256)):
        return None
    ranks = {b: i for i, b in m.bytes_of.items() if i not in m.special.values()}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=m.special)


def compile_lexicon(words: list[bytes], ids: list[list[int]]) -> np.ndarray:
    """The words, distinct and in order of bytes, as one array of int32 that can be memory-mapped.

    States with the same continuations are one state. Every arc adds a
    number; the sum along a word is its place among the words, where its ids
    are found.
    """
    register: dict[tuple, int] = {}
    finals: list[bool] = []
    arcs: list[tuple] = []

    def state(node: list) -> int:
        key = (node[0], *node[1])
        if (known := register.get(key)) is None:
            known = register[key] = len(finals)
            finals.append(node[0])
            arcs.append(tuple(node[1]))
        return known

    # path[k]: the open node after k bytes of the last word: final or not, and its closed arcs
    path: list[list] = [[False, []]]
    previous = b""
    for word in [*words, None]:
        same = 0 if word is None else len(os.path.commonprefix([previous, word]))
        while len(path) > same + 1:
            node = path.pop()
            path[-1][1].append((previous[len(path) - 1], state(node)))
        if word is not None:
            path += [[False, []] for _ in range(len(word) - same)]
            path[-1][0] = True
            previous = word
    root = state(path[0])
    below = np.zeros(len(finals), np.int64)  # a state comes after those it leads to
    keys, targets, outs = [], [], []
    for s, (final, own) in enumerate(zip(finals, arcs, strict=True)):
        n = int(final)
        for byte, to in own:
            keys.append(s * 256 + byte)
            targets.append(to)
            outs.append(n)
            n += below[to]
        below[s] = n
    ends = np.cumsum([0, *map(len, ids)])
    flat = [i for x in ids for i in x]
    parts = [keys, targets, outs, finals, ends, flat]
    return np.concatenate([np.array([root, *map(len, parts)], np.int32), *(np.asarray(p, np.int32) for p in parts)])


class Lexicon:
    """A compiled lexicon: looks many words up at once."""

    def __init__(self, packed: np.ndarray):
        self.root = int(packed[0])
        at, parts = 7, []
        for n in packed[1:7]:
            parts.append(packed[at : at + n])
            at += n
        self.keys, self.targets, self.outs, self.finals, self.ends, self.ids = map(np.asarray, parts)

    def find(self, words: list[bytes]) -> np.ndarray:
        """The place of each word, -1 for one that is not in the lexicon."""
        place = np.full(len(words), -1, np.int64)
        if not len(self.keys) or not words:
            return place
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(lengths) - lengths
        text = np.frombuffer(b"".join(words), np.uint8)
        at, state, total, step = np.arange(len(words)), np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64), 0
        while len(at):
            done = lengths[at] == step
            end = at[done]
            place[end] = np.where(self.finals[state[done]] > 0, total[done], -1)
            at, state, total = at[~done], state[~done], total[~done]
            if not len(at):
                break
            key = state * 256 + text[starts[at] + step]
            arc = np.minimum(np.searchsorted(self.keys, key.astype(np.int32)), len(self.keys) - 1)
            ok = self.keys[arc] == key
            at, state, total = at[ok], self.targets[arc[ok]].astype(np.int64), total[ok] + self.outs[arc[ok]]
            step += 1
        return place

    def encoded(self, place: int) -> list[int]:
        return self.ids[self.ends[place] : self.ends[place + 1]].tolist()


#: Makes ASCII signs spaces; what is left between them is words.
_SIGNS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def _counts(flush: int = CACHE):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], ["word", "n"])
            found.clear()
            return batch

        for batch in batches:
            for text in batch.column(0):
                found.update((text.as_py() or b"").translate(_SIGNS).split())
                if len(found) > flush:
                    yield out()
        yield out()

    return run


def frequent_words(docs: DataFrame, text_col: str = "text", most: int = LEXICON_WORDS, longest: int = LEXICON_BYTES) -> list[str]:
    """The words of all texts that occur most often, behind a space: as many whole classes of frequency as hold at most `most` words."""
    arrow_limits(docs.sparkSession)
    counts = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(_counts(), "word binary, n long")
    counts = written(counts.groupBy("word").agg(F.sum("n").alias("n")).where((F.octet_length("word") < longest) & (F.col("n") > 1)))
    band = F.floor(F.log2("n") * 16)
    room, least = most, None
    for x in sorted(counts.groupBy(band.alias("band")).count().collect(), reverse=True):
        if x["count"] > room:
            break
        room, least = room - x["count"], x.band
    return [] if least is None else [f" {bytes(r.word).decode('utf-8', 'replace')}" for r in counts.where(band >= least).select("word").collect()]


def shipped(spark: SparkSession, words: list[str], tokenizer: str) -> str:
    """Compiles the words and gives the file to all executors; returns its name there."""
    merges = Merges(tokenizer)
    coded = sorted({w.encode() for w in words if w and w not in merges.special})
    packed = compile_lexicon(coded, [merges.merge(w) for w in coded])
    name = f"lexicon-{uuid.uuid4().hex}.npy"
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="termloom-")), name)
    np.save(path, packed)
    spark.sparkContext.addFile(path)
    return name


class Codec:
    """Encodes words by a lexicon, or by merging; keeps the words seen, up to a bound.

    Of the lexicon, which all workers of a machine map, only words that are
    seen become objects of a worker's own.
    """

    def __init__(self, path: str, lexicon: str, keep_ids: bool = True):
        self.merges, self.keep_ids = Merges(path), keep_ids
        ranks = by_ranks(path, self.merges)
        self.merge = ranks.encode_ordinary if ranks else lambda word: self.merges.merge(word.encode())
        self.lexicon = Lexicon(np.load(SparkFiles.get(lexicon), mmap_mode="r"))
        size = max(self.merges.bytes_of) + 1
        self.digits, self.bytes = list(map(str, range(size))), [self.merges.bytes_of.get(i, b"") for i in range(size)]
        self._new()

    def _entries(self, ids: list[list[int]]) -> tuple[list[str], list[int], list[bytes], list]:
        """Of each word's ids: as text, their number, the bytes they stand for, and themselves if they are kept."""
        digits, plain = self.digits, self.bytes
        return [",".join([digits[i] for i in x]) for x in ids], list(map(len, ids)), [b"".join([plain[i] for i in x]) for x in ids], ids if self.keep_ids else []

    def _new(self) -> None:
        self.at: dict[str, int] = {}
        self.columns: tuple[list, ...] = ([], [], [], [])
        self._put(list(self.merges.special), self._entries([[i] for i in self.merges.special.values()]))

    def _put(self, words: list[str], entries: tuple[list, ...]) -> None:
        self.at.update(zip(words, range(len(self.at), len(self.at) + len(words)), strict=True))
        for own, new in zip(self.columns, entries, strict=True):
            own += new

    def places(self, texts: list[str]) -> list[list[int]]:
        """The places of each text's words in columns, in order."""
        split = list(map(self.merges.words, texts))
        if len(self.at) > CACHE:
            self._new()
        new = list(set(chain.from_iterable(split)).difference(self.at))
        places = self.lexicon.find([w.encode() for w in new]).tolist()
        self._put(new, self._entries([self.lexicon.encoded(i) if i >= 0 else self.merge(w) for w, i in zip(new, places, strict=True)]))
        return [list(map(self.at.__getitem__, x)) for x in split]


def _batches(batch: pa.RecordBatch, column: int, most: int = BATCH) -> Iterator[tuple[int, list[str]]]:
    """The texts of a column, a bounded number of code points together; null is empty."""
    first, texts, size = 0, [], 0
    for i, x in enumerate(batch.column(column)):
        texts.append(x.as_py() or "")
        size += len(texts[-1])
        if size > most:
            yield first, texts
            first, texts, size = i + 1, [], 0
    if texts:
        yield first, texts


def _encode(path: str, lexicon: str, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, sha = Codec(path, lexicon, not digests), lambda b: hashlib.sha256(b).hexdigest()
        gc.disable()  # lists of ids make no cycles, but would be looked through for some
        try:
            for batch in batches:
                for first, texts in _batches(batch, 1):
                    at = codec.places(texts)
                    text, size, plain, kept = codec.columns
                    ids = batch.column(0).slice(first, len(texts))
                    if digests:
                        n = [sum(map(size.__getitem__, x)) for x in at]
                        said = [sha(",".join(map(text.__getitem__, x)).encode()) for x in at]
                        back = [sha(b"".join(map(plain.__getitem__, x))) for x in at]
                        yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(said), pa.array(back)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])
                    else:
                        yield pa.RecordBatch.from_arrays([ids, pa.array([list(chain.from_iterable(map(kept.__getitem__, x))) for x in at], pa.list_(pa.int32()))], ["id", "ids"])
        finally:
            gc.enable()

    return run


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, words: int = LEXICON_WORDS) -> DataFrame:
    """(id, ids) for each row: the token ids of the whole text, without begin, end or other added tokens.

    tokenizer: a byte-level BPE .json of the tokenizers library, at the same
    path on all machines. Strings of its special tokens in a text become those
    tokens, as that library does by default. The `words` most frequent words
    of all texts are compiled into a lexicon, of bounded size, that executors
    get as a file and map into memory; all other words are merged.
    digests: (id, n_tokens, ids_sha256, decoded_sha256) instead, hex digests of
    the ids joined by commas and of the text decoded from them.
    A null text is empty. Rows stay as they are, repeated and null ids too;
    other columns are ignored.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    lexicon = shipped(spark, frequent_words(docs, text_col, words), tokenizer)
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_encode(tokenizer, lexicon, digests), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else f"id {kind}, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Merges(path).bytes_of
        for batch in batches:
            texts = [None if not x.is_valid else b"".join(map(known.__getitem__, x.as_py())).decode("utf-8", "replace") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return run


def decode(rows: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) for each row: the text of the ids, null for null; bytes that are no UTF-8 are replaced."""
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(_decode(tokenizer), f"id {kind}, text string").withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), digests=True)
