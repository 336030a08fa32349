"""Token counts with overlap resynchronisation for huge documents."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_lexicon import by_ranks
from .common import arrow_limits

#: Code points of a chunk, and of the first overlap tried between two chunks.
CHUNK, OVERLAP = 16_384, 256
LIMIT = 512


def load(path: str):
    """The library's encoder, without threads of its own, truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _kind(c: str) -> str:
    import unicodedata

    if c.isspace():
        return "s"
    return k if (k := unicodedata.category(c)[0]) in "LN" else "o"


def stable(text: str, p: int) -> bool:
    """Whether the pattern that precedes the merges always ends a piece at p, whatever stands further left.

    A run of letters, or of digits, ends where another class begins, and so
    does a run of other signs before white space or a digit; a sign and the
    letters after it may be one piece ('s).
    """
    a, b = _kind(text[p - 1]), _kind(text[p])
    return a != b and a != "s" and (a, b) != ("o", "L")


def _edges(offsets: list[tuple[int, int]], start: int) -> dict[int, int]:
    """Position in the text of each token's beginning, where the token before it ends too -> number of tokens before it."""
    return {start + b: i for i, (b, _) in enumerate(offsets) if i and offsets[i - 1][1] == b}


def splice(text: str, encode, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Number of tokens of a long text, from overlapping chunks.

    Two neighbours are joined at the last position in their overlap at which
    both have a token's edge and that is stable(): left of it the first chunk
    has the tokens of the whole text, right of it the second. Where there is
    none, the overlap doubles, at last back to the joint before, which makes
    the second chunk begin at a known edge. An overlap without a stable
    position is widened without being encoded; where there is none back to
    the joint, the text since it is one run, and the chunk grows as long
    again: so an unbroken run is encoded at most about three times over, and
    a worker then holds the run, as the library itself does.
    """
    begin, end = 0, min(chunk, len(text))
    left = encode(text[begin:end]).offsets
    total = joint = first = 0  # first: tokens of left before the joint
    while end < len(text):
        last = next((p for p in range(end - 1, joint, -1) if stable(text, p)), None)
        far, width = min(end + chunk, len(text)), overlap
        while last is not None and end - width >= last:
            width *= 2
        while last is not None and (start := max(joint, end - width)) > joint:
            right = encode(text[start:far]).offsets
            a, b = _edges(left, begin), _edges(right, start)
            if p := max((p for p in a.keys() & b.keys() if p < end and stable(text, p)), default=0):
                total += a[p] - first
                joint, first = p, b[p]
                break
            width *= 2
        else:
            start, far = joint, min(end + max(chunk, end - joint), len(text))
            right, first = encode(text[start:far]).offsets, 0
        left, begin, end = right, start, far
    return total + len(left) - first


def _count(path: str, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact, fast = load(path), by_ranks(path)
        encode = lambda s: exact.encode(s, add_special_tokens=False)
        whole = (lambda s: len(fast.encode(s, allowed_special="all"))) if fast else lambda s: len(encode(s))
        for batch in batches:
            n = [splice(x, encode, chunk, overlap) if len(x) > chunk else whole(x) for x in (x.as_py() or "" for x in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row, as the tokenizers library counts the whole text.

    tokenizer: a .json file of that library, at the same path on all machines.
    Texts above chunk code points are encoded in overlapping pieces, so that a
    worker's memory holds the tokens of one piece only, or of one unbroken run.
    Shorter ones are counted by the same merges as ranks, where the file
    allows that (by_ranks()): the counts agree, at a quarter of the time.
    A null text is empty. Rows stay as they are, repeated and null ids too;
    other columns are ignored.
    """
    arrow_limits(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes")).mapInArrow(_count(tokenizer, chunk, overlap), f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
