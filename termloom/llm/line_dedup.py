"""Line deduplication: explode normalised lines, hash, count documents per hash, drop, reassemble by position."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NO_ID, arrow_limits

MIN_CHARS = 10
MAX_DOCS = 1


def _line_hashes(lines: list[bytes], min_chars: int) -> Iterator[int]:
    """The 128-bit hash of each line's key, in order; 0 for a key that is too short."""
    from xxhash import xxh3_128_intdigest

    for line in lines:
        key = line.strip().lower()  # of bytes: only ASCII white space, only A-Z
        if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
            yield 0
        else:
            yield xxh3_128_intdigest(key)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _explode(min_chars: int):
    low = (1 << 64) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, a, b = [], [], []
            for i, text in enumerate(batch.column(1)):
                found = set(_line_hashes((text.as_py() or b"").split(b"\n"), min_chars))
                found.discard(0)
                d += [i] * len(found)
                a += [_signed(x >> 64) for x in found]
                b += [_signed(x & low) for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(d, pa.int64())), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["__d", "__a", "__b"])

    return run


def _reassemble(min_chars: int):
    low = (1 << 64) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n, gone = [], [], []
            for text, a, b in zip(batch.column(2), batch.column(3), batch.column(4), strict=True):
                lines = (text.as_py() or b"").split(b"\n")
                n.append(len(lines))
                drop = set(zip(a.as_py(), b.as_py(), strict=True)) if a.is_valid else ()
                if drop:
                    lines = [x for x, h in zip(lines, _line_hashes(lines, min_chars), strict=True) if (_signed(h >> 64), _signed(h & low)) not in drop]
                gone.append(n[-1] - len(lines))
                kept.append(b"\n".join(lines))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, pa.binary()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], ["id", "row", "text", "n_lines", "n_dropped"])

    return run


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, max_docs: int = MAX_DOCS, keep: Sequence[str] = ()) -> DataFrame:
    """(id, text, n_lines, n_dropped) for each row; text without the lines that repeat across documents.

    With keep: (row, text, n_lines, n_dropped), where row is a struct of these columns.

    A line's key is the line without ASCII white space at its ends, with A-Z
    lower-cased. A key of at least min_chars code points that more than
    max_docs documents hold loses its lines everywhere but in the document of
    the smallest id.

    Ids may be of any type that has an order. Only hashes travel to be counted, summed before the shuffle, so a line
    that every document holds is a few rows. A null or empty text is one empty
    line. Rows of one id are one document: they never make each other's lines
    repeat. Rows with a null id count as one document that comes after all
    others. Other columns are ignored.
    """
    arrow_limits(docs.sparkSession)
    kept = F.struct(*(F.col(f"`{c}`") for c in keep or [id_col])).alias("__row")
    own = F.col(f"`{id_col}`")
    whole = isinstance(docs.schema[id_col].dataType, T.IntegralType)
    doc = F.coalesce(own.cast("long"), F.lit(NO_ID)) if whole else F.struct(own.isNull().alias("none"), own.alias("id"))
    rows = docs.select(doc.alias("__d"), F.col(f"`{text_col}`").cast("binary").alias("__t"), kept)
    lines = rows.select("__d", "__t").mapInArrow(_explode(min_chars), T.StructType([rows.schema["__d"], T.StructField("__a", T.LongType()), T.StructField("__b", T.LongType())]))
    if max_docs == 1:
        held = lines.groupBy("__a", "__b").agg(F.min("__d").alias("__first"), F.max("__d").alias("__last")).where("__first <> __last").drop("__last")
    else:
        held = lines.distinct().groupBy("__a", "__b").agg(F.min("__d").alias("__first"), F.count("*").alias("__n")).where(F.col("__n") > max_docs).drop("__n")
    drops = (
        lines.join(held, ["__a", "__b"])
        .where("__d <> __first")
        .groupBy("__d")
        .agg(F.collect_set(F.struct("__a", "__b")).alias("__x"))
        .select("__d", F.col("__x.__a").alias("__a"), F.col("__x.__b").alias("__b"))
    )
    schema = T.StructType([T.StructField("id", rows.schema["__d"].dataType), T.StructField("row", rows.schema["__row"].dataType), T.StructField("text", T.BinaryType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    out = rows.join(drops, "__d", "left").select("__d", "__row", "__t", "__a", "__b").mapInArrow(_reassemble(min_chars), schema)
    first = F.col("row") if keep else F.col(f"row.`{id_col}`").alias(id_col)
    return out.select(first, F.col("text").cast("string").alias("text"), "n_lines", "n_dropped")


SQL = r"""
WITH ws AS (SELECT ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) AS s),
d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, len(ls) AS n, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT doc_id, n, pos, line, translate(trim(line, s), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l, ws),
r AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2)
SELECT k.doc_id, any_value(n)::BIGINT AS n_lines, count(*) FILTER (r.key IS NOT NULL AND k.doc_id <> r.first)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (r.key IS NULL OR k.doc_id = r.first), '')) AS kept_sha256
FROM k LEFT JOIN r ON k.key = r.key
GROUP BY k.doc_id
"""


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
