"""Helpers shared by the corpus operators: folds, byte texts, bounded chunks, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.session import cut_lineage

#: Bytes of text that a Python step handles at once.
CHUNK_BYTES = 1 << 20


def fold(column: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n. A null id counts as the empty text."""
    column = F.col(column) if isinstance(column, str) else column
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def ascii_lower(column: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def byte_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of every row; null counts as empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def chunks(batches: Iterator[pa.RecordBatch], text: int = -1, size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about ``size`` bytes of text, one row at least, and the texts of each."""
    for batch in batches:
        texts = byte_texts(batch.column(text))
        start = total = 0
        for i, data in enumerate(texts):
            total += len(data)
            if total >= size:
                yield batch.slice(start, i + 1 - start), texts[start : i + 1]
                start, total = i + 1, 0
        if start < len(texts):
            yield batch.slice(start), texts[start:]


def columns(df: DataFrame, **named: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so that no other column can clash."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in named.items()])


def connected_components(edges: DataFrame) -> DataFrame:
    """Alternating star contraction of edges (a, b): a row (node, root) for every node that has an edge.

    The root is the smallest node of the component. Every round is two aggregates
    and joins on the node; a node's neighbours are never gathered. The number of
    rounds grows with the logarithm of the longest path.
    """
    links = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    state = None
    while True:
        both = pairs(links, ("u", "v"), ("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = pairs(large.join(least, "u"), ("v", "m"), ("u", "m"))
        links = cut_lineage(small.filter("u > v").distinct())
        now = links.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first()
        if now == state:
            break
        state = now
    return pairs(links, ("u", "v"), ("v", "v")).distinct().select(F.col("u").alias("node"), F.col("v").alias("root"))


def pairs(df: DataFrame, *of: tuple[str, str]) -> DataFrame:
    """Rows (u, v): one for each named pair of columns. An explode, as a union reads its input twice."""
    return df.select(F.explode(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in of])).alias("_p")).select("_p.u", "_p.v")
