"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableward.session import cut_lineage

__all__ = ["components", "cut_lineage", "is_held_out", "map_texts", "text_bytes"]


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without building Python strings."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def map_texts(df: DataFrame, text: str, keep: list[str], work: Callable[[list[bytes | None]], list[pa.Array]],
              added: str, setup: Callable[[], object] | None = None, block_bytes: int = 4 << 20) -> DataFrame:
    """``keep`` columns plus what ``work`` makes of the texts, in blocks of about ``block_bytes``.

    A block holds whole texts, at least one.  ``setup`` runs once per task and its value is passed
    to ``work`` as a second argument.
    """
    fields, names = arrow_fields(df, keep, added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extra = () if setup is None else (setup(),)
        for batch in batches:
            for part in blocks(batch, block_bytes):
                made = work(text_bytes(part.column(0)), *extra)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *made], names=fields.names)

    return df.select(F.col(text).cast("string").alias("_text_in"), *keep).mapInArrow(run, fields).toDF(*names)


def arrow_fields(df: DataFrame, keep: list[str], added: str) -> tuple[T.StructType, list[str]]:
    """A schema of ``keep`` and ``added`` with names of its own, as batches are matched by name, and
    the names to give afterwards, which may clash."""
    fields = [*df.select(*keep).schema.fields, *T.StructType.fromDDL(added).fields]
    return T.StructType([T.StructField(f"_{n}", f.dataType) for n, f in enumerate(fields)]), [f.name for f in fields]


def blocks(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose first column has about ``size`` bytes each."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    block = (np.cumsum(lengths) - lengths) // size
    edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(edges, edges[1:], strict=False):
        yield batch.slice(lo, hi - lo)


def is_held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(True))


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """Connected components of an undirected graph: (node, component), component the least node.

    ``edges`` has columns ``a`` and ``b``.  Each round hangs every larger neighbour of a node onto
    its least neighbour, and then every node with its smaller neighbours onto the least of them.
    Both steps are a minimum per node (summed map-side) and a join back, so a hub's neighbours are
    never gathered.  Nodes without an edge do not appear.
    """
    def least(links: DataFrame, of: str, value: str) -> DataFrame:
        return links.groupBy(F.col(of).alias("_n")).agg(F.min(value).alias("_m"))

    current = cut_lineage(edges.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(rounds):
        both = current.select("a", "b").union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = least(both, "a", "b").select("_n", F.least("_n", "_m").alias("_m"))
        large = (both.filter("b > a").join(low, F.col("a") == F.col("_n"))
                 .select(F.col("b").alias("a"), F.col("_m").alias("b"))
                 .union(low.filter("_n <> _m").select(F.col("_n").alias("a"), F.col("_m").alias("b")))
                 .filter("a > b").distinct())
        low = least(large, "a", "b")
        small = (large.join(low, F.col("a") == F.col("_n")).filter("b <> _m")
                 .select(F.col("b").alias("a"), F.col("_m").alias("b"))
                 .union(low.select(F.col("_n").alias("a"), F.col("_m").alias("b"))).distinct())
        current = cut_lineage(small)
        now = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return current.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
