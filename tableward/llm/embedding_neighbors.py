"""Embedding near-duplicates by a forest of random-projection trees with spill.

A tree splits vectors again and again along random directions at the median of a bounded sample.
Vectors close to a split go to both sides, at least those within about the threshold's distance; a
node so dense that this leaves it nearly whole is not split.  Vectors of one label (and length) that share a leaf of
any tree are compared by cosine in double precision; pairs at or above the threshold are linked
and united.  A pair that meets in several leaves counts in the first: every vector carries its
leaves, so no pair is shuffled.

Equal vectors of a label are one class, compared once.  A leaf with more than ``BLOCK_ROWS``
classes is dealt into blocks, and each pair of blocks is a task of its own, so a leaf of any size
is compared whole and in bounded memory.

Contract: vectors that are null, empty, zero, or hold null or non-finite components, and rows with
a null label or key, link with nothing; they are their own component and kept.  Vectors of different lengths
never link.  Repeated rows are vectors of their own; rows that share a key but not a vector are one
node, whose links are added up.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableward.llm.common import components, cut_lineage
from tableward.llm.simhash import Forest

TREES = 8
#: Vectors that fit the splits of the trees; every vector is indexed.
SAMPLE_ROWS = 20_000
#: Vectors of the largest label that a leaf should hold, and classes of a block.
LEAF_ROWS, BLOCK_ROWS = 400, 1000
#: Sampled vectors that a leaf should hold at least.
LEAF_SAMPLE = 16
#: Part of a node's sample on either side of the median that goes to both children.
SPILL = 0.05
#: Least width of what goes to both children, in standard deviations of the difference of two
#: vectors at the threshold, and the largest part of a node that a child may have.
MARGIN, CHILD_PART = 2.0, 0.75
SEED = 29


class Tree:
    """Splits of one tree, by level: directions and intervals of node projections.

    A node that no such split makes smaller is about as dense as the threshold; it goes to its left
    child whole.
    """

    def __init__(self, sample: np.ndarray, depth: int, seed: int, threshold: float):
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        self.levels = []
        members = [np.arange(len(sample))]
        for _ in range(depth):
            directions = rng.normal(size=(len(members), dim))
            margins = MARGIN * np.sqrt(max(0.0, 2 - 2 * threshold) / dim) * np.linalg.norm(directions, axis=1)
            bounds, below = np.zeros((len(members), 2)), []
            for n, rows in enumerate(members):
                at = sample[rows] @ directions[n]
                if len(at):
                    low, mid, high = np.quantile(at, [0.5 - SPILL, 0.5, 0.5 + SPILL])
                    low, high = min(low, mid - margins[n] / 2), max(high, mid + margins[n] / 2)
                    dense = max((at <= high).mean(), (at >= low).mean()) > CHILD_PART
                    bounds[n] = np.inf if dense else (low, high)
                below += [rows[at <= bounds[n, 1]], rows[at >= bounds[n, 0]]]
            self.levels.append((directions, bounds))
            members = below

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that a row falls into."""
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        for directions, bounds in self.levels:
            at = np.einsum("ij,ij->i", x[row], directions[node])
            left, right = at <= bounds[node, 1], at >= bounds[node, 0]
            row, node = np.r_[row[left], row[right]], np.r_[2 * node[left], 2 * node[right] + 1]
        return row, node


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _first_shared(leaves: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least leaf that rows i and j share; ``leaves`` is sorted per row and padded with -1."""
    least = np.full(len(i), 1 << 62)
    for k in range(leaves.shape[1]):
        mine = leaves[i, k]
        shared = (leaves[j] == mine[:, None]).any(axis=1) & (mine >= 0)
        least = np.where(shared & (mine < least), mine, least)
    return least


def _compare(rows: list[dict], left: np.ndarray, right: np.ndarray, threshold: float, leaf: int, forest: Forest, counts):
    """Unite and count the pairs of places (left x right) that link and meet in ``leaf`` first."""
    vectors, leaves, weights = rows
    for at in range(0, len(left), 256):
        a = left[at:at + 256]
        i, j = np.nonzero(vectors[a] @ vectors[right].T >= threshold - 1e-9)
        i, j = a[i], right[j]
        ordered = i < j if left is right else i != j
        i, j = i[ordered], j[ordered]
        for cut in range(0, len(i), 1 << 16):
            p, q = i[cut:cut + (1 << 16)], j[cut:cut + (1 << 16)]
            # The sum in one order for every pair, whatever the block it is met in.
            exact = np.einsum("ij,ij->i", vectors[p], vectors[q]) >= threshold
            p, q = p[exact], q[exact]
            forest.union(p, q)
            mine = _first_shared(leaves, p, q) == leaf
            np.add.at(counts, p[mine], weights[q[mine]])
            np.add.at(counts, q[mine], weights[p[mine]])


def join_leaves(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Links per class and edges from a sorted stream of
    (label, dim, leaf, left, right, side, class, copies, vector, leaves)."""
    held, names = None, ["node", "other", "links"]

    def unit(part: pa.Table) -> pa.RecordBatch:
        dim, leaf = part.column("dim")[0].as_py(), part.column("leaf")[0].as_py()
        vectors = _unit(_matrix(part.column("vector").combine_chunks(), dim))
        lists = part.column("leaves").to_pylist()
        width = max(map(len, lists))
        leaves = np.array([x + [-1] * (width - len(x)) for x in lists], np.int64)
        weights = part.column("copies").to_numpy()
        cls, side = part.column("class").to_numpy(), part.column("side").to_numpy()
        forest, counts = Forest(len(cls)), np.zeros(len(cls), np.int64)
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if part.column("left")[0] == part.column("right")[0]:
            two = one
        _compare((vectors, leaves, weights), one, two, threshold, leaf, forest, counts)
        root = cls[forest.roots()]
        told = np.flatnonzero((counts > 0) | (root != cls))
        return pa.RecordBatch.from_arrays([pa.array(cls[told]), pa.array(root[told]), pa.array(counts[told])], names=names)

    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        keys = np.stack([held.column(c).to_numpy() for c in ("label", "dim", "leaf", "left", "right")], axis=1)
        edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()]
        for lo, hi in zip(edges, edges[1:], strict=False):
            if hi - lo > 1:
                yield unit(held.slice(lo, hi - lo))
        held = held.slice(edges[-1])
    if held is not None and held.num_rows > 1:
        yield unit(held)


def neighbors(df: DataFrame, key: str, vector: str, label: str, threshold: float = 0.98, trees: int = TREES) -> DataFrame:
    """``key``, ``n_links``, ``component_id`` and ``kept`` per row, and ``class_id``, the least key of its equals."""
    spark = df.sparkSession
    x = F.col("vector")
    # Single-precision vectors travel as they are and are widened where they are compared.
    number = "float" if df.select(vector).dtypes[0][1] == "array<float>" else "double"
    sound = (F.col("key").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & (F.size(x) > 0)
             & F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
             & F.coalesce(F.exists(x, lambda v: v != 0), F.lit(False)))
    # Minus zero is zero: equal vectors must be equal arrays.
    rows = cut_lineage(df.select(F.col(key).alias("key"), F.col(label).cast("long").alias("label"),
                                 F.transform(F.col(vector), lambda v: v.cast(number) + F.lit(0.0).cast(number)).alias("vector"))
                       .withColumn("sound", sound))
    good = rows.filter("sound")
    classes = cut_lineage(good.groupBy("label", "vector").agg(F.min("key").alias("class"), F.count(F.lit(1)).alias("copies"))
                          .withColumn("dim", F.size("vector")))
    most = classes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    sample = classes.orderBy(F.xxhash64("class", F.lit(SEED)), "class").limit(SAMPLE_ROWS).select("vector").toArrow()
    lengths = pc.list_value_length(sample.column("vector")).to_numpy()
    # No deeper than the sample can fit, which bounds what is broadcast; leaves that stay large are
    # compared in pairs of blocks.
    depth = max(0, min(math.ceil(math.log2(max(1, most) / LEAF_ROWS)), int(math.log2(max(1, len(lengths)) / LEAF_SAMPLE + 1e-9))
                       if len(lengths) else 0))
    trees_of = {}
    for dim in np.unique(lengths).tolist():
        vectors = _unit(_matrix(sample.column("vector").filter(pa.array(lengths == dim)).combine_chunks(), dim))
        trees_of[dim] = [Tree(vectors, depth, SEED + t, threshold) for t in range(trees)]
    forest = spark.sparkContext.broadcast(trees_of)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[int]] = [[] for _ in range(batch.num_rows)]
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                vectors = _unit(_matrix(batch.column("vector").take(pa.array(at)), int(dim)))
                # A length that no sampled vector has is one leaf.
                for t, tree in enumerate(forest.value.get(int(dim), [None])):
                    row, leaf = (np.arange(len(at)), np.zeros(len(at), np.int64)) if tree is None else tree.leaves(vectors)
                    for r, n in zip(at[row].tolist(), leaf.tolist(), strict=True):
                        found[r].append(t << 32 | n)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([sorted(f) for f in found], pa.list_(pa.int64()))],
                names=[*batch.schema.names, "leaves"])

    indexed = cut_lineage(classes.mapInArrow(
        index, f"label long, vector array<{number}>, class long, copies long, dim int, leaves array<long>"))
    placed = indexed.select("label", "dim", F.explode("leaves").alias("leaf"), "class", "copies", "vector", "leaves")
    sizes = placed.groupBy("label", "dim", "leaf").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.filter(F.col("n") > BLOCK_ROWS).select(
        "label", "dim", "leaf", F.ceil(F.col("n") / F.lit(BLOCK_ROWS)).cast("long").alias("parts"))
    # Every block meets every block of its leaf, itself included, as unit (left <= right).
    dealt = (placed.join(large, ["label", "dim", "leaf"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
             .withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
             .withColumn("left", F.least("part", "other")).withColumn("right", F.greatest("part", "other"))
             .withColumn("side", (F.col("part") == F.col("right")).cast("long")
                         * (F.col("left") != F.col("right")).cast("long")))
    unit = ["label", "dim", "leaf", "left", "right"]
    told = cut_lineage(
        dealt.select(*unit, "side", "class", "copies", "vector", "leaves").withColumn("dim", F.col("dim").cast("long"))
        .repartition(*unit).sortWithinPartitions(*unit)
        .mapInArrow(lambda b: join_leaves(b, threshold), "node long, other long, links long"))
    links = told.groupBy("node").agg(F.sum("links").alias("links"))
    linked = components(told.select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = cut_lineage(
        classes.select("label", "vector", "class", "copies")
        .join(links, F.col("class") == F.col("node"), "left").drop("node")
        .join(linked, F.col("class") == F.col("node"), "left")
        .select("label", "vector", F.col("class").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                F.coalesce("component", "class").alias("component_id")))
    found = (good.select("key", "label", "vector").join(named, ["label", "vector"])
             .select("key", "class_id", "n_links", "component_id"))
    rest = rows.filter(~F.col("sound")).select("key", F.col("key").alias("class_id"), F.lit(0).cast("long").alias("n_links"),
                                               F.col("key").alias("component_id"))
    return found.union(rest).select(
        F.col("key").alias(key), F.col("n_links").cast("long").alias("n_links"), "component_id",
        F.coalesce(F.col("key") == F.col("component_id"), F.lit(True)).alias("kept"), "class_id")
