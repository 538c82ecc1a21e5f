"""Centroid clustering in exact integers, with heaps of expiring bounds.

Vectors lie in blocks.  Every block keeps one heap per cluster.  An entry is a vector's gap between its
distance to the second nearest and to its own centroid when it was last scanned, plus the drift that
the cluster had gathered by then.  A cluster's drift grows in every round by the way its own centroid
went and the longest way of another one.  While an entry is above the drift its vector cannot have
changed cluster and is not looked at; only expired entries are popped, scanned against all centroids in
integers, and pushed anew.  Sums follow the vectors that moved.

Bounds are floating point and kept on the safe side by a relative margin far above their rounding; they
only decide what is scanned.  Assignments, sums, centroids and distances are integers.

Blocks are written once and then cached by block; the heaps, a twentieth of the vectors, go from round to
round through the checkpoint folder and meet their blocks in a join that moves only them.  A cluster of
any size is spread over all blocks.  The driver gets one sum per cluster and component, and the centroids.

Contract: vectors with other than ``dim`` components, or a null or non-finite one, are left out.  A
component x is floor(256 * x); beyond +-2**27 of that squared distances could pass 64 bits, which is an
ArithmeticError.  Ties go to the smaller number.  Repeated rows are vectors of their own; seeds of one hash
follow each other by their components; null keys come last.  Fewer vectors than clusters give fewer
centroids.  An empty table gives no rows.  Only key and vector are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableward.llm.common import cut_lineage

#: Vectors of a block; most blocks that lie apart.
BLOCK_ROWS, MOST_PARTITIONS = 4096, 4096
SCALE, LIMIT = 256, 1 << 27
#: Products of components below this are exact in double precision, 64 of them summed.
EXACT = 1 << 23
MARGIN = 1e-9


@dataclass(frozen=True)
class Centroids:
    """Where the centroids are, and how far each cluster's bounds have drifted so far."""

    points: np.ndarray
    drift: np.ndarray

    def moved(self, points: np.ndarray) -> Centroids:
        way = np.sqrt(((points - self.points).astype(np.float64) ** 2).sum(axis=1)) * (1 + MARGIN)
        order = np.sort(way)
        # The longest way of another cluster than one's own.
        other = np.where((way == order[-1]) & (np.sum(way == order[-1]) == 1), order[-2] if len(way) > 1 else 0.0, order[-1])
        return Centroids(points, self.drift + way + other)


def squared(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all points."""
    if max(np.abs(x).max(initial=0), np.abs(points).max(initial=0)) < EXACT:
        a, b = x.astype(np.float64), points.astype(np.float64)
        return ((a * a).sum(axis=1).astype(np.int64)[:, None] + (b * b).sum(axis=1).astype(np.int64)
                - 2 * (a @ b.T).astype(np.int64))
    return np.stack([((x - p) ** 2).sum(axis=1) for p in points], axis=1)


class Block:
    """One block's clusters and heaps."""

    def __init__(self, x: np.ndarray, k: int):
        self.x, self.k, self.cluster = x, k, np.full(len(x), -1, np.int32)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(k)]

    @classmethod
    def load(cls, x: np.ndarray, k: int, cluster: bytes, keys: bytes, rows: bytes) -> Block:
        block = cls(x, k)
        block.cluster = np.frombuffer(cluster, np.int32).copy()
        edges = np.r_[0, np.cumsum(np.bincount(block.cluster, minlength=k))]
        key, row = np.frombuffer(keys, np.float64).tolist(), np.frombuffer(rows, np.int32).tolist()
        # Stored in heap order, one heap after the other.
        block.heaps = [list(zip(key[a:b], row[a:b], strict=True)) for a, b in zip(edges, edges[1:], strict=False)]
        return block

    def dump(self) -> tuple[bytes, bytes, bytes]:
        entries = [e for heap in self.heaps for e in heap]
        return (self.cluster.tobytes(), np.array([e[0] for e in entries], np.float64).tobytes(),
                np.array([e[1] for e in entries], np.int32).tobytes())

    def expired(self, drift: np.ndarray) -> list[int]:
        """Pop the vectors whose gap the drift has used up."""
        rows = []
        for heap, used in zip(self.heaps, drift.tolist(), strict=True):
            while heap and heap[0][0] <= used:
                rows.append(heappop(heap)[1])
        return rows

    def assign(self, now: Centroids, sums: np.ndarray) -> int:
        """Scan expired vectors anew and add what moved to ``sums`` (per cluster: components, count)."""
        fresh = bool(len(self.x)) and self.cluster[0] < 0
        rows = np.arange(len(self.x)) if fresh else np.array(sorted(self.expired(now.drift)), np.int64)
        if not len(rows):
            return 0
        x, before = self.x[rows], self.cluster[rows]
        distance = squared(x, now.points)
        found = distance.argmin(axis=1).astype(np.int32)
        self.cluster[rows] = found
        near = np.sqrt(distance[np.arange(len(rows)), found].astype(np.float64))
        distance[np.arange(len(rows)), found] = np.iinfo(np.int64).max
        second = np.sqrt(distance.min(axis=1).astype(np.float64)) if self.k > 1 else np.full(len(rows), np.inf)
        key = second * (1 - MARGIN) - near * (1 + MARGIN) + now.drift[found] * (1 - MARGIN)
        for entry in zip(key.tolist(), rows.tolist(), found.tolist(), strict=True):
            (self.heaps[entry[2]].append if fresh else lambda e, h=self.heaps[entry[2]]: heappush(h, e))(entry[:2])
        if fresh:
            for heap in self.heaps:
                heapify(heap)
        moved = np.flatnonzero(found != before)
        whole = np.concatenate([x[moved], np.ones((len(moved), 1), np.int64)], axis=1)
        np.add.at(sums, found[moved], whole)
        if not fresh:
            np.subtract.at(sums, before[moved], whole)
        return len(rows)


def to_blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """Rows of (key, vector) as blocks of integer vectors."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            x = np.floor(SCALE * part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            if np.abs(x).max() > LIMIT:
                raise ArithmeticError(f"a component is beyond {LIMIT // SCALE}; its squared distances could pass 64 bits")
            kind = np.int16 if np.abs(x).max() < 1 << 15 else np.int32
            yield pa.RecordBatch.from_arrays([
                pa.array([number], pa.int64()), pa.array([part.num_rows], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0)),
                pa.array([x.astype(kind).tobytes()], pa.binary())], names=["block", "n", "_ids", "x"])
            number += 1


STATE = "block long, cluster binary, keys binary, rows binary, sums array<long>, scanned long"


@dataclass(frozen=True)
class Fit:
    """What a fit returns: a row per vector, the final centroids, and the vectors scanned per round."""

    rows: DataFrame
    centroids: np.ndarray
    scanned: list[int]


def seeds(kept: DataFrame, clusters: int, seed: str, dim: int) -> np.ndarray:
    """The vectors of least key hash."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_key").cast("string")).cast("binary"), 256)
    first = kept.select(name.alias("_name"), "_x").orderBy(F.col("_name").asc_nulls_last(), "_x").limit(clusters).collect()
    return np.floor(SCALE * np.array([r["_x"] for r in first], np.float64).reshape(-1, dim)).astype(np.int64)


def fit(df: DataFrame, key: str, vector: str, clusters: int = 40, rounds: int = 5, dim: int = 64, seed: str = "2") -> Fit:
    """Cluster vectors: ``rounds`` of assigning and moving centroids, then a last assigning.

    ``rows``: ``key``, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.
    """
    spark = df.sparkSession
    kept = df.select(F.col(key).alias("_key"), F.col(vector).cast("array<double>").alias("_x")).filter(
        (F.size("_x") == dim) & F.forall("_x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    kind = kept.schema["_key"].dataType
    found = cut_lineage(kept.mapInArrow(lambda batches: to_blocks(batches, dim), T.StructType([
        T.StructField("block", T.LongType()), T.StructField("n", T.LongType()), T.StructField("_ids", T.ArrayType(kind)),
        T.StructField("x", T.BinaryType())])))
    total, most = found.agg(F.count(F.lit(1)), F.coalesce(F.max(F.length("x") / F.col("n")), F.lit(0))).first()
    points = seeds(kept, clusters, seed, dim)
    k = len(points)
    placed = found.repartition(max(1, min(total, MOST_PARTITIONS)), "block").persist()

    def opened(row: dict) -> np.ndarray:
        return np.frombuffer(row["x"], np.int16 if len(row["x"]) == 2 * dim * row["n"] else np.int32).reshape(-1, dim).astype(np.int64)

    def advance(batches: Iterator[pa.RecordBatch], now: Centroids, last: bool) -> Iterator[pa.RecordBatch]:
        sums, scanned = np.zeros((k, dim + 1), np.int64), 0
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                row = {c: one.column(c)[0].as_py() for c in one.schema.names if c != "_ids"}
                x = opened(row)
                block = Block(x, k) if row.get("cluster") is None else Block.load(x, k, row["cluster"], row["keys"], row["rows"])
                scanned += block.assign(now, sums)
                if last:
                    away = x - now.points[block.cluster]
                    yield pa.RecordBatch.from_arrays(
                        [one.column("_ids").flatten(), pa.array(block.cluster), pa.array((away * away).sum(axis=1))], names=["_key", "cluster", "distance"])
                else:
                    yield pa.RecordBatch.from_arrays([
                        pa.array([row["block"]], pa.int64()), *[pa.array([b], pa.binary()) for b in block.dump()],
                        pa.array([None], pa.list_(pa.int64())), pa.array([None], pa.int64())],
                        names=["block", "cluster", "keys", "rows", "sums", "scanned"])
        if not last:
            yield pa.RecordBatch.from_arrays([
                pa.array([None], pa.int64()), *[pa.array([None], pa.binary())] * 3,
                pa.array([sums.ravel().tolist()], pa.list_(pa.int64())), pa.array([scanned], pa.int64())],
                names=["block", "cluster", "keys", "rows", "sums", "scanned"])

    now, state, scans, sums = Centroids(points, np.zeros(k)), None, [], np.zeros((k, dim + 1), np.int64)

    def input_() -> DataFrame:
        if state is None:
            return placed
        # Heaps go to where their blocks are.
        heaps = state.filter("block is not null").select("block", "cluster", "keys", "rows").hint("shuffle_hash")
        return placed.join(heaps, "block", "left")

    for _ in range(rounds if k else 0):
        state = cut_lineage(input_().mapInArrow(lambda batches, now=now: advance(batches, now, False), STATE))
        per_place = state.filter("block is null").select("scanned", F.posexplode("sums").alias("at", "s")).groupBy("at").agg(
            F.sum("s").alias("s"), F.sum("scanned").alias("scanned")).orderBy("at").collect()
        sums = sums + np.array([r["s"] for r in per_place], np.int64).reshape(k, dim + 1)
        scans.append(per_place[0]["scanned"])
        n = sums[:, dim:]
        now = now.moved(np.where(n > 0, sums[:, :dim] // np.maximum(n, 1), now.points))
    schema = T.StructType([T.StructField("_key", kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    if k:
        rows = cut_lineage(input_().mapInArrow(lambda batches: advance(batches, now, True), schema))
    else:
        rows = spark.createDataFrame([], schema)
    placed.unpersist()
    names = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in now.points.tolist()]
    of = spark.createDataFrame(list(enumerate(names)), "cluster int, centroid_sha256 string")
    per = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("_s"))
    # At most one row per cluster.
    totals = per.join(of, "cluster").crossJoin(F.broadcast(per.agg(F.sum("_s").alias("_all")))).select(
        "cluster", F.col("_s").cast("long").alias("cluster_inertia"), F.col("_all").cast("long").alias("inertia"), "centroid_sha256")
    done = rows.join(F.broadcast(totals), "cluster").select(
        F.col("_key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return Fit(done, now.points, scans)
