"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints that differ in at most ``budget`` of 64 bits agree in one of ``budget + 1`` blocks of
bits.  For each block the fingerprints are rotated so that the block leads; a trie below each
value of the block is then joined with itself.  Pairs of nodes are followed down together, a step
into different children spends one bit of the budget, and a pair whose budget is spent is left.
Equal texts share a fingerprint and enter the join once.

Blocks are tasks' units.  One with more than ``UNIT_ROWS`` fingerprints is opened in Spark: its
nodes eight bits further down are paired, pairs over budget are dropped, and this repeats until the
nodes of a pair are small, so no unit outgrows a task.  A unit returns one edge per linked
fingerprint (its links' spanning star); components over these edges are the groups.

Contract: words are runs without ASCII white space, A-Z in lower case; a text with fewer words than
a shingle is one shingle; null texts and those without words have fingerprint zero, which links as
any other.  Texts are read whole.  Rows with a null key take part and get their group's component.
Repeated rows are members of one group.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableward.llm.common import components, cut_lineage, map_texts

BITS, SEED = 64, 42
#: Fingerprints that one unit may hold; with more it is opened.
UNIT_ROWS = 1000
#: Bits of the trie that one opening goes down.
OPEN_BITS = 8
#: Node pairs followed at once, and leaf pairs below which a node pair is compared directly.
FRONTIER, DIRECT = 1 << 20, 32


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(counts: np.ndarray, n: int) -> int:
    """The bits set in over half of ``n`` hashes."""
    return int(np.packbits((2 * counts > n).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes | None, width: int) -> int:
    words = (text or b"").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    first = np.r_[0, ends[:len(words) - width]].tolist()
    last = (ends[width - 1:] - 1).tolist()
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(first), 1 << 16):
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(first[at:at + (1 << 16)], last[at:at + (1 << 16)], strict=True)],
                          np.uint64)
        counts += bit_counts(hashes)
    return majority(counts, len(first))


def fingerprints(df: DataFrame, text: str, keep: list[str], width: int = 3) -> DataFrame:
    """``keep`` plus ``fp``, the fingerprint as a signed long."""

    def work(texts: list[bytes | None]) -> list[pa.Array]:
        return [pa.array(np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64))]

    return map_texts(df, text, keep, work, "fp long")


class Forest:
    """Union of array places; the root of a tree is its least place."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        p = self.parent
        while True:
            q = p[p]
            if np.array_equal(p, q):
                self.parent = p
                return p
            p = q

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            p = self.roots()
            a, b = p[a], p[b]
            differ = a != b
            a, b = a[differ], b[differ]
            if len(a):
                np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


def follow(values: np.ndarray, nodes: np.ndarray, cost: np.ndarray, depth: int, budget: int, forest: Forest) -> None:
    """Follow pairs of trie nodes down and unite the leaves within budget.

    ``values`` are sorted inside each node; ``nodes`` has rows (from, to, from, to), the places of
    the leaves of both nodes of a pair, which share their first ``depth`` bits up to ``cost``
    differences.
    """
    stack = [(depth, nodes, cost)]
    zeros: dict[int, np.ndarray] = {}
    while stack:
        depth, nodes, cost = stack.pop()
        if len(nodes) > FRONTIER:
            half = len(nodes) // 2
            stack += [(depth, nodes[:half], cost[:half]), (depth, nodes[half:], cost[half:])]
            continue
        n1, n2 = nodes[:, 1] - nodes[:, 0], nodes[:, 3] - nodes[:, 2]
        small = (n1 * n2 <= DIRECT) | (depth >= BITS)
        if small.any():
            s1, s2 = n1[small], n2[small]
            each = s1 * s2
            pair = np.repeat(np.arange(len(each)), each)
            k = np.arange(len(pair)) - np.repeat(np.cumsum(each) - each, each)
            a = nodes[small, 0][pair] + k // s2[pair]
            b = nodes[small, 2][pair] + k % s2[pair]
            near = (a != b) & (np.bitwise_count(values[a] ^ values[b]) <= budget)
            forest.union(a[near], b[near])
            nodes, cost = nodes[~small], cost[~small]
        if not len(nodes):
            continue
        if depth not in zeros:
            bit = (values >> np.uint64(BITS - 1 - depth)) & np.uint64(1)
            zeros[depth] = np.r_[0, np.cumsum(bit == 0)]
        z = zeros[depth]
        lo1, hi1, lo2, hi2 = nodes.T
        mid1, mid2 = lo1 + z[hi1] - z[lo1], lo2 + z[hi2] - z[lo2]
        same = lo1 == lo2
        children = [(np.c_[lo1, mid1, lo2, mid2], cost), (np.c_[mid1, hi1, mid2, hi2], cost),
                    (np.c_[lo1, mid1, mid2, hi2], cost + 1), (np.c_[mid1, hi1, lo2, mid2][~same], cost[~same] + 1)]
        nodes, cost = np.concatenate([c[0] for c in children]), np.concatenate([c[1] for c in children])
        live = (cost <= budget) & (nodes[:, 1] > nodes[:, 0]) & (nodes[:, 3] > nodes[:, 2])
        stack.append((depth + 1, nodes[live], cost[live]))


def join_units(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Edges of the units in a sorted stream of (block, depth, left, right, side, rot)."""
    held: list[np.ndarray] = []

    def edges(rows: np.ndarray) -> pa.RecordBatch:
        """``rows``: whole units, as uint64 columns."""
        keys = rows[:, :4]
        cut = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        first = np.r_[0, cut]
        last = np.r_[cut, len(rows)]
        left = np.r_[0, np.cumsum(rows[:, 4] == 0)]
        mid = first + left[last] - left[first]
        single = rows[first, 2] == rows[first, 3]
        nodes = np.c_[first, mid, np.where(single, first, mid), np.where(single, mid, last)]
        cost = np.bitwise_count(rows[first, 2] ^ rows[first, 3]).astype(np.int64)
        values, forest = rows[:, 5].copy(), Forest(len(rows))
        for depth in np.unique(rows[first, 1]):
            at = (rows[first, 1] == depth) & ((mid - first > 1) | ~single)
            follow(values, nodes[at], cost[at], int(depth), budget, forest)
        root = forest.roots()
        moved = np.flatnonzero(root != np.arange(len(rows)))
        turn = rows[moved, 0] * np.uint64(BITS // (budget + 1))

        def turned_back(v: np.ndarray) -> np.ndarray:
            back = (np.uint64(BITS) - turn) & np.uint64(BITS - 1)
            return np.where(turn == 0, v, (v << back) | (v >> np.where(turn == 0, np.uint64(1), turn)))

        return pa.RecordBatch.from_arrays(
            [pa.array(turned_back(values[moved]).view(np.int64)), pa.array(turned_back(values[root[moved]]).view(np.int64))],
            names=["a", "b"])

    for batch in batches:
        held.append(np.stack([c.to_numpy().astype(np.int64).view(np.uint64) for c in batch.columns], axis=1))
        if sum(map(len, held)) < 50_000:
            continue
        rows = np.concatenate(held)
        change = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1))
        if len(change):
            yield edges(rows[:change[-1] + 1])
            held = [rows[change[-1] + 1:]]
        else:
            held = [rows]
    rows = np.concatenate(held) if held else np.zeros((0, 6), np.uint64)
    if len(rows):
        yield edges(rows)


def _prefix(column: str | Column, depth: int) -> Column:
    return F.shiftrightunsigned(column, BITS - depth) if depth < BITS else F.col(column)


def trie_join(values: DataFrame, fp: str = "fp", budget: int = 3, unit_rows: int = UNIT_ROWS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that span all links within ``budget`` bits."""
    width = BITS // (budget + 1)

    def turned(b: int) -> Column:
        s = b * width
        return F.shiftleft(fp, s).bitwiseOR(F.shiftrightunsigned(fp, BITS - s)) if s else F.col(fp)

    rows = cut_lineage(values.select(F.explode(F.array(*[
        F.struct(F.lit(b).alias("block"), turned(b).alias("rot")) for b in range(budget + 1)])).alias("r")).select("r.*"))
    depth = width
    nodes = rows.groupBy("block", _prefix("rot", depth).alias("left")).agg(F.count(F.lit(1)).alias("n"))
    large = cut_lineage(nodes.filter(F.col("n") > unit_rows).select(
        "block", "left", F.col("left").alias("right"), F.lit(0).alias("cost")))
    keyed = rows.withColumn("left", _prefix("rot", depth))
    unit = ["block", "depth", "left", "right", "side", "rot"]
    whole = keyed.withColumn("right", F.col("left")).withColumn("depth", F.lit(depth)).withColumn("side", F.lit(0))
    # Keys of large units are at most (budget + 1) * rows / unit_rows.
    units = [whole.join(large.select("block", "left"), ["block", "left"], "left_anti").select(*unit)]
    while depth < BITS and not large.isEmpty():
        deeper = min(BITS, depth + OPEN_BITS)
        step = deeper - depth
        opened = large.select("block", F.col("left").alias("node")).union(
            large.select("block", F.col("right").alias("node"))).distinct()
        below = cut_lineage(rows.withColumn("node", _prefix("rot", depth)).join(opened, ["block", "node"])
                            .select("block", "node", "rot", _prefix("rot", deeper).alias("child")))
        child = cut_lineage(below.groupBy("block", "node", "child").agg(F.count(F.lit(1)).alias("n")))
        left = child.select("block", F.col("node").alias("left"), F.col("child").alias("l"), F.col("n").alias("nl"))
        right = child.select("block", F.col("node").alias("right"), F.col("child").alias("r"), F.col("n").alias("nr"))
        paired = (large.join(left, ["block", "left"]).join(right, ["block", "right"])
                  .filter((F.col("left") != F.col("right")) | (F.col("l") <= F.col("r")))
                  .withColumn("cost", (F.col("cost") + F.bit_count(
                      F.col("l").bitwiseXOR(F.col("r")).bitwiseAND(F.lit((1 << step) - 1)))).cast("int"))
                  .filter(F.col("cost") <= budget)
                  .withColumn("fits", F.when(F.col("l") == F.col("r"), F.col("nl")).otherwise(
                      F.col("nl") + F.col("nr")) <= unit_rows))
        paired = cut_lineage(paired.select("block", F.col("l").alias("left"), F.col("r").alias("right"), "cost", "fits"))
        done = paired.filter("fits").select("block", "left", "right", F.lit(deeper).alias("depth"))
        member = below.select("block", "child", "rot")
        units.append(member.withColumnRenamed("child", "left").join(done, ["block", "left"])
                     .withColumn("side", F.lit(0)).select(*unit))
        units.append(member.withColumnRenamed("child", "right").join(done.filter("left <> right"), ["block", "right"])
                     .withColumn("side", F.lit(1)).select(*unit))
        large = paired.filter("not fits").select("block", "left", "right", "cost")
        depth = deeper
    every = units[0]
    for u in units[1:]:
        every = every.union(u)
    every = every.select(*[F.col(c).cast("long") for c in unit])
    return (every.repartition("block", "depth", "left", "right").sortWithinPartitions(*unit)
            .mapInArrow(lambda batches: join_units(batches, budget), "a long, b long"))


def _components(rows: DataFrame, budget: int) -> DataFrame:
    """(fp, component) of all fingerprints in ``rows``; a component is named by one of its own."""
    classes = cut_lineage(rows.select("fp").distinct())
    linked = components(trie_join(classes, "fp", budget))
    return classes.join(linked, F.col("fp") == F.col("node"), "left").select(
        "fp", F.coalesce("component", "fp").alias("component"))


def groups(df: DataFrame, key: str, text: str, width: int = 3, budget: int = 3) -> DataFrame:
    """One row per row of ``df``: ``key``, ``fp`` and ``component_id``, the least key reachable."""
    rows = cut_lineage(fingerprints(df.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_text", ["_key"], width))
    least = rows.groupBy("fp").agg(F.min("_key").alias("_least"))
    named = cut_lineage(_components(rows, budget).join(least, "fp"))
    by_component = named.groupBy("component").agg(F.min("_least").alias("component_id"))
    by_fp = cut_lineage(named.join(by_component, "component").select("fp", "component_id"))
    return rows.join(by_fp, "fp").select(F.col("_key").alias(key), "fp", "component_id")


def keep_one(df: DataFrame, key: str, text: str, width: int = 3, budget: int = 3) -> DataFrame:
    """The rows of ``df`` with the least key of each group, one of them where they repeat.

    A group's keys alone are compared; whole rows are shuffled once, by (key, fingerprint).  A null
    key stays only where a group has no other.
    """
    shell = df.select(F.struct("*").alias("_row"), F.col(key).alias("_key"), F.col(text).alias("_text"))
    rows = cut_lineage(fingerprints(shell, "_text", ["_key"], width))
    least = rows.groupBy("fp").agg(F.min(F.struct(F.col("_key").isNull().alias("no_key"), "_key", "fp")).alias("_least"))
    stay = cut_lineage(_components(rows, budget).join(least, "fp").groupBy("component").agg(F.min("_least").alias("_s"))
                       .select(F.col("_s._key").alias("_stay"), F.col("_s.fp").alias("_stay_fp")))
    whole = fingerprints(shell, "_text", ["_row", "_key"], width)
    found = whole.join(stay, F.col("_key").eqNullSafe(F.col("_stay")) & (F.col("fp") == F.col("_stay_fp")), "left_semi")
    return found.dropDuplicates(["_key", "fp"]).select("_row.*")
