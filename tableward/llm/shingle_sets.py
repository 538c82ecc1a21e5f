"""Near-duplicates by SimHash tries, checked by the exact Jaccard similarity of shingle sets.

Candidates come from the tries of ``simhash``: sets whose fingerprints differ in at most ``budget``
bits belong to one cluster.  Most sets near the wanted similarity differ in more bits, so a second
source adds those: a text has ``BANDS`` bands of ``BAND_ROWS`` minima of its shingles' hashes under
different permutations, and texts that agree in a band belong to one cluster, too.  Two texts at
similarity s agree in some band with probability 1 - (1 - s^8)^40: 0.9994 at 0.8, more above.  All pairs of a cluster, not only those that share a band, are then compared by their whole
sets, and only pairs at or above the wanted similarity are united.

Equal sets are one class, compared once.  A cluster with more than ``BLOCK_SHINGLES`` shingles is
dealt into blocks, and each pair of blocks is a task's unit, so a cluster of any size is compared
whole and in bounded memory.

Contract: words and shingles are those of ``simhash``; a text with fewer words than a shingle is one
shingle, and so are null texts and those without words, which are equal.  Texts are read whole.
Repeated rows are members of one group.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableward.llm.common import components, cut_lineage, map_texts
from tableward.llm.simhash import Forest, bit_counts, majority, trie_join

SEED = 43
BANDS, BAND_ROWS = 40, 8
#: Shingles of a block.
BLOCK_SHINGLES = 1 << 19
_RNG = np.random.default_rng(SEED)
_TURN = _RNG.integers(0, 1 << 32, (BANDS * BAND_ROWS, 1), np.uint32)
_TIMES = _RNG.integers(0, 1 << 32, (BANDS * BAND_ROWS, 1), np.uint32) | np.uint32(1)


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles, at least one."""
    words, digest = (text or b"").lower().split(), xxhash.xxh64_intdigest
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([digest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    first = np.r_[0, ends[:len(words) - width]].tolist()
    last = (ends[width - 1:] - 1).tolist()
    return np.unique(np.fromiter((digest(line[a:b], SEED) for a, b in zip(first, last, strict=True)), np.uint64, len(first)))


def fingerprint(hashes: np.ndarray) -> int:
    """The SimHash fingerprint of a set."""
    step = 1 << 16
    return majority(sum(bit_counts(hashes[at:at + step]) for at in range(0, len(hashes), step)), len(hashes))


def bands(hashes: np.ndarray) -> list[int]:
    """One signed number per band of minima."""
    least = np.full(BANDS * BAND_ROWS, (1 << 32) - 1, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 512):
        np.minimum(least, ((short[at:at + 512] ^ _TURN) * _TIMES).min(axis=1), out=least)
    raw, size = least.tobytes(), 4 * BAND_ROWS
    made = [xxhash.xxh64_intdigest(raw[b * size:(b + 1) * size], b) for b in range(BANDS)]
    return np.array(made, np.uint64).view(np.int64).tolist()


def _similar(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int, forest: Forest) -> None:
    """Unite the pairs of places (left x right) whose sets are similar."""
    sizes = np.array([len(sets[i]) for i in right], np.int64)
    values = np.concatenate([sets[i] for i in right])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], np.repeat(np.arange(len(right)), sizes)[order]
    for i in left:
        lo, hi = np.searchsorted(values, sets[i]), np.searchsorted(values, sets[i], "right")
        each = hi - lo
        places = np.repeat(lo - np.cumsum(each) + each, each) + np.arange(each.sum())
        common = np.bincount(owner[places], minlength=len(right))
        found = right[100 * common >= percent * (len(sets[i]) + sizes - common)]
        forest.union(np.full(len(found), i), found)


def join_units(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Edges of the units in a sorted stream of (cluster, left, right, side, cls, hashes)."""
    held = None

    def unit(part: pa.Table) -> pa.RecordBatch:
        cls, side = part.column("cls").to_numpy(), part.column("side").to_numpy()
        # A text may come once per task that read it.
        once = np.flatnonzero(np.r_[True, (cls[1:] != cls[:-1]) | (side[1:] != side[:-1])])
        cls, side = cls[once], side[once]
        sets = [np.frombuffer(h, np.uint64) for h in part.column("hashes").take(pa.array(once)).to_pylist()]
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if part.column("left")[0] == part.column("right")[0]:
            two = one
        forest = Forest(len(cls))
        if len(one) and len(two):
            _similar(sets, one, two, percent, forest)
        root = forest.roots()
        moved = np.flatnonzero(root != np.arange(len(cls)))
        return pa.RecordBatch.from_arrays([pa.array(cls[moved]), pa.array(cls[root[moved]])], names=["a", "b"])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        keys = np.stack([held.column(c).to_numpy() for c in ("cluster", "left", "right")], axis=1)
        edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()]
        for lo, hi in zip(edges, edges[1:], strict=False):
            if hi - lo > 1:
                yield unit(held.slice(lo, hi - lo))
        held = held.slice(edges[-1])
    if held is not None and held.num_rows > 1:
        yield unit(held)


def clusters_of(classes: DataFrame, budget: int) -> DataFrame:
    """(node, component): the clusters of classes (cls, fp, bands) that the tries or a band link."""
    first = cut_lineage(classes.groupBy("fp").agg(F.min("cls").alias("least")))
    equal = classes.join(first, "fp").filter("cls <> least").select(F.col("cls").alias("a"), F.col("least").alias("b"))
    near = trie_join(first, "fp", budget).join(first.select(F.col("fp").alias("a"), F.col("least").alias("one")), "a").join(
        first.select(F.col("fp").alias("b"), F.col("least").alias("two")), "b").select(F.col("one").alias("a"), F.col("two").alias("b"))
    placed = classes.select("cls", F.explode("bands").alias("band"))
    met = placed.groupBy("band").agg(F.min("cls").alias("least"), F.max("cls").alias("most")).filter("least <> most")
    agree = placed.join(met.select("band", "least"), "band").filter("cls <> least").select(
        F.col("cls").alias("a"), F.col("least").alias("b"))
    return components(near.union(equal).union(agree).distinct())


def _edges(shell: DataFrame, classes: DataFrame, width: int, percent: int, budget: int) -> DataFrame:
    """Edges (a, b) between classes that span all similar pairs of the clusters."""
    clusters = clusters_of(classes, budget)
    member = cut_lineage(classes.select("cls", "tid", "n").join(clusters, F.col("cls") == F.col("node"))
                         .select("tid", "cls", F.col("component").alias("cluster"), "n"))
    parts = member.groupBy("cluster").agg(F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES)).cast("long").alias("parts"))
    member = cut_lineage(member.join(parts, "cluster").select("tid", "cls", "cluster", "parts"))

    def work(texts: list[bytes | None], seen: set[bytes]) -> list[pa.Array]:
        """The sets of texts that the task has not met before."""
        names = [xxhash.xxh3_128_digest(t or b"") for t in texts]
        new = [not (n in seen or seen.add(n)) for n in names]
        return [pa.array([shingles(t, width).tobytes() if fresh else None for t, fresh in zip(texts, new, strict=True)], pa.binary())]

    read = shell.select("_text", "tid").join(member, "tid")
    sets = map_texts(read, "_text", ["cls", "cluster", "parts"], work, "hashes binary", setup=set).filter("hashes is not null")
    # Every block meets every block of its cluster, itself included, as unit (left <= right).
    dealt = (sets.withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
             .withColumn("left", F.least("part", "other")).withColumn("right", F.greatest("part", "other"))
             .withColumn("side", (F.col("part") > F.col("left")).cast("long")))
    unit = ["cluster", "left", "right"]
    return (dealt.select(*unit, "side", "cls", "hashes").repartition(*unit).sortWithinPartitions(*unit, "side", "cls")
            .mapInArrow(lambda batches: join_units(batches, percent), "a long, b long"))


def keep_one(df: DataFrame, key: str, text: str, width: int = 5, percent: int = 80, budget: int = 3) -> DataFrame:
    """The rows of ``df`` with the least key of each group, one of them where they repeat.

    A group is joined by pairs of texts whose sets of ``width``-word shingles have at least
    ``percent`` hundredths of their union in common; ``budget`` is that of the tries.  A null key stays only where a group has no
    other.
    """
    shell = df.select(F.struct("*").alias("_row"), F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")).withColumn(
        "tid", F.xxhash64("_text"))

    def work(texts: list[bytes | None]) -> list[pa.Array]:
        sets = [shingles(t, width) for t in texts]
        names = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64)
        return [pa.array(names.view(np.int64)), pa.array([len(s) for s in sets], pa.int64()),
                pa.array(np.array([fingerprint(s) for s in sets], np.uint64).view(np.int64)),
                pa.array([bands(s) for s in sets], pa.list_(pa.int64()))]

    rows = cut_lineage(map_texts(shell, "_text", ["_key", "tid"], work, "cls long, n long, fp long, bands array<long>"))
    classes = cut_lineage(rows.groupBy("cls").agg(*[F.min(c).alias(c) for c in ("tid", "n", "fp", "bands")]))
    linked = components(_edges(shell, classes, width, percent, budget))
    least = rows.groupBy("cls").agg(F.min(F.struct(F.col("_key").isNull().alias("no_key"), "_key", "tid")).alias("_least"))
    stay = cut_lineage(least.join(linked, F.col("cls") == F.col("node"), "left")
                       .groupBy(F.coalesce("component", "cls").alias("component")).agg(F.min("_least").alias("_s"))
                       .select(F.col("_s._key").alias("_stay"), F.col("_s.tid").alias("_stay_tid")))
    found = shell.join(stay, F.col("_key").eqNullSafe(F.col("_stay")) & (F.col("tid") == F.col("_stay_tid")), "left_semi")
    return found.dropDuplicates(["_key", "tid"]).select("_row.*")
