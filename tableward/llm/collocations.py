"""Recurring phrases from a weighted de Bruijn graph over the words of all texts.

An edge is a gram of four words; it joins the two nodes of three words that it overlaps.  Every word
of a piece starts exactly one gram: an edge, or a shorter one where the piece ends.  Counts of edges
and of these short ends are all that is gathered.  The count of a shorter gram is its flow: the edges
that begin with it plus the ends that do, summed from four words down to one.

Gathering.  A task sorts the grams of a block of whole texts, counts them, cuts the sorted run at
splitters and hands every part on as one compressed pack.  Splitters are quantiles of sampled grams
of the language; they decide where a gram is counted, never whether.  Grams that begin alike are
neighbours, so a part knows all flows but those of the grams that the splitters at its two edges
begin with; these are handed on as partial sums and added up.  A word, pair or passage of any
frequency is thus counted by as many tasks as its distinct grams need.

Compaction.  A node whose only edge in and only edge out carry its whole flow lies on a unary path.
Edges linked by such nodes are compacted to one path by pointer doubling; there are no cycles, as a
piece would have no end.  A node inside a path is inside a longer phrase that always holds it.

Contract: A-Z are lower-cased; pieces end at ``[.,;:!?\\x0A-\\x0D]``, words are ``[^\\x20\\x09]+``.  A
null text is empty, a null language is ``und``.  Whole texts are read; a long piece is a path like any
other.  Repeated rows count as often as they occur.  Ties are settled by the phrase in byte order.
An empty table gives no rows.  Other columns are not read, so their names do not matter.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tableward.llm.common import blocks, cut_lineage, text_bytes

ORDER = 4
#: Bytes of text that are sorted at once, and that a part should hold.
BLOCK_BYTES, PART_BYTES = 8 << 20, 4 << 20
#: Parts of one gathering, and sampled grams behind each splitter.
MOST_PARTS, SAMPLED_DOCS, SAMPLES = 1 << 16, 20_000, 64
SEED = 13
UNKNOWN = "und"

_UPPER = bytes(range(65, 91))
_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_TABLE = bytes.maketrans(_UPPER + b"\t" + _ENDS, _UPPER.lower() + b" " + b"\n" * len(_ENDS))


class Words:
    """The words of lines of text: ``vocabulary`` (sorted), ``rank`` in it from 1, and ``line`` of each."""

    def __init__(self, raw: bytes):
        data = np.frombuffer(raw, np.uint8)
        solid = (data != 32) & (data != 10)
        edge = np.flatnonzero(np.diff(np.r_[False, solid, False]))
        starts, ends = edge[::2], edge[1::2]
        offsets = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts, out=offsets[1:])
        words = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[solid])]).dictionary_encode()
        order = pc.array_sort_indices(words.dictionary)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(1, len(order) + 1)
        self.vocabulary = words.dictionary.take(order)
        self.rank = rank[words.indices.to_numpy()] if len(starts) else np.zeros(0, np.int64)
        self.line = np.searchsorted(np.flatnonzero(data == 10), starts)

    def __len__(self) -> int:
        return len(self.rank)

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Per word its place in its line, and the number of words of the line from it on."""
        new = np.flatnonzero(np.r_[True, self.line[1:] != self.line[:-1]]) if len(self) else np.zeros(0, np.int64)
        size = np.diff(np.r_[new, len(self)])
        place = np.arange(len(self)) - np.repeat(new, size)
        return place, np.repeat(size, size) - place

    def joined(self, columns: list[np.ndarray]) -> pa.Array:
        """Phrases of ranks, 0 for no word."""
        taken = [self.vocabulary.take(pa.array(c - 1, mask=c == 0)) for c in columns]
        return pc.binary_join_element_wise(*taken, pa.scalar(b" ", pa.large_binary()), null_handling="skip")


def _runs(columns: list[np.ndarray]) -> np.ndarray:
    """Where a run of equal rows of sorted columns starts."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def grams(raw: bytes) -> tuple[Words, list[np.ndarray], np.ndarray]:
    """The distinct grams that the words of a text start, as sorted columns of ranks, with counts."""
    words = Words(raw)
    left = words.places()[1]
    columns = [np.where(left > k, np.r_[words.rank[k:], np.zeros(k, np.int64)][:len(words)], 0) for k in range(ORDER)]
    bits = len(words.vocabulary).bit_length()
    halves = [(columns[0] << bits) | columns[1], (columns[2] << bits) | columns[3]]
    # Both halves as dense numbers in order fit one number, which sorts fast.
    (first, one), (second, two) = (np.unique(h, return_inverse=True) for h in halves)
    key, n = np.unique((one << 32) | two, return_counts=True)
    a, b, low = first[key >> 32], second[key & 0xFFFFFFFF], (1 << bits) - 1
    return words, [a >> bits, a & low, b >> bits, b & low], n.astype(np.int64)


def cut_points(words: Words, columns: list[np.ndarray], splitters: list[tuple[bytes, ...]]) -> list[int]:
    """Per splitter the number of grams that sort before it."""
    if not splitters:
        return []
    vocabulary, found = words.vocabulary.to_pylist(), []
    for splitter in splitters:
        lo, hi = 0, len(columns[0])
        for column, word in zip(columns, splitter, strict=False):
            at = bisect_left(vocabulary, word)
            here = column[lo:hi]
            below = lo + int(np.searchsorted(here, at + 1))
            hi = lo + int(np.searchsorted(here, at + 1, "right")) if at < len(vocabulary) and vocabulary[at] == word else below
            lo = below
            if lo == hi:
                break
        found.append(lo)
    return found


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """The texts of each language of a batch of (text, lang) as lines of words."""
    texts, encoded = text_bytes(batch.column(0)), batch.column(1).dictionary_encode()
    code = encoded.indices.to_numpy()
    for n, lang in enumerate(encoded.dictionary.to_pylist()):
        yield lang, b"\n".join(texts[i] for i in np.flatnonzero(code == n).tolist()).translate(_TABLE)


def _lines(phrases: pa.Array) -> tuple[memoryview, np.ndarray]:
    """Phrases as lines of one buffer, and where each begins."""
    ended = pc.binary_join_element_wise(phrases, pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
    at = np.r_[0, np.cumsum(pc.binary_length(ended).to_numpy())]
    return memoryview(b"" if ended.buffers()[2] is None else ended.buffers()[2]), at


def pack(batches: Iterator[pa.RecordBatch], splitters: dict[str, list[tuple[bytes, ...]]]) -> Iterator[pa.RecordBatch]:
    """Counted grams of blocks of texts, one compressed row per language and part."""
    for batch in batches:
        for block in blocks(batch, BLOCK_BYTES):
            for lang, raw in _by_language(block):
                words, columns, n = grams(raw)
                edges = np.array([0, *cut_points(words, columns, splitters.get(lang, [])), len(n)], np.int64)
                lines, at = _lines(words.joined(columns))
                for part in np.flatnonzero(np.diff(edges)).tolist():
                    line, own = lines[at[edges[part]]:at[edges[part + 1]] - 1], n[edges[part]:edges[part + 1]].tobytes()
                    yield pa.RecordBatch.from_arrays([
                        pa.array([lang]), pa.array([part], pa.int32()), pa.array([len(line)], pa.int64()),
                        pa.array([pa.compress(line, "zstd", asbytes=True)], pa.binary()), pa.array([len(own)], pa.int64()),
                        pa.array([pa.compress(own, "zstd", asbytes=True)], pa.binary())],
                        names=["lang", "part", "line_bytes", "lines", "n_bytes", "n"])


def flows(table: pa.Table, splitters: dict[str, list[tuple[bytes, ...]]], least: int) -> pa.Table:
    """Counts of the grams of one part, from four words down to none.

    Kept are counts of ``least`` and more, the partial ones at the part's edges, and the sum of all.
    """
    lang, part = table.column("lang")[0].as_py(), table.column("part")[0].as_py()
    opened = [[pa.decompress(z, size, "zstd", asbytes=True) for z, size in zip(
        table.column(name).to_pylist(), table.column(bytes_).to_pylist(), strict=True)]
        for name, bytes_ in (("lines", "line_bytes"), ("n", "n_bytes"))]
    words, flow = Words(b"\n".join(opened[0])), np.frombuffer(b"".join(opened[1]), np.int64)
    del opened
    place = words.places()[0]
    columns = []
    for k in range(ORDER):
        column = np.zeros(len(flow), np.int64)
        column[words.line[place == k]] = words.rank[place == k]
        columns.append(column)
    order = np.lexsort(columns[::-1])
    columns, flow = [c[order] for c in columns], flow[order]
    cuts, vocabulary = splitters.get(lang, []), words.vocabulary.to_pylist()
    edges = [cuts[i] for i in (part - 1, part) if 0 <= i < len(cuts)]
    made = [pa.table({"phrase": pa.array([b""], pa.large_binary()), "words": pa.array([0], pa.int32()), "f": pa.array([int(flow.sum())], pa.int64())})]
    for k in range(ORDER, 0, -1):
        # Shorter grams end a piece: they pass on as they are and join the flow of their node below.
        start = _runs(columns[:k])
        columns, flow = [c[start] for c in columns[:k]], np.add.reduceat(flow, start)
        keep = flow >= least
        for edge in edges:
            if len(edge) >= k:
                ranks = [bisect_left(vocabulary, w) + 1 for w in edge[:k]]
                if all(r <= len(vocabulary) and vocabulary[r - 1] == w for r, w in zip(ranks, edge, strict=False)):
                    keep |= np.logical_and.reduce([c == r for c, r in zip(columns, ranks, strict=True)])
        keep &= columns[-1] > 0
        made.append(pa.table({"phrase": words.joined([c[keep] for c in columns]),
                              "words": pa.array(np.full(keep.sum(), k, np.int32)), "f": pa.array(flow[keep])}))
    out = pa.concat_tables(made)
    return pa.table({"lang": pa.array([lang] * len(out), pa.string()), "phrase": out.column("phrase").cast(pa.large_string()).cast(pa.string()),
                     "words": out.column("words"), "f": out.column("f")})


def choose_splitters(texts: DataFrame) -> dict[str, list[tuple[bytes, ...]]]:
    """Per language the grams at which its sorted grams are cut into parts of about ``PART_BYTES``.

    Learnt from some ``SAMPLES`` grams a part of some ``SAMPLED_DOCS`` texts; the driver gets no more.
    """
    rows, size = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()
    parts = min(math.ceil(size / PART_BYTES), MOST_PARTS)
    if parts <= 1:
        return {}
    share = min(1.0, SAMPLED_DOCS / rows)
    every = max(1, int(size * share / 6 / (SAMPLES * parts)))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(SEED)
        for batch in batches:
            for block in blocks(batch, BLOCK_BYTES):
                for lang, raw in _by_language(block):
                    words, columns, n = grams(raw)
                    some = rng.choice(len(n), -(-int(n.sum()) // every), p=n / n.sum()) if len(n) else np.zeros(0, np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(some), pa.string()), words.joined([c[some] for c in columns]).cast(pa.binary())], names=["lang", "gram"])

    picked: dict[str, list[tuple[bytes, ...]]] = {}
    for row in texts.sample(share, SEED).mapInArrow(pick, "lang string, gram binary").toLocalIterator():
        picked.setdefault(row.lang, []).append(tuple(bytes(row.gram).split(b" ")))
    total = sum(map(len, picked.values()))
    chosen = {}
    for lang, found in picked.items():
        own, found = max(1, round(parts * len(found) / total)), sorted(found)
        chosen[lang] = sorted({found[len(found) * i // own] for i in range(1, own)})
    return chosen


def counts(docs: DataFrame, text: str, lang: str, least: int) -> DataFrame:
    """(lang, phrase, words, f): all grams of one to four words that occur ``least`` times and more, and
    with no words and an empty phrase the number of all words of the language."""
    texts = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"),
                        F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("_lang"))
    splitters = choose_splitters(texts)
    shared = docs.sparkSession.sparkContext.broadcast(splitters)
    packs = texts.mapInArrow(lambda batches: pack(batches, shared.value),
                             "lang string, part int, line_bytes long, lines binary, n_bytes long, n binary")
    partial = packs.groupBy("lang", "part").applyInArrow(
        lambda table: flows(table, shared.value, least), "lang string, phrase string, words int, f long")
    return cut_lineage(partial.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))
                       .filter((F.col("f") >= least) | (F.col("words") == 0)))


def _without(end: str) -> F.Column:
    return F.expr("substring_index(phrase, ' ', words - 1)" if end == "last" else "substring_index(phrase, ' ', 1 - words)")


def links(found: DataFrame) -> DataFrame:
    """(lang, node, a, b): nodes whose whole flow comes by edge ``a`` and goes on by edge ``b``."""
    edges = found.filter(F.col("words") == ORDER)
    nodes = found.filter(F.col("words") == ORDER - 1).select("lang", F.col("phrase").alias("node"), "f")
    into = edges.select("lang", _without("first").alias("node"), "f", F.col("phrase").alias("a"))
    out = edges.select("lang", _without("last").alias("node"), "f", F.col("phrase").alias("b"))
    return nodes.join(into, ["lang", "node", "f"]).join(out, ["lang", "node", "f"]).select("lang", "node", "a", "b")


def paths(found: DataFrame, linked: DataFrame, rounds: int = 40) -> DataFrame:
    """(lang, phrase, path, place, path_words) of every edge: the last edge of its unary path, how many
    edges lie between, and the words of the whole path.

    A round doubles the stretch that every edge looks ahead; edges that have reached their last one
    leave, so a round costs no more than the stretches that are still open.
    """
    edges = found.filter(F.col("words") == ORDER).select("lang", F.col("phrase").alias("a"))
    state = cut_lineage(edges.join(linked.select("lang", "a", "b"), ["lang", "a"], "left")
                        .select("lang", "a", F.coalesce("b", "a").alias("b"), F.col("b").isNotNull().cast("long").alias("steps"),
                                F.col("b").isNull().alias("done")))
    for _ in range(rounds):
        if state.filter("not done").isEmpty():
            break
        ahead = state.select("lang", F.col("a").alias("b"), F.col("b").alias("_b"), F.col("steps").alias("_steps"), F.col("done").alias("_done"))
        walked = state.filter("not done").join(ahead, ["lang", "b"]).select(
            "lang", "a", F.col("_b").alias("b"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_done").alias("done"))
        state = cut_lineage(walked.unionByName(state.filter("done")))
    else:
        raise RuntimeError("paths did not end")
    size = state.groupBy("lang", "b").agg((F.max("steps") + ORDER).alias("path_words"))
    return state.join(size, ["lang", "b"]).select("lang", F.col("a").alias("phrase"), F.col("b").alias("path"), F.col("steps").alias("place"), "path_words")


def passages(found: DataFrame, least_words: int = 2 * ORDER) -> DataFrame:
    """(lang, passage, words, f): the compacted paths of ``least_words`` words and more.

    A path is put together in one row, which is no longer than a text it comes from.
    """
    on_path = paths(found, cut_lineage(links(found))).filter(F.col("path_words") >= least_words)
    with_flow = on_path.join(found.select("lang", "phrase", "f"), ["lang", "phrase"])
    first = F.max_by("phrase", "place")
    tail = F.array_sort(F.collect_list(F.struct((-F.col("place")).alias("at"), F.substring_index("phrase", " ", -1).alias("w"))))
    return with_flow.groupBy("lang", "path").agg(first.alias("head"), tail.alias("tail"), F.min("f").alias("f"), F.max("path_words").alias("words")).select(
        "lang", F.array_join(F.concat(F.array("head"), F.transform(F.slice("tail", 2, F.size("tail")), lambda t: t["w"])), " ").alias("passage"), "words", "f")


def collocations(docs: DataFrame, text: str, lang: str, least: int = 30, top: int = 2000, share: int = 80) -> DataFrame:
    """Each language's first ``top`` phrases of two to four words by the strength of their weakest cut.

    lang, rank, phrase, a (its count), l and r (counts of the two parts), n (words of the language),
    score, path_words (words of the unary path that a phrase of four words lies on, else its own).
    Phrases that a longer one holds in ``share`` hundredths of their occurrences are left out.
    """
    found = counts(docs, text, lang, least)
    linked = cut_lineage(links(found))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    candidates = found.filter("words >= 2")
    # What lies in a phrase two words longer lies in one a word longer that is as frequent or more.
    around = candidates.filter("words >= 3")
    longer = around.select("lang", "f", F.explode(F.array(_without("last"), _without("first"))).alias("phrase")).groupBy(
        "lang", "phrase").agg(F.max("f").alias("most"))
    inside = linked.select("lang", F.col("node").alias("phrase")).distinct()
    open_ = candidates.join(inside, ["lang", "phrase"], "left_anti").join(longer, ["lang", "phrase"], "left").filter(
        F.coalesce(100 * wide("most") < share * wide("f"), F.lit(True))).select("lang", "phrase", "words", F.col("f").alias("a"))
    cut = open_.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).withColumns({
        "first": F.expr("substring_index(phrase, ' ', k)"), "rest": F.expr("substring_index(phrase, ' ', k - words)")})
    part = lambda name, count: found.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    scored = cut.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).withColumn(
        "score", F.expr("(2000000BD * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + r)"))
    weakest = scored.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select(
        "lang", "phrase", F.col("words").cast("long").alias("words"), "a", "cut.l", "cut.r", "cut.score")
    # The planner keeps each task's first ``top`` of a language before it shuffles them.
    strongest = W.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc())
    best = cut_lineage(weakest.withColumn("rank", F.row_number().over(strongest)).filter(F.col("rank") <= top))
    on_path = paths(found, linked).select("lang", "phrase", "path_words")
    total = found.filter("words = 0").select("lang", F.col("f").alias("n"))
    return best.join(on_path, ["lang", "phrase"], "left").join(total, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score",
        F.coalesce("path_words", "words").alias("path_words"))
