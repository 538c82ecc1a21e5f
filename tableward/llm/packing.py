"""Hierarchical packing of documents into context windows of several lengths.

Each task tokenizes and packs the documents of its own input split, so nothing is shuffled, no
state outgrows a block of texts, and a lost task comes back with the same windows.  Splits that hold
little text are read several to a task, so that what a task leaves open at its end stays a small part.

A document (its ids and a separator) that is longer than the largest tier is cut into windows of
that tier.  The rest is routed to the smallest tier that holds it.  Tiers are packed from the
longest down: a document opens a window of its tier, and the gap behind it is filled from shorter
tiers, the longest fitting document first; if none fits, the last one is cut to the gap.  What is
left at the end of a split becomes windows of powers of two, which need no padding.  Windows of
one tier are dealt to step groups that hold the same number of tokens.

Contract: a null or empty text has the separator alone.  A text of any length is tokenized whole
and may span many windows.  Repeated rows are packed each on its own.  An empty table gives no
pieces.  Columns besides the text pass through to every piece.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tableward.llm.bpe import BYTE_LEVEL_PATTERN, byte_symbols
from tableward.llm.common import arrow_fields, blocks, text_bytes

TIERS = (128, 256, 512, 1024)
#: Tokens of a step group.
STEP_TOKENS = 8192
#: Text that a task holds at least, where splits are smaller.
TASK_BYTES = 8 << 20
#: Runs of text a worker remembers before it starts afresh; decides speed and memory only.
REMEMBERED = 400_000
ID_BYTES = 4


class RunIds(dict):
    """Packed ids of texts; runs between single blanks and line breaks are remembered.

    A byte-level tokenizer never merges over such a border: the blank belongs to the run behind
    it, a line break stands alone.  Texts with any other white space go to the library whole.
    """

    def __init__(self, path: str):
        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        back = {c: b for b, c in byte_symbols().items()}
        ranks = {bytes(back[c] for c in token): n for token, n in spec["model"]["vocab"].items()
                 if token not in self.special}
        # The same vocabulary as ranks: a short text is encoded without the cost of a library call.
        self.short = tiktoken.Encoding("short", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, run: str) -> bytes:
        if any(s in run for s in self.special):
            ids = self.library.encode(run, add_special_tokens=False).ids
        else:
            ids = self.short.encode_ordinary(run)
        found = b"".join([i.to_bytes(ID_BYTES, "little") for i in ids])
        if len(run) <= 40:
            if len(self) > REMEMBERED:
                self.clear()
            self[run] = found
        return found

    def of(self, text: str) -> bytes:
        words = text.split()
        if words and "\0" not in text and len(text) == sum(map(len, words)) + len(words) - 1:
            runs = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
            if len(runs) - text.count("\n") == len(words):
                return b"".join([self[r] for r in runs])
        ids = self.library.encode(text, add_special_tokens=False).ids
        return b"".join([i.to_bytes(ID_BYTES, "little") for i in ids])


class Packer:
    """Windows of one split.  A piece is [document number, first id, ids]."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, base: int = 0):
        self.tiers, self.step_tokens, self.base = tiers, step_tokens, base
        self.pools: dict[int, deque] = {t: deque() for t in tiers}
        self.sequences = 0
        self.groups = 0
        self.open_group: dict[int, tuple[int, int]] = {}
        self.out: list[tuple] = []

    def add(self, document, ids: bytes) -> None:
        top, total = self.tiers[-1], len(ids) // ID_BYTES
        start = 0
        while total - start >= top:
            self._window(top, [(document, start, ids[start * ID_BYTES:(start + top) * ID_BYTES])])
            start += top
        if start < total:
            self._pool((document, start, ids[start * ID_BYTES:]))

    def _pool(self, piece: tuple) -> None:
        n = len(piece[2]) // ID_BYTES
        self.pools[next(t for t in self.tiers if t >= n)].append(piece)

    def _window(self, size: int, pieces: list[tuple]) -> None:
        group, used = self.open_group.get(size, (None, 0))
        if group is None or used + size > self.step_tokens:
            group, used = self.base + self.groups, 0
            self.groups += 1
        self.open_group[size] = (group, used + size)
        offset = 0
        for document, start, ids in pieces:
            n = len(ids) // ID_BYTES
            self.out.append((document, start, n, self.base + self.sequences, offset, size, group, ids))
            offset += n
        self.sequences += 1

    def _fill(self, gap: int, below: list[int]) -> list[tuple]:
        """Pieces of exactly ``gap`` tokens from the pools of ``below``, long ones first."""
        found = []
        for t in below:
            pool = self.pools[t]
            while gap and pool and len(pool[0][2]) // ID_BYTES <= gap:
                found.append(pool.popleft())
                gap -= len(found[-1][2]) // ID_BYTES
        for t in reversed(below):
            if gap and self.pools[t]:
                document, start, ids = self.pools[t].popleft()
                cut = gap * ID_BYTES
                found.append((document, start, ids[:cut]))
                if len(ids) > cut:
                    self._pool((document, start + gap, ids[cut:]))
                gap = max(0, gap - len(ids) // ID_BYTES)
                if gap:
                    return found + self._fill(gap, below)
        return found

    def pack(self) -> None:
        """Windows of every tier, as long as a tier and those below it hold a whole window."""
        held = {t: sum(len(p[2]) for p in pool) // ID_BYTES for t, pool in self.pools.items()}
        for k in range(len(self.tiers) - 1, -1, -1):
            size, reach = self.tiers[k], list(reversed(self.tiers[:k + 1]))
            left = sum(held[t] for t in reach)
            while self.pools[size] and left >= size:
                self._window(size, self._fill(size, reach))
                left -= size
            held = {t: sum(len(p[2]) for p in pool) // ID_BYTES for t, pool in self.pools.items()}

    def finish(self) -> None:
        """Windows of what is left, as powers of two."""
        self.pack()
        every = list(reversed(self.tiers))
        left = sum(len(p[2]) for pool in self.pools.values() for p in pool) // ID_BYTES
        while left:
            size = min(self.tiers[-1], 1 << (left.bit_length() - 1))
            self._window(size, self._fill(size, every))
            left -= size


_LOADED: dict[str, RunIds] = {}


def _ids(path: str) -> RunIds:
    if path not in _LOADED:
        _LOADED[path] = RunIds(path)
    return _LOADED[path]


def pack(df: DataFrame, text: str, keep: list[str], path: str, separator: int = 0,
         tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row per piece: ``keep``, ``start``, ``length``, ``doc_tokens``, ``sequence_id``,
    ``offset``, ``tier`` (tokens of the window), ``step_group`` and ``ids`` (packed little-endian
    unsigned 32-bit)."""
    fields, names = arrow_fields(df, keep, "start long, length long, doc_tokens long, sequence_id long, offset long, "
                                           "tier int, step_group long, ids binary")
    end = separator.to_bytes(ID_BYTES, "little")

    def rows(kept: dict, out: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
        which = [kept[r[0]] for r in out]
        first = [pa.array([w[0][i] for w in which], t) for i, t in enumerate(types)]
        numbers = [pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.int64()),
                   pa.array([w[1] for w in which], pa.int64()), pa.array([r[3] for r in out], pa.int64()),
                   pa.array([r[4] for r in out], pa.int64()), pa.array([r[5] for r in out], pa.int32()),
                   pa.array([r[6] for r in out], pa.int64()), pa.array([r[7] for r in out], pa.binary())]
        return pa.RecordBatch.from_arrays([*first, *numbers], names=fields.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _ids(path)
        packer = Packer(tiers, step_tokens, base=TaskContext.get().partitionId() << 40)
        kept: dict[int, tuple] = {}
        number, types = 0, []
        for batch in batches:
            types = [c.type for c in batch.columns[1:]]
            for part in blocks(batch, 4 << 20):
                values = list(zip(*(c.to_pylist() for c in part.columns[1:]), strict=True)) or [()] * part.num_rows
                for t, row in zip(text_bytes(part.column(0)), values, strict=True):
                    ids = (ids_of.of(t.decode("utf-8", "replace")) if t else b"") + end
                    kept[number] = (row, len(ids) // ID_BYTES)
                    packer.add(number, ids)
                    number += 1
                packer.pack()
                if packer.out:
                    yield rows(kept, packer.out, types)
                    packer.out.clear()
                waiting = {p[0] for pool in packer.pools.values() for p in pool}
                kept = {k: v for k, v in kept.items() if k in waiting}
        packer.finish()
        if packer.out:
            yield rows(kept, packer.out, types)

    texts = df.select(F.col(text).cast("string").alias("_text_in"), *keep)
    size = texts.agg(F.coalesce(F.sum(F.octet_length("_text_in")), F.lit(0))).first()[0]
    # Joins splits and moves no rows; more tasks than splits stay as many as there are splits.
    return texts.coalesce(max(1, -(-size // TASK_BYTES))).mapInArrow(run, fields).toDF(*names)
