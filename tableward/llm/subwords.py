"""Quality classifier on learned subword embeddings.

A document is the average of the vectors of its hashed character n-grams (3 to 5 bytes of a word
with its borders), the average of those of its words and word pairs, and the average of those of
its word shapes; the three averages are added, and a softmax over two classes follows.  Vectors
and softmax are learned together by stochastic gradient descent in numpy from a bounded sample of
labelled rows.  As the model is linear behind the lookup, scoring folds the softmax into one
number per bucket, so a document costs a lookup per n-gram.

Contract: null and empty texts have no n-grams; their score is that of the bias alone.  A text is
read whole, in pieces of at most 65 536 bytes cut between words (longer words are cut); word pairs
do not span pieces.  Null ids count as held out.  Repeated rows are scored each on its own.  With
no labelled rows, or rows of one class only, every score is 0.5 or that class's bias.  Rows with
several labels take the least.  Columns besides those named pass through.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableward.llm.common import is_held_out, map_texts

BUCKET_BITS, DIMENSIONS = 15, 16
PIECE_BYTES = 1 << 16
BLOCK_BYTES = 1 << 19
#: Labelled rows of each class that the model is fitted on: the first in the order of a hash.
ROWS_PER_CLASS = 1500
EPOCHS, BATCH, RATE = 6, 32, 0.5
#: An average counts this many empty n-grams besides a text's own, so that a few n-grams decide less.
EMPTY = 8
_MIX = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(12)
_BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE_CODE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_BYTE_CLASS = np.full(256, 5, np.uint64)  # 0 lower, 1 upper, 2 digit, 3 stop, 4 other sign, 5 not ASCII
_BYTE_CLASS[:128] = 4
_BYTE_CLASS[97:123] = 0
_BYTE_CLASS[65:91] = 1
_BYTE_CLASS[48:58] = 2
_BYTE_CLASS[list(b".,;:")] = 3


def pieces(text: bytes) -> list[bytes]:
    """Words between single blanks, in pieces of bounded size."""
    words = text.split()
    if not words:
        return []
    if len(text) <= PIECE_BYTES:
        return [b" " + b" ".join(words) + b" "]
    found, open_words, size = [], [], 0
    for long_word in words:
        for at in range(0, len(long_word), PIECE_BYTES // 2):
            w = long_word[at:at + PIECE_BYTES // 2]
            if size + len(w) + 1 > PIECE_BYTES:
                found.append(b" " + b" ".join(open_words) + b" ")
                open_words, size = [], 0
            open_words.append(w)
            size += len(w) + 1
    return [*found, b" " + b" ".join(open_words) + b" "]


def _bucket(code: np.ndarray, salt: int) -> np.ndarray:
    code = (code + np.uint64(salt)) * _MIX
    code ^= code >> np.uint64(31)
    code *= np.uint64(0xBF58476D1CE4E5B9)
    return (code >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def hashed(block: list[tuple[int, bytes]]) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """For pieces of documents: per family, arrays of (document, bucket)."""
    raw = np.frombuffer(b"".join([p for _, p in block]), np.uint8)
    sizes = np.array([len(p) for _, p in block])
    owner = np.repeat(np.array([d for d, _ in block], np.int32), sizes)
    blank = raw == 32
    wide = raw.astype(np.uint64)
    # Characters: an n-gram may begin or end with the blank at a word's border, but not hold one.
    after = np.where(blank, np.arange(len(raw)), len(raw))
    next_blank = np.minimum.accumulate(after[::-1])[::-1]
    reach = np.full(len(raw), 0)
    reach[:-1] = np.where(blank[:-1], next_blank[1:], next_blank[:-1]) - np.arange(len(raw) - 1) + 1
    chars, code = [], wide.copy()
    for n in range(2, 6):
        code = code[:-1] | (wide[n - 1:] << np.uint64(8 * (n - 1))) if len(code) > 1 else code[:0]
        if n >= 3:
            ok = reach[:len(code)] >= n
            chars.append((owner[:len(code)][ok], _bucket(code[ok], n)))
    # Words.
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    ends = np.flatnonzero(~blank[:-1] & blank[1:])
    if not len(starts):
        return [chars, [], []]
    place = np.arange(len(raw)) - np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, len(raw)]))
    signed = np.where(blank, np.uint64(0), _BYTE_CODE[raw] * _PLACE_CODE[place & 63] + (place.astype(np.uint64) >> np.uint64(6)))
    word = np.add.reduceat(signed, starts)
    of = owner[starts]
    length = (ends - starts + 1).astype(np.uint64)
    pair = of[1:] == of[:-1]
    # A pair spans no two pieces: their border has two blanks.
    pair &= starts[1:] - ends[:-1] == 2
    both = word[:-1] * np.uint64(3) + word[1:]
    shape = _BYTE_CLASS[raw[starts]] * np.uint64(6) + _BYTE_CLASS[raw[ends]]
    shape = shape * np.uint64(8) + np.minimum(length, np.uint64(31)) // np.uint64(4)
    # A pair of equal words is a shape of its own, whatever the word.
    shapes = (shape[:-1] * np.uint64(2048) + shape[1:]) * np.uint64(2) + (word[:-1] == word[1:])
    same = (word[:-1] == word[1:]).astype(np.uint64)
    return [chars,
            [(of, _bucket(word, 11)), (of[1:][pair], _bucket(both[pair], 12))],
            [(of, _bucket(shape, 13)), (of[1:][pair], _bucket(shapes[pair], 14)), (of[1:][pair], _bucket(same[pair], 15))]]


def blocks_of(texts: list[bytes | None]):
    """Lists of (document, piece) of about ``BLOCK_BYTES``."""
    block, size = [], 0
    for d, t in enumerate(texts):
        for p in pieces(t) if t else []:
            block.append((d, p))
            size += len(p)
            if size >= BLOCK_BYTES:
                yield block
                block, size = [], 0
    if block:
        yield block


def averages(texts: list[bytes | None], value: np.ndarray) -> np.ndarray:
    """Per document the sum over families of the mean of ``value`` over its buckets."""
    n = len(texts)
    sums, counts = np.zeros((3, n)), np.zeros((3, n))
    for block in blocks_of(texts):
        for f, family in enumerate(hashed(block)):
            for owner, bucket in family:
                first, last = block[0][0], block[-1][0] + 1
                sums[f, first:last] += np.bincount(owner - first, value[bucket], last - first)
                counts[f, first:last] += np.bincount(owner - first, minlength=last - first)
    return (sums / (counts + EMPTY)).sum(axis=0)


def bags(texts: list[bytes | None]) -> list[pa.Array]:
    """Per document its buckets (packed uint16) and their weights (packed float16)."""
    buckets, weights = [], []
    for t in texts:
        total = np.zeros((3, 1 << BUCKET_BITS))
        for block in blocks_of([t]):
            for f, family in enumerate(hashed(block)):
                for _, bucket in family:
                    total[f] += np.bincount(bucket, minlength=1 << BUCKET_BITS)
        total /= total.sum(axis=1, keepdims=True) + EMPTY
        total = total.sum(axis=0)
        held = np.flatnonzero(total)
        buckets.append(held.astype(np.uint16).tobytes())
        # Scaled, as float16 has few digits near zero.
        weights.append((total[held] * 1000).astype(np.float16).tobytes())
    return [pa.array(buckets, pa.binary()), pa.array(weights, pa.binary())]


def fit(rows: list[tuple[int, bytes, bytes]], seed: int = 5) -> tuple[np.ndarray, float]:
    """Value of each bucket and bias, for log odds of class 1, from (label, buckets, weights)."""
    size = 1 << BUCKET_BITS
    labels = np.array([r[0] for r in rows], np.int64)
    if not len(rows):
        return np.zeros(size, np.float32), 0.0
    held = [(np.frombuffer(b, np.uint16), np.frombuffer(w, np.float16).astype(np.float32) / 1000) for _, b, w in rows]
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (size, DIMENSIONS)).astype(np.float32)
    out = rng.normal(0, 0.1, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    steps, done = EPOCHS * -(-len(rows) // BATCH), 0
    bag = np.zeros((BATCH, size), np.float32)
    speed = [np.zeros_like(x) for x in (vectors, out, bias)]
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            chosen = order[at:at + BATCH]
            bag[:] = 0
            for i, r in enumerate(chosen):
                bag[i, held[r][0]] = held[r][1]
            x = bag[:len(chosen)]
            document = x @ vectors
            z = document @ out + bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            error = z / z.sum(axis=1, keepdims=True)
            error[np.arange(len(chosen)), labels[chosen]] -= 1
            error /= len(chosen)
            rate = RATE * (1 - done / steps)
            grads = (x.T @ (error @ out.T), document.T @ error, error.sum(axis=0))
            # Steps are scaled by the gradients seen so far, as rare buckets learn from few rows.
            for p, g, s in zip((vectors, out, bias), grads, speed, strict=True):
                s += g * g
                p -= rate * g / (np.sqrt(s) + 1e-6)
            done += 1
    side = out[:, 1] - out[:, 0]
    return (vectors @ side).astype(np.float32), float(bias[1] - bias[0])


def train(df: DataFrame, labels: DataFrame, key: str, text: str, label: str, modulus: int, remainder: int,
          per_class: int = ROWS_PER_CLASS) -> tuple[np.ndarray, float]:
    """A model from at most ``per_class`` labelled rows of each class that are not held out."""
    known = (labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~is_held_out(F.col(key), modulus, remainder))
             .groupBy(F.col(key).alias("_k")).agg(F.min(label).cast("int").alias("_y")))
    have = known.join(df.select(F.col(key).alias("_k")).distinct(), "_k", "left_semi")
    first = [have.filter(F.col("_y") == y).orderBy(F.xxhash64("_k"), "_k").limit(per_class) for y in (0, 1)]
    # At most twice per_class rows.
    chosen = F.broadcast(first[0].union(first[1]))
    rows = df.select(F.col(key).alias("_k"), F.col(text).alias("_t")).join(chosen, "_k")
    # Of rows with one id the least text counts.
    single = rows.groupBy("_k", "_y").agg(F.min("_t").alias("_t"))
    made = map_texts(single, "_t", ["_y", "_k"], bags, "buckets binary, weights binary")
    return fit([(r["_y"], r["buckets"], r["weights"]) for r in sorted(made.collect(), key=lambda r: r["_k"])])


def score(df: DataFrame, text: str, keep: list[str], model: tuple[np.ndarray, float]) -> DataFrame:
    """``keep`` plus ``score``, the probability of class 1."""
    value, bias = df.sparkSession.sparkContext.broadcast(model[0]), model[1]

    def work(texts: list[bytes | None], value: np.ndarray) -> list[pa.Array]:
        return [pa.array(1 / (1 + np.exp(-(averages(texts, value) + bias))), pa.float64())]

    load: Callable[[], np.ndarray] = lambda: value.value
    return map_texts(df, text, keep, work, "score double", setup=load)
