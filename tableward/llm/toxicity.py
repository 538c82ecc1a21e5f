"""Toxicity after noisy-channel deobfuscation.

1. Character model: trigram counts of all documents, aggregated by Spark over a bounded alphabet.
2. Channel: a written run of signs is read as a lattice.  Each sign stands for itself, for a letter
   it can imitate (digits and signs for letters), for nothing (separators, repeated letters).
   Letters written one by one are read as one run, in which a blank may be kept.  Viterbi decoding
   finds the reading of least cost: channel cost plus trigram cost.
3. Score: how strongly the restored words, and their beginnings and endings, go with toxic rows.
   The three strongest words of a text are combined as independent evidence.  Evidence is counted
   per text on a bounded sample of labelled rows, copies once.  Clear words, and parts that
   several words share, are kept as they are; of the rest those that explain toxic rows that no feature before them explains.

Contract: null and empty texts score the rate of toxic rows among those sampled (0.5 without
any).  Texts are read whole; runs of any length are decoded in linear time.  Null ids count as
held out.  Rows with several labels take the greatest.  Repeated rows are scored each on its own.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableward.llm.common import cut_lineage, is_held_out, map_texts

#: Signs and the letters they imitate.
IMITATED = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "&": "a", "%": "", "#": "h", "€": "e",
    "£": "l", "¡": "i", "§": "s", "ø": "o", "*": "aeiou",
}
#: Costs in nats of reading a sign as a letter, of dropping a separator, of dropping a
#: repeated letter, of dropping a sign that could be a letter, of keeping a blank between letters.
AS_LETTER, DROP_SEPARATOR, DROP_REPEAT, DROP_SIGN, KEPT_BLANK = 1.0, 0.3, 0.5, 12.0, 1.5
INVISIBLE = "\u200b\u200c\u200d\u00ad\u2060"
SEPARATORS = frozenset(".-_*~^'`/\\,:;" + INVISIBLE)
EDGE = "".join(c for c in "\"'()[]{}<>.,;:!?*#$%&|~^-_=+/\\`“”‘’«»¿¡")
ALPHABET_BITS = 6
#: Labelled rows that the evidence is counted on: all classes together, in the order of a hash.
LABELLED_ROWS = 24_000
#: Pseudo-rows of the base rate that a feature's rate is shrunk with.
SHRINK = 2.0
#: Features kept: those that go with toxic rows, at most this many, the strongest first.
KEPT_FEATURES, LEAST_RATE = 200_000, 0.3
#: Toxic rows that a feature must explain.
LEAST_ROWS = 4
#: Rate and toxic rows of a whole word that is kept as it is, and of a beginning or ending, where
#: the rows of its most frequent word do not count.
CLEAR_WORD, CLEAR_PART = (0.75, 15), (0.9, 10)
#: Words a worker remembers before it starts afresh; decides speed and memory only.
REMEMBERED = 300_000
_REPEATED = re.compile(r"(.)\1\1")
_DOUBLED = re.compile(r"(.)\1+")
_LONG_REPEAT = re.compile(r"(\S )\1{3,}")
_UNSEEN = str.maketrans({c: None for c in INVISIBLE})


def letter(c: str) -> int:
    """Place of a lower-case letter in the alphabet; 0 is the word border, rare letters share places."""
    if "a" <= c <= "z":
        return ord(c) - 96
    return 27 + ord(c) % ((1 << ALPHABET_BITS) - 27) if c.isalpha() else 0


_LATIN = np.array([letter(chr(i).lower()[0]) for i in range(0x180)], np.int64)


def trigram_counts(texts: list[bytes | None], size: int = 1 << 3 * ALPHABET_BITS) -> np.ndarray:
    total = np.zeros(size, np.int64)
    for t in texts:
        for at in range(0, len(t or b""), 1 << 20):  # pieces bound memory; their borders count as words'
            codes = np.frombuffer(t[at:at + (1 << 20)].decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
            place = np.where(codes < 0x180, _LATIN[np.minimum(codes, 0x17F)], 27 + codes % 37)
            place = np.r_[0, 0, place, 0, 0].astype(np.int64)
            total += np.bincount((place[:-2] << 12) | (place[1:-1] << 6) | place[2:], minlength=size)
    return total


class CharModel:
    """Costs of a letter behind two others, interpolated over trigrams, bigrams and letters."""

    def __init__(self, counts: np.ndarray):
        n = 1 << ALPHABET_BITS
        three = counts.reshape(n, n, n).astype(float)
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        p1 = (one + 1) / (one.sum() + n)
        p2 = (two + 20 * p1) / (two.sum(axis=1, keepdims=True) + 20)
        p3 = (three + 20 * p2[None]) / (three.sum(axis=2, keepdims=True) + 20)
        self.cost = (-np.log(p3)).reshape(-1).tolist()


def char_model(df: DataFrame, text: str) -> CharModel:
    """Trigram counts over all rows: summed per task, then per trigram, then fetched (a bounded table)."""
    def count(batches):
        total = np.zeros(1 << 3 * ALPHABET_BITS, np.int64)
        for b in batches:
            total += trigram_counts(b.column(0).cast(pa.binary()).to_pylist())
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["gram", "n"])

    sums = df.select(F.col(text).cast("string").alias("_t")).mapInArrow(count, "gram int, n long").groupBy("gram").agg(
        F.sum("n").alias("n")).collect()
    counts = np.zeros(1 << 3 * ALPHABET_BITS, np.int64)
    for r in sums:
        counts[r["gram"]] = r["n"]
    return CharModel(counts)


def viterbi(run: str, cost: list[float]) -> str:
    """The likeliest reading of a lower-case run of signs; a blank in it may be kept or dropped."""
    shift, mask = ALPHABET_BITS, (1 << 2 * ALPHABET_BITS) - 1
    # State: the last two letters; value: cost and the chain of letters read so far.
    states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
    before = ""
    for c in run:
        made: dict[int, tuple[float, tuple | None]] = {}
        options: list[tuple[str, float]] = []
        if c.isalpha():
            options.append((c, 0.0))
        options += [(x, AS_LETTER) for x in IMITATED.get(c, "")]
        if c == " ":
            options.append((" ", KEPT_BLANK))
        if c in SEPARATORS or c == " ":
            drop = DROP_SEPARATOR
        elif c == before:
            drop = DROP_REPEAT
        elif c.isalpha():
            drop = None
        else:
            drop = DROP_SIGN
        for state, (so_far, chain) in states.items():
            if drop is not None and (state not in made or so_far + drop < made[state][0]):
                made[state] = (so_far + drop, chain)
            for x, channel in options:
                at = letter(x[0])
                total = so_far + channel + cost[(state << shift) | at]
                new = ((state << shift) | at) & mask
                if new not in made or total < made[new][0]:
                    made[new] = (total, (x, chain))
        if not made:
            made = states
        # Far costlier readings cannot win any more.
        least = min(v[0] for v in made.values())
        states = {k: v for k, v in made.items() if v[0] <= least + 25}
        before = c
    border = {k: (v[0] + cost[k << shift], v[1]) for k, v in states.items()}
    chain = min(border.values(), key=lambda v: v[0])[1]
    found = []
    while chain is not None:
        found.append(chain[0])
        chain = chain[1]
    return "".join(reversed(found))


def plain(word: str) -> bool:
    return word.isalpha() and not _REPEATED.search(word)


class Restorer(dict):
    """Remembers the restored words of a written word."""

    def __init__(self, cost: list[float]):
        super().__init__()
        self.cost = cost

    def read(self, written: bytes) -> tuple[str, ...]:
        text = written.decode("utf-8", "replace").lower()
        core = text.strip(EDGE).translate(_UNSEEN)
        if plain(core):
            once = _DOUBLED.sub(r"\1", core)
            found = (core,) if once == core else (core, once)
        elif not any(c.isalpha() for c in text):
            found = ()
        else:
            # Signs at either edge may be letters or punctuation: every reading counts.
            forms = (core, text.rstrip(EDGE), text.lstrip(EDGE), text)
            found = tuple(dict.fromkeys(w for w in (viterbi(f, self.cost) for f in dict.fromkeys(forms)) if w))
        return found

    def __missing__(self, written: bytes) -> tuple[str, ...]:
        found = self.read(written)
        if len(written) <= 40:
            if len(self) > REMEMBERED:
                self.clear()
            self[written] = found
        return found

    def spaced(self, letters: list[bytes]) -> tuple[str, ...]:
        """Words written letter by letter."""
        run = " ".join(x.decode("utf-8", "replace").lower() for x in letters)
        run = _LONG_REPEAT.sub(r"\1\1\1", run + " ").strip()
        return tuple(w for w in viterbi(run, self.cost).split() if w)


def spelled(written: list[bytes]) -> list[list[bytes]]:
    """Runs of three or more one-letter words that are not all the same."""
    found, run = [], []
    for w in [*written, b"--"]:
        if len(w) == 1 or len(w) == 2 and w[0] > 0x7F:
            run.append(w)
        elif run:
            if len(run) >= 3 and len(set(run)) > 1:
                found.append(run)
            run = []
    return found


def restored_words(text: bytes, words: Restorer) -> set[str]:
    written = text.split()
    found = {w for x in set(written) for w in words[x]}
    for run in spelled(written):
        found.update(words.spaced(run))
    return found


def features(word: str) -> list[str]:
    """The word, its beginnings and its endings."""
    return [f"={word}", *(f"<{word[:n]}" for n in range(4, min(8, len(word)))),
            *(f">{word[-n:]}" for n in range(5, min(8, len(word))))]


class Evidence(dict):
    """Remembers the strongest rate among a written word's restored words."""

    def __init__(self, rates: dict[str, float], words: Restorer):
        super().__init__()
        self.rates, self.words = rates, words

    def of(self, restored_words) -> float:
        get = self.rates.get
        return max((get(f, 0.0) for w in restored_words for f in features(w)), default=0.0)

    def __missing__(self, written: bytes) -> float:
        found = self.of(self.words.read(written))
        if len(written) <= 40:
            if len(self) > REMEMBERED:
                self.clear()
            self[written] = found
        return found


def score_text(text: bytes | None, evidence: Evidence, base: float) -> float:
    written = (text or b"").split()
    # Without words, or where all labelled rows were of one class, nothing tells texts apart.
    if not written or base in (0, 1):
        return float(base)
    found = [evidence[w] for w in set(written)]
    found += [evidence.of(evidence.words.spaced(run)) for run in spelled(written)]
    top = sorted((r for r in found if r), reverse=True)[:3]
    if not top:
        return 0.0
    odds = base / (1 - base)
    total = odds
    for r in top:
        total *= r / (1 - r) / odds
    return total / (1 + total)


def train(df: DataFrame, labels: DataFrame, key: str, text: str, label: str, modulus: int, remainder: int,
          model: CharModel, rows: int = LABELLED_ROWS) -> tuple[dict[str, float], float]:
    """Rates of toxic rows per feature, and the base rate, from at most ``rows`` labelled rows."""
    known = (labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~is_held_out(F.col(key), modulus, remainder))
             .groupBy(F.col(key).alias("_k")).agg(F.max(label).cast("int").alias("_y"))
             .join(df.select(F.col(key).alias("_k")).distinct(), "_k", "left_semi"))
    # At most ``rows`` rows.
    chosen = F.broadcast(known.orderBy(F.xxhash64("_k"), "_k").limit(rows))
    docs = (df.select(F.col(key).alias("_k"), F.col(text).cast("string").alias("_t")).join(chosen, "_k")
            # Equal texts count once, as toxic if one of them is.
            .filter(F.col("_t").isNotNull()).groupBy("_t").agg(F.max("_y").alias("_y")))
    shared = df.sparkSession.sparkContext.broadcast(model.cost)

    def count(batches):
        words = Restorer(shared.value)
        seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        total = [0, 0]

        def flush():
            table = pa.RecordBatch.from_arrays([
                pa.array(["", *seen], pa.string()), pa.array([total[0], *(v[0] for v in seen.values())], pa.int64()),
                pa.array([total[1], *(v[1] for v in seen.values())], pa.int64())], names=["f", "clean", "toxic"])
            seen.clear()
            total[:] = [0, 0]
            return table

        for b in batches:
            for t, y in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[y] += 1
                for f in {f for w in restored_words(t, words) for f in features(w)}:
                    seen[f][y] += 1
                if len(seen) > 500_000:
                    yield flush()
        yield flush()

    sums = docs.select("_t", "_y").mapInArrow(count, "f string, clean long, toxic long").groupBy("f").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    sums = cut_lineage(sums.filter(f"f = '' or toxic >= {LEAST_ROWS}"))
    top = sums.filter("f = ''").first()
    clean, toxic = (top["clean"], top["toxic"]) if top else (0, 0)
    if not clean + toxic:
        return {}, 0.5
    base = toxic / (clean + toxic)
    rate = (F.col("toxic") + F.lit(SHRINK * base)) / (F.col("toxic") + F.col("clean") + F.lit(SHRINK))
    strong = (sums.filter("f <> ''").filter(rate >= max(base, LEAST_RATE))
              .orderBy(F.desc("toxic"), "f").limit(KEPT_FEATURES))
    counts = {r["f"]: (r["toxic"], r["clean"]) for r in strong.collect()}
    held = df.sparkSession.sparkContext.broadcast(counts)

    def present(batches):
        words = Restorer(shared.value)
        for b in batches:
            found = [sorted({f for w in restored_words(t, words) for f in features(w) if f in held.value})
                     for t in b.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], names=["fs"])

    # At most ``rows`` lists of features.
    lists = [r["fs"] for r in docs.filter("_y = 1").select("_t").mapInArrow(present, "fs array<string>").collect()]
    return explaining(lists, counts, base), base


def explaining(lists: list[list[str]], counts: dict[str, tuple[int, int]], base: float) -> dict[str, float]:
    """Rates of the features that explain the toxic rows, chosen by the rows that are left."""
    rows_of = defaultdict(set)
    for n, fs in enumerate(lists):
        for f in fs:
            rows_of[f].add(n)

    def merit(f: str) -> tuple[float, int]:
        new = len(rows_of[f])
        return (new + SHRINK * base) / (new + counts[f][1] + SHRINK) * math.log1p(new), new

    # Merits only fall as rows are explained, so a stale one at the top is renewed and put back.
    heap = [(-merit(f)[0], -len(f), f) for f in rows_of]
    heapq.heapify(heap)
    every = {f: (t + SHRINK * base) / (t + c + SHRINK) for f, (t, c) in counts.items()}
    words = sorted((f for f in rows_of if f[0] == "="), key=lambda f: (len(rows_of[f]), f))
    top_word = {part: w for w in words for part in features(w[1:]) if part[0] != "="}
    chosen = {}
    for f, rows in rows_of.items():
        if f[0] == "=":
            clear = every[f] >= CLEAR_WORD[0] and len(rows) >= CLEAR_WORD[1]
        else:
            others = len(rows - rows_of.get(top_word.get(f, ""), set()))
            clear = (others >= CLEAR_PART[1]
                     and (others + SHRINK * base) / (others + counts[f][1] + SHRINK) >= CLEAR_PART[0])
        if clear:
            chosen[f] = every[f]
    explained = set().union(*(rows_of[f] for f in chosen))
    while heap:
        old, size, f = heapq.heappop(heap)
        rows_of[f] -= explained
        now, new = merit(f)
        if new < LEAST_ROWS:
            continue
        if -now > old + 1e-12:
            heapq.heappush(heap, (-now, size, f))
            continue
        if (new + SHRINK * base) / (new + counts[f][1] + SHRINK) >= 0.5:
            chosen[f] = every[f]
            explained |= rows_of[f]
    return chosen


def score(df: DataFrame, text: str, keep: list[str], model: CharModel, rates: dict[str, float], base: float) -> DataFrame:
    """``keep`` plus ``score``: the likelihood that a text is toxic."""
    shared = df.sparkSession.sparkContext.broadcast((model.cost, rates))

    def setup() -> Evidence:
        cost, held = shared.value
        return Evidence(held, Restorer(cost))

    def work(texts: list[bytes | None], evidence: Evidence) -> list[pa.Array]:
        return [pa.array([score_text(t, evidence, base) for t in texts], pa.float64())]

    return map_texts(df, text, keep, work, "score double", setup=setup)


def deobfuscate(df: DataFrame, text: str, keep: list[str], model: CharModel) -> DataFrame:
    """``keep`` plus ``restored``: the text with every written word in its likeliest reading."""
    shared = df.sparkSession.sparkContext.broadcast(model.cost)

    def work(texts: list[bytes | None], words: Restorer) -> list[pa.Array]:
        return [pa.array([None if t is None else _restore(t, words) for t in texts], pa.string())]

    return map_texts(df, text, keep, work, "restored string", setup=lambda: Restorer(shared.value))


def _restore(text: bytes, words: Restorer) -> str:
    written = text.split()
    out, at = [], 0
    for run in spelled(written):
        while written[at:at + len(run)] != run:
            out += words[written[at]][:1]
            at += 1
        out += words.spaced(run)
        at += len(run)
    return " ".join([*out, *(x for w in written[at:] for x in words[w][:1])])
