"""Document fingerprints from closed syncmers, in DataFrame expressions alone.

A k-mer of ``K`` code points is chosen if the least hash among its inner substrings of ``S`` code
points is that of its first or its last one.  Whether it is chosen depends on nothing around it, so a
passage has the same anchors wherever it stands.  An anchor is the hash of a chosen k-mer and the place
of its first occurrence.  A fingerprint holds the ``SIZE`` anchors of least hash of the whole text.

Likeness of two fingerprints: of the ``SIZE`` least hashes of their union, the share of those that
both hold and that stand in the same order in both, that is the longest chain of common anchors with
rising places.  Without the order it would be the usual estimate of the Jaccard similarity.

Texts are hashed as fixed-width code points in chunks of ``CHUNK`` places; a chunk's anchors are merged
into the fingerprint before the next is read, so memory does not grow with the text.  The edited text
takes the anchors that lie in what it keeps from the text's own; only k-mers that touch the borrowed
part are looked at anew.

Texts are shuffled once, by key, and a borrowed part once more.  Neighbours are found on keys alone, by
range-partitioned lags, so no task holds more than its share of them.

Contract: a text with fewer than ``K`` code points is one k-mer, an empty or null text has no anchors.
Two fingerprints without anchors are alike (1.0).  Documents follow each other by descending key, equal
keys by descending text hash, a null key last; after the last comes the first.  Of repeated rows all but the
last have a copy as next document.  An empty table gives no rows.  Only key and text are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableward.functions.ordered import with_neighbour

#: Code points of a k-mer and of its inner substrings; anchors kept; places of a chunk.
K, S, SIZE, CHUNK = 16, 9, 48, 4096
#: Bits of an anchor's place; its 32-bit hash lies above.
PLACE_BITS = 31
_NONE = "cast(array() as array<bigint>)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, though lambdas in it may use it often."""
    return F.transform(F.array(value), body)[0]


def _wide(text: Column) -> Column:
    """Four bytes a code point, so that any place is reached at once."""
    return F.encode(text, "UTF-32")


def _anchor(mer: Column, place: Column) -> Column:
    """Hash above, place below, not negative."""
    return F.shiftleft(F.xxhash64(mer).bitwiseAND(F.lit(0xFFFFFFFF)), PLACE_BITS).bitwiseOR(place)


def _hash(anchor: Column) -> Column:
    return F.shiftright(anchor, PLACE_BITS)


def _place(anchor: Column) -> Column:
    return anchor.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))


def _bound(h: Column, after: Callable[[Column], Column]) -> Column:
    return let(h, lambda a: F.zip_with(a, after(a), lambda x, y: F.least(x, y)))


def _window_least(h: Column, width: int) -> Column:
    """The least of each element and those after it, ``width`` (a power of two) in all."""
    reach = 1
    while reach < width:
        after = lambda a, r=reach: F.slice(a, r + 1, F.lit(2 * CHUNK))
        h, reach = _bound(h, after), 2 * reach
    return h


def _chunk_anchors(wide: Column, base: Column) -> Column:
    """Anchors of a chunk of at least K code points that begins at place ``base``."""
    span, half = K - S, (K - S + 1) // 2
    places = F.sequence(F.lit(0), (F.octet_length(wide) / 4).cast("int") - K)
    hashes = F.transform(F.sequence(F.lit(1), F.octet_length(wide) - (4 * S - 1), F.lit(4)),
                         lambda byte: F.xxhash64(F.substring(wide, byte, F.lit(4 * S))))
    # The least inner hash is that of the first or of the last inner substring: the least of its own half
    # and no more than that of the other half.
    closed = let(hashes, lambda h: let(_window_least(h, half), lambda m: F.filter(places, lambda i: (
        (F.get(h, i) == F.get(m, i)) & (F.get(h, i) <= F.get(m, i + half))) | (
        (F.get(h, i + span) == F.get(m, i + half)) & (F.get(h, i + span) <= F.get(m, i))))))
    return F.transform(closed, lambda i: _anchor(F.substring(wide, 4 * i + 1, F.lit(4 * K)), base + i))


def _first(ordered: Column) -> Column:
    """The ``SIZE`` least hashes of sorted anchors, each at its first place."""
    return F.slice(F.filter(ordered, lambda x, i: (i == 0) | (_hash(x) != _hash(F.get(ordered, i - 1)))), 1, SIZE)


def _least(anchors: Column) -> Column:
    """The ``SIZE`` least hashes, each at its first place."""
    return let(F.sort_array(anchors), _first)


def _merged(held: Column, ordered: Column) -> Column:
    """The least hashes of what is held and of sorted anchors behind it."""
    return F.when(F.size(held) == 0, let(ordered, _first)).otherwise(_least(F.concat(held, let(ordered, _first))))


def sketch(text: Column, length: Column, until: Column, base: Column | None = None) -> Column:
    """(own, head): anchors of a text whose places start at ``base``, and of its k-mers that end by ``until``."""
    return let(F.struct(length.alias("n"), until.alias("until"), (F.lit(0).cast("long") if base is None else base).alias("base")),
               lambda p: _sketch(text, p["n"], p["until"], p["base"]))


def _sketch(text: Column, length: Column, until: Column, base: Column) -> Column:
    whole = F.when(length > 0, F.array(_anchor(_wide(text), base))).otherwise(F.expr(_NONE))

    def merged(wide: Column) -> Column:
        def step(held: Column, chunk: Column) -> Column:
            at = chunk * CHUNK
            part = F.substring(wide, (4 * at + 1).cast("int"), F.lit(4 * (CHUNK + K - 1)))
            # Sorted once; what is merged with the anchors held is short.
            return let(F.sort_array(let(part, lambda p: _chunk_anchors(p, base + at))), lambda found: F.struct(
                _merged(held["own"], found).alias("own"),
                F.when(base + at + K <= until, _merged(held["head"], F.filter(found, lambda x: _place(x) <= until - K)))
                .otherwise(held["head"]).alias("head")))

        chunks = F.sequence(F.lit(0).cast("long"), F.floor((length - K) / CHUNK).cast("long"))
        return F.aggregate(chunks, F.struct(F.expr(_NONE).alias("own"), F.expr(_NONE).alias("head")), step)

    short = F.struct(whole.alias("own"), F.when(length <= until, whole).otherwise(F.expr(_NONE)).alias("head"))
    return F.when(length < K, short).otherwise(let(_wide(text), merged))


def likeness(one: Column, two: Column) -> Column:
    """Share of the least hashes of both fingerprints that they hold in common and in the same order."""
    def chain(pairs: Column) -> Column:
        """Longest rising run of places: per length the least place that ends such a run."""
        def step(ends: Column, p: Column) -> Column:
            return let(F.filter(ends, lambda e: e < p["two"]), lambda below: F.concat(
                below, F.array(p["two"]), F.slice(ends, F.size(below) + 2, F.lit(SIZE))))

        return F.size(F.aggregate(pairs, F.expr(_NONE), step))

    def share(b: Column) -> Callable[[Column], Column]:
        def of(least: Column) -> Column:
            top = F.element_at(least, -1)
            held = F.filter(one, lambda x: (_hash(x) <= top) & F.array_contains(b, _hash(x)))
            pairs = F.sort_array(F.transform(held, lambda x: F.struct(
                _place(x).alias("one"), _place(F.get(two, F.array_position(b, _hash(x)).cast("int") - 1)).alias("two"))))
            return chain(pairs) / F.size(least)

        return of

    both = let(F.transform(two, _hash), lambda b: let(
        F.slice(F.sort_array(F.array_union(F.transform(one, _hash), b)), 1, SIZE), share(b)))
    return F.when(one == two, F.lit(1.0)).when((F.size(one) == 0) | (F.size(two) == 0), F.lit(0.0)).otherwise(both)


def printed(fingerprint: Column) -> Column:
    """Sixteen hexadecimal digits an anchor."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def next_documents(rows: DataFrame) -> DataFrame:
    """(_id, _next, _times): distinct rows with the one that follows by descending key.

    An id is a struct, which is never null itself and equal to one with the same nulls.
    """
    ids = rows.groupBy("_id").agg(F.count(F.lit(1)).alias("_copies"))
    placed = with_neighbour(ids, [], ["_id"], {"_next": "_id"})
    # One row; there is no key to join by.
    found = placed.crossJoin(F.broadcast(ids.agg(F.max("_id").alias("_top")))).select(
        "_id", F.coalesce("_next", "_top").alias("_next"), "_copies")
    return found.select("_id", "_next", F.lit(1).cast("long").alias("_times")).unionByName(
        found.filter("_copies > 1").select("_id", F.col("_id").alias("_next"), (F.col("_copies") - 1).alias("_times")))


def edited_likeness(df: DataFrame, key: str, text: str) -> DataFrame:
    """Per row of ``df`` its fingerprint, that of its edited text, and how like it is to that and to the next.

    The edited text has the last half of the code points replaced by the first as many of the next
    document.  Columns: ``key``, n_chars, edited_sha256, fingerprint and edited_fingerprint (arrays of
    anchors), near_edited, near_next.
    """
    texts = df.select(F.col(key).alias("_key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    rows = texts.select(F.struct("_key", F.xxhash64("_text").alias("h"), F.length("_text").cast("long").alias("n")).alias("_id"), "_text")
    stays = lambda n: n - F.floor(n / 2)
    own = rows.withColumn("_sketch", sketch(F.col("_text"), F.col("_id.n"), stays(F.col("_id.n"))))
    # One exchange of texts, read by both joins.  Copies of a key and text are one row.
    held = own.groupBy("_id").agg(F.first("_text").alias("_text"), F.first("_sketch").alias("_sketch"))
    lender = held.select(*[F.col(c).alias(f"_l{c}") for c in held.columns])
    lent = next_documents(rows.select("_id")).join(lender, F.col("_next") == F.col("_l_id")).select(
        F.col("_id").alias("_r_id"), "_times", F.substring("_l_text", F.lit(1), F.floor(F.col("_id.n") / 2).cast("int")).alias("_lent"),
        F.col("_l_sketch.own").alias("_next"))
    met = held.join(lent, F.col("_id") == F.col("_r_id")).withColumns({"_key": F.col("_id._key"), "_n": F.col("_id.n")})

    first = F.substring("_text", F.lit(1), F.col("_stays").cast("int"))
    tail = F.substring("_text", F.greatest(F.col("_stays") - (K - 2), F.lit(1)).cast("int"), F.least(F.col("_stays"), F.lit(K - 1)).cast("int"))
    parts = met.withColumn("_stays", stays(F.col("_n"))).select(
        "_key", "_n", "_times", "_stays", F.col("_sketch.own").alias("_own"), F.col("_sketch.head").alias("_head"), "_next",
        F.concat(first, "_lent").alias("_edited"), F.concat(tail, "_lent").alias("_tail"))
    fresh = parts.withColumn("_fresh", F.when(F.length("_edited") < K, sketch(
        F.col("_edited"), F.length("_edited").cast("long"), F.lit(0).cast("long"))["own"]).when(F.length("_tail") >= K, sketch(
            F.col("_tail"), F.length("_tail").cast("long"), F.lit(0).cast("long"), F.greatest(F.col("_stays") - (K - 1), F.lit(0).cast("long")))["own"])
        .otherwise(F.expr(_NONE)))
    done = fresh.select(
        F.col("_key").alias(key), F.col("_n").alias("n_chars"), F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        F.col("_own").alias("fingerprint"), "_next", "_times",
        F.when(F.length("_edited") < K, F.col("_fresh")).otherwise(_least(F.concat("_head", "_fresh"))).alias("edited_fingerprint"))
    return done.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))).select(
        key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_next")).alias("near_next"))
