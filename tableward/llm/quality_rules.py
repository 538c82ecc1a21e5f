"""Quality rules whose limits come from the data: quantile sketches per language and source.

Every document is measured in one pass.  The measures of documents that pass the base rule are
summarised by KLL sketches per (language, source); the sketches of a language are merges of its
sources' sketches, the overall ones merges of the languages'.  A limit is a fence: the median plus
a multiple of a spread, that of the quartiles or, where most texts have none of what is measured, that
of the last hundredth; with a least reach per measure, so that a measure that is constant in clean text
does not reject the first deviation.  A group with few
documents uses the limits of its language, a language with few those of the whole table.

Contract: a null text has no words; it fails the base rule, as does an empty one.  Null languages
and sources are groups of their own.  Texts are measured whole.  Repeated rows are judged each on
its own.  An empty table gives no rows.  Columns besides those named pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableward.llm.common import cut_lineage, map_texts

WHITE = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS, REPEAT_PERCENT = 20, 30
#: Documents a group needs for limits of its own.
MIN_GROUP = 200
SKETCH_K = 800
#: Measure: (expression, spread, multiple of it, least reach from the median, low side too).  Spread lies
#: between two quantiles: the quartiles, or where most texts have 0, the median and the last hundredth.
#: The least reach of the repeated words ends below the base rule's 0.30, so that this limit can reject.
QUARTILES, TAIL = (0, 2), (1, 3)
MEASURES = {
    "symbol_rate": ("try_divide(n_symbols, word_chars)", QUARTILES, 8.0, 0.08, False),
    "dup_line_rate": ("try_divide(n_dup_lines, n_lines)", TAIL, 3.0, 0.35, False),
    "repeat_rate": ("try_divide(n_repeat_words, n_words)", TAIL, 1.0, 0.285, False),
    "word_length": ("try_divide(word_chars, n_words)", QUARTILES, 6.0, 3.0, True),
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURED = (*BASE, "n_lines")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    codes: dict[bytes, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.uint64, len(words))
    if len(codes) == len(words):
        return 0
    with np.errstate(over="ignore"):
        mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        windows = np.zeros(n, np.uint64)
        for k in range(window):
            windows = windows * np.uint64(0x100000001B3) + mixed[k:k + n]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:n] += twice
    edges[window:window + n] -= twice
    return int((np.cumsum(edges[:-1]) > 0).sum())


def measure(texts: list[bytes | None]) -> list[pa.Array]:
    rows = []
    for t in texts:
        t = t or b""
        words = t.split()
        solid = t.translate(None, WHITE)
        lines = [line for line in t.split(b"\n") if line.strip()]
        rows.append((len(words), len(solid.decode("utf-8", "replace")),
                     len(solid) - len(solid.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
                     repeated_words(words), len(lines)))
    columns = zip(*rows, strict=True) if rows else [[]] * len(MEASURED)
    return [pa.array(c, pa.int64()) for c in columns]


def _sketches(groups: DataFrame, by: list[str], merge: bool) -> DataFrame:
    """Sketches per group of ``by``, from measures or from finer sketches."""
    made = (F.kll_merge_agg_double if merge else F.kll_sketch_agg_double)
    return groups.groupBy(*by).agg(
        F.sum("_n" if merge else F.lit(1)).alias("_n"), *[made(m, SKETCH_K).alias(m) for m in MEASURES])


def _limits(sketches: DataFrame) -> DataFrame:
    """A struct ``limits`` of fences from the sketches' quartiles."""
    fences = []
    for m, (_, spread, times, least, low) in MEASURES.items():
        # A sketch of nothing has no quantiles.
        q = F.when(F.coalesce("_n", F.lit(0)) > 0, F.kll_sketch_get_quantile_double(
            F.col(m), F.array(*map(F.lit, (0.25, 0.5, 0.75, 0.99)))))
        reach = F.greatest((q[spread[1]] - q[spread[0]]) * times, F.lit(least))
        fences += [(q[1] + reach).alias(f"{m}_high"), *([(q[1] - reach).alias(f"{m}_low")] if low else [])]
    return sketches.withColumn("limits", F.struct(*fences)).drop(*MEASURES)


def thresholds(measured: DataFrame, lang: str, source: str, min_group: int = MIN_GROUP) -> DataFrame:
    """Limits per (language, source) from documents that pass the base rule; (lang, source, limits).

    ``level`` names the group whose sketches were used.
    """
    passed = measured.filter("not base_failed").select(
        F.col(lang).alias("_lang"), F.col(source).alias("_source"),
        *[F.expr(e).cast("double").alias(m) for m, (e, *_) in MEASURES.items()])
    fine = cut_lineage(_sketches(passed, ["_lang", "_source"], merge=False))
    by_lang = _sketches(fine, ["_lang"], merge=True)
    overall = _limits(_sketches(by_lang, [], merge=True)).select(F.col("limits").alias("_all"))
    pairs = measured.select(F.col(lang).alias("_lang"), F.col(source).alias("_source")).distinct()

    def large(limits: DataFrame) -> DataFrame:
        return limits.filter(F.col("_n") >= min_group)

    own = large(_limits(fine)).select(F.col("_lang").alias("_l"), F.col("_source").alias("_s"),
                                      F.col("limits").alias("_own"))
    wide = large(_limits(by_lang)).select(F.col("_lang").alias("_wl"), F.col("limits").alias("_wide"))
    return (pairs.join(own, F.col("_lang").eqNullSafe(F.col("_l")) & F.col("_source").eqNullSafe(F.col("_s")), "left")
            .join(wide, F.col("_lang").eqNullSafe(F.col("_wl")), "left")
            .join(F.broadcast(overall), F.lit(True), "left")  # one row
            .select("_lang", "_source", F.coalesce("_own", "_wide", "_all").alias("limits"),
                    F.when(F.col("_own").isNotNull(), "source").when(F.col("_wide").isNotNull(), "lang")
                    .otherwise("all").alias("level")))


def _verdict() -> Column:
    """Whether every measure lies within its limits; without limits nothing is rejected."""
    within = F.lit(True)
    for m, (e, *_, low) in MEASURES.items():
        value = F.expr(e).cast("double")
        within = within & F.coalesce(value <= F.col(f"limits.{m}_high"), F.lit(True))
        if low:
            within = within & F.coalesce(value >= F.col(f"limits.{m}_low"), F.lit(True))
    return within


def judge(df: DataFrame, text: str, lang: str, source: str, keep: list[str], min_group: int = MIN_GROUP) -> DataFrame:
    """``keep``, the base measures, ``base_failed``, ``kept``, and the ``level`` and ``limits`` used."""
    shell = df.select(text, F.struct(*keep).alias("_keep"), F.col(lang).cast("string").alias("_dl"),
                      F.col(source).cast("string").alias("_ds"))
    measured = cut_lineage(
        map_texts(shell, text, ["_keep", "_dl", "_ds"], measure, ", ".join(f"{b} long" for b in MEASURED))
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                    | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))))
    limits = thresholds(measured, "_dl", "_ds", min_group)
    joined = measured.join(limits, F.col("_dl").eqNullSafe(F.col("_lang")) & F.col("_ds").eqNullSafe(F.col("_source")),
                           "left")
    return joined.select("_keep.*", *BASE, "base_failed",
                         (~F.col("base_failed") & _verdict()).alias("kept"), "level", "limits")
