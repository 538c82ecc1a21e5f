"""Language of web pages by Bayesian fusion of evidence.

Text: byte trigrams of the visible text under models counted over all labelled documents.  Declared
language and address suffix: likelihoods counted over all pages, each page weighted by what its
text says.  Host: a prior smoothed towards its domain's, and that towards the prior of all pages;
a page's own text is left out of its host's prior.  All counts are grouped aggregations; models
have one row per language and bucket, per suffix, per declared value and per host.

Contract: null and empty pages have no text evidence; their host, suffix and declaration decide.
A null address is a host of its own.  Pages are read whole; unclosed tags end at the page's end.
Ties go to the language that comes first in the alphabet.  Repeated rows are judged each on its
own.  Without labelled documents the language is null.  Languages without a row in the labelled
documents are never answered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableward.llm.common import cut_lineage, map_texts

BUCKET_BITS = 14
#: Trigrams overlap: a text counts as at most this many independent ones.
EFFECTIVE = 60
#: Pseudo-pages of the level above in a host's or domain's prior, and of the mean in a likelihood.
HOST_WEIGHT, EVIDENCE_WEIGHT = 5.0, 20.0
_HTML = re.compile(rb"<html\b[^>]*", re.I)
_LANG = re.compile(rb"\blang\s*=\s*[\"']?\s*([A-Za-z]{2,8})", re.I)
_TRIGRAM = np.uint32(0x9E3779B1)


def visible(html: bytes) -> bytes:
    """Text outside tags, comments, scripts and styles."""
    low, out, at = html.lower(), [], 0
    while True:
        i = html.find(b"<", at)
        if i < 0:
            out.append(html[at:])
            break
        out.append(html[at:i])
        if low.startswith(b"<!--", i):
            close, size = low.find(b"-->", i + 4), 3
        else:
            name = next((n for n in (b"script", b"style") if low.startswith(n, i + 1)), None)
            j = low.find(b"</" + name, i) if name else i
            close, size = (low.find(b">", j) if j >= 0 else -1), 1
        if close < 0:
            break
        at = close + size
    return b" ".join(out)


def trigrams(text: bytes) -> np.ndarray:
    """Buckets of the byte trigrams of lower-case words."""
    line = b" " + b" ".join(text.decode("utf-8", "replace").lower().encode().split()) + b" "
    raw = np.frombuffer(line, np.uint8).astype(np.uint32)
    code = raw[:-2] | raw[1:-1] << np.uint32(8) | raw[2:] << np.uint32(16)
    return (code * _TRIGRAM) >> np.uint32(32 - BUCKET_BITS) if len(raw) > 3 else code[:0]


def language_models(docs: DataFrame, text: str, lang: str) -> tuple[list[str], np.ndarray]:
    """Languages, and log-likelihoods of trigram buckets (languages x buckets), from all rows."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for t, g in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist(), strict=True):
                if g not in total:
                    total[g] = np.zeros(1 << BUCKET_BITS, np.int64)
                for at in range(0, len(t), 1 << 20):
                    total[g] += np.bincount(trigrams(t[at:at + (1 << 20)]), minlength=1 << BUCKET_BITS)
        for g, n in total.items():
            held = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(held), pa.string()), pa.array(held.astype(np.int32)),
                                              pa.array(n[held])], names=["lang", "bucket", "n"])

    sums = (docs.select(F.col(text).cast("string").alias("_t"), F.col(lang).cast("string").alias("_l"))
            .filter("_t is not null and _l is not null").mapInArrow(count, "lang string, bucket int, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect())
    langs = sorted({r["lang"] for r in sums})
    counts = np.full((len(langs), 1 << BUCKET_BITS), 0.5)
    place = {g: n for n, g in enumerate(langs)}
    for r in sums:
        counts[place[r["lang"]], r["bucket"]] += r["n"]
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True))


def read_pages(pages: DataFrame, html: str, url: str, keep: list[str], model: np.ndarray) -> DataFrame:
    """``keep`` columns, ``_url``, ``declared`` and ``text_ll``, log-likelihoods of the visible text."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def work(htmls: list[bytes | None], model: np.ndarray) -> list[pa.Array]:
        declared, lls = [], []
        for h in htmls:
            found = next(filter(None, (_LANG.search(tag[0]) for tag in _HTML.finditer(h or b""))), None)
            declared.append(found[1][:2].lower().decode() if found else "")
            grams = trigrams(visible(h)) if h else np.zeros(0, np.int64)
            if len(grams):
                seen = np.bincount(grams, minlength=1 << BUCKET_BITS)
                at = np.flatnonzero(seen)
                lls.append((model[:, at] @ seen[at] * min(1.0, EFFECTIVE / len(grams))).tolist())
            else:
                lls.append([0.0] * len(model))
        return [pa.array(declared, pa.string()), pa.array(lls, pa.list_(pa.float64()))]

    return map_texts(pages.withColumn("_url", F.col(url).cast("string")), html, [*keep, "_url"], work,
                     "declared string, text_ll array<double>", setup=lambda: shared.value)


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    raised = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def _sums(df: DataFrame, by: list[str], vector: str, size: int, count: Column) -> DataFrame:
    return df.groupBy(*by).agg(F.sum(count).alias("n"), F.array(*[F.sum(F.col(vector)[i]) for i in range(size)]).alias("s"))


def _likelihood(df: DataFrame, by: str, size: int, totals: list[float], name: str) -> DataFrame:
    """Log P(value | language) per value of ``by``, smoothed towards the value's share of all pages."""
    counted = _sums(df, [by], "text_post", size, F.lit(1.0))
    n = sum(totals) or 1.0
    logs = F.array(*[F.log((F.col("s")[i] + F.lit(EVIDENCE_WEIGHT) * F.col("n") / F.lit(n)) / F.lit(totals[i] + EVIDENCE_WEIGHT))
                     for i in range(size)])
    return counted.select(F.col(by).alias(f"_{by}"), logs.alias(name))


def identify(pages: DataFrame, docs: DataFrame, key: str, url: str, html: str, text: str, lang: str) -> DataFrame:
    """``key``, ``lang``, ``confidence``, ``text_lang``, ``declared``, ``host`` and ``posterior`` per page."""
    langs, model = language_models(docs, text, lang)
    k = len(langs)
    if not k:
        empty = pages.select(F.col(key), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"))
        return empty.select("*", F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("declared"),
                            F.lit(None).cast("string").alias("host"), F.lit(None).cast("array<double>").alias("posterior"))
    shell = pages.select(F.struct(F.col(key).alias("key")).alias("_keep"), F.col(url).alias("_u"), F.col(html).alias("_h"))
    host = F.coalesce(F.lower(F.regexp_extract("_url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    read = cut_lineage(
        read_pages(shell, "_h", "_u", ["_keep"], model).select("_keep", "declared", "text_ll", host.alias("host"))
        .withColumn("domain", F.substring_index("host", ".", -2)).withColumn("suffix", F.substring_index("host", ".", -1))
        .withColumn("text_post", _softmax(F.col("text_ll"))))
    hosts = cut_lineage(_sums(read, ["host", "domain"], "text_post", k, F.lit(1.0)))
    domains = hosts.groupBy("domain").agg(F.sum("n").alias("dn"), F.array(*[F.sum(F.col("s")[i]) for i in range(k)]).alias("ds"))
    total = domains.agg(*[F.sum(F.col("ds")[i]).alias(f"s{i}") for i in range(k)]).first()
    totals = [float(total[f"s{i}"] or 0.0) for i in range(k)]
    share = F.array(*[F.lit((t + 1) / (sum(totals) + k)) for t in totals])
    smooth = F.lit(HOST_WEIGHT)
    domains = domains.select(F.col("domain").alias("_domain"), F.zip_with(
        "ds", share, lambda s, p: (s + smooth * p) / (F.col("dn") + smooth)).alias("domain_prior"))
    priors = hosts.join(domains, F.col("domain") == F.col("_domain")).select(
        F.col("host").alias("_host"), F.col("s").alias("host_sum"), F.col("n").alias("host_n"), "domain_prior")
    prior = F.transform(F.arrays_zip("host_sum", "text_post", "domain_prior"), lambda z: F.greatest(
        (z["host_sum"] - z["text_post"] + smooth * z["domain_prior"]) / (F.col("host_n") - 1 + smooth), F.lit(1e-9)))
    declared = _likelihood(read, "declared", k, totals, "declared_ll")
    suffix = _likelihood(read, "suffix", k, totals, "suffix_ll")
    joined = (read.join(priors, F.col("host") == F.col("_host")).join(suffix, F.col("suffix") == F.col("_suffix"))
              .join(declared, F.col("declared") == F.col("_declared")))
    logs = F.transform(F.arrays_zip("text_ll", "declared_ll", "suffix_ll", prior.alias("prior")), lambda z:
                       z["text_ll"] + z["declared_ll"] + z["suffix_ll"] + F.log(z["prior"]))
    names = F.array(*[F.lit(g) for g in langs])

    def best(column: str) -> Column:
        return F.element_at(names, F.array_position(column, F.array_max(column)).cast("int"))

    return joined.withColumn("posterior", _softmax(logs)).select(
        F.col("_keep.key").alias(key), best("posterior").alias("lang"), F.array_max("posterior").alias("confidence"),
        best("text_ll").alias("text_lang"), "declared", "host", "posterior")
