import hashlib

import pytest
import xxhash
from pyspark.sql import functions as F

from tableward.llm import fingerprints as fp
from tableward.llm import queries


def mer_hash(text):
    return xxhash.xxh64_intdigest(text.encode("utf-32-be"), 42)


def signed(n):
    return n - (1 << 64) if n >> 63 else n


def fingerprint(text):
    """The whole text at once, from the definition."""
    if len(text) < fp.K:
        chosen = [(0, text)] if text else []
    else:
        chosen = []
        for i in range(len(text) - fp.K + 1):
            inner = [signed(mer_hash(text[i + j:i + j + fp.S])) for j in range(fp.K - fp.S + 1)]
            if min(inner) in (inner[0], inner[-1]):
                chosen.append((i, text[i:i + fp.K]))
    first = {}
    for place, mer in chosen:
        first.setdefault(mer_hash(mer) & 0xFFFFFFFF, place)
    return sorted((h << fp.PLACE_BITS) | p for h, p in first.items())[:fp.SIZE]


def likeness(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    ha, hb = ({x >> fp.PLACE_BITS: x & ((1 << fp.PLACE_BITS) - 1) for x in f} for f in (a, b))
    least = sorted(set(ha) | set(hb))[:fp.SIZE]
    pairs = sorted((ha[h], hb[h]) for h in least if h in ha and h in hb)
    runs = []
    for n, (_, q) in enumerate(pairs):
        runs.append(1 + max((runs[m] for m in range(n) if pairs[m][1] < q), default=0))
    return max(runs, default=0) / len(least)


def brute(rows):
    """Sorted (key, n_chars, edited digest, fingerprints, likeness) of (key, text)."""
    texts = [(k, t or "") for k, t in rows]
    order = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, signed(xxhash.xxh64_intdigest(r[1].encode(), 42)), len(r[1])), reverse=True)
    made = []
    for (k, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        edited = t[:len(t) - half] + u[:half]
        a, b, c = fingerprint(t), fingerprint(edited), fingerprint(u)
        made.append((k, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, round(likeness(a, b), 9), round(likeness(a, c), 9)))
    return sorted(made, key=repr)


def found(df):
    rows = fp.edited_likeness(df, "doc_id", "text").collect()
    return sorted([(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9))
                   for r in rows], key=repr)


@pytest.mark.parametrize("chunk", [4096, 64])
def test_rows_are_those_of_the_definition(spark, small, monkeypatch, chunk):
    monkeypatch.setattr(fp, "CHUNK", chunk)
    df = queries.documents(spark, small).filter("length(text) < 3000")
    assert found(df) == brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])


def test_edges(docs):
    long = "".join(chr(97 + (n * n // 7) % 26) for n in range(9000))
    texts = ["", None, "a", "ab", "x" * 15, "x" * 16, "y" * 17, "z" * 500, "é𝔘 " * 40, long, long[:4500] + "!" + long[4500:], long]
    rows = [(n, t, None, None) for n, t in enumerate(texts)]
    rows += [(None, "no key " * 9, None, None), (None, None, None, None), (5, "other text of key five", None, None)]
    rows += [(3, "ab", None, None)] * 4  # repeated rows
    assert found(docs(rows)) == brute([r[:2] for r in rows])
    one = docs([(1, "the only document there is", None, None)])
    assert found(one) == brute([(1, "the only document there is")])
    assert found(one.limit(0)) == []


def test_likeness_grows_with_what_is_shared(docs, small, spark):
    text = spark.read.parquet(f"{small}/documents.parquet").filter("length(text) > 5000").first().text
    rows = [(n, text[: len(text) * n // 10] + text[::-1][: len(text) * (10 - n) // 10], None, None) for n in range(11)]
    prints = {r.doc_id: r.fingerprint for r in fp.edited_likeness(docs(rows), "doc_id", "text").collect()}
    near = [likeness(prints[10], prints[n]) for n in range(11)]
    assert near[10] == 1.0 and near[0] < 0.1 and all(a <= b + 0.15 for a, b in zip(near, near[1:], strict=False))


def test_query(spark, small, capsys):
    df = queries.QUERIES["op11_closed_syncmers"](spark, small)
    df.explain("formatted")
    assert "Python" not in (plan := capsys.readouterr().out) and "Arrow" not in plan
    rows = df.collect()
    assert len(rows) == queries.documents(spark, small).count() and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    same = queries.documents(spark, small).groupBy("text").agg(F.collect_list("doc_id").alias("ids")).filter("size(ids) > 1").collect()
    prints = {r.doc_id: r.fingerprint for r in rows}
    assert same and all(len({prints[i] for i in r.ids}) == 1 for r in same)
