import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tableward.llm import packing, queries

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, texts, top=1024):
    """Every id in one piece, gapless windows, little padding.  ``rows`` as dicts of one document each."""
    by_doc, by_window = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_window.setdefault(r["sequence_id"], []).append(r)
    assert by_doc.keys() == texts.keys()
    library = Tokenizer.from_file(BYTE)
    for doc, own in by_doc.items():
        ids = library.encode(texts[doc] or "", add_special_tokens=False).ids + [0]
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at:at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for own in by_window.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= top and at & (at - 1) == 0 and at == own[0]["tier"]


def test_query(spark, small):
    texts = {r.doc_id: r.text for r in queries.documents(spark, small).collect()}
    check([r.asDict() for r in queries.QUERIES["op8_hierarchical_packing"](spark, small).collect()], texts)


def test_step_groups_hold_the_same_tokens(spark, small):
    rows = packing.pack(queries.documents(spark, small), "text", ["doc_id"], BYTE).collect()
    windows = {(r.step_group, r.sequence_id): r.tier for r in rows}
    totals = {}
    for (group, _), tier in windows.items():
        totals.setdefault(group, [tier, 0])
        assert totals[group][0] == tier
        totals[group][1] += tier
    assert all(t <= packing.STEP_TOKENS for _, t in totals.values())
    full = sum(t == packing.STEP_TOKENS for _, t in totals.values())
    assert full >= len(totals) - 12  # one open group per window size


def test_runs_equal_the_library():
    ids, library = packing.RunIds(BYTE), Tokenizer.from_file(BYTE)
    for text in ("a b", "a  b", " a", "a ", "a\nb c", "a\n\nb", "a\tb", "a b", "x <|endoftext|>\ny", "\0 a", "é à\nß",
                 "don't we'll 12.5% \U0001f600 ok", "a b", "\n", " "):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids.of(text), "<u4").tolist() == want, text


def test_short_documents_fill_gaps_of_long_ones():
    p = packing.Packer()
    for n, size in enumerate([900, 100, 24, 600, 400]):
        p.add(n, b"\1\0\0\0" * size)
    p.finish()
    windows = {}
    for doc, _, n, seq, *_ in p.out:
        windows.setdefault(seq, []).append((doc, n))
    assert windows[0] == [(0, 900), (1, 100), (2, 24)]
    assert sum(n for w in windows.values() for _, n in w) == 2024
    assert all((t := sum(n for _, n in w)) & (t - 1) == 0 for w in windows.values())


def test_edges(docs):
    df = docs([(None, "a", None, None), (1, None, None, None), (1, None, None, None), (2, "", None, None),
               (3, "word " * 5000, None, None)])
    rows = packing.pack(df, "text", ["doc_id", "source"], BYTE).collect()
    assert sum(r.length for r in rows if r.doc_id == 1) == 2 and sum(r.length for r in rows if r.doc_id == 2) == 1
    assert sum(r.length for r in rows if r.doc_id == 3) == next(r.doc_tokens for r in rows if r.doc_id == 3)
    assert packing.pack(df.limit(0), "text", ["doc_id"], BYTE).count() == 0


def test_tiers_and_step_groups_hold_over_many_splits(spark):
    """A hundred splits of a few documents each: groups are full and few windows are below the tiers."""
    df = queries.documents(spark, "/root/testdata/sf0.01").repartition(100)
    rows = packing.pack(df, "text", ["doc_id"], BYTE).select("sequence_id", "tier", "step_group").distinct().collect()
    groups = {}
    for r in rows:
        groups[r.step_group] = groups.get(r.step_group, 0) + r.tier
    assert sum(t == packing.STEP_TOKENS for t in groups.values()) >= 0.9 * len(groups)
    assert sum(r.tier < packing.TIERS[0] for r in rows) <= 0.05 * len(rows)
