import random
import re
import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))

import oracle  # noqa: E402

from tableward.llm import collocations as co  # noqa: E402
from tableward.llm import queries  # noqa: E402

UPPER = {c: chr(c + 32) for c in range(65, 91)}


def brute(rows, least=30, top=2000, share=80):
    """{(lang, rank): (phrase, a, l, r, n, score)} of (text, lang)."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i:i + k])] += 1
    found, made = {p: c for p, c in f.items() if c >= least and len(p[1]) > 1}, {}
    for lang in n:
        ranked = []
        for (own, p), a in found.items():
            if own != lang or any(o == lang and 100 * c >= share * a and len(q) > len(p) and any(
                    q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (o, q), c in found.items()):
                continue
            cuts = [(2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            ranked.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(ranked)[:top], 1):  # noqa: E741
            made[lang, rank] = (phrase.decode(), -a, l, r, n[lang], -score)
    return made


def found(docs, rows, **options):
    df = docs([(i, t, g, None) for i, (t, g) in enumerate(rows)])
    return {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in co.collocations(df, "text", "lang", **options).collect()}


def babble(seed, n):
    """Texts of few words, so that phrases recur, with a passage that most of them share."""
    rng = random.Random(seed)
    words = ["the", "The", "of", "a", "state", "art", "new", "york", "city", "in", "ÉTÉ", "x\x01", "0"]
    passage = "once upon a time there was a very long passage that many texts share word by word"
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b"]) for _ in range(rng.randrange(60)))
        rows.append((text + (passage if rng.random() < 0.6 else ""), rng.choice(["en", "en", "en", "fr", None])))
    return rows


@pytest.mark.parametrize("part,block", [(16 << 20, 8 << 20), (900, 2000)])
def test_phrases_are_those_of_brute_force(docs, monkeypatch, part, block):
    """In one part, and in dozens of parts whose edges split words, pairs and nodes."""
    monkeypatch.setattr(co, "PART_BYTES", part)
    monkeypatch.setattr(co, "BLOCK_BYTES", block)
    rows = babble(4, 300)
    want = brute(rows)
    assert len(want) > 40 and found(docs, rows) == want
    assert found(docs, rows, least=5, top=7) == brute(rows, 5, 7)


def test_counts_over_many_parts(docs, monkeypatch):
    monkeypatch.setattr(co, "PART_BYTES", 700)
    rows = babble(8, 120)
    df = docs([(i, t, g, None) for i, (t, g) in enumerate(rows)])
    assert len(co.choose_splitters(df.selectExpr("coalesce(text, '') as _text", "coalesce(lang, 'und') as _lang"))["en"]) > 10
    want = Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\x0A-\x0D]", text.translate(UPPER)):
            words = re.findall("[^\x20\x09]+", piece)
            want["und" if lang is None else lang, "", 0] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    want["und" if lang is None else lang, " ".join(words[i:i + k]), k] += 1
    got = {(r.lang, r.phrase, r.words): r.f for r in co.counts(df, "text", "lang", 3).collect()}
    assert got == {key: c for key, c in want.items() if c >= 3 or key[2] == 0}


def test_passages(docs):
    passage = "once upon a time there was a very long passage that many texts share word by word"
    rows = [(f"w{i} {passage} v{i}", "en") for i in range(40)] + [("once upon a", "fr")]
    df = docs([(i, t, g, None) for i, (t, g) in enumerate(rows)])
    made = [tuple(r) for r in co.passages(co.counts(df, "text", "lang", 30)).collect()]
    assert made == [("en", passage, 17, 40)]


def test_edges(docs):
    rows = [(None, None), ("", "en"), (" \t.,\n", "en"), ("a b " * 20000, "en"), ("word", None)] + [("a b", "en")] * 3
    assert found(docs, rows) == brute(rows)
    assert found(docs, rows[:0]) == {}
    assert found(docs, [("one two", None)] * 30) == {("und", 1): ("one two", 30, 30, 30, 60, 1000000)}


def test_query(spark, small):
    df = queries.QUERIES["op13_de_bruijn_phrases"](spark, small)
    same, note = oracle.compare(df, oracle.connect(small), queries.SQL["op13_de_bruijn_phrases"])
    assert same, note
