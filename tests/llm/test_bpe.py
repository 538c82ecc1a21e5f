import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tableward.llm import bpe, queries

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
LETTERS = "abcdefghijklmnopqrstuvwxyz'stréÉßΣσçİ .,!12\n\t\xa0\x1c\x85̀ 日本語ﬁ"


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_equals_the_library(path):
    mine, library = bpe.PrefixBpe(path), Tokenizer.from_file(path)
    rng = random.Random(3)
    texts = ["", " ", "a", "a" * 3000, "<|endoftext|>", "x<|endoftext|>y <|startoftext|>", "'S 'll don't", "̀a"]
    texts += ["".join(rng.choices(LETTERS, k=rng.randint(0, 60))) for _ in range(1500)]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert mine.encode(text) == ids, text
        assert mine.decode(ids).decode() == library.decode(ids, skip_special_tokens=False)


def test_cutting_at_white_space_changes_nothing():
    mine = bpe.PrefixBpe(WORD)
    pieces = bpe.Pieces(mine)
    rng = random.Random(4)
    for _ in range(500):
        text = "".join(rng.choices(LETTERS, k=rng.randint(0, 80)))
        assert b"".join(pieces[run][0] for run in text.encode().split()) == bpe.pack(mine.encode(text))


def test_every_prefix_has_one_token():
    """The stored token of each prefix is the last one of the prefix's own encoding."""
    mine = bpe.PrefixBpe(BYTE)
    for word in ("internationalisation", "aaaaaaaaaaaaaaaa", "thththththeheh"):
        for n in range(1, len(word) + 1):
            whole = mine.encode_word(word[:n])
            if len(whole) > 1:
                shorter = word[:n - len(mine.text_of[whole[-1]])]
                assert mine.encode_word(shorter) == whole[:-1]


def test_query_against_the_library(spark, small):
    library = Tokenizer.from_file(WORD)
    texts = {r.doc_id: r.text or "" for r in queries.documents(spark, small).collect()}
    found = queries.QUERIES["op10_bpe_prefix"](spark, small).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_edges(docs):
    df = docs([(None, "a b", None, None), (1, None, None, None), (1, None, None, None), (2, "", None, None)])
    found = {(r.doc_id, r.decoded): len(r["ids_"]) for r in bpe.encode_decode(
        df, "text", ["doc_id"], WORD).withColumnRenamed("ids", "ids_").collect()}
    assert found == {(None, "a</w> b</w>"): 8, (1, ""): 0, (2, ""): 0}
    assert bpe.encode_decode(df.limit(0), "text", ["doc_id"], WORD).count() == 0


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_every_code_point_equals_the_library(path):
    """All planes: assigned or not in this Python's tables, alone, among letters and among digits."""
    mine, library = bpe.PrefixBpe(path), Tokenizer.from_file(path)
    points = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000]
    # Far planes hold nothing but unassigned and private characters: every 31st.
    points = [c for n, c in enumerate(points) if ord(c) < 0x32000 or 0xE0000 <= ord(c) < 0xE0200 or n % 31 == 0]
    texts = [f"{c} a{c}b{c}{c} 1{c}!" for c in points]
    wrong = [t for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True) if mine.encode(t) != e.ids]
    assert not wrong, (len(wrong), wrong[:3])
