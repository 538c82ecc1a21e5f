import zlib

import numpy as np
import pytest

from tableward.llm import queries, subwords, toxicity


def held_out(doc_id, modulus, remainder):
    return zlib.crc32(str(doc_id).encode()) % modulus == remainder


def accuracy(spark, folder, query, label, modulus, remainder):
    labels = {r.doc_id: r[label] for r in queries.labels(spark, folder).collect()}
    found = queries.QUERIES[query](spark, folder).collect()
    ids = [r.doc_id for r in queries.documents(spark, folder).select("doc_id").collect()]
    assert sorted(r.doc_id for r in found) == sorted(ids)
    assert all(0 <= r.score <= 1 and r.held_out == held_out(r.doc_id, modulus, remainder) for r in found)
    judged = [(r.predicted, labels[r.doc_id]) for r in found if r.held_out and r.doc_id in labels]
    return found, sum(p == y for p, y in judged) / len(judged)


def test_quality_on_held_out_rows(spark):
    found, right = accuracy(spark, "/root/testdata/sf0.01", "op7_subword_quality", "quality", 5, 0)
    assert right > 0.93 and all(r.predicted == (r.score >= 0.3) for r in found)


def test_toxicity_on_held_out_rows(spark):
    found, right = accuracy(spark, "/root/testdata/sf0.1", "op3_noisy_channel_toxicity", "toxic", 3, 1)
    assert right > 0.95 and all(r.predicted == (r.score >= 0.7) for r in found)


def test_buckets_equal_a_plain_count():
    """Vectorised n-grams against loops over words."""
    text = b"Ab ab!! ab  \xc3\xa9t\xc3\xa9\nab"
    families = subwords.hashed([(0, subwords.pieces(text)[0])])
    line = b" " + b" ".join(text.split()) + b" "
    grams = [line[i:i + n] for n in (3, 4, 5) for i in range(len(line) - n + 1) if b" " not in line[i + 1:i + n - 1]]
    assert sum(len(o) for o, _ in families[0]) == len(grams)
    assert len({int(b) for _, bs in families[0] for b in bs}) <= len(set(grams))
    words = text.split()
    assert len(families[1][0][0]) == len(words) and len(families[1][1][0]) == len(words) - 1
    single = {w: b for w, b in zip(words, families[1][0][1].tolist(), strict=True)}
    assert len(set(single.values())) == len(set(words))
    assert families[2][2][1].tolist().count(families[2][2][1].tolist()[2]) == 4  # no two neighbours are equal


def test_averages_do_not_depend_on_blocks(monkeypatch):
    rng = np.random.default_rng(1)
    value = rng.normal(size=1 << subwords.BUCKET_BITS)
    texts = [None, b"", b"one", b"some longer text, with words. " * 40, b"a b " * 300]
    whole = subwords.averages(texts, value)
    monkeypatch.setattr(subwords, "BLOCK_BYTES", 10)
    assert np.allclose(subwords.averages(texts, value), whole)
    for t, w in zip(texts, whole, strict=True):
        bag = subwords.bags([t])
        at = np.frombuffer(bag[0][0].as_py(), np.uint16)
        weight = np.frombuffer(bag[1][0].as_py(), np.float16).astype(float) / 1000
        assert abs((value[at] * weight).sum() - w) < 0.02


def test_long_texts_are_cut_between_words():
    text = b"word " * 40_000 + b"x" * 200_000
    made = subwords.pieces(text)
    assert all(len(p) <= subwords.PIECE_BYTES + 2 for p in made)
    assert b"".join(made).replace(b" ", b"") == text.replace(b" ", b"")


@pytest.fixture(scope="module")
def model():
    corpus = [b"you stupid idiot and moron", b"the worthless trash is here", b"a plain text about the weather and so on"] * 200
    return toxicity.CharModel(toxicity.trigram_counts(corpus))


@pytest.mark.parametrize("written,read", [
    ("5tup1d", "stupid"), ("m0r0n", "moron"), ("(idi0t)", "idiot"), ("s.t.u.p.i.d", "stupid"), ("stuuuupid", "stupid"),
    ("tr@5h!", "trash"), ("w-o-r-t-h-1-e-s-s", "worthless"), ("plain", "plain"), ("M O R O N", "moron"), ("$tup1d", "stupid"),
])
def test_readings(model, written, read):
    words = toxicity.Restorer(model.cost)
    assert read in toxicity.restored_words(written.encode(), words)


def brute_reading(run, cost):
    """All readings of a short run, by enumeration."""
    best = (float("inf"), "")

    def walk(at, before, state, total, read):
        nonlocal best
        if at == len(run):
            end = total + cost[state << toxicity.ALPHABET_BITS]
            best = min(best, (end, read))
            return
        c = run[at]
        options = [(c, 0.0)] if c.isalpha() else []
        options += [(x, toxicity.AS_LETTER) for x in toxicity.IMITATED.get(c, "")]
        drop = (toxicity.DROP_SEPARATOR if c in toxicity.SEPARATORS else toxicity.DROP_REPEAT if c == before
                else None if c.isalpha() else toxicity.DROP_SIGN)
        if drop is not None:
            walk(at + 1, c, state, total + drop, read)
        for x, channel in options:
            n = toxicity.letter(x)
            key = (state << toxicity.ALPHABET_BITS) | n
            walk(at + 1, c, key & ((1 << 2 * toxicity.ALPHABET_BITS) - 1), total + channel + cost[key], read + x)

    walk(0, "", 0, 0.0, "")
    return best[1]


@pytest.mark.parametrize("run", ["1d10t", "5tup1d", "m00oron", "t.r4.sh", "aa1ll", "x!!y"])
def test_viterbi_equals_enumeration(model, run):
    assert toxicity.viterbi(run, model.cost) == brute_reading(run, model.cost)


def test_rates_are_plain_counts():
    lists = [["=bad", "<badx"]] * 20 + [["=rare", "=bad"]] * 5 + [["=worse"]] * 6
    counts = {"=bad": (25, 0), "=rare": (5, 1), "=worse": (6, 0), "<badx": (20, 30)}
    rates = toxicity.explaining(lists, counts, 0.1)
    assert rates["=bad"] == pytest.approx(25.2 / 27) and rates["=worse"] == pytest.approx(6.2 / 8)
    assert "=rare" not in rates and "<badx" not in rates


def test_restoring_keeps_words_in_order(spark, docs, model):
    df = docs([(1, "You 5tup1d m o r o n", None, None), (2, None, None, None), (3, "", None, None)])
    found = {r.doc_id: r.restored for r in toxicity.deobfuscate(df, "text", ["doc_id"], model).collect()}
    assert found == {1: "you stupid moron", 2: None, 3: ""}


def test_edges(spark, docs):
    rows = [(None, "x", None, None), (1, None, None, None), (2, "", None, None), (2, "", None, None), (3, "a " * 9000, None, None)]
    df = docs(rows)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (2, None, None), (9, 5, 7)],
                                   "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        fitted = subwords.train(df, known, "doc_id", "text", "quality", 5, 0)
        found = subwords.score(df, "text", ["doc_id", "score"], fitted).toDF("doc_id", "own", "p").collect()
        assert len(found) == 5 and all(0 <= r.p <= 1 and r.own == "own" for r in found)
        chars = toxicity.char_model(df, "text")
        rates, base = toxicity.train(df, known, "doc_id", "text", "toxic", 3, 1, chars)
        found = toxicity.score(df, "text", ["doc_id"], chars, rates, base).collect()
        assert len(found) == 5 and all(0 <= r.score <= 1 for r in found)
    empty = df.limit(0)
    assert subwords.score(empty, "text", ["doc_id"], subwords.train(empty, labels, "doc_id", "text", "quality", 5, 0)).count() == 0
    chars = toxicity.char_model(empty, "text")
    assert toxicity.score(empty, "text", ["doc_id"], chars, *toxicity.train(
        empty, labels, "doc_id", "text", "toxic", 3, 1, chars)).count() == 0


@pytest.mark.parametrize("y", [0, 1])
def test_labels_of_one_class(docs, spark, y):
    """Where all labelled rows are of one class every text has a defined score."""
    df = docs([(n, f"some words of text {n}" if n else "", "en", "s") for n in range(20)] + [(90, None, None, None)])
    labels = spark.createDataFrame([(n, y, y) for n in range(20)], "doc_id long, quality int, toxic int")
    chars = toxicity.char_model(df, "text")
    rates = toxicity.train(df, labels, "doc_id", "text", "toxic", 3, 1, chars)
    assert {r.score for r in toxicity.score(df, "text", ["doc_id"], chars, *rates).collect()} == {float(y)}
    model = subwords.train(df, labels, "doc_id", "text", "quality", 5, 0)
    scores = [r[-1] for r in subwords.score(df, "text", ["doc_id"], model).collect()]
    assert len(scores) == 21 and all(0 <= s <= 1 for s in scores) and (min(scores) > 0.5 if y else max(scores) < 0.5)


def test_equal_texts_with_different_labels(docs, spark):
    """A text is toxic if one of its rows is, whichever row a task meets first."""
    df = docs([(n, f"text {n % 10} {'bad' if n % 10 < 5 else 'good'}", "en", "s") for n in range(60)])
    labels = spark.createDataFrame([(n, 0, int(n % 10 < 5 and n < 30)) for n in range(60)], "doc_id long, quality int, toxic int")
    chars = toxicity.char_model(df, "text")
    made = [toxicity.train(df.repartition(k), labels, "doc_id", "text", "toxic", 3, 1, chars) for k in (1, 7)]
    assert made[0] == made[1] and made[0][1] == 0.5
