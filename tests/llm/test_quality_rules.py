import re
from collections import Counter

from tableward.llm import quality_rules, queries


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    marked = {k for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for k in range(i, i + 8)}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for w in words for c in w), repeated, len(marked))


def test_query_measures(spark, small):
    texts = {r.doc_id: r.text for r in queries.documents(spark, small).collect()}
    found = queries.QUERIES["op9_adaptive_rules"](spark, small).collect()
    assert sorted(r.doc_id for r in found) == sorted(texts)
    for r in found:
        n, chars, symbols, lines, repeats = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeats)
        assert r.base_failed == (n < 20 or 100 * repeats > 30 * n) and not (r.kept and r.base_failed)


def test_clean_rows_are_kept_and_junk_is_not(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in queries.labels(spark, folder).collect()}
    found = [r for r in queries.QUERIES["op9_adaptive_rules"](spark, folder).collect() if r.doc_id in labels]
    clean = [r.kept for r in found if labels[r.doc_id] == 1 and not r.base_failed]
    junk = [r.kept for r in found if labels[r.doc_id] == 0]
    assert sum(clean) >= 0.995 * len(clean) and sum(junk) < 0.1 * len(junk)


def test_windows():
    for words in (["a"] * 20, list("abcdefgh") * 2, list("abcdefghijk") + list("abcdefgh"), list("abcdefg") * 1, []):
        text = " ".join(words)
        assert quality_rules.repeated_words(text.encode().split()) == brute(text)[4]


def test_limits_follow_the_group(spark, docs):
    """A source whose clean text is full of signs has limits of its own."""
    plain = [(n, " ".join(f"word{n + k}" for k in range(25 + n % 5)), "en", "news") for n in range(300)]
    code = [(1000 + n, " ".join(f"a{n + k}<b&&c>d" for k in range(25 + n % 5)), "en", "code") for n in range(300)]
    few = [(2000, plain[0][1], "en", "small"), (2001, plain[1][1], None, None)]
    found = {r.doc_id: r for r in quality_rules.judge(
        docs(plain + code + few), "text", "lang", "source", ["doc_id"]).collect()}
    assert found[5].limits.symbol_rate_high < found[1005].limits.symbol_rate_high
    assert {found[5].level, found[1005].level} == {"source"}
    assert found[2000].level == "lang" and found[2001].level == "all"


def test_edges(docs):
    rows = [(None, None, None, None), (1, "", "en", None), (1, "", "en", None), (2, "w " * 30, None, "s"),
            (3, " ".join(f"w{n}" for n in range(5000)), "en", "s")]
    df = docs(rows)
    found = quality_rules.judge(df, "text", "lang", "source", ["doc_id", "score"]).collect()
    assert len(found) == 5 and [r.kept for r in sorted(found, key=lambda r: r.n_words)] == [False, False, False, False, True]
    assert quality_rules.judge(df.limit(0), "text", "lang", "source", ["doc_id"]).count() == 0


def test_no_row_passes_the_base_rule(docs):
    df = docs([(1, "too short", "en", "s"), (2, None, "en", None)])
    assert [r.kept for r in quality_rules.judge(df, "text", "lang", "source", ["doc_id"]).collect()] == [False, False]


def test_each_limit_rejects_what_passes_the_base_rule(docs):
    """Junk of one kind each, planted among texts with some repeated lines and words of their own."""
    def plain(n, words=60):
        return [f"word{n * 7 + k}" for k in range(words)]

    def lines(words, size):
        return "\n".join(" ".join(words[k:k + size]) for k in range(0, len(words), size))

    clean = [(n, lines(plain(n), 6) + ("\n" + " ".join(plain(n)[:6]) if n % 60 == 0 else "")
              + (" " + " ".join(plain(n)[20:29]) if n % 70 == 0 else ""), "en", "s") for n in range(600)]
    planted = {
        "symbol_rate": " ".join(f"a#{k}$%&|" for k in range(40)),
        "dup_line_rate": "\n".join("a b\n" + " ".join(plain(901)[7 * k:7 * k + 7]) for k in range(8)),
        "repeat_rate": " ".join([*plain(902, 85), *plain(2000, 18), *plain(2100, 2), *plain(2000, 18)]),
        "word_length": " ".join("x" * 30 + str(k) for k in range(40)),
    }
    junk = [(1000 + n, text, "en", "s") for n, text in enumerate(planted.values())]
    found = {r.doc_id: r for r in quality_rules.judge(docs(clean + junk), "text", "lang", "source", ["doc_id"]).collect()}
    assert all(found[n].kept for n, *_ in clean)
    for n, name in enumerate(planted):
        r = found[1000 + n]
        assert not r.base_failed and not r.kept, (name, r)
        others = {"symbol_rate": r.n_symbols / r.word_chars, "repeat_rate": r.n_repeat_words / r.n_words}
        assert all(others[m] <= r.limits[f"{m}_high"] for m in others if m != name), (name, r)
