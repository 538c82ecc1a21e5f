import numpy as np
import pytest

from tableward.llm import language, queries

DOCS = [("der die das und nicht ich sie es ein " * 9, "de"), ("the and of to in is you that it was " * 9, "en"),
        ("le la les et de un une que dans pour " * 9, "fr")]


def test_query(spark, small):
    found = queries.QUERIES["op5_language_fusion"](spark, small).collect()
    assert len(found) == spark.read.parquet(f"{small}/pages.parquet").count()
    assert sum(r.lang == r.declared for r in found) >= 0.95 * len(found)
    assert all(abs(sum(r.posterior) - 1) < 1e-9 and r.confidence == max(r.posterior) for r in found)


def test_visible_text():
    html = b"<html><SCRIPT>if (a<b) x('</p>')</SCRIPT>one<!-- <p> two --><style>p{}</style> th<b>r</b>ee <p unclosed"
    assert language.visible(html).split() == [b"one", b"th", b"r", b"ee"]
    assert language.visible(b"a <script>never closed") .split() == [b"a"]
    assert language.visible(b"") == b""


def test_posterior_equals_plain_computation(spark):
    """Fusion in DataFrame expressions against loops over pages."""
    pages = [(1, "http://a.x.de/1", "<html lang='de'>der die und nicht ich"), (2, "http://a.x.de/2", "<html lang='en'>"),
             (3, "http://b.x.de/", "<html>the and of"), (4, "https://q.fr/", "<html lang=fr>le la les"), (5, None, None),
             (6, "http://a.x.de/3", "<html lang='de'>the die")]
    page_df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as lang", "2 as host")
    docs = spark.createDataFrame(DOCS, "text string, lang string")
    langs, model = language.language_models(docs, "text", "lang")
    assert langs == ["de", "en", "fr"]
    rows = []
    for key, url, html in pages:
        raw = (html or "").encode()
        found = language._LANG.search(raw)
        grams = language.trigrams(language.visible(raw)) if raw else []
        ll = model[:, grams].sum(axis=1) * min(1, language.EFFECTIVE / len(grams)) if len(grams) else np.zeros(3)
        host = (url or "").split("//")[-1].split("/")[0]
        post = np.exp(ll - ll.max())
        rows.append((key, found[1][:2].lower().decode() if found else "", host, ".".join(host.split(".")[-2:]), host.split(".")[-1], ll,
                     post / post.sum()))
    total = sum(r[6] for r in rows)
    share = (total + 1) / (total.sum() + 3)
    w, e = language.HOST_WEIGHT, language.EVIDENCE_WEIGHT
    found = {r.page_id: r for r in language.identify(page_df, docs, "page_id", "url", "html", "text", "lang").collect()}
    for key, declared, host, domain, suffix, ll, post in rows:
        same = [r for r in rows if r[3] == domain]
        domain_prior = (sum(r[6] for r in same) + w * share) / (len(same) + w)
        same = [r for r in rows if r[2] == host]
        prior = (sum(r[6] for r in same) - post + w * domain_prior) / (len(same) - 1 + w)
        log = ll + np.log(prior)
        for at, value in ((1, declared), (4, suffix)):
            same = [r for r in rows if r[at] == value]
            log += np.log((sum(r[6] for r in same) + e * len(same) / len(rows)) / (total + e))
        want = np.exp(log - log.max())
        want /= want.sum()
        assert np.allclose(found[key].posterior, want), key
        assert found[key].lang == langs[int(np.argmax(want))] and found[key].declared == declared and found[key].host == host
    assert found[2].lang == "de"  # its host outweighs its declaration


def test_edges(spark):
    pages = spark.createDataFrame([(None, None, None), (1, "", ""), (1, "", "")], "page_id long, url string, html string")
    docs = spark.createDataFrame([*DOCS, (None, "en"), ("text", None)], "text string, lang string")
    assert language.identify(pages, docs, "page_id", "url", "html", "text", "lang").count() == 3
    assert language.identify(pages.limit(0), docs, "page_id", "url", "html", "text", "lang").count() == 0
    found = language.identify(pages, docs.limit(0), "page_id", "url", "html", "text", "lang").collect()
    assert len(found) == 3 and all(r.lang is None for r in found)


@pytest.mark.parametrize("before", [0, 1999, 2000, 50000])
def test_declared_language_behind_attributes_of_any_length(spark, before):
    html = f"<HTML data-x='{'y' * before}'\n lang = 'fr-CA'>le la"
    pages = spark.createDataFrame([(1, "http://x.de/", html), (2, "http://x.de/", "<html><p lang='de'>x"),
                                   (3, "http://x.de/", "<html " * 20000)], "page_id long, url string, html string")
    read = language.read_pages(pages, "html", "url", ["page_id"], np.zeros((1, 1 << language.BUCKET_BITS)))
    assert {r.page_id: r.declared for r in read.collect()} == {1: "fr", 2: "", 3: ""}
