import sys
from pathlib import Path

import corpus_pipeline

sys.path.insert(0, str(Path(__file__).parent))

from test_shingle_sets import brute  # noqa: E402

from tableward.llm import queries, subwords, toxicity  # noqa: E402


def test_stages_keep_what_their_operator_keeps(spark):
    """Each stage against its operator's own decision on the rows that it got."""
    folder = "/root/testdata/sf0.001"
    docs = queries.documents(spark, folder)
    columns, ids = docs.columns, lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    labels = queries.labels(spark, folder)

    kept = corpus_pipeline.quality(spark, docs, folder).cache()
    model = subwords.train(docs, labels, "doc_id", "text", "quality", 5, 0)
    assert ids(kept) == ids(subwords.score(docs, "text", ["doc_id"], model).filter("score >= 0.3")) and kept.columns == columns

    clean = corpus_pipeline.nontoxic(spark, kept, folder).cache()
    chars = toxicity.char_model(kept, "text")
    rates = toxicity.train(kept, labels, "doc_id", "text", "toxic", 3, 1, chars)
    assert ids(clean) == ids(toxicity.score(kept, "text", ["doc_id"], chars, *rates).filter("score < 0.7")) and clean.columns == columns

    single = corpus_pipeline.near_dedup(spark, clean, folder).cache()
    assert set(ids(single)) == brute([(r.doc_id, r.text) for r in clean.collect()]) and single.columns == columns

    pieces = corpus_pipeline.packed(spark, single, folder)
    assert sorted({r.doc_id for r in pieces.collect()}) == ids(single)


def test_run(spark, small):
    pieces = corpus_pipeline.run(spark, small)
    totals = pieces.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert totals and all(r["sum(length)"] == r["max(doc_tokens)"] for r in totals)


def test_edges(spark, docs):
    df = docs([(None, None, None, None), (1, "", None, None), (1, "", None, None)])
    for limit in (3, 0):
        rows = df.limit(limit)
        for _, stage in corpus_pipeline.STAGES[:3]:
            rows = stage(spark, rows, "/root/testdata/sf0.001")
            assert rows.columns == df.columns
        assert corpus_pipeline.packed(spark, rows, "/root/testdata/sf0.001").count() == (1 if limit else 0)
