import numpy as np
import pytest

import corpus_pipeline
from tableward.llm import shingle_sets


def brute(rows, percent=80):
    """Keys that stay: the least of each group of (key, text)."""
    sets = {k: set(zip(*[(t or "").lower().split()[n:] for n in range(5)], strict=False))
            or {" ".join((t or "").lower().split())} for k, t in rows}
    parent = {k: k for k, _ in rows}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {k for k in parent if find(k) == k}


def edited(seed, groups, size):
    """Texts of which some are copies with one to twenty words changed."""
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(groups):
        words = [f"w{x}" for x in rng.integers(0, 5000, rng.integers(80, 400))]
        for _ in range(rng.integers(1, size)):
            copy = list(words)
            for at in rng.integers(0, len(copy), rng.integers(0, 20)):
                copy[at] = f"x{rng.integers(0, 5000)}"
            rows.append((len(rows), " ".join(copy)))
    return rows


@pytest.mark.parametrize("block", [1 << 19, 600])
def test_groups_are_those_of_brute_force(spark, docs, monkeypatch, block):
    monkeypatch.setattr(shingle_sets, "BLOCK_SHINGLES", block)
    rows = edited(5, 60, 9) + [(9000, "one two"), (9001, "ONE  two"), (9002, None), (9003, ""), (9004, "one three")]
    kept = corpus_pipeline.near_dedup(spark, docs([(k, t, None, None) for k, t in rows]), "")
    assert {r.doc_id for r in kept.collect()} == brute(rows)


def test_boundary(spark, docs):
    """Four shingles of five in common link, three of four do not."""
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h i"), (3, "p q r s t u v"), (4, "p q r s t u v w")]
    assert brute(rows) == {1, 3, 4}
    sets = [shingle_sets.shingles(t.encode(), 5) for _, t in rows]
    for a, b, linked in [(0, 1, True), (2, 3, False)]:
        forest = shingle_sets.Forest(4)
        shingle_sets._similar(sets, np.array([a]), np.array([b]), 80, forest)
        assert (forest.roots()[b] == a) == linked


def test_bands_meet_at_the_wanted_similarity():
    rng, met = np.random.default_rng(3), 0
    for _ in range(1000):
        common, rest = rng.integers(0, 1 << 63, 160, np.uint64), rng.integers(0, 1 << 63, 40, np.uint64)
        a, b = np.r_[common, rest[:20]], np.r_[common, rest[20:]]
        met += bool(set(shingle_sets.bands(a)) & set(shingle_sets.bands(b)))
    assert met >= 995


def test_stage_on_documents(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    kept = corpus_pipeline.near_dedup(spark, df, small).cache()
    want = brute([(r.doc_id, r.text) for r in df.collect()])
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == df.columns
    assert {r.doc_id for r in corpus_pipeline.packed(spark, kept, small).collect()} == want


def test_tries_link_without_a_common_band(spark):
    """Fingerprints within three bits, equal ones, and one four bits away, which a band links to another."""
    rows = [(5, 0b0, [50]), (6, 0b111, [60]), (7, 0b111 | 1 << 63, [70]), (8, 0b111, [80]), (9, 0xF << 20, [90]), (4, 0xFF << 40, [90, 91])]
    classes = spark.createDataFrame([(c, f - (1 << 64) if f >> 63 else f, b) for c, f, b in rows], "cls long, fp long, bands array<long>")
    found = {r.node: r.component for r in shingle_sets.clusters_of(classes, 3).collect()}
    assert found == {5: 5, 6: 5, 7: 5, 8: 5, 4: 4, 9: 4}


def test_fingerprint_of_a_set():
    hashes = np.random.default_rng(1).integers(0, 1 << 63, 70_001, np.uint64)
    want = sum(1 << b for b in range(64) if 2 * int(((hashes >> np.uint64(b)) & np.uint64(1)).sum()) > len(hashes))
    assert shingle_sets.fingerprint(hashes) == want
