import random
import re

import numpy as np
import pytest
import xxhash

from tableward.llm import queries, simhash


def plain_fingerprint(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, budget):
    """Value -> least value reachable by links."""
    values = sorted(set(values))
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for n, a in enumerate(values):
        for b in values[n + 1:]:
            if (a ^ b).bit_count() <= budget:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def test_fingerprints():
    rng = random.Random(1)
    texts = [None, "", " \t\n", "One", "ONE two", "a b c", "É é\x0bx y\xa0z"]
    texts += [" ".join(rng.choices(["a", "B", "cc", "Dé", "e."], k=rng.randint(1, 90))) for _ in range(60)]
    for width in (3, 5):
        for t in texts:
            assert simhash.fingerprint(None if t is None else t.encode(), width) == plain_fingerprint(t, width)


def clustered(seed, centres, members, flips):
    rng = random.Random(seed)
    found = set()
    for _ in range(centres):
        centre = rng.getrandbits(64)
        found.add(centre)
        for _ in range(members):
            v = centre
            for b in rng.sample(range(64), rng.randint(0, flips)):
                v ^= 1 << b
            found.add(v)
    return sorted(found)


@pytest.mark.parametrize("unit_rows", [1000, 20])
def test_trie_join_equals_all_pairs(spark, unit_rows):
    """Also where units are opened: one tight cluster holds most values."""
    values = clustered(2, 40, 5, 5) + clustered(3, 1, 250, 4) + [0, 1, (1 << 64) - 1, 1 << 63]
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(v,) for v in set(signed)], "fp long")
    edges = simhash.trie_join(df, "fp", 3, unit_rows).collect()
    whole = {int(np.int64(v).view(np.uint64)) for v in signed}
    parent = {v: v for v in whole}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for e in edges:
        a, b = (int(np.int64(x).view(np.uint64)) for x in (e.a, e.b))
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert {v: find(v) for v in whole} == plain_components(whole, 3)


@pytest.mark.parametrize("budget", [0, 1, 7])
def test_other_budgets(spark, budget):
    values = clustered(5, 20, 6, 8)
    df = spark.createDataFrame([(v,) for v in np.array(values, np.uint64).view(np.int64).tolist()], "fp long")
    from tableward.llm.common import components

    found = components(simhash.trie_join(df, "fp", budget, 15)).collect()
    want = plain_components(values, budget)
    sizes = sorted(list(want.values()).count(c) for c in set(want.values()))
    by_component = {}
    for r in found:
        by_component.setdefault(r.component, set()).add(r.node)
    linked = sorted(len(m) for m in by_component.values())
    assert linked == [n for n in sizes if n > 1]


def test_query_against_brute_force(spark, small):
    texts = {r.doc_id: r.text for r in queries.documents(spark, small).collect()}
    prints = {d: plain_fingerprint(t, 3) for d, t in texts.items()}
    group = plain_components(prints.values(), 3)
    least = {}
    for d, v in prints.items():
        least[group[v]] = min(least.get(group[v], d), d)
    found = queries.QUERIES["op2_simhash_trie"](spark, small).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in found} == {
        d: (f"{v:016x}", least[group[v]]) for d, v in prints.items()}
    assert len(found) == len(texts)


def test_edges(docs):
    rows = [(None, None, None, None), (1, "", None, None), (1, "", None, None), (2, "some words here now", None, None),
            (None, "some words here now", None, None), (7, "other", None, None)]
    found = sorted((str(r.doc_id), r.component_id) for r in simhash.groups(docs(rows), "doc_id", "text").collect())
    assert found == sorted([("None", 1), ("1", 1), ("1", 1), ("2", 2), ("None", 2), ("7", 7)])
    kept = simhash.keep_one(docs(rows), "doc_id", "text").collect()
    assert sorted((r.doc_id, r.text, r.fp) for r in kept) == [
        (1, "", "own"), (2, "some words here now", "own"), (7, "other", "own")]
    assert simhash.groups(docs(rows).limit(0), "doc_id", "text").count() == 0
    assert simhash.keep_one(docs(rows).limit(0), "doc_id", "text").count() == 0
