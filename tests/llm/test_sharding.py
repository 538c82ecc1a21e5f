import zlib

from pyspark.sql import functions as F

from tableward.llm import queries, sharding


def test_query(spark, small):
    texts = {r.doc_id: r.text or "" for r in queries.documents(spark, small).collect()}
    rows = queries.QUERIES["op6_kd_sharding"](spark, small).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    shards = {}
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert r["size"] == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw) and r.grown_shard is None
        shards.setdefault(r.shard, []).append(r)
    for own in shards.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))


def test_near_equal_bytes_with_a_hot_group(spark, docs):
    rows = [(n, "same text " * 20 if n % 3 == 0 else f"{'w' * (n % 50)} {n}", "en" if n % 2 else None, f"s{n % 7}")
            for n in range(6000)]
    found = sharding.kd_shards(docs(rows), "doc_id", "text", ["lang", "source"], shards=8)
    sizes = [r["sum(size)"] for r in found.groupBy("shard").agg(F.sum("size")).collect()]
    assert len(sizes) == 8 and max(sizes) < 1.05 * sum(sizes) / 8 and min(sizes) > 0.95 * sum(sizes) / 8


def test_equal_texts_share_a_shard(spark, docs):
    rows = [(n, f"text {n // 3} " * 5, None, f"s{n % 3}") for n in range(3000)]
    found = sharding.kd_shards(docs(rows), "doc_id", "text", ["lang", "source"], shards=5)
    assert found.groupBy("text_crc32").agg(F.countDistinct("shard").alias("n")).filter("n > 1").count() == 0


def test_target_bytes_and_uneven_counts(spark, docs):
    rows = [(n, "x" * 99, None, None) for n in range(300)]
    df = docs(rows).withColumn("text", F.concat("text", F.col("doc_id").cast("string")))
    found = sharding.kd_shards(df, "doc_id", "text", ["lang"], target_bytes=4300)
    sizes = [r["sum(size)"] for r in found.groupBy("shard").agg(F.sum("size")).collect()]
    assert len(sizes) == -(-sum(sizes) // 4300) and max(sizes) < 1.2 * min(sizes)


def test_edges(docs):
    rows = [(None, None, None, None), (1, "", None, None), (1, "", None, None), (2, "é", "fr", None)]
    found = sharding.kd_shards(docs(rows), "doc_id", "text", ["lang", "source"], shards=16).collect()
    assert sorted(r["size"] for r in found) == [1, 1, 1, 3]
    assert all(r.text_crc32 == (zlib.crc32("é".encode()) if r["size"] == 3 else 0) for r in found)
    assert sharding.kd_shards(docs(rows).limit(0), "doc_id", "text", ["lang"], shards=16).count() == 0


def test_no_python_in_the_plan(spark, small, capsys):
    queries.QUERIES["op6_kd_sharding"](spark, small).explain("formatted")
    assert "Python" not in (plan := capsys.readouterr().out) and "Arrow" not in plan


def kd_brute(rows, shards, large):
    """Shard loads of a k-d tree over (weight, dims) units, split at exact weighted medians."""
    whole = {d: max(u[1][d] for u in rows) - min(u[1][d] for u in rows) or 1 for d in range(len(rows[0][1]))}

    def split(units, k):
        if k == 1:
            return [sum(w for w, _ in units)]
        wide = max(whole, key=lambda d: (max(u[1][d] for u in units) - min(u[1][d] for u in units)) / whole[d])
        units = sorted(units, key=lambda u: u[1][wide])
        below, share, at = 0, sum(w for w, _ in units) * (k // 2) / k, 0
        while at < len(units) and below + units[at][0] / 2 < share:
            below += units[at][0]
            at += 1
        return split(units[:at], k // 2) + split(units[at:], k - k // 2)

    return split(rows, shards)


def test_tree_is_that_of_brute_force(spark, docs):
    """One text a group, sizes all different: shards hold what exact medians give them, and each is a box."""
    rows = [(n, "w" * (40 + 3 * n), f"language-{n % 4}", f"a long source name {(n * 7) % 11:02d}") for n in range(800)]
    found = sharding.kd_shards(docs(rows), "doc_id", "text", ["lang", "source"], shards=8).collect()
    shard = {r.doc_id: r.shard for r in found}
    import math
    units = [(len(t) + 1, (math.log2(len(t) + 1), int(g[-1]), int(s[-2:]))) for _, t, g, s in rows]
    want = kd_brute(units, 8, 0)
    got = [sum(len(t) + 1 for n, t, *_ in rows if shard[n] == k) for k in range(8)]
    assert all(abs(a - b) <= 0.01 * sum(want) / 8 + 2500 for a, b in zip(got, want, strict=True)), (got, want)


def test_metadata_are_compared_whole(spark, docs):
    """Values equal in their first bytes are different places on a dimension."""
    rows = [(n, "x" * 50 + f"{n:04d}", f"a very long common prefix {n % 2}", None) for n in range(400)]
    found = sharding.kd_shards(docs(rows), "doc_id", "text", ["lang"], shards=2).collect()
    assert len({(r.shard, r.doc_id % 2) for r in found}) == 2
