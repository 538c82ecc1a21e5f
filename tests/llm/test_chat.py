import duckdb

from tableward.llm import chat, queries


def test_query_equals_sql(spark, small):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{small}/conversations.parquet'")
    want = con.sql(queries.SQL["op1_perspective_rotation"])
    names = want.columns
    found = queries.QUERIES["op1_perspective_rotation"](spark, small).select(*names).collect()
    assert sorted(map(tuple, found)) == sorted(want.fetchall())


def test_rotation_masks_and_parts(spark):
    rows = [(1, 0, "system", "be brief"), (1, 1, "ann", "hi"), (1, 2, "bob", "ho"), (1, 3, "ann", "é!"), (1, 3, "ann", "é!"),
            (2, None, None, None), (3, 0, "system", "alone"), (None, 1, "cy", "x")]
    rows += [(4, n, "ann" if n % 2 else "bob", f"t{n}") for n in range(9)]
    df = spark.createDataFrame(rows, "conv long, turn long, role string, text string").selectExpr("*", "1 as at", "2 as part")
    found = chat.rotate(df, "conv", "turn", "role", "text", part_turns=4).collect()
    by_key = {(r.conv, r.perspective, r.part): r for r in found}
    assert set(by_key) == {(1, "ann", 0), (1, "bob", 0), (2, "unknown", 0), (None, "cy", 0),
                           *((4, p, k) for p in ("ann", "bob") for k in range(3))}
    ann = by_key[1, "ann", 0]
    assert ann.n_turns == 4 and ann.n_trained == 2
    assert ann.rendered.startswith("<|im_start|>system\nbe brief<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n")
    assert "user name=bob" in ann.rendered
    assert [ann.rendered[s.start:s.start + s.length] for s in ann.spans] == ["hi<|im_end|>", "é!<|im_end|>"]
    assert "".join(by_key[4, "ann", k].rendered for k in range(3)).count("<|im_start|>") == 9
    assert chat.rotate(df.limit(0), "conv", "turn", "role", "text").count() == 0


def test_no_python_in_the_plan(spark, small, capsys):
    queries.QUERIES["op1_perspective_rotation"](spark, small).explain("formatted")
    assert "Python" not in (plan := capsys.readouterr().out) and "Arrow" not in plan
