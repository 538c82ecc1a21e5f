import json

from pyspark.sql import functions as F

from tableward.sources import readers, sinks


def test_csv_is_text_with_blank_as_null(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name,amount\n1,"a, b",5\n2,,x\n')
    df = readers.read_csv_text(spark, str(tmp_path))
    assert dict(df.dtypes) == {"id": "string", "name": "string", "amount": "string"}
    assert [tuple(r) for r in df.orderBy("id").collect()] == [("1", "a, b", "5"), ("2", None, "x")]


def test_csv_keeps_lines_that_do_not_fit(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v\n1,5\n2,x\n")
    df = readers.read_csv_typed(spark, str(tmp_path), "id int, v int, _corrupt_record string")
    assert [r["_corrupt_record"] for r in df.orderBy("id").collect()] == [None, "2,x"]


def test_json_envelopes(spark, tmp_path):
    records = [{"a": 1}, {"a": 2}]
    for name, content in {"array": records, "records": {"records": records}, "data": {"data": records}, "single": {"a": 1}}.items():
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(content))
        rows = readers.read_json_batch(spark, str(path)).collect()
        assert [r["a"] for r in rows] == ([1] if name == "single" else [1, 2])
    lines = tmp_path / "ref.jsonl"
    lines.write_text("\n".join(map(json.dumps, records)))
    assert readers.read_reference(spark, str(lines), "jsonl").count() == 2


def test_history_reads_only_the_days_asked_for(spark, tmp_path):
    days = spark.range(10).select("id", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(id)").alias("ts"))
    sinks.append_by_day(days, str(tmp_path / "h"), "ts")
    sinks.append_by_day(days, str(tmp_path / "h"), "ts")
    df = readers.read_history(spark, str(tmp_path / "h"), since="2024-01-03", until="2024-01-04")
    assert df.count() == 4
    assert "PartitionFilters: [isnotnull(date" in df._jdf.queryExecution().executedPlan().toString()


def test_unreadable_audit_lines_are_skipped(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"event_type": "x"}\nnot json\n{"event_type": "y"}\n')
    assert readers.read_audit(spark, str(tmp_path), "event_type string").count() == 2
    assert readers.read_audit(spark, str(tmp_path), "event_type string", ["x"]).count() == 1


def test_release_keeps_what_is_still_held(spark, tmp_path):
    rows = spark.createDataFrame([("b", "1", ["DV-002"]), ("b", "2", ["DV-003"])], "batch_id string, row_key string, failure_codes array<string>")
    held = rows.withColumn("record", F.struct("row_key"))
    sinks.append_quarantine(held, str(tmp_path / "q"))
    left = sinks.release(spark, str(tmp_path / "q"), str(tmp_path / "r"), rows.filter("row_key = '1'"))
    assert [r["row_key"] for r in left.collect()] == ["2"]


def test_baselines_by_name(spark, tmp_path):
    for name, n in (("a", 1), ("b", 2)):
        sinks.save_baseline(spark.range(n), str(tmp_path / "b"), name)
    assert sinks.load_baseline(spark, str(tmp_path / "b"), "b").count() == 2


def test_saved_baselines_are_replaced(spark, tmp_path):
    from tableward.sources import sinks

    folder = str(tmp_path / "b")
    for n in (1, 2):
        sinks.save_baseline(spark.createDataFrame([("k", n)], "key string, n int"), folder, "one")
    sinks.save_baseline(spark.createDataFrame([(0, 1.0)], "bin_no int, low double"), folder, "two")
    assert [tuple(r) for r in sinks.load_baseline(spark, folder, "one").collect()] == [("k", 2)]
    assert sinks.load_baseline(spark, folder, "two").columns == ["bin_no", "low"]


def test_unreadable_audit_lines_are_counted(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"event_type": "x"}\nnot json\n{"event_type": "y"}\n')
    assert readers.read_audit(spark, str(tmp_path), "event_type string").count() == 2
    assert [r["lines"] for r in readers.unreadable_audit(spark, str(tmp_path), "event_type string").collect()] == [1]


def test_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"x\ny"\n2,z\n')
    assert [tuple(r) for r in readers.read_csv_text(spark, str(tmp_path), multi_line=True).collect()] == [("1", "x\ny"), ("2", "z")]
