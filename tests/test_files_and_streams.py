from millrace.sources import files
from millrace.streaming import twins

SF = "/root/testdata/sf0.001"


def test_files(spark, tmp_path):
    d = spark.createDataFrame([("/a", 1.5), ("/b", None)], "endpoint string, mean double")
    files.write_csv(d, str(tmp_path / "csv"))
    assert sorted(r.endpoint for r in files.read_csv(spark, str(tmp_path / "csv")).collect()) == ["/a", "/b"]
    (tmp_path / "b.json").write_text('{"/a": {"mean": 1.0, "p95": 2.0, "success_rate": 99.0}}')
    assert files.read_benchmark_json(spark, str(tmp_path / "b.json")).first().p95 == 2.0
    (tmp_path / "x.log").write_text('1.2.3.4 - bob [01/Jan/2024] "GET /v1 HTTP/1.1" 200 512 0.25 0.2\nbroken\n')
    r = files.read_access_log(spark, str(tmp_path / "x.log")).collect()
    assert len(r) == 1 and (r[0].path, r[0].status, r[0].request_time) == ("/v1", 200, 0.25)
    (tmp_path / "l.json").write_text('{"level": "info"}\nnot json\n')
    rows = files.read_json_log(spark, str(tmp_path / "l.json"), "level string").collect()
    assert sorted((r.level, r._corrupt_record) for r in rows if r.level) == [("info", None)] and len(rows) == 2


def test_stream_forms(spark, tmp_path):
    src = tmp_path / "in"
    spark.read.parquet(f"{SF}/events.parquet").repartition(1).write.parquet(str(src))
    e = twins.events_stream(spark, str(src))
    twins.run_available(twins.limiter(e, 3, 86400), str(tmp_path / "out"), str(tmp_path / "c"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == spark.read.parquet(str(src)).count()
    assert out.where("allowed <> (n <= 3)").count() == 0
    twins.run_available(twins.tumbling_stats(twins.events_stream(spark, str(src))), str(tmp_path / "t"), str(tmp_path / "ct"))
    assert "average" in spark.read.parquet(str(tmp_path / "t")).columns
