from strataq.sources import files


def test_scan_and_export(spark, tmp_path):
    (tmp_path / "in/a/b").mkdir(parents=True)
    for name in ("x.md", "a/y.md", "a/b/z.md", "a/key.pem"):
        (tmp_path / "in" / name).write_text(name)
    root = str(tmp_path / "in")
    assert sorted(r[0] for r in files.scan(spark, root).select("relative_path").collect()) == ["a/b/z.md", "a/y.md", "x.md"]
    assert sorted(r[0] for r in files.scan(spark, root, "*.md", max_depth=1).select("relative_path").collect()) == ["a/y.md", "x.md"]
    out = files.export({"t": spark.range(5)}, str(tmp_path / "out"))
    assert [tuple(r) for r in out.collect()] == [("t", 5)]


def test_event_log(spark, tmp_path):
    rows = spark.sql("SELECT 1L AS id, timestamp'2024-01-02 03:04:05' AS ts")
    files.append_events(rows, str(tmp_path / "log"))
    assert files.event_log(spark, str(tmp_path / "log"), "id long, ts timestamp").count() == 1
