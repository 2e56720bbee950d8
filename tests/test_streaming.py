from reflume.streaming.resolutions import resolution_changes


def test_changes_follow_the_log(spark, tmp_path):
    src = str(tmp_path / "in")
    kind = "file string, seq long, action string, citation_id string, choice long"
    write = lambda rows: spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").json(src)
    write([("f", 1, "resolve", "c0", 5), ("f", 2, "resolve", "c0", 6)])
    q = resolution_changes(spark.readStream.schema(kind).json(src)).writeStream.format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    try:
        q.processAllAvailable()
        write([("f", 3, "clear", None, None), ("f", 4, "resolve", "c1", 7)])
        q.processAllAvailable()
        got = [tuple(r) for r in spark.sql("select * from changes order by seq, choice").collect()]
    finally:
        q.stop()
    assert got == [("f", 1, "c0", 5), ("f", 2, "c0", 6), ("f", 3, "c0", None), ("f", 4, "c1", 7)]
