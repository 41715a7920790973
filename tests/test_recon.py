from tidemark.operators import recon


def test_row_counts(spark, frame):
    frames = {("raw", "a"): spark.range(3), ("raw", "b"): spark.range(0), ("staging", "a"): spark.range(2)}
    assert sorted(map(tuple, recon.row_counts(frames).collect())) == [
        ("raw", "a", 3),
        ("raw", "b", 0),
        ("staging", "a", 2),
    ]


def test_staged_files_can_be_searched(spark, frame, base):
    frame([("c2", "x", 1), ("c1", "y", 2)], "k string, city string, n int").write.parquet(f"{base}/t")
    files = spark.read.parquet(f"{base}/t")
    assert [tuple(r) for r in recon.lookup_key(files, "k", "c1", ["k", "city"]).collect()] == [("c1", "y")]
    assert [r.k for r in recon.sample(files, "k", ["k"], 1).collect()] == ["c1"]
    plan = recon.lookup_key(files, "k", "c1", ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k,c1)" in plan and "ReadSchema: struct<k:string>" in plan
