import pytest

from tidemark.sources import files, marks, statelog, store
from tidemark.sources.statelog import StateLog


def parquet_files(spark, path):
    found = []
    for epoch in files.children(spark, path):
        found += [f"{epoch}/{name}" for name in files.children(spark, f"{path}/{epoch}") if name.endswith(".parquet")]
    return found


@pytest.fixture(autouse=True)
def short_tail(monkeypatch):
    monkeypatch.setattr(statelog, "TAIL_FILES", 3)


def test_a_long_log_stays_small(spark, base):
    log = StateLog(f"{base}/log", "k string, n int", lambda lines: lines.groupBy("k").agg({"n": "max"}).toDF("k", "n"))
    for n in range(30):
        log.append(spark, [{"k": f"k{n % 2}", "n": n}])
    lines = log.read(spark)
    assert len(lines.inputFiles()) <= 4 and lines.count() <= 2 + 4
    assert {r.k: r[1] for r in lines.groupBy("k").max("n").collect()} == {"k0": 28, "k1": 29}
    # two epochs at most are kept
    assert len(parquet_files(spark, log.path)) <= 8 and len(files.children(spark, log.path)) == 2


def test_an_epoch_without_checkpoint_does_not_count(spark, base):
    log = StateLog(f"{base}/log", "k string")
    log.append(spark, [{"k": "a"}])
    spark.range(0).write.format("noop").mode("overwrite").save()
    (spark.createDataFrame([], "k string").write.format("json").save(f"{log.path}/epoch=00000009"))
    assert [r.k for r in log.read(spark).collect()] == ["a"]
    log.append(spark, [{"k": "b"}])
    assert sorted(r.k for r in log.read(spark).collect()) == ["a", "b"]


def test_ledger_of_many_publishes(spark, frame, base):
    """Slices that ended leave the ledger, the schema is there once a publish, the rows are known."""
    df = frame([(1, "a"), (2, "b"), (2, "c")], "m int, k string")
    for turn in range(9):
        part = df.selectExpr("k", f"concat('s', m, '-', {turn}) AS part")
        store.publish_slices(part, base, "t", "part")
    lines = store._ledger_log(base, "t").read(spark)
    assert len(lines.inputFiles()) <= 4 and lines.count() < 9 * 5
    assert lines.where("schema IS NOT NULL").count() <= 4
    found = store.current(spark, base, "t")
    assert (found.rows, found.n_rows, found.seq) == ({"s1-8": 1, "s2-8": 2}, 3, 9)


def test_marks_and_batches_over_checkpoints(spark, base):
    for n in range(12):
        marks.save_mark(spark, base, "t", f"2020-01-{n + 1:02d} 00:00:00", f"b{n}")
        marks.log_batch(spark, base, "t", f"b{n}", f"2024-01-01 00:00:{n:02d}", rows=n)
        if n < 10:
            marks.log_batch(spark, base, "t", f"b{n}", f"2024-01-01 00:00:{n:02d}", cleaned=True)
    assert marks.load_mark(spark, base, "t") == "2020-01-12 00:00:00"
    assert [tuple(b) for b in marks.waiting(spark, base, "t")] == [
        ("b10", "2024-01-01 00:00:10", 10), ("b11", "2024-01-01 00:00:11", 11),
    ]
    assert marks.logged_batches(spark, base, "t").count() == 12
    assert marks.next_ingest_time(spark, base, "t", "2024-01-01 00:00:05") == "2024-01-01 00:00:11.000001"
