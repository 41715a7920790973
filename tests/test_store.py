import pytest
from pyspark.sql import functions as F

from tidemark.sources import store


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_publish_replaces_and_keeps_readers_alive(spark, frame, base):
    store.publish(frame([("a", 1)], "k string, n int"), base, "t")
    before = store.read_table(spark, base, "t")
    # The new version is computed from the old one: never an overwrite in place.
    store.publish(before.withColumn("n", F.col("n") + 1), base, "t")
    assert rows(before) == [("a", 1)]
    assert rows(store.read_table(spark, base, "t")) == [("a", 2)]


def test_empty_publish_clears_the_table(spark, frame, base):
    df = frame([("a", 1)], "k string, n int")
    store.publish(df, base, "rejects")
    store.publish(df.limit(0), base, "rejects")
    assert rows(store.read_table(spark, base, "rejects")) == []
    assert store.read_table(spark, base, "rejects").schema == df.schema


def test_guard_leaves_the_old_version(spark, frame, base):
    df = frame([("a", 1)], "k string, n int")
    store.publish(df, base, "t", allow_empty=False)
    with pytest.raises(store.EmptyTableError):
        store.publish(df.limit(0), base, "t", allow_empty=False)
    assert rows(store.read_table(spark, base, "t")) == [("a", 1)]


def test_unpublished_table(spark, base):
    assert not store.exists(spark, base, "t")
    with pytest.raises(LookupError):
        store.read_table(spark, base, "t")


def test_slices_are_replaced_one_by_one(spark, frame, base):
    schema = "m int, k string, n int"
    store.publish_slices(frame([(1, "a", 1), (2, "b", 1), (3, "c", 1)], schema), base, "t", "m")
    store.publish_slices(frame([(2, "b", 2)], schema), base, "t", "m", replaced=["2", "3"])
    assert rows(store.read_table(spark, base, "t")) == [("a", 1), ("b", 2)]
    assert rows(store.read_table(spark, base, "t", ["2"])) == [("b", 2)]
    assert rows(store.read_table(spark, base, "t", ["9"])) == []
    store.publish_slices(frame([], schema), base, "t", "m", replaced=["1"])
    assert rows(store.read_table(spark, base, "t")) == [("b", 2)]
    store.publish_slices(frame([(5, "e", 5)], schema), base, "t", "m")
    assert rows(store.read_table(spark, base, "t")) == [("e", 5)]


def test_columns_follow_the_last_publish(spark, frame, base):
    store.publish_slices(frame([(1, "a", 1)], "m int, k string, gone int"), base, "t", "m")
    store.publish_slices(frame([(2, "b", True)], "m int, k string, new boolean"), base, "t", "m", [])
    table = store.read_table(spark, base, "t")
    assert table.columns == ["k", "new"]
    assert rows(table.fillna(False)) == [("a", False), ("b", True)]


def test_failed_write_switches_nothing(spark, frame, base):
    store.publish(frame([("1",)], "k string"), base, "t")
    broken = frame([("x",)], "k string").select(F.col("k").cast("int").cast("string").alias("k"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        store.publish(broken, base, "t")
    assert rows(store.read_table(spark, base, "t")) == [("1",)]


def test_stage_uses_the_shared_folder(spark, frame):
    df = frame([("a", 1)], "k string, n int")
    staged = store.stage(df)
    assert rows(staged) == [("a", 1)]
    assert staged.inputFiles()[0].split("/staged-")[0].endswith(
        store.checkpoint_folder(spark).split(":")[-1].lstrip("/")
    )


def test_old_versions_are_deleted_on_request(spark, frame, base):
    schema = "m int, k string"
    store.publish_slices(frame([(1, "a"), (2, "b")], schema), base, "t", "m")
    store.publish_slices(frame([(2, "c")], schema), base, "t", "m", replaced=["2"])
    assert store.drop_old_versions(spark, base, "t") == 0  # slice 1 still uses the first
    store.publish_slices(frame([(1, "d")], schema), base, "t", "m", replaced=["1"])
    assert store.drop_old_versions(spark, base, "t") == 1
    assert rows(store.read_table(spark, base, "t")) == [("c",), ("d",)]
    assert store.drop_old_versions(spark, base, "unknown") == 0


def test_staged_frame_can_be_removed(spark, frame):
    path = store.staging_path(spark)
    store.stage(frame([("a",)], "k string"), path)
    store.unstage(spark, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_hash_slices_are_found_by_key(spark, base):
    slicing = store.Slicing(("id",), 8)
    store.publish_hashed(spark.range(1000).selectExpr("id", "1 AS n"), base, "t", slicing)
    before = store.current(spark, base, "t")
    assert before.slicing == slicing and len(before.versions) == 8 and before.n_rows == 1000
    change = spark.range(5, 6).selectExpr("id", "2 AS n")
    touched = store.touched_slices(change, before.slicing)
    assert len(touched) == 1
    old = store.read_table(spark, base, "t", touched)
    assert all(f"_slice={touched[0]}/" in path for path in old.inputFiles())
    store.replace_touched(old.where("id <> 5").unionByName(change), base, "t", before.slicing, touched)
    after = store.current(spark, base, "t")
    assert {name for name, v in after.versions.items() if v != before.versions[name]} == set(touched)
    assert after.n_rows == 1000 and after.slicing == slicing
    assert store.read_table(spark, base, "t").where("n = 2").count() == 1
    # another cut comes with a new whole table only
    store.publish_hashed(store.read_table(spark, base, "t"), base, "t", store.Slicing(("id",), 3))
    assert set(store.current(spark, base, "t").versions) <= {"h0", "h1", "h2"}
    assert store.read_table(spark, base, "t").count() == 1000
