import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators.history import scd2_apply, scd2_replay, scd2_start, scd2_step, versions_of

SCHEMA = "k string, city string, state string, at timestamp_ntz, batch string"


def batch(frame, day, rows):
    df = frame([(k, c, s) for k, c, s in rows], "k string, city string, state string")
    at = f"2024-01-{day:02d} 00:00:00"
    return df.withColumns({"at": F.lit(at).cast("timestamp_ntz"), "batch": F.lit(f"b{day:02d}")})


def at(day):
    return F.lit(f"2024-01-{day:02d} 00:00:00")


def both_ways(frame, days):
    """History by steps and by replay, as sorted tuples."""
    frames = {day: batch(frame, day, rows) for day, rows in days.items()}
    steps, union = None, None
    for day, df in frames.items():
        start = steps is None
        steps = scd2_start(df, at(day)) if start else scd2_apply(steps, df, "k", ["city", "state"], at(day))
        union = df if start else union.unionByName(df)
    replay = scd2_replay(union, "k", ["city", "state"], "at", ["batch"])
    rows = [sorted(map(repr, df.select(*steps.columns).collect())) for df in (steps, replay)]
    assert rows[0] == rows[1]
    return steps


@pytest.mark.parametrize(
    "values, versions",
    [
        (["a", "a", "a"], 1),
        (["a", "b", "b"], 2),
        (["a", "b", "a"], 3),
        ([None, None, None], 1),
        ([None, "a", None], 3),
        (["a", None, None], 2),
    ],
)
def test_changes_are_null_safe(frame, values, versions):
    days = {day: [("c1", v, "SP")] for day, v in enumerate(values, 1)}
    history = both_ways(frame, days)
    assert history.count() == versions
    assert history.filter("valid_to IS NULL").count() == 1


def test_missing_key_stays_open_and_new_key_opens(frame):
    history = both_ways(frame, {1: [("c1", "a", "x")], 2: [("c2", "b", "y")]})
    rows = {r.k: (r.valid_from.day, r.valid_to) for r in history.collect()}
    assert rows == {"c1": (1, None), "c2": (2, None)}


def test_unchanged_row_keeps_its_metadata(frame):
    history = both_ways(frame, {1: [("c1", "a", "x")], 2: [("c1", "a", "x")]})
    assert [r.batch for r in history.collect()] == ["b01"]


def test_step_reads_open_rows_only(frame):
    opened = scd2_start(batch(frame, 1, [("c1", "a", "x"), ("c2", "a", "x")]), at(1))
    rows = scd2_step(opened, batch(frame, 2, [("c1", "b", "x"), ("c2", "a", "x")]), "k", ["city", "state"], at(2))
    closed = rows.filter("valid_to IS NOT NULL").collect()
    assert [(r.k, r.city, r.valid_to.day) for r in closed] == [("c1", "a", 2)]
    assert rows.filter("valid_to IS NULL").count() == 2


def test_random_histories_agree_and_do_not_overlap(frame):
    rng = random.Random(7)
    keys = [f"c{i}" for i in range(40)]
    days = {
        day: [(k, rng.choice(["a", "b", None]), rng.choice(["x", "y"])) for k in keys if rng.random() < 0.8]
        for day in range(1, 5)
    }
    history = both_ways(frame, days)
    nxt = F.lead("valid_from").over(Window.partitionBy("k").orderBy("valid_from"))
    gaps = history.withColumn("next", nxt).filter(~F.col("next").eqNullSafe(F.col("valid_to")))
    assert gaps.count() == 0


def test_copies_within_a_batch_make_one_version(frame):
    df = batch(frame, 1, [("c1", "a", "x")] * 500 + [("c2", "a", "x")])
    assert scd2_replay(df, "k", ["city", "state"], "at", ["batch"]).count() == 2


def test_versions_of_one_key(frame):
    history = both_ways(frame, {1: [("c1", "a", "x"), ("c2", "a", "x")], 2: [("c1", "b", "x")]})
    assert [r.city for r in versions_of(history, "k", "c1").collect()] == ["a", "b"]
