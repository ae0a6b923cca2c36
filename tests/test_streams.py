"""Streams over several files: a batch a session, failures, late news, and a sink whose readers see whole batches."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof
from tidemark.streaming import daily

D = dt.date
KEYS, SCHEMA = ["k"], "k int, v int"


def land(df, folder, n):
    """One Parquet file of its own, younger than the ones before."""
    target, written = folder / f"part-{n}.parquet", folder.parent / f"written-{n}"
    df.coalesce(1).write.parquet(f"file://{written}")
    next(written.glob("part-*.parquet")).rename(target)
    os.utime(target, (1_600_000_000 + n * 100, 1_600_000_000 + n * 100))


def test_a_failing_session_keeps_those_before_it(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for n in range(5):
        land(spark.createDataFrame([(n, n * 10)], SCHEMA), folder, n)
    done, broken = [], [True]

    def work(batch, n):
        rows = [r["k"] for r in batch.collect()]
        if rows == [2] and broken[0]:
            raise ValueError("no prices for this session")
        done.append((n, rows))

    stream = lambda: daily.session_files(spark, f"file://{folder}", SCHEMA)
    with pytest.raises(Exception, match="no prices"):
        daily.catch_up(stream(), work, f"file://{tmp_path}/log")
    assert done == [(0, [0]), (1, [1])]
    broken[0] = False
    daily.catch_up(stream(), work, f"file://{tmp_path}/log")
    assert [rows for _, rows in done] == [[0], [1], [2], [3], [4]] and [n for n, _ in done] == [0, 1, 2, 3, 4]
    daily.catch_up(stream(), work, f"file://{tmp_path}/log")
    assert len(done) == 5


def test_late_news_is_dropped_and_counted(spark, tmp_path):
    folder, out = tmp_path / "in", f"file://{tmp_path}/out"
    folder.mkdir()
    cal = asof.numbered_calendar(spark.createDataFrame([(D(2021, 1, d),) for d in (4, 5, 6, 7, 8, 11, 12)], "date date"))
    shape = "symbol string, created_at timestamp, score double"
    at = lambda d, h=15: dt.datetime(2021, 1, d, h)
    files = [
        [("a", at(4), 0.2), ("a", at(4), 0.4), ("b", at(4), 1.0)],
        [("a", at(5), 0.5), ("a", at(4), 0.6)],  # a session may still get news
        [("a", at(7), 0.1)],
        [("a", at(4), 0.9), ("a", at(8), 0.3)],  # its session is closed now
        [(None, at(12), None)],
    ]
    progress = []
    for n, rows in enumerate(files):
        land(spark.createDataFrame(rows, shape), folder, n)
        means = daily.news_by_session(daily.session_files(spark, f"file://{folder}", shape), asof.session_map(cal), "1 day")
        progress += daily.run_sessions(means, out, f"file://{tmp_path}/log")
    got = {(r["symbol"], r["session_date"].day): (round(r["sentiment_raw"], 6), r["n_news"]) for r in spark.read.parquet(out).collect()}
    assert got == {("a", 4): (0.4, 3), ("b", 4): (1.0, 1), ("a", 5): (0.5, 1), ("a", 7): (0.1, 1), ("a", 8): (0.3, 1)}
    assert spark.read.parquet(out).count() == 5 and sum(p["late"] for p in progress) == 1
    assert max(p["open"] for p in progress) >= 3 and progress[-1]["open"] <= 1  # what has closed leaves the state


@pytest.fixture
def sink(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    work = daily.upsert_sink(spark, path, KEYS, SCHEMA)
    return path, lambda rows, n: work(spark.createDataFrame(rows, SCHEMA), n)


def rows_of(spark, path, **kw):
    return sorted(map(tuple, daily.read_upserted(spark, path, KEYS, SCHEMA, **kw).collect()))


def test_compaction_between_two_reads_changes_no_row(spark, sink):
    path, put = sink
    for n, rows in enumerate([[(1, 1), (2, 1)], [(2, 2), (3, 2)], [(1, 9)], [(4, 4)]]):
        put(rows, n)
    early = daily.read_upserted(spark, path, KEYS, SCHEMA)  # planned before, read after
    before = rows_of(spark, path)
    daily.compact(spark, path, None, KEYS, SCHEMA, 2)
    assert before == rows_of(spark, path) == sorted(map(tuple, early.collect())) == [(1, 9), (2, 2), (3, 2), (4, 4)]
    assert set(daily.live_batches(spark, path)[1]) == {2, 3}
    put([(2, 7)], 4)
    put([(4, 5)], 3)  # an old batch that is tried again takes its own place
    assert rows_of(spark, path) == [(1, 9), (2, 7), (3, 2), (4, 5)]
    gone = daily.sweep(spark, path, 1)
    assert sum(g.startswith("data-") for g in gone) == 4 and rows_of(spark, path) == [(1, 9), (2, 7), (3, 2), (4, 5)]
    assert daily.sweep(spark, path, 1) == []


def test_a_crash_after_each_step_leaves_one_state(spark, sink, monkeypatch):
    path, put = sink
    put([(1, 1), (2, 1)], 0)
    put([(1, 2)], 1)
    whole = rows_of(spark, path)
    publish = daily._publish

    def stopped(*a):
        raise KeyboardInterrupt

    monkeypatch.setattr(daily, "_publish", stopped)  # after the folder, before the manifest
    for step in (lambda: put([(2, 9)], 2), lambda: daily.compact(spark, path, None, KEYS, SCHEMA, 1)):
        with pytest.raises(KeyboardInterrupt):
            step()
        assert rows_of(spark, path) == whole
    monkeypatch.setattr(daily, "_publish", publish)
    rename = daily._files

    class Lost:
        """A file system whose rename doesn't come about."""

        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            return (lambda a, b: False) if name == "rename" else getattr(self.fs, name)

    monkeypatch.setattr(daily, "_files", lambda *a: (Lost(rename(*a)[0]), *rename(*a)[1:]))
    with pytest.raises(RuntimeError):
        put([(2, 9)], 2)
    monkeypatch.setattr(daily, "_files", rename)
    assert rows_of(spark, path) == whole
    put([(2, 9)], 2)
    daily.compact(spark, path, None, KEYS, SCHEMA, 2)
    assert rows_of(spark, path) == [(1, 2), (2, 9)]
    with pytest.raises(RuntimeError):
        daily._publish(spark, path, daily.live_batches(spark, path)[0], {})  # another writer was first


def test_a_read_of_some_keys_skips_folders(spark, sink):
    path, put = sink
    put([(k, k) for k in range(200)], 0)
    put([(k, -k) for k in range(0, 200, 2)], 1)
    wanted = spark.createDataFrame([(4,), (5,), (999,)], "k int")
    assert rows_of(spark, path, wanted=wanted) == [(4, -4), (5, 5)]
    plan = daily.read_upserted(spark, path, KEYS, SCHEMA, wanted=wanted)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan or "_bucket#" in plan.split("PartitionFilters", 1)[1][:200]
    files = daily.read_upserted(spark, path, KEYS, SCHEMA, wanted=wanted).select(F.input_file_name()).count()
    assert files == 2
