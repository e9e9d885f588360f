"""Streams over several micro-batches, and what a failed or repeated one leaves behind."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from docloom.streaming import events as V

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


@pytest.fixture
def folder(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    for k in range(4):
        rows = [(10 * k + i, start + dt.timedelta(hours=10 * k + i), i % 3, "end" if (k, i) in {(1, 0), (2, 4)} else "step", float(i)) for i in range(6)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def stream(spark, folder):
    return V.read_events(spark, folder, files_per_trigger=1)


def test_update_mode_keeps_keys_that_did_not_change(spark, folder):
    late = stream(spark, folder).where("user_id = 0 or event_id < 10")
    got = {r.user_id: r.n_events for r in V.run_available(V.latest_state(late), "update", ["user_id"]).collect()}
    assert got == {0: 8, 1: 2, 2: 2}
    with pytest.raises(ValueError, match="keys"):
        V.run_available(V.latest_state(stream(spark, folder)), "update")


def test_progress_ends_at_the_terminal_event(spark, folder):
    rows = V.run_available(V.job_progress(stream(spark, folder), ["end"])).collect()
    by_job = {}
    for r in sorted(rows, key=lambda r: r.step):
        by_job.setdefault(r.user_id, []).append((r.event_id, r.step, r.closed))
    assert by_job[0] == [(0, 1, False), (3, 2, False), (10, 3, True)] and by_job[1][-1] == (24, 6, True) and [s for _, s, _ in by_job[2]] == list(range(1, 9))


def test_dead_letters(spark, folder):
    done, dead = V.run_split(V.with_failures(stream(spark, folder), F.when(F.col("value") != 3, F.col("value") * 2)))
    assert done.count() == 20 and {r.status for r in done.collect()} == {"done"} and dead.count() == 4 and dead.first().error_message == "no result"


def test_upsert_repeats_a_batch_and_fails_on_a_broken_table(spark, tmp_path):
    path = str(tmp_path / "table")
    write = V.upsert_batch(path, ["k"], ["n"])
    one, two = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, n int, v string"), spark.createDataFrame([(2, 2, "c")], "k int, n int, v string")
    write(one, 0)
    for _ in range(2):
        write(two, 3)
    assert {(r.k, r.v) for r in V.last_version(spark, path).collect()} == {(1, "a"), (2, "c")}
    for f in (tmp_path / "table" / "v3").glob("*.parquet"):
        f.write_bytes(b"broken")
    with pytest.raises(Exception):
        write(two, 4)


def test_expired(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 1, 9))], "event_id int, ts timestamp")
    assert [r.event_id for r in V.expired(df, F.lit(dt.datetime(2024, 1, 10))).collect()] == [1]
