"""Streams over a folder of Parquet files."""

import datetime as dt
import time

from archivolt.operators import audit
from archivolt.streaming import watch


def test_windows_repeats_and_revocations(spark, tmp_path):
    t = lambda m: dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=m)
    rows = [(1, t(0), "a"), (2, t(10), "a"), (2, t(10), "a"), (3, t(70), "b"), (4, t(75), "a")]
    df = spark.createDataFrame(rows, "id int, ts timestamp, k string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: watch.read_events(spark, str(tmp_path / "in"), df.schema)
    counts = watch.drain(watch.windowed_counts(stream(), "ts", "k"), "complete").collect()
    assert sorted((r.window_start.hour, r.k, r.n) for r in counts) == [(0, "a", 3), (1, "a", 1), (1, "b", 1)]
    assert watch.drain(watch.without_repeats(stream(), "ts", "id"), "append").count() == 4
    left = watch.drain(watch.not_revoked(stream(), spark.createDataFrame([("a",)], "k string"), "k"), "append").collect()
    assert [r.id for r in left] == [3]
    sessions = watch.drain(watch.sessions(stream(), "ts", "k"), "complete").collect()
    assert sorted((r.k, r.n) for r in sessions) == [("a", 1), ("a", 3), ("b", 1)]


def test_late_events_are_dropped(spark, tmp_path):
    t = lambda m: dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=m)
    for rows in (([(1, t(0), "a"), (2, t(200), "a")], [(6, t(201), "b")], [(3, t(5), "a"), (4, t(190), "a")], [(5, t(400), "a")])):
        df = spark.createDataFrame(rows, "id int, ts timestamp, k string")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken in order of their times
    stream = watch.read_events(spark, str(tmp_path / "in"), df.schema, files_per_trigger=1)
    counts = watch.drain(watch.windowed_counts(stream, "ts", "k", late="30 minutes"), "append").collect()
    assert sorted((r.window_start.hour, r.n) for r in counts if r.k == "a") == [(0, 1), (3, 2)]  # event 3 comes too late, event 4 does not


def test_state_changes_over_batches(spark, tmp_path):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    for rows in ([("k", t(1), "active"), ("k", t(2), "active"), ("q", t(1), "frozen")], [("k", t(4), "withdrawn"), ("k", t(3), "active"), ("q", t(2), "frozen")]):
        df = spark.createDataFrame(rows, "key string, ts timestamp, state string")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = watch.read_events(spark, str(tmp_path / "in"), df.schema, files_per_trigger=1)
    got = watch.drain(watch.state_changes(stream, "key", "ts", "state"), "append").collect()
    assert sorted((r.key, r.before or "", r.after) for r in got) == [("k", "", "active"), ("k", "active", "withdrawn"), ("q", "", "frozen")]


def test_chains_grow_by_batches(spark, tmp_path):
    """Two batches, one of them repeated in part, give the chain that one batch over all events gives."""
    columns = "event_id string, event_type string, record_id string, actor_role string, actor_id string, event_time string, reason string, evidence_ref string, prev_hash string, hash string, metadata map<string,string>, ingested_at int"
    row = lambda i, r: (f"e{i}", "t", r, "role", None, f"2024-01-01T00:00:0{i}Z", None, None, None, None, {"k": "v"}, i)
    batches = [[row(0, "r"), row(1, "s"), row(2, "r")], [row(2, "r"), row(3, "r"), row(4, "s"), row(5, "new")]]
    for rows in batches:
        df = spark.createDataFrame(rows, columns)
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = watch.read_events(spark, str(tmp_path / "in"), df.schema, files_per_trigger=1)
    watch.extend_chains(stream, str(tmp_path / "log"), str(tmp_path / "state"))
    whole = audit.emit_chain(spark.read.parquet(str(tmp_path / "in")))
    order = lambda d: sorted((r.record_id, r.line, r.event_id, r.prev_hash, r.hash) for r in d.collect())
    assert order(spark.read.parquet(str(tmp_path / "log"))) == order(whole)
