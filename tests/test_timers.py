"""Streams whose state ends: timers against session windows, and how many rows of state are left."""

from datetime import timedelta

from test_sources import batches

from mdloom.streaming import streams as Z
from mdloom.streaming import timers as T


def run(result, folder, mode):
    """Run to the end of what is there; the rows put out, and the progress of the last batch."""
    query = result.writeStream.format("memory").queryName(folder).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return result.sparkSession.table(folder).collect(), query.lastProgress


def test_a_timer_closes_each_burst_once(spark, tmp_path):
    parts = [
        [("k", "2024-01-01 00:00:05", "late start"), ("k", "2024-01-01 00:00:01", "b"), ("m", "2024-01-01 00:00:00", "x"), ("n", "2024-01-01 00:00:00", None)],
        [("k", "2024-01-01 00:00:03", "joins both"), ("k", "2024-01-01 01:00:00", "d"), ("k", "2024-01-01 01:00:00", "e")],
        [("m", "2024-01-01 03:00:00", "y")],
        [("k", "2024-01-01 00:00:03", "too late"), ("z", "2024-01-01 09:00:00", "end")],
    ]
    edits = batches(spark, tmp_path, parts, "key string, at string, content string").selectExpr("key", "cast(at as timestamp) as ts", "content")
    with T.with_state_store(spark):
        rows, last = run(T.debounced_by_timer(edits, timedelta(seconds=2), "10 minutes"), "bursts", "append")
    told = sorted((r.key, str(r.started), str(r.saved), r.content) for r in rows)
    windows, _ = run(Z.debounced_latest(edits, "2 seconds", "10 minutes"), "windows", "append")
    assert told[:3] == [("k", "2024-01-01 00:00:01", "2024-01-01 00:00:07", "late start"), ("k", "2024-01-01 01:00:00", "2024-01-01 01:00:02", "e"), ("m", "2024-01-01 00:00:00", "2024-01-01 00:00:02", "x")]
    assert sorted((r.key, str(r.started), str(r.saved), r.content) for r in windows) == told
    left = {k: v for k, v in last.stateOperators[0].customMetrics.items() if "NumOfValueState" in k or "numKeys" in k.lower()}
    assert last.stateOperators[0].numRowsTotal <= 4, left  # z's burst: a list of one, its counter, and the timer in two indexes


def test_a_key_has_one_timer_however_many_bursts(spark, tmp_path):
    day = [("k", f"2024-01-01 {h:02d}:{m:02d}:00", f"{h}:{m}") for h in range(24) for m in range(0, 60, 10)]
    edits = batches(spark, tmp_path, [day[::-1], [("z", "2024-01-01 12:05:00", "late"), ("k", "2024-01-02 00:00:00", "x")]], "key string, at string, content string").selectExpr("key", "cast(at as timestamp) as ts", "content")
    with T.with_state_store(spark):
        rows, last = run(T.debounced_by_timer(edits, timedelta(seconds=2), "12 hours"), "day", "append")
    assert sorted((r.key, r.content) for r in rows) == sorted(("k", c) for _, at, c in day if at < "2024-01-01 12")
    assert last.stateOperators[0].numRowsTotal <= 90  # k's open bursts and z's, and two rows of a timer for each key; 74 timers would be 148 more


def test_jobs_that_end_leave_no_state(spark, tmp_path):
    first = [(f"j{i}", "2024-01-01 00:00:00", "uploading") for i in range(200)] + [("old", "2024-01-01 00:00:00", "extracting")]
    second = [(f"j{i}", "2024-01-01 00:10:00", "complete" if i % 2 else "error") for i in range(199)] + [("j199", "2024-01-01 00:10:00", "formatting")]
    stages = batches(spark, tmp_path, [first, second, [("j199", "2024-01-03 00:00:00", "generating")], [("j199", "2024-01-03 00:00:01", "formatting")]], "job string, at string, stage string").selectExpr("job", "cast(at as timestamp) as ts", "stage")
    with T.with_state_store(spark):
        rows, last = run(T.progress_until_done(stages), "progress", "update")
    assert len(rows) == len(first) + len(second) + 2
    ends = {r.job: r.stage for r in sorted(rows, key=lambda r: r.ts)}
    assert ends == {f"j{i}": "complete" if i % 2 else "error" for i in range(199)} | {"j199": "formatting", "old": "extracting"}
    assert last.stateOperators[0].numRowsTotal <= 3  # one job under way: its value, and its timer in two indexes
