"""Queries of streams against plain Python on the smallest tables."""

from collections import Counter
from datetime import timedelta

from spanloom.plans.queries import QUERIES
from spanloom.sources.store import Store
from spanloom.streaming import jobs as streams
from test_queries import SF


def events(spark):
    return spark.read.parquet(f"{SF}/events.parquet").selectExpr("event_id", "user_id", "event_type", "cast(ts AS timestamp) AS ts", "unix_timestamp(cast(ts AS timestamp)) AS s").collect()


def test_daily_is_a_stream_of_several_runs(spark):
    """All events are counted once, in their window or as late; windows that the watermark has not passed are there."""
    got = QUERIES["stream_daily"](spark, SF).collect()
    seen = events(spark)
    assert sum(r.n for r in got) == len(seen) and sum(r.ids for r in got) == sum(r.event_id for r in seen)
    assert any(r.day is None for r in got) and max(r.day for r in got if r.day) == str(max(r.ts for r in seen).date())


def test_upserts_of_a_repeated_run(spark):
    """A second run that brings nothing new, and rows that change a window that was written before."""
    rows = lambda *x: spark.createDataFrame(x, "event_id long, event_type string, ts string")
    first = rows((1, "a", "2024-01-01 01:00:00"), (2, "a", "2024-01-01 02:00:00"), (3, "b", "2024-01-02 02:00:00"))
    more = rows((4, "a", "2024-01-01 23:00:00"), (5, "a", "2024-01-20 00:00:00"))
    late = rows((6, "a", "2024-01-01 23:00:00"), (7, "a", "2024-01-12 23:00:00"))
    counted, arrived = streams.upserted([first, first.limit(0), more, late], lambda s: streams.daily(s, "10 days"), ["day", "event_type"])
    assert sorted(map(tuple, counted.collect())) == [("2024-01-01", "a", 3, 7), ("2024-01-02", "b", 1, 3), ("2024-01-12", "a", 1, 7), ("2024-01-20", "a", 1, 5)]
    assert arrived.count() == 7


def test_store_merges_folds_and_clears(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(x, "k long, v string")
    store = Store(spark, str(tmp_path / "store"), rows((0, "")).schema, ["k"])
    held = lambda: sorted(map(tuple, store.rows().collect()))
    assert held() == []
    store.merge(rows((1, "a"), (2, "b"), (None, "n")), 0)
    store.merge(rows((2, "c"), (3, "d"), (3, "e"), (4, None)), 1)
    want = sorted([(1, "a"), (2, "c"), (3, "e"), (4, None), (None, "n")], key=str)
    assert sorted(map(tuple, store.rows().collect()), key=str) == want
    store.merge(rows((2, "c"), (3, "d"), (3, "e"), (4, None)), 1)  # the same batch again
    assert sorted(map(tuple, store.rows().collect()), key=str) == want
    store.compact(1)
    assert sorted(map(tuple, store.rows().collect()), key=str) == want
    store.merge(rows((1, "z")), 0)  # a batch that a fold holds already changes nothing
    store.merge(rows((1, "y")), 2)
    assert [tuple(r) for r in store.peek(k=1).collect()] == [(1, "y")] and store.peek(k=9).count() == 0
    rows((1, "torn")).write.parquet(store._folder("base", 7))  # a fold that broke off before its mark
    assert [tuple(r) for r in store.peek(k=1).collect()] == [(1, "y")]
    store.clear(2)
    assert held() == []
    store.merge(rows((5, "q")), 3)
    assert held() == [(5, "q")]


def test_sessions_hold_all_events(spark):
    by = {}
    for r in events(spark):
        by.setdefault(r.user_id, []).append((r.ts, r.s))
    want = []
    for user, seen in by.items():
        before = None
        for ts, s in sorted(seen):
            if before is None or ts - before > timedelta(days=1):
                want.append([user, s, 0])
            want[-1][2] += 1
            before = ts
    got = QUERIES["stream_sessions"](spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def fold(rows, last, stale=120):
    """Claims in plain Python: rows (item, worker, second, kind) to the same with accepted, and freed claims."""
    out, items = [], {}
    for item, worker, second, kind in sorted(rows, key=lambda r: (r[0], r[2], r[1], r[3])):
        holder, seen, done = items.get(item, ("", 0, False))
        if holder and not done and second - seen > stale:
            out.append((item, holder, seen + stale, "freed", True))
            holder = ""
        ok = not done and (holder == worker or (holder == "" and kind == "claim"))
        items[item] = (worker, second, kind == "done") if ok else (holder, seen, done)
        out.append((item, worker, second, kind, ok))
    out += [(i, h, s + stale, "freed", True) for i, (h, s, done) in items.items() if h and not done and s + stale < last]
    return sorted(out)


def test_claims_equal_plain_python(spark):
    out = QUERIES["stream_claims"](spark, SF)
    rows = [(r.event_id % 500, f"w{r.user_id % 5}", r.event_id % 1000 + 1, ["claim", "claim", "beat", "done"][r.event_id % 4]) for r in events(spark)]
    assert sorted(tuple(r) for r in out.collect()) == fold(rows, max(r[2] for r in rows)) and out.inputFiles()


def test_claims_over_several_batches(spark, tmp_path):
    """State and timers live from run to run: a worker that goes silent loses its claim when the watermark has passed it."""
    log = str(tmp_path / "log")
    kind = "item long, worker string, second long, kind string"
    runs = [
        [(1, "a", 100, "claim"), (2, "a", 100, "claim"), (3, "a", 100, "claim"), (4, "a", 100, "beat")],
        [(1, "b", 150, "claim"), (2, "a", 200, "beat"), (3, "a", 160, "done"), (9, "x", 230, "claim")],
        [(1, "b", 240, "claim"), (2, "b", 300, "claim"), (3, "b", 310, "claim"), (9, "x", 231, "beat")],
        [(2, "b", 330, "claim"), (1, "a", 335, "done"), (1, "b", 340, "done"), (9, "y", 900, "claim")],
    ]
    path, state = str(tmp_path / "out"), str(tmp_path / "state")
    for rows in runs:
        spark.createDataFrame(rows, kind).write.mode("append").parquet(log)
        stream = streams.claims(spark.readStream.schema(kind).parquet(log))
        streams.run_out(spark, stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", state).outputMode("append"))
    got = sorted(tuple(r) for r in spark.read.parquet(path).collect())
    assert got == fold([r for rows in runs for r in rows], 900)
    assert (1, "a", 220, "freed", True) in got and (2, "b", 330, "claim", True) in got


def test_callbacks_once_each(spark):
    out = QUERIES["stream_callbacks"](spark, SF)
    assert sorted(r.job_id for r in out.collect()) == sorted({r.user_id % 20 for r in events(spark)}) and out.inputFiles()


def test_drained_stream_without_rows(spark, tmp_path):
    (tmp_path / "log").mkdir()
    log = spark.readStream.schema("item long, worker string, second long, kind string").parquet(str(tmp_path / "log"))
    assert streams.drained(streams.claims(log), "none").collect() == []
