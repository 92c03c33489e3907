"""Streams with state over several micro-batches against plain replays of the same rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stacklore.streaming import buckets as b
from stacklore.streaming import jobs as s
from stacklore.streaming import stateful as st

START = datetime(2024, 3, 1, 22, 0)


def _stream(spark, tmp_path, batches, schema, ts="ts", delay="1 minute"):
    """The batches as files that a stream takes one at a time, in order of time."""
    folder = f"{tmp_path}/in-{random.random()}"
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{n:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{folder}/*").withWatermark(ts, delay)


def _cut(rows, n):
    return [rows[i * len(rows) // n : (i + 1) * len(rows) // n] for i in range(n)]


EVENTS = "event_id long, ts timestamp, user_id long, k long"


@pytest.mark.parametrize("n", [1, 4, 9])
def test_seen_once_forgets_after_two_hours(spark, tmp_path, n):
    at = lambda m: START + timedelta(minutes=m)
    rows = [(0, at(0), 1, 5), (1, at(60), 1, 5), (2, at(150), 1, 5), (3, at(151), 1, None), (4, at(200), 1, 6), (5, at(290), 1, 5), (6, at(400), 1, 5), (7, at(400), 2, 5), (8, at(900), 3, 1)]
    got = s.drain(st.seen_once(_stream(spark, tmp_path, _cut(rows, n), EVENTS))).collect()
    # a new chunk after 200 minutes keeps the session, so 290 is still known and 400 is not
    assert sorted((r.user_id, r.k, r.ts) for r in got) == sorted([(1, 5, at(0)), (1, 5, at(150)), (1, 6, at(200)), (1, 5, at(400)), (2, 5, at(400)), (3, 1, at(900))])


def _replay_alerts(rows, held=5):
    out, state = [], {}
    for at, rule, hot in sorted(rows):
        since, last, fired = state.get(rule, (None, None, False))
        if since is not None and at - last > timedelta(minutes=1):
            out += [(rule, "resolved", last + timedelta(minutes=1))] * fired
            since, fired = None, False
        if hot and since is None:
            since, fired = at, False
            out.append((rule, "pending", at))
        if hot and not fired and at - since >= timedelta(minutes=held):
            fired = True
            out.append((rule, "firing", at))
        if not hot and since is not None:
            out += [(rule, "resolved", at)] * fired
            since, fired = None, False
        state[rule] = (since, at, fired)
    return sorted(out)


@pytest.mark.parametrize("n", [1, 3, 8])
def test_alerts_across_midnight_and_missing_windows(spark, tmp_path, n):
    rng = random.Random(6)
    rows = []
    for rule in ("a", "b"):
        hot = False
        for m in range(240):  # two hours on either side of midnight
            hot = hot if rng.random() < 0.85 else not hot
            if rng.random() < 0.95:
                rows.append((START + timedelta(minutes=m), rule, hot))
        rows += [(START + timedelta(minutes=300), rule, False)]
    rows.sort()
    want = _replay_alerts(rows)
    assert {x for _, x, _ in want} == {"pending", "firing", "resolved"}
    feed = _stream(spark, tmp_path, _cut(rows, n), "ts timestamp, rule string, hot boolean", delay="0 seconds")
    got = sorted((r.rule, r.state, r["at"]) for r in s.drain(st.alerts(feed)).collect())
    assert got == want
    gap = [(START + timedelta(minutes=110 + m), "c", True) for m in range(4)] + [(START + timedelta(minutes=830), "c", True)]
    feed = _stream(spark, tmp_path, _cut(gap, 2), "ts timestamp, rule string, hot boolean", delay="0 seconds")
    assert {r.state for r in s.drain(st.alerts(feed)).collect()} == {"pending"}  # hot twice with nothing between never fires


def test_a_timer_resolves_an_alert_that_goes_silent(spark, tmp_path):
    hot = [(START + timedelta(minutes=m), "a", True) for m in range(8)]
    later = [(START + timedelta(minutes=60 + m), "z", False) for m in range(3)]
    feed = _stream(spark, tmp_path, [hot, later[:1], later[1:]], "ts timestamp, rule string, hot boolean", delay="0 seconds")
    got = sorted((r["at"], r.state) for r in s.drain(st.alerts(feed)).collect())
    assert got == [(START, "pending"), (START + timedelta(minutes=5), "firing"), (START + timedelta(minutes=8), "resolved")]


@pytest.mark.parametrize("n", [1, 5])
def test_stale_jobs(spark, tmp_path, n):
    rng = random.Random(9)
    rows = sorted((START + timedelta(seconds=rng.randrange(40_000)), rng.randrange(6), rng.random() < 0.3) for _ in range(60))
    rows.append((START + timedelta(hours=30), 99, True))
    want = []
    for job in range(6):
        own = [(at, final) for at, j, final in rows if j == job]
        for (at, final), (nxt, _) in zip(own, [*own[1:], (START + timedelta(hours=29), None)]):
            want += [(job, at)] if not final and nxt - at > timedelta(seconds=3000) else []
    feed = _stream(spark, tmp_path, _cut(rows, n), "ts timestamp, id long, final boolean")
    got = sorted((r.id, r.updated_at) for r in s.drain(st.stale_jobs(feed, 3000)).collect())
    assert got == sorted(want)


SCHEMA = "event_id long, user_id long, value double, ts timestamp"


def test_upserts_touch_their_buckets_only(spark, tmp_path):
    rng = random.Random(2)
    rows = b.BucketTable(spark, f"file://{tmp_path}/rows", ["user_id", "event_id"], "user_id", "ts", 4)
    sums = b.BucketTable(spark, f"file://{tmp_path}/sums", ["user_id"], "user_id", "batch_number", 4)
    apply = b.refresh(rows, sums, SCHEMA, "user_id", {"total": F.lit(1), "high": (F.col("value") > 5).cast("long")})
    state, batches = {}, []
    for n in range(6):
        users = [1, 2, 3, 4, 5, 6] if n == 0 else [n % 3 + 1]
        batches.append([(rng.randrange(5), u, float(rng.randrange(10)), START + timedelta(minutes=60 * n + i)) for i, u in enumerate(users * 4)])
    frame = lambda n: spark.createDataFrame(batches[n], SCHEMA)
    for n, batch in enumerate(batches):
        before = rows.current()
        apply(frame(n), n)
        state |= {(u, i): v for i, u, v, _ in sorted(batch, key=lambda r: r[3])}
        after = rows.current()
        assert sum(before.get(k) != after[k] for k in after) <= len({r[1] for r in batch})
        assert len(rows.read(SCHEMA).inputFiles()) <= 4  # one file a bucket, however many batches
    apply(frame(3), 3)  # a batch that runs again
    got = {(r.user_id, r.event_id): r.value for r in rows.read(SCHEMA).collect()}
    assert got == state
    want = {u: (sum(x == u for x, _ in state), sum(v > 5 for (x, _), v in state.items() if x == u)) for u in range(1, 7)}
    assert {r.user_id: (r.total, r.high) for r in sums.read("user_id long, total long, high long, batch_number long").collect()} == want


def test_a_broken_batch_is_replaced(spark, tmp_path):
    table = b.BucketTable(spark, f"file://{tmp_path}/t", ["user_id", "event_id"], "user_id", "ts", 4)
    table.upsert(spark.createDataFrame([(1, 1, 1.0, START)], SCHEMA), 0)
    # what a run that died has left: rows without a mark
    (tmp_path / "t" / "batch=1").mkdir()
    spark.createDataFrame([(9, 1, 9.0, START)], SCHEMA).write.parquet(f"file://{tmp_path}/t/batch=1/bucket=0")
    assert [r.event_id for r in table.read(SCHEMA).collect()] == [1]
    table.upsert(spark.createDataFrame([(2, 1, 2.0, START)], SCHEMA), 1)
    assert sorted(r.event_id for r in table.read(SCHEMA).collect()) == [1, 2]
