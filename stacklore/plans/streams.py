"""Queries that run a stream over the event table; the SQL gives the batch result."""

import uuid

from pyspark.sql import functions as F

from stacklore.catalog import query
from stacklore.sources.shared import shared_dir
from stacklore.sources.views import table
from stacklore.streaming import buckets as b
from stacklore.streaming import jobs as s
from stacklore.streaming import stateful as st


def _feed(spark, d):
    return s.change_feed(spark, f"{d}/events.parque*")


def _plain(df, *ts):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ts})


@query("SELECT event_id, event_type, (props->>'$.k')::BIGINT AS k FROM events")
def stm01_change_feed(spark, d):
    return s.drain(_feed(spark, d)).select("event_id", "event_type", "k")


@query("""WITH RECURSIVE e AS (SELECT user_id, ts, (props->>'$.k')::BIGINT AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events WHERE (props->>'$.k') IS NOT NULL),
s AS (SELECT user_id, nth, k, ts, true AS new, [k] AS seen, ts AS last FROM e WHERE nth = 1
UNION ALL SELECT user_id, nth, k, ts, new, CASE WHEN new THEN list_append(own, k) ELSE own END, CASE WHEN new THEN ts ELSE last END FROM (
  SELECT *, NOT list_contains(own, k) AS new FROM (SELECT e.user_id, e.nth, e.k, e.ts, s.last, CASE WHEN e.ts - s.last >= INTERVAL 2 HOUR THEN [] ELSE s.seen END AS own FROM s JOIN e ON e.user_id = s.user_id AND e.nth = s.nth + 1)))
SELECT user_id, k, ts FROM s WHERE new""")
def stm02_seen_once(spark, d):
    """What each session shows for the first time; it forgets two hours after the last of these."""
    return _plain(s.drain(st.seen_once(_feed(spark, d))), "ts")


@query("""WITH e AS (SELECT user_id, event_type, value, (props->>'$.k')::BIGINT AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS back_own FROM events)
SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean, round(avg(k), 6) AS mean_k, string_agg(k::VARCHAR, ',' ORDER BY back DESC) FILTER (back <= 50) AS recent, coalesce(string_agg(k::VARCHAR, ',' ORDER BY back DESC) FILTER (event_type = 'error' AND back_own <= 20), '') AS disliked,
coalesce(max(k) FILTER (event_type = 'click' AND back_own = 1), -1) AS anchor FROM e GROUP BY 1""")
def stm03_session_state(spark, d):
    out = s.drain(s.session_state(_feed(spark, d), ["value", "k"]))
    last = out.groupBy("user_id").agg(F.max_by(F.struct("n", "mean", "recent", "disliked", "anchor"), "n").alias("r")).select("user_id", "r.*")
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return last.select("user_id", "n", F.round(F.col("mean")[0], 6).alias("mean"), F.round(F.col("mean")[1], 6).alias("mean_k"), listed("recent"), listed("disliked"), "anchor")


@query("""WITH o AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events), g AS (SELECT *, sum((gap IS NULL OR gap > INTERVAL 2 HOUR)::INT) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM o),
x AS (SELECT user_id, count(*) AS n, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end" FROM g GROUP BY user_id, g) SELECT user_id, n, start, "end" FROM x WHERE "end" <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def stm04_sessions(spark, d):
    return _plain(s.drain(s.sessions(_feed(spark, d))), "start", "end")


_W = """w AS (SELECT start, start + INTERVAL 10 MINUTE AS "end", count(*) AS n, count_if(event_type = 'error') AS errors, count_if(value > 200) AS slow
FROM (SELECT *, time_bucket(INTERVAL 1 MINUTE, ts) - to_minutes(i) AS start FROM events, range(0, 10) r(i)) GROUP BY 1 HAVING start + INTERVAL 10 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events))"""


def _windows(spark, d):
    return s.rolling_metrics(_feed(spark, d), "10 minutes", "1 minute")


@query(f"WITH {_W} SELECT start, n, errors, slow FROM w")
def stm05_rolling_metrics(spark, d):
    """Ten minutes of figures, every minute."""
    return _plain(s.drain(_windows(spark, d)), "start").select("start", "n", "errors", "slow")


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, count_if(event_type = 'error') AS errors, count_if(value > 200) AS slow FROM events GROUP BY 1
HAVING start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def stm05_hourly_counts(spark, d):
    return _plain(s.drain(s.rolling_metrics(_feed(spark, d), "1 hour", "1 hour")), "start").select("start", "n", "errors", "slow")


@query(f"""WITH {_W}, h AS (SELECT "end" AS t FROM w WHERE errors > n * 0.1::DOUBLE), g AS (SELECT t, t - to_minutes(row_number() OVER (ORDER BY t)) AS island FROM h),
r AS (SELECT min(t) AS a, max(t) AS b FROM g GROUP BY island)
SELECT 'errors' AS rule, 'pending' AS state, a AS "at" FROM r UNION ALL SELECT 'errors', 'firing', a + INTERVAL 5 MINUTE FROM r WHERE b - a >= INTERVAL 5 MINUTE
UNION ALL SELECT 'errors', 'resolved', b + INTERVAL 1 MINUTE FROM r WHERE b - a >= INTERVAL 5 MINUTE AND b < (SELECT max("end") FROM w)""")
def stm06_threshold_alerts(spark, d):
    """The windows are written as they close and read by the alert rules as a stream of their own."""
    windows = s.drain(_windows(spark, d))
    fed = s.follow(windows).withWatermark("end", "0 seconds")
    return _plain(s.drain(st.alerts(st.hot_rows(fed, "errors"))), "at")


@query("""WITH e AS (SELECT user_id AS id, ts, event_type = 'purchase' AS final, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_type = 'purchase') AS next FROM events)
SELECT id, ts AS updated_at FROM e WHERE NOT final AND coalesce(next, (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)) - ts > INTERVAL 43200 SECOND""")
def stm07_stale_jobs(spark, d):
    """Each status sets a job's timer anew, a final one clears it."""
    status = _feed(spark, d).select(F.col("user_id").alias("id"), "ts", (F.col("event_type") == "purchase").alias("final"))
    return _plain(s.drain(st.stale_jobs(status, 43200)), "updated_at")


@query("""WITH n AS (SELECT event_id, any_value(user_id) AS item, any_value(event_type) AS kind, any_value(value) AS value FROM events GROUP BY 1)
SELECT item, count(*) AS total, count_if(value > 50) AS embedded, count_if(kind = 'click') AS a, count_if(kind = 'view') AS b, count_if(kind NOT IN ('click', 'view')) AS c, round(count_if(value > 50) / count(*), 4) AS coverage FROM n GROUP BY 1""")
def stm08_incremental_upsert(spark, d):
    """Rows by item as they come and change: how many, how many with a vector, how many of each level, and the coverage of all so far."""
    path = f"{shared_dir(spark)}/upserts-{uuid.uuid4().hex}"
    one = lambda c: c.cast("long")
    kind = F.col("event_type")
    measures = {"total": F.lit(1), "embedded": one(F.col("value") > 50), "a": one(kind == "click"), "b": one(kind == "view"), "c": one(~kind.isin("click", "view"))}
    rows = b.BucketTable(spark, f"{path}/rows", ["user_id", "event_id"], "user_id", "ts")
    sums = b.BucketTable(spark, f"{path}/sums", ["user_id"], "user_id", "batch_number")
    schema = "event_id long, user_id long, event_type string, value double, ts timestamp"
    feed = s.change_feed(spark, f"{d}/events.parque*").select("event_id", "user_id", "event_type", "value", "ts")
    s.drain_batches(feed, b.refresh(rows, sums, schema, "user_id", measures))
    out = sums.read("user_id long, " + ", ".join(f"{m} long" for m in measures) + ", batch_number long").drop("batch_number").withColumnRenamed("user_id", "item")
    return out.withColumn("coverage", F.round(F.col("embedded") / F.col("total"), 4))


@query("SELECT user_id, event_type, min(ts) AS first_at FROM events GROUP BY ALL")
def stm09_freshness_probe(spark, d):
    out = s.drain(s.change_feed(spark, f"{d}/events.parque*").select("user_id", "event_type", "ts"))
    return _plain(s.first_ready(out), "first_at")
