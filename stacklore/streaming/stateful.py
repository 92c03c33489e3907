"""Streaming jobs with state and timers of their own: what has been seen, alerts that must hold, jobs that stand still.

Rows of a batch are taken in order of event time, and what a batch leaves in the state is all that the next one
needs, so runs in one batch and in many give the same rows, as long as batches follow one another in time. Times are microseconds in the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SECOND, MINUTE, HOUR = 1_000_000, 60_000_000, 3_600_000_000
#: How long a session remembers what it has shown after the last that was new.
SEEN_LIFE = 2 * HOUR


def _us(ts: pd.Series) -> list[int]:
    return ts.astype("datetime64[us]").astype("int64").tolist()


def _time(us: list[int]) -> pd.Series:
    return pd.Series(us, dtype="int64").astype("datetime64[us]").astype("datetime64[ns]")


def _wake(state: GroupState, at: int) -> None:
    """Set the timer of a group to the millisecond in which ``at`` is past."""
    state.setTimeoutTimestamp(max(at // 1000 + 1, state.getCurrentWatermarkMs() + 1))


def seen_once(feed: DataFrame, life: int = SEEN_LIFE) -> DataFrame:
    """user_id, k, ts of events whose chunk the session has not shown yet; a session forgets all ``life`` after it last showed a new one.

    The life is one of event time and has nothing to do with the delay of the watermark. Rows without a chunk never pass.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, last = state.get if state.exists else ([], None)
        seen, out = set(seen), []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        rows = rows[rows["k"].notna()]
        for k, at in zip(rows["k"].astype("int64"), _us(rows["ts"])):
            if last is not None and at - last >= life:
                seen = set()
            if k not in seen:
                seen.add(k)
                out.append((k, at))
                last = at if last is None else max(last, at)
        if last is not None:
            state.update((sorted(int(k) for k in seen), last))
            _wake(state, last + life)
        yield pd.DataFrame({"user_id": [key[0]] * len(out), "k": [k for k, _ in out], "ts": _time([t for _, t in out])})

    return feed.groupBy("user_id").applyInPandasWithState(step, "user_id long, k long, ts timestamp", "seen array<bigint>, last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def alerts(metrics: DataFrame, held: int = 5 * MINUTE, every: int = MINUTE) -> DataFrame:
    """rule, state, at: ``pending`` when a rule first holds, ``firing`` when it has held for ``held``, ``resolved`` when it no longer does after that.

    ``metrics`` is a stream of rule, ts (the time a value is for) and hot (whether the rule holds), one row every ``every``. A time
    without a row is one at which the rule does not hold; if no row follows, a timer says so.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since, last, fired = state.get if state.exists else (None, None, False)
        out = []

        def end(at: int) -> None:
            nonlocal since, fired
            if fired:
                out.append(("resolved", at))
            since, fired = None, False

        if state.hasTimedOut:
            end(last + every)
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values("ts")
            for at, hot in zip(_us(rows["ts"]), rows["hot"]):
                if since is not None and at > last + every:
                    end(last + every)
                if not hot:
                    if since is not None:
                        end(at)
                else:
                    if since is None:
                        since = at
                        out.append(("pending", at))
                    if not fired and at - since >= held:
                        fired = True
                        out.append(("firing", at))
                last = at
            if since is None:
                state.remove()
            else:
                state.update((since, last, fired))
                _wake(state, last + every)
        yield pd.DataFrame({"rule": [key[0]] * len(out), "state": [s for s, _ in out], "at": _time([t for _, t in out])})

    return metrics.groupBy("rule").applyInPandasWithState(step, "rule string, state string, at timestamp", "since bigint, last bigint, fired boolean", "append", GroupStateTimeout.EventTimeTimeout)


def stale_jobs(status: DataFrame, seconds: int) -> DataFrame:
    """id, updated_at of every time a job stood still for more than ``seconds`` after a status that was not final.

    ``status`` is a stream of id, ts and final. Each row of a job sets its timer anew, a final one clears it.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, out = (state.get[0] if state.exists else None), []
        if state.hasTimedOut:
            out.append(last)
            last = None
        else:
            rows = pd.concat(list(batches)).sort_values(["ts", "final"])
            for at, final in zip(_us(rows["ts"]), rows["final"]):
                if last is not None and at - last > seconds * SECOND:
                    out.append(last)
                last = None if final else at
        if last is None:
            state.remove()
        else:
            state.update((last,))
            _wake(state, last + seconds * SECOND)
        yield pd.DataFrame({"id": [key[0]] * len(out), "updated_at": _time(out)})

    return status.groupBy("id").applyInPandasWithState(step, "id long, updated_at timestamp", "last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def hot_rows(windows: DataFrame, rule: str, ratio: float = 0.1) -> DataFrame:
    """rule, ts, hot of windows (end, n, errors): whether the share of errors is above ``ratio`` at the end of each."""
    return windows.select(F.lit(rule).alias("rule"), F.col("end").alias("ts"), (F.col("errors") > F.col("n") * ratio).alias("hot"))
