"""Ordered folds by key over event logs: token bucket, circuit breaker, TTL cache; batch and stream share the steps.

A batch deals the log by key, sorts each partition by key and time, and steps through it batch by batch, so a
key's log is never in memory as a whole; a stream keeps the state by key in ``transformWithStateInPandas``.
``start`` and ``step`` of a machine are the one definition of both.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class TokenBucket:
    """At most ``limit`` tokens; one comes back for each whole interval gone by, whose fraction is lost."""

    limit: int = 3
    interval_ms: int = 1000
    output = "allowed boolean"

    def start(self):
        return (self.limit, None)

    def step(self, state, ts_ms: int, ok: bool):
        left, last = state
        last = ts_ms if last is None else last
        gained = (ts_ms - last) // self.interval_ms
        if gained > 0:
            left, last = min(self.limit, left + gained), ts_ms
        return ((left - 1, last), (True,)) if left > 0 else ((left, last), (False,))


@dataclass(frozen=True)
class Breaker:
    """Closed; open from ``failures`` failures in a row on; half-open once ``timeout_ms`` is over since the last failure.

    Half-open admits every call: ``probes`` successes close it, and a failure opens it again as soon as the
    failures in a row (a success resets them, opening doesn't) are enough.
    """

    failures: int = 2
    timeout_ms: int = 1000
    probes: int = 5
    output = "state string, admitted boolean"

    def start(self):
        return ("closed", 0, 0, 0)

    def step(self, state, ts_ms: int, ok: bool):
        name, failed, since, good = state
        if name == "open":
            if ts_ms - since <= self.timeout_ms:
                return state, (name, False)
            name, good = "half-open", 0
        if not ok:
            failed, since = failed + 1, ts_ms
            name = "open" if failed >= self.failures else name
        elif name == "half-open":
            failed, good = 0, good + 1
            name = "closed" if good >= self.probes else name
        else:
            failed = 0
        return (name, failed, since, good), (name, True)


@dataclass(frozen=True)
class TtlCache:
    """A value is there for ``ttl_ms`` after it was last set (``ok``); a look-up doesn't renew it."""

    ttl_ms: int = 1000
    output = "hit boolean"

    def start(self):
        return (None,)

    def step(self, state, ts_ms: int, ok: bool):
        (at,) = state
        return ((ts_ms,) if ok else state), (at is not None and ts_ms <= at + self.ttl_ms,)


def fold(df: DataFrame, machine, key: str, ts_ms: str, ok: str, event: str) -> DataFrame:
    """(key, event, outputs) of each event (ties in time by event id), one state machine a key."""
    names = [x.split()[0] for x in machine.output.split(", ")]

    def run(batches):
        now, state = None, None
        for b in batches:
            rows = []
            for k, t, o in zip(b.column(key).to_pylist(), b.column(ts_ms).to_pylist(), b.column(ok).to_pylist(), strict=True):
                if state is None or k != now:
                    now, state = k, machine.start()
                state, out = machine.step(state, t, o)
                rows.append(out)
            if rows:
                yield pa.RecordBatch.from_arrays([b.column(key), b.column(event), *(pa.array(c) for c in zip(*rows, strict=True))], names=[key, event, *names])

    types = dict(df.dtypes)
    dealt = df.select(key, event, ts_ms, ok).repartition(key).sortWithinPartitions(key, ts_ms, event)
    return dealt.mapInArrow(run, f"{key} {types[key]}, {event} {types[event]}, {machine.output}")


def fold_stream(df: DataFrame, machine, key: str, ts_ms: str, ok: str, event: str) -> DataFrame:
    """The same over a stream: state by key, events of a micro-batch in time order."""
    import json

    from pyspark.sql.streaming import StatefulProcessor

    names = [x.split()[0] for x in machine.output.split(", ")]

    class Keeper(StatefulProcessor):
        def init(self, handle):
            self.state = handle.getValueState("state", "json string")

        def handleInputRows(self, k, rows, timers):
            pdf = pd.concat(list(rows)).sort_values([ts_ms, event], kind="stable")
            state, out = (tuple(json.loads(self.state.get()[0])) if self.state.exists() else machine.start()), []
            for e, t, o in zip(pdf[event].tolist(), pdf[ts_ms].tolist(), pdf[ok].tolist(), strict=True):
                state, got = machine.step(state, t, o)
                out.append((k[0], e, *got))
            self.state.update((json.dumps(state),))
            yield pd.DataFrame(out, columns=[key, event, *names])

        def close(self):
            pass

    types = dict(df.dtypes)
    return df.select(key, event, ts_ms, ok).groupBy(key).transformWithStateInPandas(Keeper(), f"{key} {types[key]}, {event} {types[event]}, {machine.output}", "append", "none")
