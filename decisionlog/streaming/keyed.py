"""Keyed state of the stream jobs that depend on the row before a row (R4, R5), on Spark's own state store.

Keys come as one text each (``of_key``) and are dealt to buckets by its hash. Spark groups a micro-batch by bucket: a bucket's rows meet in one call of Python, which reads the state of
the bucket's keys once, as an array with an entry per key, and writes it once. The cost of a batch follows its rows and the buckets they touch, not the number of keys times calls.
Batches bound what one task sees of a busy key: read the log with ``files_per_batch``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_PROVIDER, _IDLE = "spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.noDataMicroBatches.enabled"


@contextmanager
def keyed_state(spark: SparkSession, idle_batches: bool = True):
    """For the queries started inside: state on disk, which keyed state needs.

    ``idle_batches``: whether batches without rows run, as event-time timers and the end of windows need them. State with a time to live asks for them
    without end, so a query that should stop when its log is read goes without.
    """
    wanted = {_PROVIDER: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", _IDLE: str(idle_batches).lower()}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def _whole(rows: Iterator[pd.DataFrame], order: Sequence[str]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(list(order), na_position="first", kind="stable", ignore_index=True)


_WHOLE = ("tinyint", "smallint", "int", "bigint", "long")


def _kinds(ddl: str) -> list[str]:
    return [c.split(" ", 1)[1] for c in ddl.split(", ")]


def _plain(value, kind: str):
    """A value as the state store takes it; columns of whole numbers with nulls come as floats."""
    if value is None or (isinstance(value, float) and value != value) or value is pd.NaT:
        return None
    value = value.tolist() if hasattr(value, "tolist") else value
    return int(value) if kind in _WHOLE else value


def _bare(value):
    """A value read from state as it may be written again: rows inside become tuples."""
    return list(map(_bare, value)) if isinstance(value, list) else tuple(map(_bare, value)) if isinstance(value, tuple) else value


def _first_nulls(place: Sequence) -> tuple:
    return tuple((x is not None, x) for x in place)


class PreviousRow(StatefulProcessor):
    """Rows with the values of the row before them, each key's last row as state that ends after ``ttl_ms`` without an update.

    A row that does not come after its key's last row is late: it gets no values and leaves the state as it is.
    """

    def __init__(self, order: Sequence[str], places: str, values: dict[str, str], kept: str, ttl_ms: int | None):
        self.order, self.values, self.ttl_ms = list(order), dict(values), ttl_ms
        self.place_kinds, self.kinds = _kinds(places), _kinds(kept)
        self.schema = f"last array<struct<of_key string, updated long, place struct<{places}>, kept struct<{kept}>>>"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", self.schema, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs() if self.ttl_ms else 0
        state = self.last.get()
        held = {k: x for k, *x in _bare(state[0])} if state else {}
        if self.ttl_ms:
            held = {k: x for k, x in held.items() if x[0] + self.ttl_ms > now}
        batch = _whole(rows, ["of_key", *self.order])
        places = list(zip(*[[_plain(v, kind) for v in batch[c]] for c, kind in zip(self.order, self.place_kinds, strict=True)], strict=True))
        values = list(zip(*[[_plain(v, kind) for v in batch[c]] for c, kind in zip(self.values.values(), self.kinds, strict=True)], strict=True))
        before, late, fresh = [], [], {}
        for own, place, value in zip(batch["of_key"], places, values, strict=True):
            last = held.get(own)
            behind = last is not None and _first_nulls(place) <= _first_nulls(last[1])
            late.append(behind)
            previous = None if behind else fresh.get(own, last)
            before.append(previous and previous[-1])
            if not behind:
                fresh[own] = (now, place, value)
        if fresh:
            self.last.update(([(k, *x) for k, x in (held | fresh).items()],))
        out = {n: pd.Series([None if x is None else x[i] for x in before], dtype=object) for i, n in enumerate(self.values)}
        yield batch.assign(**out, seen_before=[x is not None for x in before], too_late=late)

    def close(self) -> None:
        pass


TOTALS = (
    "total_commands long, first_stamp double, last_stamp double, mode_switches long, direction_reversals long, bursts long, "
    "translation_seconds double, rotation_seconds double, gripper_seconds double"
)
_TOTALS = [c.split()[0] for c in TOTALS.split(", ")]
_NONE = (0, None, None, 0, 0, 0, 0.0, 0.0, 0.0)
_MS = 1000


def _due(row: tuple) -> int:
    """Milliseconds of a waiting row's event time; a row without one comes first, as in the batch twin."""
    return 0 if row[1] is None else row[1] // _MS


class Priors(StatefulProcessor):
    """Totals of trials' commands, taken in event-time order.

    Rows wait in list state, an entry per arrival, until the watermark has passed them; an event-time timer at the bucket's earliest one takes them out in
    order and emits the totals so far of each trial with such rows. Value state holds per trial the totals, the last mode and, per (mode, axis), the last
    direction and an open burst. What arrives behind the watermark is dropped and counted by Spark.
    """

    def __init__(self, order: Sequence[str], waiting: str, max_burst: float):
        self.order, self.waiting, self.max_burst = list(order), waiting, max_burst
        self.names = [c.split()[0] for c in waiting.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", f"rows array<struct<of_key string, {self.waiting}>>")
        axes = "axes array<struct<mode string, axis string, direction long, open boolean, since double>>"
        self.trials = handle.getValueState("trials", f"trials array<struct<of_key string, {TOTALS}, last_mode string, rows long, {axes}>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kinds, first = ["string", *_kinds(self.waiting)], None
        for new in rows:
            values = list(zip(*[[_plain(v, kind) for v in new[c].astype(object)] for c, kind in zip(("of_key", *self.names), kinds, strict=True)], strict=True))
            if values:
                self.pending.appendValue((values,))
                earliest = min(map(_due, values))
                first = earliest if first is None else min(first, earliest)
        timers = list(self.handle.listTimers())
        if first is not None and (not timers or first < min(timers)):
            self.handle.registerTimer(first)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit = timerValues.getCurrentWatermarkInMs()
        rows = [tuple(r) for entry in self.pending.get() for r in entry[0]] if self.pending.exists() else []
        ready, later = [r for r in rows if _due(r) <= limit], [r for r in rows if _due(r) > limit]
        if ready:
            if later:
                self.pending.put([(later,)])
            else:
                self.pending.clear()
            yield pd.DataFrame(self._totals(ready), columns=["of_key", *_TOTALS, "rows"])
        else:
            yield pd.DataFrame()
        if later:
            self.handle.registerTimer(min(map(_due, later)))

    def _totals(self, ready: list[tuple]) -> list[tuple]:
        """The new totals of the trials that ``ready`` is of."""
        state = self.trials.get()
        held, found = {k: x for k, *x in _bare(state[0])} if state else {}, []
        trials: dict[str, list[tuple]] = {}
        for r in ready:
            trials.setdefault(r[0], []).append(r[1:])
        for of_key, rows in trials.items():
            rows.sort(key=lambda r: _first_nulls(r[: len(self.order)]))
            held[of_key] = self._taken(held.get(of_key, (*_NONE, None, 0, [])), [dict(zip(self.names, r, strict=True)) for r in rows])
            found.append((of_key, *held[of_key][: len(_TOTALS)], held[of_key][-2]))
        self.trials.update(([(k, *x) for k, x in held.items()],))
        return found

    def _taken(self, held: tuple, rows: list[dict]) -> tuple:
        """A trial's state after ``rows``."""
        t, (last_mode, seen, places) = dict(zip(_TOTALS, held[: len(_TOTALS)], strict=True)), held[len(_TOTALS) :]
        axes = {(mode, axis): list(x) for mode, axis, *x in places}
        for r in rows:
            moves = r["type"] == "cartesian_velocity" and bool(r["active"])
            stops = r["type"] == "stop" and r["reason"] == "release"
            stamp = r["stamp"] if r["stamp"] is not None else 0.0
            mode = "gripper" if r["type"] == "gripper" else r["command_mode"] if r["command_mode"] in ("translation", "rotation") else "translation"
            if moves or r["type"] == "gripper":
                t["total_commands"] += 1
                t["first_stamp"] = stamp if t["first_stamp"] is None else t["first_stamp"]
                t["last_stamp"] = stamp
                t["mode_switches"] += last_mode is not None and mode != last_mode
                last_mode = mode
            if moves or stops:
                axis = axes.setdefault((r["command_mode"] or "", r["axis"] or ""), [None, False, None])
                if stops and axis[1] and 0 < stamp - axis[2] < self.max_burst:
                    t["bursts"] += 1
                    t[f"{mode}_seconds"] += stamp - axis[2]
                axis[1:] = [moves, stamp]
                if moves and r["direction"]:
                    t["direction_reversals"] += axis[0] is not None and axis[0] != r["direction"]
                    axis[0] = r["direction"]
        return (*t.values(), last_mode, seen + len(rows), [(*place, *axis) for place, axis in axes.items()])

    def close(self) -> None:
        pass
