"""Streams: deduplicated events, windowed detections, snapshots to events, state changes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from fleetscope.operators.detect import Rule, detect_tumbling
from fleetscope.operators.timeline import command_words
from fleetscope.sources import state as S
from fleetscope.sources.events import append_by_day


def deduplicated(events: DataFrame, keys: Sequence[str] = ("host_id", "event_id"), ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Sources read overlapping windows; a key counts once while it is within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def detect_stream(events: DataFrame, rule: Rule, late: str = "10 minutes") -> DataFrame:
    """Alerts of a stream, in windows side by side; their ids are those of the batch."""
    return detect_tumbling(events.withWatermark("ts", late), rule)


def start(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None, mode: str = "append") -> StreamingQuery:
    """A query whose batches go to ``sink``: every so often, or all that is there and then it ends."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def append_sink(path: str, keys: Sequence[str] = ("host_id", "event_id"), date: str = "event_date") -> Callable[[DataFrame, int], None]:
    """Appends a batch's new events to a table by date; those older than the watermark are still kept out by their keys."""

    def write(batch: DataFrame, _: int) -> None:
        append_by_day(batch, path, keys, date=date)

    return write


def state_sink(folder: str, keys: Sequence[str], src: str, table: str, emit: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """Each batch is a writer's snapshot: its difference to the last version becomes events, its rows the next version."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = S.first_rows(batch.withColumn("_src", F.lit(src)), keys, keys)
        if number:
            old = spark.read.parquet(f"{folder}/v{number - 1}")
            emit(S.change_events(S.state_diff(old, new, keys, src), keys, table))
            new = S.apply_snapshot(old, new, keys, src)
        S.as_text(new).write.mode("overwrite").parquet(f"{folder}/v{number}")

    return write


def keyed_state(spark: SparkSession) -> None:
    """State by key and map entry needs a store on disk; set before a query starts, for streams that hold such state."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _millis(ts: pd.Series) -> np.ndarray:
    return ts.astype("datetime64[us]").astype("int64").to_numpy() // 1000


class _Fleeting(StatefulProcessor):
    """Map states whose entries live for ``horizon`` milliseconds of event time after they were last set.

    Every entry is a row of the state store of its own; a batch reads and writes those that its events name. An entry past its horizon counts as
    absent at once, and a timer of its group removes it, so the store holds what the horizon spans, however long the stream runs.
    """

    maps: tuple[str, ...] = ()

    def __init__(self, horizon: int):
        self.horizon = horizon

    def init(self, handle) -> None:
        self.handle = handle
        self.state = {name: handle.getMapState(name, "key string", "value string, seen bigint") for name in self.maps}
        self.due = handle.getValueState("due", "at bigint")

    def entry(self, cache: dict, name: str, key: str, now: int) -> str | None:
        """The entry's value at the time ``now``."""
        if (name, key) not in cache:
            own = self.state[name]
            cache[name, key] = tuple(own.getValue((key,))) if own.containsKey((key,)) else None
        found = cache[name, key]
        return found[0] if found and now - found[1] <= self.horizon else None

    def store(self, cache: dict, changed: set) -> None:
        for name, key in changed:
            self.state[name].updateValue((key,), cache[name, key])

    def wake(self, at: int) -> None:
        """One timer at a time for each group, at its first expiry that may come."""
        known = self.due.get() if self.due.exists() else None
        if known is None or known[0] > at:
            if known is not None:
                self.handle.deleteTimer(known[0])
            self.handle.registerTimer(at)
            self.due.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        least = None
        for own in self.state.values():
            entries = [(k, v[1]) for k, v in own.iterator()]
            for k, seen in entries:
                if seen + self.horizon < passed:
                    own.removeKey(k)
                else:
                    least = seen if least is None else min(least, seen)
        self.due.clear()
        if least is not None:
            self.wake(max(least + self.horizon + 1, passed + 1))
        return iter(())

    def close(self) -> None:
        pass


class _Snapshots(_Fleeting):
    """A host's last snapshot, a key an entry; the entry's time is that of the snapshot."""

    maps = ("known",)

    def __init__(self, horizon: int, by: Sequence[str], keys: Sequence[str], order: str, ts: str):
        super().__init__(horizon)
        self.by, self.keys, self.order, self.ts = by, keys, order, ts

    def init(self, handle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "run bigint, seen bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        own, out = self.state["known"], []
        pdf = pd.concat(list(rows), ignore_index=True)
        pdf["_at"] = _millis(pdf[self.ts])
        for _, x in pdf.sort_values([self.order, "_at"]).iterrows():
            run, at = int(x[self.order]), int(x["_at"])
            last = self.last.get() if self.last.exists() else None
            if last is not None and run <= last[0]:
                continue
            now = {"\0".join(str(r[k]) for k in self.keys) for r in x["rows"]}
            known = {k[0] for k, _ in own.iterator()}
            # After a silence beyond the horizon a snapshot is a new baseline.
            if last is not None and at - last[1] <= self.horizon:
                out += [(*key, run, *k.split("\0"), "appeared") for k in sorted(now - known)]
                out += [(*key, run, *k.split("\0"), "vanished") for k in sorted(known - now)]
            for k in known - now:
                own.removeKey((k,))
            for k in now:
                own.updateValue((k,), ("", at))
            self.last.update((run, at))
            self.wake(at + self.horizon + 1)
        yield pd.DataFrame(out, columns=[*self.by, self.order, *self.keys, "action"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        self.due.clear()
        last = self.last.get() if self.last.exists() else None
        if last is not None and last[1] + self.horizon < passed:
            self.state["known"].clear()
            self.last.clear()
        elif last is not None:
            self.wake(last[1] + self.horizon + 1)
        return iter(())


def snapshot_events(snapshots: DataFrame, keys: Sequence[str], by: Sequence[str] = ("host_id",), order: str = "run", ts: str = "ts", horizon_ms: int = 7 * 86_400_000, late: str = "10 minutes") -> DataFrame:
    """Appearances and disappearances between a host's consecutive snapshots.

    A snapshot is one row: ``by…``, ``order``, ``ts`` and ``rows``, an array of structs of the keys. The state is the last snapshot, an entry a key, and goes when the
    host has been silent for the horizon of event time; its next snapshot is a baseline again.
    """
    keyed_state(snapshots.sparkSession)
    texts = ", ".join(f"{k} string" for k in keys)
    schema = ", ".join([*(f"{c} string" for c in by), f"{order} bigint", texts, "action string"])
    return snapshots.withWatermark(ts, late).groupBy(*by).transformWithStateInPandas(_Snapshots(horizon_ms, by, keys, order, ts), schema, "Append", "EventTime")


class _Chains(_Fleeting):
    """The chains that a host's sockets, objects and users stood in last."""

    maps = ("socket", "object", "user")

    def __init__(self, horizon: int, by: Sequence[str]):
        super().__init__(horizon)
        self.by = by

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True)
        pdf["_at"] = _millis(pdf["ts"])
        pdf = pdf.sort_values(["ts", "event_id"], kind="stable")
        cache: dict[tuple[str, str], tuple[str, int] | None] = {}
        changed: set[tuple[str, str]] = set()
        out = []
        for at, event, root, socket, thing, command, user, module in zip(*(pdf[c] for c in ("_at", "event_id", "root", "socket", "object", "command", "user", "module"))):
            marks = [(n, k) for n, k in (("socket", socket), ("object", thing), ("user", user)) if k]
            led = [(n, c) for n, k in marks if (c := self.entry(cache, n, k, at)) is not None]
            if root:
                chain, how = f"proc:{root}", "ancestry"
            elif led:
                chain, how = led[0][1], led[0][0] if led[0][0] != "user" else "time"
            else:
                chain, how = (f"user:{user}" if user else f"mod:{module or '?'}"), "time"
            marks += [("object", w) for w in command_words(command) if ("object", w) not in marks and self.entry(cache, "object", w, at) is None]
            for mark in marks:
                cache[mark] = (chain, int(at))
                changed.add(mark)
            out.append((*key, str(event), chain, how))
        self.store(cache, changed)
        if changed:
            self.wake(int(min(cache[m][1] for m in changed)) + self.horizon + 1)
        yield pd.DataFrame(out, columns=[*self.by, "event_id", "chain_id", "how"])


def chain_stream(events: DataFrame, by: Sequence[str] = ("host_id",), horizon_ms: int = 6 * 3_600_000, late: str = "10 minutes") -> DataFrame:
    """Chains over a stream of keyed events (``host_id`` and the fields that chains look at): a mark leads to its chain for the horizon of event time after it was last seen, then it is forgotten."""
    keyed_state(events.sparkSession)
    schema = ", ".join([*(f"{c} string" for c in by), "event_id string, chain_id string, how string"])
    return events.withWatermark("ts", late).groupBy(*by).transformWithStateInPandas(_Chains(horizon_ms, by), schema, "Append", "EventTime")
