"""Keyed state: live incidents with updates before close, and the sequential drift test with its latch."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewatch.operators.drift import CHECK_EVERY, CRITICAL, DELTA, LAMBDA, MIN_EVENTS, WARNING, WINDOW

GAP_MS = 30 * 60 * 1000


INCIDENT_COLUMNS = ["hostname", "start_us", "last_us", "events", "status"]


def _fold(host: str, now: tuple[int, int, int] | None, rows: Iterator[pd.DataFrame]) -> tuple[tuple[int, int, int] | None, list[tuple]]:
    """The open incident (first and last event time, count) after a batch, and the rows to tell.

    The batch's times over all its frames are cut at pauses and the pieces folded in. A piece that ended more than a gap before the
    open incident is an incident of its own, closed.
    """
    out, gap = [], GAP_MS * 1000
    times = np.sort(np.concatenate([p["event_us"].to_numpy(np.int64) for p in rows] or [np.empty(0, np.int64)]))
    if not len(times):
        return now, out
    cuts = np.flatnonzero(np.diff(times) > gap) + 1
    for lo, hi in itertools.pairwise([0, *cuts.tolist(), len(times)]):
        first, last, n = int(times[lo]), int(times[hi - 1]), hi - lo
        if now is None:
            now = first, last, n
        elif now[0] - last > gap:
            out.append((host, first, last, n, "closed"))
        elif first - now[1] > gap:
            out.append((host, *now, "closed"))
            now = first, last, n
        else:
            now = min(now[0], first), max(now[1], last), now[2] + n
    return now, [*out, (host, *now, "open")]


class LiveIncident(StatefulProcessor):
    """The processor form of `live_incident`: one read and one write of the state for a batch, and a timer of its own."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("incident", "start_us bigint, last_us bigint, n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, out = _fold(key[0], tuple(self.state.get()) if self.state.exists() else None, rows)
        if not out:
            return
        self.state.update(now)
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        self.handle.registerTimer(now[1] // 1000 + GAP_MS + 1)
        yield pd.DataFrame(out, columns=INCIDENT_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            row = (key[0], *self.state.get(), "closed")
            self.state.clear()
            yield pd.DataFrame([row], columns=INCIDENT_COLUMNS)

    def close(self) -> None:
        pass


def live_incident(key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Per host: first and last event time and the count; an update per batch, a final row when the gap has passed.

    Only three numbers are kept per host, so a hot host costs its rate, not its history.
    """
    now = state.get if state.exists else None
    if state.hasTimedOut:
        state.remove()
        yield pd.DataFrame([(key[0], *now, "closed")], columns=INCIDENT_COLUMNS)
        return
    now, out = _fold(key[0], now, rows)
    if out:
        state.update(now)
        state.setTimeoutTimestamp(now[1] // 1000 + GAP_MS)  # due once the watermark is beyond it
        yield pd.DataFrame(out, columns=INCIDENT_COLUMNS)


INCIDENT_SCHEMA = "hostname string, start_us bigint, last_us bigint, events bigint, status string"


def live_incidents(events: DataFrame) -> DataFrame:
    """Needs hostname, event_ts under a watermark, and event_us (micros).

    Many hosts share a batch of rows and states, so a host costs no round trips of its own.
    """
    return events.select("hostname", "event_ts", "event_us").groupBy("hostname").applyInPandasWithState(
        live_incident, INCIDENT_SCHEMA, "start_us bigint, last_us bigint, n bigint", "update", GroupStateTimeout.EventTimeTimeout)


class DriftMonitor(StatefulProcessor):
    """Per stream: running mean, deviation and minimum of the sequential test, an alarm latch and the last 500 scores.

    A control row (value null) resets the test and the latch.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.test = handle.getValueState("test", "n bigint, mean double, total double, low double, latched boolean")
        self.recent = handle.getListState("recent", "value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """Order the batch over all its frames by time (ties by value, resets last) and run the test over the runs between
        resets with cumulative sums."""
        n, mean, total, low, latched = self.test.get() if self.test.exists() else (0, 0.0, 0.0, float("inf"), False)
        window = [float(v[0]) for v in self.recent.get()]
        frames = list(rows)
        times = np.concatenate([p["event_us"].to_numpy(np.int64) for p in frames] or [np.empty(0, np.int64)])
        values = np.concatenate([p["value"].to_numpy(float, na_value=np.nan) for p in frames] or [np.empty(0)])
        values = values[np.lexsort((values, times))]  # nan, a reset, sorts behind equal times
        resets = np.flatnonzero(np.isnan(values))
        for k, run in enumerate(np.split(values, resets)):
            if k:
                n, mean, total, low, latched = 0, 0.0, 0.0, float("inf"), False
                run = run[1:]
            if not len(run):
                continue
            counts = n + np.arange(1, len(run) + 1)
            means = (n * mean + np.cumsum(run)) / counts
            totals = total + np.cumsum(run - means - DELTA)
            lows = np.minimum(np.minimum.accumulate(totals), low)
            latched = bool(latched or (totals - lows > LAMBDA).any())
            n, mean, total, low = int(counts[-1]), float(means[-1]), float(totals[-1]), float(lows[-1])
            window += run[-WINDOW:].tolist()
        window = window[-WINDOW:]
        self.test.update((n, float(mean), float(total), float(low), bool(latched)))
        self.recent.put([(v,) for v in window])
        s = pd.Series(window, dtype=float)
        yield pd.DataFrame([{
            "stream": key[0], "n": n, "ph": total - low if n else 0.0, "drift": bool(latched),
            "window_filled": len(window), "recent_mean": float(s.mean()) if len(s) else 0.0,
            "recent_std": float(s.std(ddof=0)) if len(s) else 0.0}])

    def close(self) -> None:
        pass


DRIFT_SCHEMA = ("stream string, n bigint, ph double, drift boolean, window_filled int, recent_mean double, "
                "recent_std double")


def drift_monitor(scores: DataFrame) -> DataFrame:
    """Needs stream, event_us and value; value null is a reset request."""
    return scores.groupBy("stream").transformWithStateInPandas(
        DriftMonitor(), outputStructType=DRIFT_SCHEMA, outputMode="Update", timeMode="None")


def stabilities(expected: tuple[np.ndarray, np.ndarray, int], values: np.ndarray, lows: np.ndarray, highs: np.ndarray,
                eps: float = 1e-10) -> np.ndarray:
    """Stability index of each values[low:high] against a stored histogram (edges, counts, n). Every value is put into its bin once;
    a window's counts are the difference of two running sums."""
    edges, counts, n = expected
    bins = len(edges) - 1
    if bins < 1:
        return np.zeros(len(lows))
    cuts = np.unique(np.concatenate([lows, highs]))
    at = np.searchsorted(edges, values, "right") - 1
    at[values == edges[-1]] = bins - 1
    inside = (at >= 0) & (at < bins)
    piece = np.searchsorted(cuts, np.arange(len(values)), "right")[inside]
    sums = np.bincount(piece * bins + at[inside], minlength=(len(cuts) + 1) * bins).reshape(-1, bins).cumsum(axis=0)
    found = sums[np.searchsorted(cuts, highs)] - sums[np.searchsorted(cuts, lows)]
    e = np.maximum(counts / (n + eps), eps)
    a = np.maximum(found / ((highs - lows)[:, None] + eps), eps)
    return ((a - e) * np.log(a / e)).sum(axis=1)


class DriftChecks(StatefulProcessor):
    """Per stream: the last 500 vectors in a ring, the sequential test, and a check every 100 events against the baseline.

    The ring is kept as bytes, so a batch reads and writes one state row per stream, however many events it brings.
    """

    def __init__(self, features: list[str], baseline: dict[str, tuple[np.ndarray, np.ndarray, int]]):
        self.features, self.baseline = features, baseline

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState(
            "monitor", "n bigint, mean double, total double, low double, alarmed boolean, latched boolean, ring binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, mean, total, low, alarmed, latched, ring = (
            self.state.get() if self.state.exists() else (0, 0.0, 0.0, float("inf"), False, False, b""))
        width = len(self.features) + 1
        seen = np.frombuffer(bytes(ring), np.float64).reshape(-1, width)
        frame = pd.concat(list(rows), ignore_index=True).sort_values(["event_us", "event_key"], kind="stable")
        new = frame[[*self.features, "value"]].to_numpy(np.float64)
        counts = n + np.arange(1, len(new) + 1)
        means = (n * mean + np.cumsum(new[:, -1])) / counts
        totals = total + np.cumsum(new[:, -1] - means - DELTA)
        lows = np.minimum(np.minimum.accumulate(totals), low)
        alarms = np.logical_or.accumulate(totals - lows > LAMBDA) | alarmed
        out, every = [], np.concatenate([seen, new])
        ends = np.arange((-n) % CHECK_EVERY or CHECK_EVERY, len(new) + 1, CHECK_EVERY)
        ends = ends[np.minimum(len(seen) + ends, WINDOW) >= MIN_EVENTS]
        highs = len(seen) + ends
        starts = np.maximum(0, highs - WINDOW)
        told = [stabilities(self.baseline[f], every[:, k], starts, highs).tolist() for k, f in enumerate([*self.features, "score"])]
        for at, size, (*psi, score) in zip(ends.tolist(), (highs - starts).tolist(), zip(*told, strict=True), strict=True):
            worst = max((x for x in psi if x > WARNING), default=0.0)
            high, tested = sum(x > CRITICAL for x in psi), bool(alarms[at - 1])
            level = "CRITICAL" if high or score > CRITICAL else "WARNING" if worst or score > WARNING or tested else "none"
            out.append((key[0], int(counts[at - 1]), size, bool(tested or latched), round(score, 4), round(worst, 4), int(high), level))
            latched = latched or level == "CRITICAL"
        if len(new):
            n, mean, total, low, alarmed = int(counts[-1]), float(means[-1]), float(totals[-1]), float(lows[-1]), bool(alarms[-1])
        self.state.update((n, mean, total, low, alarmed, bool(latched), every[-WINDOW:].tobytes()))
        yield pd.DataFrame(out, columns=["stream", "n_processed", "window_size", "ph_drift", "psi_scores", "max_psi", "n_critical", "drift_level"])

    def close(self) -> None:
        pass


CHECK_SCHEMA = ("stream string, n_processed bigint, window_size bigint, ph_drift boolean, psi_scores double, max_psi double, n_critical int, "
                "drift_level string")


def drift_checks(rows: DataFrame, features: list[str], baseline: DataFrame) -> DataFrame:
    """Needs stream, event_us, event_key, the features and value (the score). The baseline has one row per feature and one for
    the score, so it travels with the processor."""
    held = {r.feature: (np.array(r.edges, float), np.array(r.counts, float), r.n) for r in baseline.collect()}
    return rows.groupBy("stream").transformWithStateInPandas(
        DriftChecks(features, held), outputStructType=CHECK_SCHEMA, outputMode="Append", timeMode="None")
