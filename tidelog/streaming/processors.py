"""Stateful processors: an incident recorder, bounded memory of what was said, decisions, and holds that run out.

Each keeps its state in the state store, so a query that is started again from
its checkpoint goes on where it stopped. A key's rows of one micro-batch are put
in order of time before they are looked at.
"""

from __future__ import annotations

import json
import math
from collections import OrderedDict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators import signals as batch
from .stream import in_order

# Sessions that are remembered, fingerprints that are remembered of each, and the time after which an unexamined record is let go.
SESSIONS, FINGERPRINTS, HOLD_MS = 40, 300, 900_000


class _Recorder(StatefulProcessor):
    """A key's latest rows, frozen around triggers."""

    def __init__(self, before_ms: int, after_ms: int):
        self.before, self.after = before_ms, after_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.ring = handle.getListState("ring", "ts_ms double, trigger boolean, event string")

    def handleInputRows(self, key, rows, timerValues):
        fresh = [(float(t), bool(g), e) for frame in rows for t, g, e in zip(frame["ts_ms"], frame["trigger"], frame["event"])]
        yield self.settled(key, fresh, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield self.settled(key, [], timerValues.getCurrentWatermarkInMs())

    def settled(self, key, fresh: list, watermark: int) -> pd.DataFrame:
        """Incidents that no trigger can extend any more, with their rows; keeps what a later trigger can still want."""
        rows = sorted([*map(tuple, self.ring.get()), *fresh], key=lambda r: (r[0], r[2] or ""))
        found: list[list] = []  # [first trigger, last trigger, triggers]
        for t in (r[0] for r in rows if r[1]):
            if found and t - found[-1][1] < self.before + self.after + 1:
                found[-1][1:] = [t, found[-1][2] + 1]
            else:
                found.append([t, t, 1])
        ends = [last + self.after + self.before + 1 for _, last, _ in found]
        closed = [f for f, end in zip(found, ends) if end <= watermark]
        still = [f for f, end in zip(found, ends) if end > watermark]
        out = [(*key, first - self.before, last + self.after, n, *r) for first, last, n in closed for r in rows if first - self.before <= r[0] <= last + self.after]
        since = min([watermark, *(f[0] for f in still)]) - self.before
        done = {r[0] for r in rows if r[1] and any(first <= r[0] <= last for first, last, _ in closed)}
        keep = [(t, g and t not in done, e) for t, g, e in rows if t >= since]
        self.ring.put(keep) if keep else self.ring.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if still:
            self.handle.registerTimer(math.ceil(still[0][1] + self.after + self.before + 1))
        return pd.DataFrame(out, columns=["key", "from_ms", "to_ms", "triggers", "ts_ms", "trigger", "event"])

    def close(self) -> None:
        pass


def incidents(events: DataFrame, key: str, ts: str, trigger: Column, columns: list[str], before_ms: int = 60_000, after_ms: int = 5_000) -> DataFrame:
    """(key, from_ms, to_ms, triggers, ts_ms, trigger, event): the rows from before_ms before to after_ms after a key's triggers, each once; triggers whose windows touch are one incident.

    ts: a timestamp with a watermark. event: the other columns as JSON. An incident comes out when the watermark is past its last trigger by both
    spans, since until then a trigger can extend it; further triggers push the timer on. State: rows of before_ms behind the watermark, more only while an incident is open.
    """
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(ts), (F.unix_micros(ts) / 1000.0).alias("ts_ms"), F.coalesce(trigger, F.lit(False)).alias("trigger"), F.to_json(F.struct(*columns)).alias("event"))
    schema = "key string, from_ms double, to_ms double, triggers long, ts_ms double, trigger boolean, event string"
    return rows.groupBy("key").transformWithStateInPandas(_Recorder(before_ms, after_ms), schema, "Append", "EventTime")


class Memory:
    """What has been said in which session, least recently used first: at most `sessions`, and `prints` of each."""

    def __init__(self, sessions: int = SESSIONS, prints: int = FINGERPRINTS):
        self.sessions, self.prints = sessions, prints
        self.said: OrderedDict[str, OrderedDict[str, int]] = OrderedDict()
        self.gone: list[tuple[str, str | None]] = []

    def surfaces(self, session: str, fp: str, rank: int) -> bool:
        """Whether this is new to the session or of a higher rank than before. To be looked at is to be used, for session and fingerprint."""
        known = self.said.setdefault(session, OrderedDict())
        self.said.move_to_end(session)
        if len(self.said) > self.sessions:
            self.gone.append((self.said.popitem(last=False)[0], None))
        fresh = rank > known.get(fp, 0)
        known[fp] = max(rank, known.get(fp, 0))
        known.move_to_end(fp)
        if len(known) > self.prints:
            self.gone.append((session, known.popitem(last=False)[0]))
        return fresh


class _Remembering(StatefulProcessor):
    """A scope's memory; `used` numbers looks, so that the order of use is read back from the store."""

    def __init__(self, sessions: int, prints: int):
        self.bounds = sessions, prints

    def init(self, handle) -> None:
        self.clock = handle.getValueState("clock", "n long")
        self.used = handle.getMapState("used", "session string", "at long")
        self.seen = handle.getMapState("seen", "session string, fp string", "rank int, at long")

    def handleInputRows(self, key, rows, timerValues):
        memory, clock = Memory(*self.bounds), self.clock.get()[0] if self.clock.exists() else 0
        for (session,), _ in sorted(self.used.iterator(), key=lambda kv: kv[1][0]):
            memory.said[session] = OrderedDict()
        for (session, fp), (rank, _) in sorted(self.seen.iterator(), key=lambda kv: kv[1][1]):
            memory.said[session][fp] = rank
        out, looked = [], {}
        for r in in_order(rows, "session", "fp", "rank"):
            clock += 1
            looked[r.session, r.fp] = clock
            if memory.surfaces(r.session, r.fp, int(r.rank)):
                out.append((key[0], r.session, r.fp, int(r.rank), float(r.ts_ms)))
        # what has gone leaves the store, unless it has come back since; what was looked at is written
        for session, fp in memory.gone:
            if fp is None and session not in memory.said and self.used.containsKey((session,)):
                self.used.removeKey((session,))
        alive = {(s, f) for s, known in memory.said.items() for f in known}
        if memory.gone:
            for pair in [k for k in self.seen.keys() if tuple(k) not in alive]:
                self.seen.removeKey(tuple(pair))
        for (session, fp), at in looked.items():
            if session in memory.said:
                self.used.updateValue((session,), (max(at, self.used.getValue((session,))[0] if self.used.containsKey((session,)) else 0),))
            if (session, fp) in alive:
                self.seen.updateValue((session, fp), (memory.said[session][fp], at))
        self.clock.update((clock,))
        yield pd.DataFrame(out, columns=["scope", "session", "fp", "rank", "ts_ms"])

    def close(self) -> None:
        pass


def surfaced(signals: DataFrame, sessions: int = SESSIONS, fingerprints: int = FINGERPRINTS) -> DataFrame:
    """Of signals (scope, session, fp, rank, ts_ms) those that are new to their session or of a higher rank than before, as far as the scope's bounded memory goes. What was least recently looked at is forgotten first and surfaces again."""
    rows = signals.select("scope", "session", "fp", F.col("rank").cast("int").alias("rank"), F.col("ts_ms").cast("double").alias("ts_ms"))
    return rows.groupBy("scope").transformWithStateInPandas(_Remembering(sessions, fingerprints), "scope string, session string, fp string, rank int, ts_ms double", "Append", "None")


class _Deciding(StatefulProcessor):
    """A session's claims: what was said of which kind and fingerprint, at which rank, whether it has been taken back, and when each tier spoke last."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle) -> None:
        self.claims = handle.getMapState("claims", "kind string, fp string", "rank int, retracted boolean")
        self.spoke = handle.getMapState("spoke", "rank int", "at_s double")

    def handleInputRows(self, key, rows, timerValues):
        out = []
        for tick in in_order(rows):
            out += [(key[0], tick.ts_ms / 1000.0, *s) for s in self.decided(json.loads(tick.signals), set(json.loads(tick.tracked or "[]")), tick.ts_ms / 1000.0)]
        yield pd.DataFrame(out, columns=["session", "at_s", "tier", "kind", "fp", "correction"])

    def decided(self, signals: list[dict], tracked: set[str], at_s: float) -> list[tuple]:
        claims = {tuple(k): tuple(v) for k, v in self.claims.iterator()}
        live = {(s["kind"], s["fp"]) for s in signals}
        fresh = [s for s in signals if s["correction"] or batch.TIERS[s["tier"]] > claims.get((s["kind"], s["fp"]), (0,))[0]]
        fresh += [{"kind": kind, "tier": "notice", "fp": fp, "correction": True, "deadline": False, "claim": True} for (kind, fp), (rank, retracted) in claims.items() if rank >= batch.TIERS["notice"] and not retracted and (kind, fp) not in live and fp not in tracked]
        if not fresh:
            return []
        top = max(batch.TIERS[s["tier"]] for s in fresh)
        if top == batch.TIERS["heartbeat"] and not any(s["kind"] == "started" for s in fresh):
            return []
        if self.spoke.containsKey((top,)) and at_s - self.spoke.getValue((top,))[0] < next(batch.GAPS_S[t] for t, r in batch.TIERS.items() if r == top):
            return []
        placed = sorted((s for s in fresh if s["correction"] or batch.TIERS[s["tier"]] == top), key=lambda s: (not s["correction"], s["kind"], s["fp"]))
        late = next((i for i, s in enumerate(placed) if s["deadline"]), None)
        chosen = placed[: self.limit] if late is None or late < self.limit else [*placed[: self.limit - 1], placed[late]]
        for s in chosen:
            pair = (s["kind"], s["fp"])
            if s.get("claim"):
                self.claims.updateValue(pair, (claims[pair][0], True))
            elif not s["correction"]:
                self.claims.updateValue(pair, (batch.TIERS[s["tier"]], False))
            self.spoke.updateValue((batch.TIERS[s["tier"]],), (at_s,))
        return [(s["tier"], s["kind"], s["fp"], s["correction"]) for s in chosen]

    def close(self) -> None:
        pass


def decisions(ticks: DataFrame, limit: int = 3) -> DataFrame:
    """(session, at_s, tier, kind, fp, correction): what to say at each tick, as `signals.decided` gives it for one moment.

    ticks: session, ts_ms, signals (as `signals.listed` builds them) and tracked, the fingerprints that are still counted though no signal names them.
    Claims stay with the session across batches. A claim of a notice or alert that no live signal backs and nobody tracks is taken back, once; one that is said
    again later at a higher rank is a new claim.
    """
    rows = ticks.select("session", F.col("ts_ms").cast("double").alias("ts_ms"), F.to_json("signals").alias("signals"), F.to_json("tracked").alias("tracked"))
    return rows.groupBy("session").transformWithStateInPandas(_Deciding(limit), "session string, at_s double, tier string, kind string, fp string, correction boolean", "Append", "None")


class _Holding(StatefulProcessor):
    """One record's hold: examined, or let go by a timer."""

    def __init__(self, hold_ms: int):
        self.hold = hold_ms

    def init(self, handle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", "since_ms long")

    def handleInputRows(self, key, rows, timerValues):
        now, out = timerValues.getCurrentProcessingTimeInMs(), []
        examined = any(bool(x) for frame in rows for x in frame["examined"])
        if examined:
            since = self.held.get()[0] if self.held.exists() else now
            self.forget()
            out.append((key[0], "examined", now - since))
        elif not self.held.exists():
            self.held.update((now,))
            self.handle.registerTimer(now + self.hold)
        yield self.rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        since = self.held.get()[0] if self.held.exists() else None
        self.held.clear()
        yield self.rows([(key[0], "expired", timerValues.getCurrentProcessingTimeInMs() - since)] if since is not None else [])

    def forget(self) -> None:
        self.held.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def rows(self, out: list) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["record", "outcome", "held_ms"])

    def close(self) -> None:
        pass


def holds(records: DataFrame, hold_ms: int = HOLD_MS) -> DataFrame:
    """(record, outcome, held_ms) of records (record, examined): `examined` when a row says so, `expired` when hold_ms have passed on the clock, new input or not. A record that comes again while it is held is held once."""
    rows = records.select(F.col("record").cast("string").alias("record"), F.coalesce("examined", F.lit(False)).alias("examined"))
    return rows.groupBy("record").transformWithStateInPandas(_Holding(hold_ms), "record string, outcome string, held_ms long", "Append", "ProcessingTime")
