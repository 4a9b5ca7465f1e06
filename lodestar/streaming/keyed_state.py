"""The state of each entity, kept up to date by its observations as a stream.

Each signal has a half-life of its own and weights that a recent date boosts. Such a
weight is the sum of two exponentials of its age, so two sums at a reference time, the
latest observation's, rescale to any later time: observations may come in any order
and in any batches, and the state equals an aggregation of all of them. Booleans keep
the sums of both values, texts those of each text. What has no date counts as new. What is dated after the clock
waits, at its plain weight, until a timer folds it in. A signal that nothing was added
to for the time to live leaves the state, with what waits in it; its last row stays in the
table.
"""

from __future__ import annotations

import math
import time
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lodestar.functions import decay
from lodestar.operators.state import at_time

DAY_MICROS = decay.DAY_SECONDS * 1e6
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"
#: Support, its part of true and of false, and of value times weight; each plain and boosted.
_SUMS = 8
_SIGNAL = ("value_type string, half_life double, ref long, n long, numbers long, last_at long, sums array<double>, "
           "texts array<struct<text:string,plain:double,boosted:double,first_ord:long,undated:double>>, undated array<double>, "
           "waiting array<struct<at:long,ord:long,weight:double,estimated:boolean,value_num:double,value_bool:boolean,value_text:string>>")
_OUT = ("signal string, value_type string, half_life double, ref long, n long, numbers long, last_at long, sums array<double>, waiting array<double>, "
        "texts array<struct<text:string,plain:double,boosted:double,waiting:double,first_ord:long>>, closed_at long, other_at long")


@contextmanager
def settings(spark: SparkSession) -> Iterator[None]:
    """The session's settings that such a stream starts under: a state store that holds maps, and no batches without data.

    With timers a stream has always more to do, so a run to the end of what is there would
    not end; timers and the time to live are looked at whenever data come.
    """
    before = {k: spark.conf.get(k, None) for k in (PROVIDER, NO_DATA)}
    spark.conf.set(PROVIDER, ROCKS)
    spark.conf.set(NO_DATA, "false")
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _factors(days: float, half_life: float) -> tuple[float, float]:
    plain = 0.5 ** (days / half_life) if half_life > 0 else 1.0
    return plain, plain * math.exp(-days / decay.BOOST_DAYS)


def _parts(o) -> list[float]:
    """What one observation of weight 1 adds to support, true, false and value times weight."""
    yes = bool(o["value_bool"])
    return [1.0, float(yes), float(not yes), o["value_num"] if o["value_num"] is not None else 0.0]


_WAITS = ("at", "ord", "weight", "estimated", "value_num", "value_bool", "value_text")
_ROW = ("value_type", "half_life", "ref", "n", "numbers", "last_at", "sums", "waiting", "texts")


class Sums:
    """What is kept of one signal of one entity."""

    def __init__(self, value_type: str, half_life: float, ref=None, n=0, numbers=0, last_at=None, sums=None, texts=(), undated=None, waiting=()):
        self.value_type, self.half_life, self.ref, self.n, self.numbers, self.last_at = value_type, half_life, ref, n, numbers, last_at
        self.sums, self.texts, self.waiting = list(sums or [0.0] * _SUMS), {t[0]: list(t[1:]) for t in texts or ()}, [tuple(w) for w in waiting or ()]
        self.undated = list(undated or [0.0] * 4)

    @classmethod
    def read(cls, value) -> Sums:
        return cls(*value)

    def stored(self) -> tuple:
        return (self.value_type, self.half_life, self.ref, self.n, self.numbers, self.last_at, self.sums, [(t, *v) for t, v in self.texts.items()], self.undated, self.waiting)

    def add(self, o) -> None:
        """Fold an observation in, at the reference time, which is the latest observation's."""
        at = o["at"]
        self.n += 1
        self.numbers += o["value_num"] is not None
        text = o["value_text"] if self.value_type == "text" and o["value_text"] and o["weight"] is not None and o["weight"] > 0 else None
        if at is None:  # as of an age of 0, whenever it is asked for
            w = max(o["weight"] or 0.0, 0.0) * (1.0 if o["estimated"] else 1.0 + decay.BOOST)
            self.undated = [x + w * p for x, p in zip(self.undated, _parts(o), strict=True)]
            if text:
                t = self.texts.setdefault(text, [0.0, 0.0, o["ord"], 0.0])
                t[2], t[3] = min(t[2], o["ord"]), t[3] + w
            return
        self.last_at = at if self.last_at is None else max(self.last_at, at)
        self.ref = at if self.ref is None else self.ref
        if at > self.ref:
            f = _factors((at - self.ref) / DAY_MICROS, self.half_life)
            self.sums = [x * f[k % 2] for k, x in enumerate(self.sums)]
            for t in self.texts.values():
                t[0], t[1] = t[0] * f[0], t[1] * f[1]
            self.ref = at
        if o["weight"] is None or not o["weight"] > 0:
            return
        f = _factors((self.ref - at) / DAY_MICROS, self.half_life)
        new = (o["weight"] * f[0], 0.0 if o["estimated"] else o["weight"] * decay.BOOST * f[1])
        parts = _parts(o)
        self.sums = [x + new[k % 2] * parts[k // 2] for k, x in enumerate(self.sums)]
        if text:
            t = self.texts.setdefault(text, [0.0, 0.0, o["ord"], 0.0])
            t[0], t[1], t[2] = t[0] + new[0], t[1] + new[1], min(t[2], o["ord"])

    def row(self) -> dict:
        """The columns of a row; what waits, and what has no date, at the weight that it keeps."""
        sums, texts, n, numbers, last = self.undated, {t: [*v[:2], v[3], v[2]] for t, v in self.texts.items()}, self.n, self.numbers, self.last_at
        for o in (dict(zip(_WAITS, w, strict=True)) for w in self.waiting):
            n, numbers, last = n + 1, numbers + (o["value_num"] is not None), max(o["at"], last or o["at"])
            w = o["weight"] if o["weight"] is not None and o["weight"] > 0 else 0.0
            sums = [x + w * p for x, p in zip(sums, _parts(o), strict=True)]
            if w and self.value_type == "text" and o["value_text"]:
                t = texts.setdefault(o["value_text"], [0.0, 0.0, 0.0, o["ord"]])
                t[2], t[3] = t[2] + w, min(t[3], o["ord"])
        values = (self.value_type, self.half_life, self.ref, n, numbers, last, self.sums, sums, [(t, *v) for t, v in texts.items()])
        return dict(zip(_ROW, values, strict=True))


class EntityState(StatefulProcessor):
    """Folds the observations of one entity. clock: a fixed time for replays; else the processing time counts."""

    def __init__(self, closure: str, live_ms: int | None, clock: int | None):
        self.closure, self.live_ms, self.clock = closure, live_ms, clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.signals = handle.getMapState("signals", "signal string", _SIGNAL, self.live_ms)
        self.entity = handle.getValueState("entity", "closed_at long, other_at long, waiting array<string>")

    def _now(self) -> int:
        return self.clock if self.clock is not None else int(time.time() * 1e6)

    def _of(self, held: dict[str, Sums], signal: str, o=None) -> Sums | None:
        if signal not in held:
            if self.signals.containsKey((signal,)):
                held[signal] = Sums.read(self.signals.getValue((signal,)))
            elif o is not None:
                held[signal] = Sums(o["value_type"], o["half_life"])
        return held.get(signal)

    def _rows(self, key, held: dict[str, Sums], closed, other) -> Iterator[Row]:
        for signal, s in held.items():
            self.signals.updateValue((signal,), s.stored())
            yield Row(entity_id=key[0], signal=signal, **s.row(), closed_at=closed, other_at=other)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held, now, unknown = {}, self._now(), None
        closed, other, waiting = tuple(self.entity.get()) if self.entity.exists() else (None, None, [])
        waiting = set(waiting or ())
        for o in list(rows):
            at = o["at"]
            if at is not None and not o["estimated"]:
                if o["signal"] != self.closure:
                    other = at if other is None else max(other, at)
                elif o["value_bool"]:
                    closed = at if closed is None else max(closed, at)
            if o["value_type"] is None:
                unknown = o["signal"]
                continue
            s = self._of(held, o["signal"], o)
            if at is not None and at > now:
                s.waiting.append(tuple(o[c] for c in _WAITS))
                waiting.add(o["signal"])
                if self.clock is None:
                    self.handle.registerTimer(at // 1000 + 1)
            else:
                s.add(o)
        self.entity.update((closed, other, sorted(waiting)))
        yield from self._rows(key, held, closed, other)
        if unknown is not None and not held:  # a row for the dates alone
            yield Row(entity_id=key[0], signal=unknown, **dict.fromkeys(_ROW), closed_at=closed, other_at=other)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held, now, still = {}, self._now(), []
        closed, other, waiting = tuple(self.entity.get())
        for signal in waiting:
            s = self._of(held, signal)
            if s is not None:
                due = [o for o in s.waiting if o[0] <= now]
                s.waiting = [o for o in s.waiting if o[0] > now]
                for o in due:
                    s.add(dict(zip(_WAITS, o, strict=True)))
                if s.waiting:
                    still.append(signal)
        self.entity.update((closed, other, still))
        yield from self._rows(key, held, closed, other)

    def close(self) -> None:
        pass


def entity_states(observations: DataFrame, signals: DataFrame, closure: str = "spot_closed", live_days: float | None = None, clock: datetime | None = None) -> DataFrame:
    """Rows of each (entity, signal) that a batch of the stream changed, for `scores_at`.

    observations: a stream of entity_id, signal, value_num, value_bool, value_text, weight,
    observed_at, date_estimated, ord, which tells observations of a signal and a time apart.
    signals: signal, value_type, half_life; observations of others only date a closure.
    live_days: how long a signal lives without a new observation. Start it under `settings`.
    """
    rows = observations.join(signals.select("signal", "value_type", F.col("half_life").cast("double")), "signal", "left").select(
        "entity_id", "signal", "value_type", "half_life", F.col("weight").cast("double").alias("weight"), F.coalesce("date_estimated", F.lit(False)).alias("estimated"),
        F.col("value_num").cast("double").alias("value_num"), "value_bool", "value_text", F.unix_micros("observed_at").alias("at"), F.col("ord").cast("long").alias("ord"))
    micros = None if clock is None else int(clock.replace(tzinfo=timezone.utc).timestamp() * 1e6)
    kind = rows.schema["entity_id"].dataType.simpleString()
    live_ms = None if live_days is None else int(live_days * decay.DAY_SECONDS * 1000)
    states = rows.groupBy("entity_id").transformWithState(EntityState(closure, live_ms, micros), f"entity_id {kind}, {_OUT}", "Update", "ProcessingTime")
    return states


def scores_at(states: DataFrame, as_of: datetime, closure: str = "spot_closed") -> DataFrame:
    """The latest rows of `entity_states` as scores at a time not before what they hold: the columns of an aggregation of all observations."""
    days = (F.unix_micros(at_time(as_of)) - F.col("ref")) / DAY_MICROS
    plain = F.when(F.col("half_life") <= 0, 1.0).otherwise(F.pow(F.lit(0.5), days / F.col("half_life")))
    boosted = plain * F.exp(-days / decay.BOOST_DAYS)
    total = lambda k: F.coalesce(F.get("sums", F.lit(2 * k)) * plain + F.get("sums", F.lit(2 * k + 1)) * boosted, F.lit(0.0)) + F.get("waiting", F.lit(k))
    texts = F.transform("texts", lambda t: F.struct((t["plain"] * F.coalesce("f", F.lit(1.0)) + t["boosted"] * F.coalesce("g", F.lit(1.0)) + t["waiting"]).alias("tw"), (-t["first_ord"]).alias("o"), t["text"].alias("text")))
    rows = states.where("value_type IS NOT NULL").withColumns({"f": plain, "g": boosted, "support": total(0), "t": total(1), "no": total(2), "v": total(3)})
    rows = rows.withColumn("mode", F.array_max(F.filter(texts, lambda t: t["tw"] > 0)))
    dates = states.groupBy("entity_id").agg(F.max("closed_at").alias("closed"), F.max("other_at").alias("other"))
    rows = rows.join(dates, "entity_id").where((F.col("signal") != closure) | F.coalesce(F.col("other") <= F.col("closed"), F.lit(True)))
    kind = F.col("value_type")
    confidence = (F.when(kind == "boolean", decay.boolean_confidence(F.col("t"), F.col("no"))).when(kind == "numeric", decay.numeric_confidence(F.col("support")))
                  .otherwise(F.col("mode.tw") / F.col("support")))
    kept = (kind == "boolean") | ((kind == "numeric") & (F.col("numbers") > 0)) | ((kind == "text") & F.col("mode").isNotNull())
    return rows.where((F.col("support") > 0) & kept).select(
        "entity_id", "signal", F.when(kind == "numeric", F.round(F.col("v") / F.col("support"), 6)).alias("score_num"), F.when(kind == "boolean", F.col("t") >= F.col("no")).alias("score_bool"),
        F.when(kind == "text", F.col("mode.text")).alias("score_text"), F.round(confidence, 6).alias("confidence"), F.round("support", 6).alias("support"),
        F.col("n").alias("n_observations"), F.timestamp_micros("last_at").alias("last_observed_at"))
