"""HOT alerts on a stream of review rows, one per permit and review cycle, ever."""

from __future__ import annotations

import json
import sys
from collections import namedtuple
from collections.abc import Collection, Iterable, Iterator, Sequence
from datetime import date, timedelta

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lintel.functions.patterns import is_adverse, is_fire_department, is_open_review
from lintel.plans.skew import latest
from lintel.schemas import PERMIT_KEY, REVIEW_KEY

# Workers get this code with the task, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SIGNAL = ("jurisdiction_id int, record_number bigint, cycle_number int, reason string, "
          "department string, status string, signal_date date, comment_text string")
KEYS = [*PERMIT_KEY, "cycle_number"]
#: All rules of the monitor, strongest first; a stream follows those it is asked for.
RULES = ("rejection", "repeat_cycle", "stalled")
MIN_BASELINE = 20
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What is kept of a department's newest row.
LAST = "adverse boolean, status string, status_date date, stalls_on date, comment_text string"
#: What is kept of a permit.
STATE = ("sent array<struct<cycle: int, reason: string>>, last array<struct<cycle: int, department: string, "
         + LAST.replace(" ", ": ").replace(",: ", ", ") + ">>")
#: Permits are dealt to so many groups by their hash, those of a group to so many slots: half a million in all.
GROUPS, SLOTS = 16_384, 32
#: Up to so many slots of a group are read one by one; for more the group is read at once.
SINGLE_READS = 8
_KEPT = [f.split()[0] for f in LAST.split(", ")]
_ROW = ["status_date", "observed_at", "comment_text", "due_date", "opened_on", "reviewer_name", "status",
        "department", "cycle_number", "adverse", "stalls_on"]
_REVIEW = namedtuple("Review", _ROW)
_KNOWN = ["cycle_number", "department", "sent", *_KEPT]
_DAY_MS = 86_400_000
_EPOCH = date(1970, 1, 1)
_EPOCH_ORDINAL = _EPOCH.toordinal()


class ReviewWatch(StatefulProcessor):
    """Follows one permit: per review cycle the reason already sent, per cycle and department the newest row.

    Both lie in one value, so a permit costs one read and at most one write a trigger, however many reviews it has.
    A row older than its department's newest is late: it never alerts and replaces nothing.
    """

    def __init__(self, rules: Sequence[str]):
        self.rules = tuple(rules)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("permit", STATE)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        sent, last = self._read()
        for row in initialState.known:
            place = row["cycle_number"], row["department"]
            if row["sent"] is not None:
                sent[place[0]] = row["sent"]
            else:
                last[place] = tuple(row[c] for c in _KEPT)
        self._write(sent, last)
        self._wait(last.values())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        sent, last = self._read()
        changed, found = {}, {}
        for row in sorted((tuple(getattr(r, c) for c in _ROW) for r in rows), key=_order):
            day, _, comment, _, _, _, status, department, cycle, adverse, stalls_on = row
            before = last.get((cycle, department))
            if before and day < before[2]:
                continue
            if "rejection" in self.rules and adverse and not (before and before[0]):
                found.setdefault(cycle, []).append((1, day, department, comment, status))
            if "repeat_cycle" in self.rules and cycle >= 2 and not before:
                found.setdefault(cycle, []).append((2, day, department, comment, status))
            last[cycle, department] = changed[cycle, department] = (adverse, status, day, stalls_on, comment)
        new = {cycle: min(signals) for cycle, signals in found.items() if cycle not in sent}
        if changed:
            self._write(sent | _reasons(new), last)
            self._wait(changed.values())
        yield from self._alerts(key, new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        today = _EPOCH + timedelta(days=timerValues.getCurrentWatermarkInMs() // _DAY_MS)
        sent, last = self._read()
        late: dict[int, tuple] = {}
        for (cycle, department), row in last.items():
            if row[3] is not None and row[3] <= today:
                signal = (3, today, department, row[4], row[1])
                late[cycle] = min(late.get(cycle, signal), signal)
        new = {cycle: signal for cycle, signal in late.items() if cycle not in sent}
        if new:
            self._write(sent | _reasons(new), last)
        self._wait(row for row in last.values() if row[3] is not None and row[3] > today)
        yield from self._alerts(key, new)

    def close(self) -> None:
        pass

    def _read(self) -> tuple[dict, dict]:
        value = self.state.get()
        if value is None:
            return {}, {}
        return {cycle: reason for cycle, reason in value[0]}, {(row[0], row[1]): tuple(row[2:]) for row in value[1]}

    def _write(self, sent: dict, last: dict) -> None:
        self.state.update(([*sent.items()], [(*place, *row) for place, row in last.items()]))

    def _wait(self, rows: Iterable[tuple]) -> None:
        """Wake at the first of the rows' days; the timer then waits for the next."""
        days = [row[3] for row in rows if row[3] is not None] if "stalled" in self.rules else []
        if days:
            self.handle.registerTimer((min(days) - _EPOCH).days * _DAY_MS)

    def _alerts(self, key: tuple, new: dict[int, tuple]) -> Iterator[Row]:
        for cycle, (rank, day, department, comment, status) in new.items():
            yield Row(jurisdiction_id=key[0], record_number=key[1], cycle_number=cycle, reason=RULES[rank - 1],
                      department=department, status=status, signal_date=day, comment_text=comment)


class _Slot:
    """What the permits of a slot keep, as the handle that ``ReviewWatch`` asks; ``permit`` is the one it follows.

    A permit's state is text until it is asked for: each typed value of a store costs a conversion on both sides.
    """

    def __init__(self, value: tuple | None):
        self.permits = {(jurisdiction, record): text for jurisdiction, record, text in value[0]} if value else {}
        self.permit, self.changed, self.day = None, False, None

    def getValueState(self, *_) -> _Slot:
        return self

    def get(self) -> tuple | None:
        text = self.permits.get(self.permit)
        if text is None:
            return None
        sent, last = json.loads(text)
        return sent, [(*place, adverse, status, _date(day), _date(stalls), comment)
                      for *place, adverse, status, day, stalls, comment in last]

    def update(self, value: tuple) -> None:
        sent, last = value
        last = [(*place, adverse, status, _number(day), _number(stalls), comment)
                for *place, adverse, status, day, stalls, comment in last]
        self.permits[self.permit], self.changed = json.dumps((sent, last)), True

    def registerTimer(self, at: int) -> None:
        day = at // _DAY_MS
        self.day = day if self.day is None else min(self.day, day)


class PermitsWatch(StatefulProcessor):
    """Follows a group of permits, each by the rules of ``ReviewWatch``.

    A call, of Python or of the state store, costs far more than a permit's rules.  So a trigger calls once per group,
    reads and writes slots of a few permits, and has one timer per group; ``due`` tells for which slots it is.
    """

    def __init__(self, rules: Sequence[str], permit: str):
        self.watch, self.permit = ReviewWatch(rules), permit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slots = handle.getMapState("slots", "slot int", f"permits array<struct<{self.permit}, state: string>>")
        self.due = handle.getValueState("due", "days array<int>")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        dealt: dict[int, dict[tuple, list]] = {}
        for row in initialState.known:
            known = json.loads(row["_values"])
            known |= {c: _date(known[c]) for c in ("status_date", "stalls_on")}
            dealt.setdefault(row["_slot"], {}).setdefault(tuple(row[c] for c in PERMIT_KEY), []).append(known)
        list(self._followed(dealt, lambda permit, of: self.watch.handleInitialState(permit, Row(known=of), timerValues)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        dealt: dict[int, dict[tuple, list]] = {}
        for row in rows:
            slot, *permit, text = row[-2 - len(PERMIT_KEY):]  # as _dealt() gives them
            day, *values, stalls = json.loads(text).values()
            dealt.setdefault(slot, {}).setdefault(tuple(permit), []).append(_REVIEW(_date(day), *values, _date(stalls)))
        yield from self._followed(dealt, lambda permit, of: self.watch.handleInputRows(permit, of, timerValues))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        today = timerValues.getCurrentWatermarkInMs() // _DAY_MS
        late = {slot: None for slot, day in enumerate(self._due()) if day is not None and day <= today}
        yield from self._followed(late, lambda permit, _: self.watch.handleExpiredTimer(permit, timerValues, expiredTimerInfo))

    def close(self) -> None:
        pass

    def _followed(self, dealt: dict[int, dict[tuple, list] | None], follow) -> Iterator[Row]:
        """Follow the permits dealt to slots; a slot without any has its day reached: all it keeps are followed."""
        kept, days = self._read(dealt), {}
        for number, permits in dealt.items():
            slot = _Slot(kept.get(number))
            self.watch.init(slot)
            for permit, rows in (dict.fromkeys(slot.permits) if permits is None else permits).items():
                slot.permit = permit
                yield from follow(permit, rows) or ()
            if slot.changed:
                self.slots.updateValue((number,), ([(*permit, text) for permit, text in slot.permits.items()],))
            if slot.day is not None or permits is None:
                days[number] = (slot.day, permits is None)
        self._wait(days)

    def _read(self, wanted: Collection[int]) -> dict[int, tuple]:
        if len(wanted) > SINGLE_READS:
            return {slot: value for (slot,), value in self.slots.iterator() if slot in wanted}
        return {slot: value for slot in wanted if (value := self.slots.getValue((slot,)))}

    def _due(self) -> list[int | None]:
        value = self.due.get()
        return [*value[0]] if value else [None] * SLOTS

    def _wait(self, days: dict[int, tuple[int | None, bool]]) -> None:
        """Wake at the first day of the group's slots; a new day replaces one that was reached, else the earlier holds."""
        if not days:
            return
        before = self._due()
        due = [*before]
        for slot, (day, reached) in days.items():
            if reached or due[slot] is None or day < due[slot]:
                due[slot] = day
        if due != before:
            self.due.update((due,))
            if any(day is not None for day in due):
                self.handle.registerTimer(min(day for day in due if day is not None) * _DAY_MS)


def _date(number: int | None) -> date | None:
    return None if number is None else date.fromordinal(_EPOCH_ORDINAL + number)


def _number(day: date | None) -> int | None:
    return None if day is None else day.toordinal() - _EPOCH_ORDINAL


def _reasons(new: dict[int, tuple]) -> dict[int, str]:
    return {cycle: RULES[signal[0] - 1] for cycle, signal in new.items()}


def _order(row: tuple) -> tuple:
    """The order of a review's rows; a missing value comes first, as in the batch monitor."""
    return tuple((v is not None, v) if v is not None else (False,) for v in row[:7])


def use_rocksdb(spark: SparkSession) -> None:
    """Keep stream state on local disk with changelog in the checkpoint; "ever" outgrows memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def stalls_on(reviews: DataFrame, baseline: DataFrame | None) -> DataFrame:
    """Add the first day on which an open review counts as stalled; null if it never does.

    The day after the due date; without one, the day on which its age goes beyond the local p90.
    """
    by_due = F.date_add("due_date", 1)
    if baseline is None:
        day, rows = by_due, reviews
    else:
        p90 = baseline.select("jurisdiction_id", F.col("p90_days").alias("_p90"), F.col("completed").alias("_completed"))
        rows = reviews.join(p90, "jurisdiction_id", "left")
        by_age = F.when(F.col("_completed") >= MIN_BASELINE, F.date_add("opened_on", (F.floor("_p90") + 1).cast("int")))
        day = F.when(F.col("due_date").isNotNull(), by_due).otherwise(by_age)
    return rows.withColumn("stalls_on", F.when(is_open_review(F.col("status")), day)).drop("_p90", "_completed")


def _column(df: DataFrame, name: str, kind: str) -> Column:
    """A column that a feed may leave out."""
    return (F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name)


def _watched(reviews: DataFrame, baseline: DataFrame | None) -> DataFrame:
    """Fire reviews that have a place in the order, with what the rules look at."""
    text = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("department", "status", "comment_text")]
    fire = (reviews.filter(F.col("status_date").isNotNull() & F.col("cycle_number").isNotNull())
            .filter(is_fire_department(F.col("department")))
            .select(*PERMIT_KEY, F.col("cycle_number").cast("int").alias("cycle_number"), "status_date", F.col("observed_at").cast("timestamp").alias("observed_at"), *text,
                    _column(reviews, "due_date", "date"), _column(reviews, "opened_on", "date"),
                    _column(reviews, "reviewer_name", "string")))
    return stalls_on(fire, baseline).withColumn("adverse", F.coalesce(is_adverse(F.col("status")), F.lit(False)))


def _dealt(df: DataFrame, values: Sequence[str]) -> DataFrame:
    """Permits with their group and slot, and the other values as one text, which Python takes faster than columns."""
    code, kinds = F.xxhash64(*PERMIT_KEY), dict(df.dtypes)
    numbers = {"date": F.unix_date, "timestamp": F.unix_micros}
    text = F.to_json(F.struct(*(numbers.get(kinds[c], F.col)(c).alias(c) for c in values)), {"ignoreNullFields": "false"})
    return df.select(F.pmod(code, F.lit(GROUPS)).cast("int").alias("_group"),
                     F.pmod(F.shiftright(code, 32), F.lit(SLOTS)).cast("int").alias("_slot"), *PERMIT_KEY, text.alias("_values"))


def known_state(reviews: DataFrame, alerts: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """What a new stream must know of the past: each review's newest row, and every cycle that has alerted."""
    newest = latest(_watched(reviews, baseline), REVIEW_KEY, ["status_date", "observed_at"])
    sent = alerts.select(*KEYS, F.lit(None).cast("string").alias("department"),
                         *(F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in LAST.split(", ")),
                         F.col("reason").alias("sent"))
    return newest.select(*KEYS, "department", *_KEPT, F.lit(None).cast("string").alias("sent")).unionByName(sent)


def hot_stream(reviews: DataFrame, rules: Sequence[str] = ("rejection",), known: DataFrame | None = None,
               baseline: DataFrame | None = None, delay: str = "0 seconds") -> DataFrame:
    """New alerts of a review stream: of a trigger's reasons the strongest, then the earliest.

    ``rules`` are those of ``RULES`` to follow.  "stalled" fires by timer, when the watermark of ``observed_at`` less
    ``delay`` reaches the day (UTC) on which an open review becomes stalled; rows behind the watermark are still
    followed.  ``known`` is the past, see ``known_state``: without it what has been alerted before is alerted again.

    Only fire departments reach the state.  State is one reason per cycle and a few values per cycle and
    department; it never expires.  A task holds one trigger's rows of a group of permits at a time; bound the trigger at the source with
    ``maxFilesPerTrigger``.  Keys keep the types they come in.  Rows without a date have no place in
    the order of a permit's reviews; ``undated`` gives them for the rejects.
    """
    signal = ", ".join(f"{c} {reviews.schema[c].dataType.simpleString()}" if c in PERMIT_KEY else f"{c} {kind}"
                       for c, kind in (x.split() for x in SIGNAL.split(", ")))
    use_rocksdb(reviews.sparkSession)  # no other store holds several kinds of state
    rows = _watched(reviews, baseline)
    timed = "stalled" in rules
    if timed:  # the clock is a column of its own, so that rows behind it are not taken for late ones
        rows = rows.withColumn("_clock", F.col("observed_at")).withWatermark("_clock", delay).drop("_clock")
    if known is not None:  # one row per group, as each row of an initial state is handed over on its own
        kinds = {f.name: f.dataType for f in rows.schema.fields}
        known = known.select(*(F.col(c).cast(kinds[c]).alias(c) if c in KEYS else F.col(c) for c in known.columns))
        known = (_dealt(known, _KNOWN).groupBy("_group")
                 .agg(F.collect_list(F.struct("_slot", *PERMIT_KEY, "_values")).alias("known")).groupBy("_group"))
    permit = ", ".join(f"{c}: {reviews.schema[c].dataType.simpleString()}" for c in PERMIT_KEY)
    return _dealt(rows, _ROW).groupBy("_group").transformWithState(
        PermitsWatch(rules, permit), signal, "append", "EventTime" if timed else "None", known)


def undated(reviews: DataFrame) -> DataFrame:
    """Rows that ``hot_stream`` cannot place: no status date or no cycle."""
    return reviews.filter(F.col("status_date").isNull() | F.col("cycle_number").isNull())
