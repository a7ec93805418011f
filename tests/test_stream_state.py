"""What the alert stream asks of its state store."""

from __future__ import annotations

import json
from datetime import date, datetime

from pyspark.sql import Row

from lintel.streaming import hot


class _Store:
    """A state store that counts its calls, for one permit."""

    def __init__(self):
        self.kept, self.calls, self.timers = None, [], []

    def getValueState(self, *_):
        return self

    def get(self):
        self.calls.append("get")
        return self.kept

    def update(self, value):
        self.calls.append("update")
        self.kept = value

    def registerTimer(self, at):
        self.timers.append(at // 86_400_000)


class _Clock:
    def __init__(self, day):
        self.at = day * 86_400_000

    def getCurrentWatermarkInMs(self):
        return self.at


def _day(number):
    return date.fromordinal(date(1970, 1, 1).toordinal() + number)


def _row(cycle, day, status="Rejected", stalls=None):
    return Row(status_date=_day(day), observed_at=datetime(2001, 1, 1), comment_text="", due_date=None, opened_on=None,
               reviewer_name=None, status=status, department="Fire Marshal", cycle_number=cycle, adverse=status == "Rejected",
               stalls_on=None if stalls is None else _day(stalls))


def _watch(rules):
    watch, store = hot.ReviewWatch(rules), _Store()
    watch.init(store)
    return watch, store


def test_a_trigger_reads_and_writes_a_permit_once():
    watch, store = _watch(("rejection",))
    found = list(watch.handleInputRows((1, 2), iter([_row(c, d) for c in range(1, 9) for d in (1, 2, 3)]), None))
    assert [(a.cycle_number, a.reason, a.signal_date) for a in found] == [(c, "rejection", _day(1)) for c in range(1, 9)]
    assert store.calls == ["get", "update"]
    assert not list(watch.handleInputRows((1, 2), iter([_row(3, 2)]), None))  # late: nothing to keep
    assert store.calls == ["get", "update", "get"]


def test_one_timer_waits_for_the_next_stall():
    watch, store = _watch(hot.RULES)
    # cycles 3 and 4 alert as second cycles at once, so only cycle 1 may stall
    list(watch.handleInputRows((1, 2), iter([_row(1, 1, "In Review", 9), *(_row(c, 1, "In Review", 10 + c) for c in (3, 4))]), None))
    assert store.timers == [9]
    found = list(watch.handleExpiredTimer((1, 2), _Clock(9), None))
    assert [(a.cycle_number, a.reason) for a in found] == [(1, "stalled")] and store.timers == [9, 13]
    assert not list(watch.handleExpiredTimer((1, 2), _Clock(20), None)) and store.timers == [9, 13]


def test_a_missing_cycle_in_the_history_hides_no_other():
    watch, store = _watch(("rejection", "repeat_cycle"))
    kept = {"adverse": None, "status": None, "status_date": None, "stalls_on": None, "comment_text": None, "department": None}
    watch.handleInitialState((1, 2), Row(known=[{**kept, "cycle_number": None, "sent": "rejection"},
                                                {**kept, "cycle_number": 7, "sent": "repeat_cycle"}]), None)
    assert not list(watch.handleInputRows((1, 2), iter([_row(7, 5, "Approved")]), None))


class _Group(_Store):
    """The state store of a group of permits: its slots, and the days on which they are due."""

    def __init__(self):
        super().__init__()
        self.kept = {}
        self.due = _Store()

    def getMapState(self, *_):
        return self

    def getValueState(self, *_):
        return self.due

    def getValue(self, key):
        self.calls.append("get")
        return self.kept.get(key)

    def iterator(self):
        self.calls.append("all")
        return iter([*self.kept.items()])

    def updateValue(self, key, value):
        self.calls.append("update")
        self.kept[key] = value


def _dealt(slot, record, row):
    """A row as the stream hands it to its group."""
    values = {c: hot._number(v) if isinstance(v, date) and not isinstance(v, datetime) else str(v) if isinstance(v, datetime) else v
              for c, v in zip(hot._ROW, (row[c] for c in hot._ROW), strict=True)}
    return Row("_group", "_slot", "jurisdiction_id", "record_number", "_values")(5, slot, 1, record, json.dumps(values))


def _group(rules):
    watch, store = hot.PermitsWatch(rules, "jurisdiction_id: int, record_number: bigint"), _Group()
    watch.init(store)
    return watch, store


def test_a_trigger_reads_a_group_once_and_writes_slots_not_permits():
    watch, store = _group(("rejection",))
    first = [_dealt(record % 20, record, _row(2, day)) for record in range(2000) for day in (1, 3)]
    found = list(watch.handleInputRows((5,), iter(first), None))
    assert sorted((a.record_number, a.cycle_number, a.signal_date) for a in found) == [(r, 2, _day(1)) for r in range(2000)]
    assert store.calls == ["all"] + ["update"] * 20  # one read and one write per permit were 4,000 calls
    again = [_dealt(7, 7, _row(2, 9)), _dealt(8, 8, _row(3, 9)), _dealt(9, 9, _row(2, 2)), _dealt(19, None, _row(1, 2))]
    found = list(watch.handleInputRows((5,), iter(again), None))
    assert [(a.record_number, a.cycle_number) for a in found] == [(8, 3), (None, 1)]  # sent, new, late, no number
    assert store.calls[21:] == ["get"] * 4 + ["update"] * 3
    assert sum(len(slot[0]) for slot in store.kept.values()) == 2001


def test_a_group_goes_on_from_history_and_wakes_for_its_next_stall():
    watch, store = _group(hot.RULES)
    kept = dict(adverse=False, status="In Review", status_date=1, comment_text="", department="Fire Marshal", sent=None)
    old = dict.fromkeys(kept) | {"cycle_number": 2, "stalls_on": None, "sent": "rejection"}
    known = [(3, 10, kept | {"cycle_number": 1, "stalls_on": 9}), (4, 11, kept | {"cycle_number": 1, "stalls_on": 12}), (4, 11, old)]
    watch.handleInitialState((5,), Row(known=[{"_slot": slot, "jurisdiction_id": 1, "record_number": record,
                                               "_values": json.dumps(values)} for slot, record, values in known]), None)
    assert store.timers == [9]
    found = list(watch.handleInputRows((5,), iter([_dealt(4, 11, _row(2, 5)), _dealt(30, 12, _row(1, 5, "In Review", 8))]), None))
    assert not found and store.timers == [9, 8]  # cycle 2 was sent before
    stalled = [[(a.record_number, a.reason, a.signal_date) for a in watch.handleExpiredTimer((5,), _Clock(day), None)] for day in (9, 9, 20)]
    assert stalled == [[(10, "stalled", _day(9)), (12, "stalled", _day(9))], [], [(11, "stalled", _day(20))]]
    assert store.timers == [9, 8, 12]
