"""SS-06: a group's keys share the calls of its state."""

import pandas as pd

from evspark.streaming.stream import OpenClose


class Held:
    def __init__(self, calls):
        self.calls, self.rows, self.value, self.timers = calls, [], None, []

    def getListState(self, name, schema):
        return self

    def getValueState(self, name, schema):
        return Value(self)

    def registerTimer(self, at):
        self.timers.append(at)

    def appendValue(self, row):
        self.calls.append("append")
        self.rows.append(row)

    def get(self):
        self.calls.append("get")
        return iter(list(self.rows))

    def clear(self):
        self.rows = []


class Value:
    def __init__(self, held):
        self.held = held

    def get(self):
        self.held.calls.append("get")
        return self.held.value

    def update(self, row):
        self.held.calls.append("update")
        self.held.value = row

    def clear(self):
        self.held.value = None


class Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_state_calls_do_not_grow_with_the_keys():
    calls = []
    held, sessions = Held(calls), OpenClose(None)
    sessions.init(held)
    keys = [None, *[f"k{i}" for i in range(1999)]]
    t = lambda s: pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=s)
    ends = pd.DataFrame({"key": keys, "ts": t(9), "opens": False})
    starts = pd.DataFrame({"key": keys, "ts": t(3), "opens": True})
    late = pd.DataFrame({"key": keys[:5], "ts": t(50), "opens": True})
    for batch in (ends, starts, late):  # ends come first
        sessions.handleInputRows((0,), iter([batch]), None)
    ms = lambda s: t(s).value // 10**6
    got = pd.concat(list(sessions.handleExpiredTimer((0,), Now(ms(20)), None)))
    assert len(got) == 2000 and set(got["end_kind"]) == {"closed"} and {str(k) for k in got["key"]} == {str(k) for k in keys}
    assert set(got["start_ts"]) == {t(3).tz_localize("UTC")} and set(got["end_ts"]) == {t(9).tz_localize("UTC")}
    assert len(calls) < 20 and held.timers[-1] == ms(50) + 1
    # what the watermark passes later opens sessions that the next ends close
    assert list(sessions.handleExpiredTimer((0,), Now(ms(60)), None)) == []
    sessions.handleInputRows((0,), iter([ends.head(9).assign(ts=t(70))]), None)
    assert len(pd.concat(list(sessions.handleExpiredTimer((0,), Now(ms(80)), None)))) == 5 and held.value is None
