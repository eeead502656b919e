"""The state of a CUSUM key: read and written once a batch, one timer, and none after the signal."""

import pandas as pd

from epiframe.streaming.online import _Cusum

DAY = 86_400_000


class Handle:
    def __init__(self):
        self.value, self.calls, self.timers = None, 0, []

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def registerTimer(self, at):
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):
        return self.mark


def test_one_read_one_write_and_one_timer_a_batch():
    h = Handle()
    p = _Cusum("key", "ts", None, DAY, 1.5, 2.0)
    p.init(h)
    h.mark = 0
    ts = pd.to_datetime([d * DAY + i for d in (4, 2, 3, 2, 2, 2) for i in range(2)], unit="ms")
    assert list(p.handleInputRows(("a",), iter([pd.DataFrame({"ts": ts})]), h)) == [] and (h.calls, h.timers) == (2, [3 * DAY])
    h.mark, h.calls = int(3.5 * DAY), 0
    out = list(p.handleExpiredTimer(("a",), h, None))
    assert [(r["key"][0], r["signal_step"][0].value // 10**6, r["statistic"][0]) for r in out] == [("a", 2 * DAY, 6.5)]
    assert h.calls == 2 and h.timers == [3 * DAY] and h.value[0] == [] and h.value[4]
    assert list(p.handleInputRows(("a",), iter([pd.DataFrame({"ts": ts + pd.Timedelta(days=9)})]), h)) == [] and h.calls == 3
