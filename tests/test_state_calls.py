"""What keyed state is asked for, with states that count their calls: no session needed."""

from pyspark.sql import Row

from souklens.streaming import state as S


class Value:
    def __init__(self, held=None):
        self.held, self.calls = held, 0

    def get(self):
        self.calls += 1
        return self.held

    def update(self, value):
        self.calls, self.held = self.calls + 1, value


class Map(dict):
    asked = 0

    def containsKey(self, key):
        self.asked += 1
        return key in self

    def updateValue(self, key, value):
        self[key] = value


def page(seq, url, block=None):
    return Row(scan_id="a", seq=seq, url=url, n_products=2, block=block)


def test_a_scan_asks_once_for_an_address():
    scan = S._Scans("scan_id", 1)
    scan.total, scan.visited = Value(), Map()
    assert list(scan.handleInputRows(("a",), iter([page(3, "v"), page(1, "u"), page(2, "u")]), None)) == [Row(scan_id="a", pages=2, repeats=1, products=4, last_seq=3, status="running")]
    assert scan.visited.asked == 0 and scan.total.calls == 2  # a new scan has read nothing before
    (got,) = scan.handleInputRows(("a",), iter([page(5, "u"), page(4, "u"), page(7, "x"), page(6, "w", "captcha")]), None)
    assert (scan.visited.asked, got.pages, got.repeats, got.last_seq, got.status) == (1, 2, 3, 6, "blocked")
    assert list(scan.handleInputRows(("a",), iter([page(8, "y")]), None)) == [] and ("y",) not in scan.visited


def test_a_latch_asks_once_and_passes_rows_on():
    latch = S._Latch("seq", 1)
    latch.first = Value()
    assert [r.seq for r in latch.handleInputRows(("a",), iter([page(5, "u"), page(4, "u", "captcha"), page(2, "u")]), None)] == [2]
    assert latch.first.held == (1, 4) and latch.first.calls == 2
    assert [r.seq for r in latch.handleInputRows(("a",), iter([page(3, "u"), page(9, "u")]), None)] == [3] and latch.first.calls == 3


def test_state_is_dealt_to_all_cores(spark, monkeypatch):
    assert S.stream_session(spark).conf.get("spark.sql.shuffle.partitions") == "8" and S.stream_session(spark, 2).conf.get("spark.sql.shuffle.partitions") == "2"
    monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", 12)
    assert S.stream_session(spark).conf.get("spark.sql.shuffle.partitions") == "12"
