import itertools
import random

import pytest
from plain import moment
from pyspark.sql import functions as F

from tracewell.operators import timeline

CLOCKS = [("lantern", "Europe/Berlin", "dmy"), ("brisk", "America/New_York", "mdy"), ("odd", "Nowhere/Land", None), (None, "UTC", "dmy")]
TEXTS = [
    "1760150909888", "1784846378", "1739393611396508", "1764413005897708078", "1779798335.260", "2025-03-09T02:13:15", "2026-08-31T17:11:50.454Z",
    "2025-11-29 07:53", "03/27/2026 00:22:48", "27/03/2026 00:22:48", "05/06/2026 01:02:03", "2025-11-29 08:27:08,633", "20250826T065135Z", "13.05.2025 17:08:58",
    "2026-09-30 00:01:27 UTC", "2026-07-01 00:01:27 CEST", "2025-10-14T00:56:55+01", "2025-10-27T02:41:59.176994+11:00", "05/Jul/2026:04:31:34 +0200",
    "2025-08-08 00:09:00+0900", "Sat, 18 Apr 2026 09:58:46 +0200", "Tue Aug 26 02:40:24 2025", "Thu Dec  4 09:39:29 2025",
    "2026-05-13T18:19:56.498+01:00[Europe/London]", "30/3/2025, 4:47:14 AM", "9/12/2026, 12:16:16 PM", "2025-10-26 02:30:00", "2025-03-30T02:30:00",
    "\t2026-05-01 20:53:16 EDT ", "0", "-1", "n/a", "unknown", "", "   ", None, "2025-13-41T25:61:00Z", "0000-00-00 00:00:00", "2019-12-31T23:59:59Z", "2031-01-01T00:00:00Z",
    "9" * 40, "2026-09-30 00:01:27 XYZ", "2025-02-30 00:00:00",
]


def test_every_form_on_every_clock(spark):
    agents = ["lantern", "brisk", "odd", "nobody", None]
    rows = [(i, a, t, i % 3) for i, (a, t) in enumerate(itertools.product(agents, TEXTS))]
    df = spark.createDataFrame(rows, "id long, agent string, ts string, zone int")  # ``zone`` clashes with the clocks' column
    clocks = timeline.clocks(spark.createDataFrame(CLOCKS, "agent string, zone string, date_order string"))
    got = {r["id"]: r for r in timeline.read_times(df, "ts", "agent", "zone", ["id"], clocks).collect()}
    known = {"lantern": ("Europe/Berlin", "dmy"), "brisk": ("America/New_York", "mdy")}
    assert len(got) == len(rows)
    for i, a, t, z in rows:
        assert got[i]["utc_ms"] == moment(t, *known.get(a, ("UTC", "dmy"))), (a, t)
        assert got[i]["zone"] == z


def test_empty_and_repeated_rows(spark):
    clocks = timeline.clocks(spark.createDataFrame([], "agent string, zone string, date_order string"))
    empty = spark.createDataFrame([], "id long, agent string, ts string")
    assert timeline.read_times(empty, "ts", "agent", "agent", ["id"], clocks).collect() == []
    twice = spark.createDataFrame([(1, "a", "5/6/2026 01:02:03")] * 3, "id long, agent string, ts string")
    assert [r["utc_ms"] for r in timeline.read_times(twice, "ts", "agent", "agent", ["id"], clocks).collect()] == [moment("05/06/2026 01:02:03")] * 3


def brute(rows, costs):
    """The least total over all combinations of readings of one source."""
    seq = [r for r in rows if r]
    best = float("inf")
    for pick in itertools.product(*[range(len(r)) for r in seq]):
        got = [r[i] for r, i in zip(seq, pick)]
        total = sum(c for _, _, c in got)
        for (f0, m0, _), (f1, m1, _) in zip(got, got[1:]):
            total += costs.switch * (f0 != f1) + costs.backward * (m1 < m0)
        best = min(best, total)
    return best


@pytest.mark.parametrize("bits,fan", [(1, 1), (1, 10), (2, 1), (12, 10)])
def test_path_is_least_whatever_the_chunks(spark, monkeypatch, bits, fan):
    monkeypatch.setattr(timeline, "CHUNK_BITS", bits)
    monkeypatch.setattr(timeline, "FAN_BITS", fan)  # chunks are joined as a tree of pairs, or at once
    rng, costs = random.Random(bits), timeline.Costs(off_rule=1.0)
    rows, plain = [], {}
    for s in ["a", "b", None, "c"]:
        seq = []
        for i in range(9):
            n = rng.choice([0, 1, 2, 2, 2, 4])
            seq.append([(rng.choice("xyz"), rng.randrange(50), float(rng.randrange(3))) for _ in range(n)])
        plain[s] = seq
        rows += [(s, i, seq[i]) for i in range(9)]
    df = spark.createDataFrame(rows, "src string, n int, readings array<struct<fmt string, ms long, cost double>>")
    out = timeline.resolve(df, "src", ["n"], costs=costs).collect()
    for s, seq in plain.items():
        got = {r["n"]: (r["utc_ms_format"], r["utc_ms"]) for r in out if r["src"] == s}
        assert len(got) == 9
        total, last = 0.0, None
        for i in range(9):
            if not seq[i]:
                assert got[i] == (None, None)
                continue
            total += min(c for f, m, c in seq[i] if (f, m) == got[i])
            if last:
                total += costs.switch * (last[0] != got[i][0]) + costs.backward * (got[i][1] < last[1])
            last = got[i]
        assert total == pytest.approx(brute(seq, costs))


def test_too_many_readings_are_an_error(spark):
    df = spark.createDataFrame([("a", 1, [("x", i, 0.0) for i in range(timeline.K + 1)])], "src string, n int, readings array<struct<fmt string, ms long, cost double>>")
    with pytest.raises(Exception, match="readings"):
        timeline.resolve(df, "src", ["n"]).collect()


def test_order_without_a_clock(spark):
    """With no trusted clock the record order tells the date order."""
    texts = ["01/02/2026 10:00:00", "02/02/2026 10:00:00", "03/02/2026 10:00:00", "25/02/2026 10:00:00"]
    df = spark.createDataFrame([(i, "x", t) for i, t in enumerate(texts)], "id long, agent string, ts string")
    clocks = timeline.clocks(spark.createDataFrame([("x", "UTC", "mdy")], "agent string, zone string, date_order string"))
    got = timeline.read_times(df, "ts", "agent", "agent", ["id"], clocks, timeline.Costs(off_rule=0.0)).orderBy("id").collect()
    assert [r["utc_ms"] for r in got] == [moment(t, "UTC", "dmy") for t in texts]
    assert df.where(F.col("id") < 0).count() == 0
