import datetime as dt
import random

from quotemill.operators.deliveries import latest_deliveries
from quotemill.operators.rolling import busier_than_usual, trailing_totals
from tests.helpers import at

SCHEMA = "ticker string, timestamp timestamp, volume double, close double, trade_day string"


def brute(data, windows):
    days = {}
    for t, ts, v, c, _ in data:
        if t is None or not t.strip() or ts is None:
            continue
        k = t.strip().upper()
        days.setdefault(k, {}).setdefault(ts.date(), []).append((v, c))
    out = {}
    for k, by in days.items():
        d = min(by)
        while d <= max(by):
            for n in windows:
                span = [x for i in range(n) for x in by.get(d - dt.timedelta(days=i), [])]
                vs = [v for v, _ in span if v is not None and v == v and abs(v) < 1e24]
                seen = sum(1 for i in range(n) if any(v is not None and v == v and abs(v) < 1e24 for v, _ in by.get(d - dt.timedelta(days=i), [])))
                out[k, d, n] = (sum(vs), seen, sum(vs) / len(vs) if vs else None)
            d += dt.timedelta(days=1)
    return out


def test_against_brute_force(spark):
    r = random.Random(3)
    data = []
    for t in ("a", " A ", "B", "", None):
        for _ in range(40):
            day = r.randint(0, 60)
            data.append((t, None if r.random() < 0.03 else at("2024-02-01") + dt.timedelta(days=day, hours=r.randint(0, 23)), r.choice([None, float("nan"), 1e30, *map(float, range(100, 140))]), r.choice([None, 10.25, 11.5]), "clash"))
    data += data[:5]
    got = {}
    for row in trailing_totals(spark.createDataFrame(data, SCHEMA), windows=(7, 30)).collect():
        for n in (7, 30):
            got[row.ticker, row.trade_day, n] = (float(row[f"total_volume_{n}"]), row[f"seen_volume_{n}"], row[f"mean_volume_{n}"])
    assert got == brute(data, (7, 30))


def test_huge_values_leave_no_trace(spark):
    data = [("A", at("2024-01-01"), 1e22, 1.0, None)] + [("A", at("2024-01-01") + dt.timedelta(days=i), 3.0, 1.0, None) for i in range(1, 20)]
    last = trailing_totals(spark.createDataFrame(data, SCHEMA)).orderBy("trade_day").collect()[-1]
    assert float(last.total_volume_7) == 21.0 and last.avg_volume_7 == 3.0


def test_empty_and_busy_days(spark):
    empty = trailing_totals(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and busier_than_usual(empty).count() == 0
    data = [("A", at("2024-01-01") + dt.timedelta(days=i), 100.0 if i < 35 else 1000.0, 1.0, None) for i in range(40)]
    got = [r.trade_day for r in busier_than_usual(trailing_totals(spark.createDataFrame(data, SCHEMA))).collect()]
    assert sorted(got) == ["2024-02-05", "2024-02-06", "2024-02-07", "2024-02-08", "2024-02-09"]


def test_latest_deliveries(spark):
    rows = [(1, at("2024-01-01"), 1.0, "x"), (1, at("2024-01-02"), None, "y"), (1, None, 9.0, "z"), (None, at("2024-01-01"), 1.0, "a"), (None, at("2024-01-01"), 1.0, "a"), (None, at("2024-01-01"), 2.0, "b"), (2, at("2024-01-01"), 1.0, "p"), (2, at("2024-01-01"), 5.0, "q")]
    got = latest_deliveries(spark.createDataFrame(rows, "bar_id long, ingested_at timestamp, v double, w string")).select("bar_id", "v", "w").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, None, "y"), (None, 1.0, "a"), (None, 2.0, "b"), (2, 5.0, "q")], key=str)
