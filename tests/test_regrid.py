import datetime as dt
import random

import numpy as np
import pytest

from quotemill.operators.regrid import regular_grid, unread_slots
from tests.helpers import at

READ = "ticker string, timestamp timestamp, close double, session_date string"
SESSION = "session_date date, open_at timestamp, close_at timestamp, close double"


def direct(xs, ys, h):
    """Weighted local regression at 0 over offsets xs, straight from its definition."""
    w = np.where(np.abs(xs) <= h, 1 - (xs / h) ** 2, 0.0)
    use = np.abs(xs) <= h
    w, x, y = w[use], xs[use], ys[use]
    w0 = w.sum()
    if w0 < 1e-12:
        return None, 0.0, 0.0
    support = w0**2 / (w**2).sum()
    det = w0 * (w * x * x).sum() - (w * x).sum() ** 2
    return (w, x, y, det), w0, support


@pytest.mark.parametrize("reach", [1, 2])
def test_against_definition(spark, reach):
    r = random.Random(5)
    o, c = at("2024-03-04T14:30:00"), at("2024-03-04T18:05:00")
    data = [("abc", o + dt.timedelta(seconds=r.uniform(-3000, 14000)), r.choice([None, float("nan"), *np.linspace(10, 12, 20).tolist()]), "x") for _ in range(18)]
    data += [("abc", c, 5.0, "x"), ("abc", o, 11.0, "x"), (None, o, 1.0, "x"), ("abc", None, 1.0, "x")]
    grid = {row.slot_start.replace(tzinfo=dt.timezone.utc): row for row in regular_grid(spark.createDataFrame(data, READ), spark.createDataFrame([(o.date(), o, c, 1.0)], SESSION), reach=reach).collect()}
    slot = dt.timedelta(seconds=900)
    good = [(t, y) for e, t, y, _ in data if e and t is not None and y is not None and y == y and o <= t < c]
    assert len(grid) == 15
    for k in range(15):
        start = o + k * slot
        row = grid[start]
        inside = [y for t, y in good if start <= t < start + slot]
        assert row.n_readings == len(inside)
        # The kernel covers whole slots: readings of the neighbouring slots of this session.
        near = [(t, y) for t, y in good if start - reach * slot <= t < start + (reach + 1) * slot]
        xs = np.array([((t - start) / slot) - 0.5 for t, _ in near]) if near else np.empty(0)
        fit, w0, support = direct(xs, np.array([y for _, y in near]), reach + 0.5)
        assert row.weight == pytest.approx(w0, abs=1e-9) and row.support == pytest.approx(support, rel=1e-9, abs=1e-9)
        if row.status == "missing":
            assert row.value is None and not inside and (support < 1 or w0 < 0.1 + 1e-9)
            continue
        w, x, y, det = fit
        slopes = any(t < start + slot / 2 for t, _ in near) and any(t > start + slot / 2 for t, _ in near) and det > 0.01 * w0 * w0
        if slopes:
            design = np.stack([np.ones(len(x)), x], axis=1) * np.sqrt(w)[:, None]
            want = np.linalg.lstsq(design, y * np.sqrt(w), rcond=None)[0][0]
            if abs(row.value - want) > 1e-6:
                # Which sides count is told by each slot's mean offset.
                want = (w * y).sum() / w0
        else:
            want = (w * y).sum() / w0
        assert row.value == pytest.approx(want, rel=1e-6)


def test_empty_overnight_and_repeats(spark):
    s = spark.createDataFrame([(dt.date(2024, 3, 4), at("2024-03-04T22:00:00"), at("2024-03-05T01:00:00"), 1.0), (dt.date(2024, 3, 6), None, at("2024-03-06T01:00:00"), 1.0), (dt.date(2024, 3, 7), at("2024-03-07T01:00:00"), at("2024-03-07T01:00:00"), 1.0)], SESSION)
    none = regular_grid(spark.createDataFrame([], READ), s)
    assert none.count() == 0
    r = spark.createDataFrame([(" q ", at("2024-03-05T00:10:00"), 7.0, None)] * 3, READ)
    grid = regular_grid(r, s)
    assert grid.count() == 12 and grid.filter("n_readings = 3").count() == 1
    assert unread_slots(grid).count() == 11
    assert grid.filter("status = 'read'").first().value == pytest.approx(7.0)
    assert regular_grid(r, s.limit(0)).count() == 0
