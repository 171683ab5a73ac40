import datetime as dt
import random

import pytest

from quotemill.llm.nearest import nearest
from tests.helpers import at

LEFT, RIGHT = "news_id long, ticker string, published_at timestamp, bar_id string", "bar_id long, ticker string, timestamp timestamp, e int"


@pytest.mark.parametrize("span,batch", [(7200, 10000), (600, 3), (50, 7)])
def test_against_all(spark, span, batch):
    r = random.Random(6)
    t0 = at("2024-01-01")
    moment = lambda: t0 + dt.timedelta(seconds=r.randint(0, 40000), microseconds=r.choice([0, 0, 1]))
    left = [(i, r.choice(["A", " a", "B", None, ""]), moment() if r.random() > 0.05 else None, "x") for i in range(300)] + [(1, "A", t0, "x")] * 2 + [(None, "A", t0, "x")]
    right = [(i, r.choice(["A", "B", None]), moment() if r.random() > 0.05 else None, 1) for i in range(120)]
    right += [(500 + k, "A", right[5][2], 1) for k in range(3)] + [right[7]] * 2
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = sorted((x.news_id, x.bar_id, x.offset_us) for x in nearest(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), span_seconds=span).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    key = lambda e: e.strip().upper() if e and e.strip() else None
    for i, e, t, _ in left:
        if i is None or key(e) is None or t is None:
            continue
        near = [(abs(u - t), u, b) for b, f, u, _ in right if u is not None and f is not None and key(f) == key(e) and abs(u - t) <= dt.timedelta(minutes=10)]
        if near:
            _, u, b = min(near)
            want.append((i, b, (u - t) // dt.timedelta(microseconds=1)))
    assert got == sorted(want)


def test_empty(spark):
    l, r = spark.createDataFrame([(1, "A", at("2024-01-01"), "x")], LEFT), spark.createDataFrame([(1, "A", at("2024-01-01"), 1)], RIGHT)
    assert nearest(l.limit(0), r).count() == 0 and nearest(l, r.limit(0)).count() == 0
    assert nearest(l, r).first().asDict() == {"news_id": 1, "bar_id": 1, "offset_us": 0}
