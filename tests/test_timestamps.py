import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from quotemill.operators import timestamps as TS
from quotemill.operators.timestamps import Penalties, interpreted, normalise_timestamps
from tests.helpers import at

NY, LONDON, BERLIN = "America/New_York", "Europe/London", "Europe/Berlin"
CASES = [
    ("2024-01-22 18:25:05.513+00:00", NY, "MDY", "2024-01-22T18:25:05.513"),
    ("2024-05-16 23:52:06+0530", NY, "MDY", "2024-05-16T18:22:06"),
    ("2024-03-19T18:33:56.987515820Z", NY, "MDY", "2024-03-19T18:33:56.987515"),
    ("20220812T140235z", NY, "MDY", "2022-08-12T14:02:35"),
    ("2025-04-25T16:18:08-04:00[America/New_York]", BERLIN, "DMY", "2025-04-25T20:18:08"),
    ("2023-11-05 02:30:40 UTC-06:00", BERLIN, "DMY", "2023-11-05T08:30:40"),
    ("8/7/2022 20:15:49", NY, "MDY", "2022-08-08T00:15:49"),
    ("8/7/2022 20:15:49", LONDON, "DMY", "2022-07-08T19:15:49"),
    ("04/03/25 11:44 pm", LONDON, "DMY", "2025-03-04T23:44:00"),
    ("12/31/2024 4:58am", LONDON, "DMY", None),
    ("Apr 2, 2023 at 12:01 a.m.", NY, "MDY", "2023-04-02T04:01:00"),
    ("17 August 2023, 22:13", LONDON, "MDY", "2023-08-17T21:13:00"),
    ("Wed, 06 Mar 2024 16:56:00 -0600", LONDON, "MDY", "2024-03-06T22:56:00"),
    ("Wed, 17 May 2023 09:29:04 BST", NY, "MDY", "2023-05-17T08:29:04"),
    ("May 12, 2024 12:03 PM ET", LONDON, "MDY", "2024-05-12T16:03:00"),
    ("21.12.2024 10:06 Uhr", BERLIN, "MDY", "2024-12-21T09:06:00"),
    ("2025-02-23 09:38:58 Australia/Sydney", NY, "MDY", "2025-02-22T22:38:58"),
    (" \t20230620\n", "Australia/Sydney", "DMY", "2023-06-19T14:00:00"),
    ("2023-03-12", NY, "MDY", "2023-03-12T05:00:00"),
    ("1652311318", NY, "MDY", "2022-05-11T23:21:58"),
    ("1739488483.131", NY, "MDY", "2025-02-13T23:14:43.131"),
    ("1747678935290", NY, "MDY", "2025-05-19T18:22:15.290"),
    ("1697751622462516", NY, "MDY", "2023-10-19T21:40:22.462516"),
    ("1691565746062233297", NY, "MDY", "2023-08-09T07:22:26.062233"),
    # The clock is set back: the earlier instant; set forward: none.
    ("2024-11-03 01:30:00", NY, "MDY", "2024-11-03T05:30:00"),
    ("2024-03-10 02:30:00", NY, "MDY", None),
    ("2024-03-10 02:30:00 America/New_York", LONDON, "MDY", None),
    ("2024-03-10 02:30:00 EST", LONDON, "MDY", "2024-03-10T07:30:00"),
    ("2025-02-30T10:00:00Z", NY, "MDY", None),
    ("Thu, 32 Jan 2025 10:00:00 GMT", NY, "MDY", None),
    ("0000-00-00 00:00:00", NY, "MDY", None),
    ("25:61", NY, "MDY", None),
    ("TBC Mar 2025", NY, "MDY", None),
    ("N/A", NY, "MDY", None),
    ("2024-05-05 10:00:00 XYZT", NY, "MDY", None),
    ("2024-05-05 10:00:00 Moon/Base", NY, "MDY", None),
    ("2024-05-05 10:00:00", None, "MDY", None),
    ("2024-05-05 10:00:00Z", None, None, "2024-05-05T10:00:00"),
    ("99999999999999999999999", NY, "MDY", None),
]
RAW = "rec_id long, kind string, feed string, ticker string, published_at string, timestamp string, received_at timestamp, fmt string"
FEEDS = "feed string, provider string, zone string, date_order string"


def us(text):
    t = at(text)
    return int(t.timestamp()) * 1_000_000 + t.microsecond


def test_cases(spark):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "i int, s string, z string, o string, want string")
    got = {r.i: r.c for r in interpreted(df, "s", "z", "o", "c").collect()}
    for i, (s, _, _, want) in enumerate(CASES):
        best = min(got[i], key=lambda c: c.cost).utc_us if got[i] else None
        assert best == (us(want) if want else None), s


def test_both_instants_of_a_repeated_hour(spark):
    c = interpreted(spark.createDataFrame([("2024-10-27 02:30:00", BERLIN, "DMY")], "s string, z string, o string"), "s", "z", "o", "c").first().c
    assert [x.utc_us for x in c] == [us("2024-10-27T00:30:00"), us("2024-10-27T01:30:00")] and c[1].cost >= 1000


def feed_rows(n=120, seed=2):
    """An undeclared feed whose slashed dates are read by their neighbours."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        day, month = r.randint(1, 28), 1 + i * 12 // n
        text = f"{month:02d}/{day:02d}/2024 10:{r.randint(0, 59):02d}:00" if r.random() < 0.7 else f"2024-{month:02d}-{day:02d}T10:00:00Z" if r.random() < 0.5 else f"{day:02d}/{month:02d}/2024 09:00:00"
        out.append((i, "news", "odd", None, text, None, at("2024-01-01"), "clash"))
    return out


def brute(cands, p):
    """Cheapest path over all combinations is too many; dynamic programming over one list, as plainly as can be."""
    best = {k: (c.cost, [k]) for k, c in enumerate(cands[0])}
    for prev, cur in itertools.pairwise(cands):
        nxt = {}
        for k, c in enumerate(cur):
            nxt[k] = min(((v + c.cost + p.switch * (prev[j].fmt != c.fmt) + p.backward * (prev[j].utc_us > c.utc_us), path + [k]) for j, (v, path) in best.items()), key=lambda x: x[0])
        best = nxt
    return min(best.values(), key=lambda x: x[0])[0]


@pytest.mark.parametrize("parts,fan", [(1, 1024), (2, 1024), (7, 1024), (7, 2), (20, 2)])
def test_viterbi_over_blocks_is_optimal(spark, parts, fan, monkeypatch):
    """Over one block, several, and several levels of blocks."""
    monkeypatch.setattr(TS, "ROWS_PER_BLOCK", 10_000)
    monkeypatch.setattr(TS, "FAN", fan)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        p = Penalties()
        raw = spark.createDataFrame(feed_rows(), RAW)
        feeds = spark.createDataFrame([("odd", "rss", "UTC", None)], FEEDS)
        got = {r.rec_id: r for r in normalise_timestamps(raw, feeds, penalties=p).collect()}
        assert len(got) == 120
        cand = {r.rec_id: r.c for r in interpreted(raw.withColumns({"z": F.lit("UTC"), "o": F.lit(None).cast("string")}), "published_at", "z", "o", "c", p).collect()}
        order = sorted(cand)
        cost = sum(next(c.cost for c in cand[i] if c.utc_us == got[i].utc_us and c.fmt == got[i].fmt) for i in order)
        cost += sum(p.switch * (got[a].fmt != got[b].fmt) + p.backward * (got[a].utc_us > got[b].utc_us) for a, b in itertools.pairwise(order))
        assert cost == pytest.approx(brute([cand[i] for i in order], p))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_all_interpretations_reach_the_path(spark):
    """Declared rules decide there, by their cost, and not before."""
    feeds = spark.createDataFrame([("a", "x", NY, "MDY")], FEEDS)
    stamps = ["03/04/2024 10:00:00", "2024-11-03 01:30:00", "1704067200", "2024-01-05 10:00:00 IST"]
    raw = spark.createDataFrame([(i, "news", "a", None, x, None, at("2024-01-01"), "q") for i, x in enumerate(stamps)], RAW)
    got = {r.rec_id: (r.readings, r.utc_us) for r in normalise_timestamps(raw, feeds).collect()}
    assert got == {0: (2, us("2024-03-04T15:00:00")), 1: (2, us("2024-11-03T05:30:00")), 2: (4, us("2024-01-01T00:00:00")), 3: (2, us("2024-01-05T04:30:00"))}


def test_the_path_alone_finds_the_order_of_undeclared_feeds(spark):
    """Feeds that declare nothing, of either order, with records received in order and some late ones."""
    r = random.Random(8)
    rows, truth = [], {}
    for f, order in (("m", "%m/%d/%Y"), ("d", "%d/%m/%Y")):
        t = at("2024-01-01")
        for i in range(600):
            t += dt.timedelta(hours=r.uniform(1, 20))
            told = t - dt.timedelta(days=r.uniform(2, 30)) if r.random() < 0.05 else t
            k = len(rows)
            text = told.strftime(order + " %H:%M:%S") if r.random() < 0.8 else told.strftime("%Y-%m-%dT%H:%M:%SZ")
            rows.append((k, "news", f, None, text, None, t, "q"))
            truth[k] = int(told.timestamp()) * 1_000_000
    feeds = spark.createDataFrame([(f, "x", "UTC", None) for f in "md"], FEEDS)
    got = {x.rec_id: x.utc_us for x in normalise_timestamps(spark.createDataFrame(rows, RAW), feeds).collect()}
    right = sum(got[k] == v for k, v in truth.items()) / len(truth)
    assert right >= 0.9, right


def test_nulls_repeats_and_empty(spark):
    feeds = spark.createDataFrame([("a", "x", NY, "MDY"), ("a", "x", NY, "MDY"), (None, "x", NY, "MDY")], FEEDS)
    assert normalise_timestamps(spark.createDataFrame([], RAW), feeds).count() == 0
    long = "x" * 200_000
    rows = [(1, "news", "a", None, None, "2024-01-01 00:00:00", None, "q"), (1, "news", "a", None, None, "2024-01-01 00:00:00", None, "q"), (None, "bar", "a", None, "  ", None, None, "q"), (3, None, None, None, "2024-01-01T00:00:00Z", "ignored", None, "q"), (4, "news", "gone", None, "2024-01-01 00:00:00", None, None, "q"), (5, "news", "a", None, long, None, None, "q"), (None, "news", "a", None, "1704067200", None, at("2024-01-01"), "q")]
    got = sorted([(r.rec_id, r.utc_us) for r in normalise_timestamps(spark.createDataFrame(rows, RAW), feeds).collect()], key=str)
    assert got == sorted([(1, us("2024-01-01T05:00:00")), (1, us("2024-01-01T05:00:00")), (3, us("2024-01-01T00:00:00")), (None, us("2024-01-01T00:00:00"))], key=str)
