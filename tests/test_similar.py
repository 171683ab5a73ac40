import datetime as dt
import random

import pytest

from quotemill.functions.text import word_set
from quotemill.operators.asof import asof_join
from quotemill.operators.dedup import distinct_articles, first_by_key, first_of_similar
from quotemill.operators.sentiment import event_clusters, recency_weight, score_with, ticker_signals
from quotemill.operators.similar import components, first_come, similar_pairs
from tests.helpers import at


def texts(n, seed):
    r = random.Random(seed)
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    return [(i, r.choice("AB"), r.choice([None, "", " ".join(r.choices(words, k=r.randint(1, 6)))]) if r.random() < 0.1 else " ".join(r.choices(words, k=r.randint(1, 6)))) for i in range(n)]


def sets(rows):
    return {i: frozenset((t or "").split()) for i, _, t in rows}


def overlap(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("t", [0.5, 0.6, 0.85])
def test_pairs_against_all(spark, t):
    from pyspark.sql import functions as F

    rows = texts(120, 3)
    df = spark.createDataFrame(rows, "id long, g string, t string").withColumn("w", word_set(F.coalesce("t", F.lit(""))))
    got = sorted((r.a, r.b) for r in similar_pairs(df, key="id", words="w", similarity=t, within=("g",)).collect())
    s, group = sets(rows), {i: g for i, g, _ in rows}
    assert got == sorted((a, b) for a in s for b in s if a < b and group[a] == group[b] and s[a] and s[b] and overlap(s[a], s[b]) >= t)


def test_components_and_first_come(spark):
    edges = [(1, 2), (2, 3), (5, 6), (8, 9), (9, 10), (10, 11), (11, 12), (12, 13)]
    nodes, pairs = spark.createDataFrame([(i,) for i in range(1, 15)], "n long"), spark.createDataFrame(edges, "a long, b long")
    got = {r.n: r.component for r in components(nodes, pairs, key="n").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7, 8: 8, 9: 8, 10: 8, 11: 8, 12: 8, 13: 8, 14: 14}
    kept = {r.n for r in first_come(nodes, pairs, key="n").collect() if r.kept}
    assert kept == {1, 3, 4, 5, 7, 8, 10, 12, 14}
    none = pairs.limit(0)
    assert components(nodes, none, key="n").filter("n <> component").count() == 0 and first_come(nodes, none, key="n").filter("not kept").count() == 0


def test_greedy_removal_depends_on_order(spark):
    rows = texts(150, 9)
    df = spark.createDataFrame(rows, "id long, g string, t string")
    got = sorted(r.id for r in first_of_similar(df, key="id", text="t", similarity=0.6, within=("g",)).collect())
    s, kept = sets(rows), []
    for i, g, _ in rows:
        if not s[i] or not any(rows[k][1] == g and s[k] and overlap(s[i], s[k]) >= 0.6 for k in kept):
            kept.append(i)
    assert got == kept


def test_three_passes(spark):
    kind = "news_id long, ticker string, url string, article_id string, headline string"
    rows = [(1, "A", "u1", None, "one two three"), (2, "A", "u1", "x", "other words here"), (3, "A", None, "x", "some third thing"), (4, "A", "", "x", "a fourth one"), (5, "B", "u1", "x", "one two three"), (6, "A", "u6", "", "one two three"), (7, "A", None, None, None), (8, "A", None, None, None)]
    df = spark.createDataFrame(rows, kind)
    assert sorted(r.news_id for r in distinct_articles(df).collect()) == [1, 3, 5, 7, 8]
    assert sorted(r.news_id for r in first_by_key(df, "url", ["news_id"]).collect()) == [1, 3, 4, 6, 7, 8]
    assert distinct_articles(df.limit(0)).count() == 0


def test_asof_against_scan(spark):
    r = random.Random(4)
    t0 = at("2024-01-01")
    left = [(i, r.choice(["A", "B", None]), t0 + dt.timedelta(hours=r.randint(0, 24 * 200)), "l") for i in range(150)] + [(999, "A", None, "l")]
    right = [(i, r.choice(["A", "B", None]), t0 + dt.timedelta(hours=r.randint(0, 24 * 200)), "r") for i in range(60)] + [(60, "A", t0, "r"), (61, "A", t0, "r")]
    ls, rs = spark.createDataFrame(left, "id long, k string, t timestamp, tag string"), spark.createDataFrame(right, "id long, k string, u timestamp, tag string")
    for offset, tol in ((0, None), (3600 * 30, None), (0, 3600 * 24 * 5)):
        got = {x.id: x.id_asof for x in asof_join(ls, rs, by="k", left_at="t", right_at="u", right_order=["id"], offset_seconds=offset, tolerance_seconds=tol, span_days=7).collect()}
        want = {}
        for i, k, t, _ in left:
            ok = [(u, j) for j, rk, u, _ in right if k and t and rk == k and u <= t - dt.timedelta(seconds=offset) and (tol is None or t - dt.timedelta(seconds=offset) - u <= dt.timedelta(seconds=tol))]
            want[i] = max(ok)[1] if ok else None
        assert got == want


class Lengths:
    name = "lengths"

    def __init__(self, ok=True):
        self.ok = ok

    def available(self):
        return self.ok

    def score(self, x):
        import pandas as pd

        if x.str.contains("boom").any():
            raise ValueError
        return pd.DataFrame({"sentiment": ["POSITIVE"] * len(x), "conviction": x.str.len().astype(float).tolist()})


def test_scorers(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "boom"), (3, "abcd")], "id long, analysis_text string").coalesce(1)
    got = {r.id: (r.conviction, r.scored_by) for r in score_with(df, [Lengths(False), Lengths()], batch=1).collect()}
    assert got == {1: (3.0, "lengths"), 2: (None, "lengths"), 3: (4.0, "lengths")}
    with pytest.raises(RuntimeError):
        score_with(df, [Lengths(False)])


class Ones(Lengths):
    name = "ones"

    def score(self, x):
        import pandas as pd

        if x.str.contains("bang").any():
            raise ValueError
        return pd.DataFrame({"sentiment": ["NEUTRAL"] * len(x), "conviction": [1.0] * len(x)})


class Short(Lengths):
    name = "short"

    def score(self, x):
        return super().score(x).head(0)


def test_scorers_fall_back(spark):
    kind = "id long, analysis_text string"
    by_id = lambda df: {r.id: (r.conviction, r.scored_by) for r in df.collect()}
    df = spark.createDataFrame([(1, "abc"), (2, "boom"), (3, "abcd")], kind).coalesce(1)
    # A batch that one scorer fails on goes to the next as a whole.
    assert by_id(score_with(df, [Lengths(), Ones()])) == {i: (1.0, "ones") for i in (1, 2, 3)}
    assert by_id(score_with(df, [Lengths(), Ones()], batch=1)) == {1: (3.0, "lengths"), 2: (1.0, "ones"), 3: (4.0, "lengths")}
    # One bad text costs no other its score.
    assert by_id(score_with(df, [Lengths()])) == {1: (3.0, "lengths"), 2: (None, "lengths"), 3: (4.0, "lengths")}
    assert by_id(score_with(df.filter("id <> 2"), [Short(), Lengths()])) == {1: (3.0, "lengths"), 3: (4.0, "lengths")}
    bad = spark.createDataFrame([(1, "abc"), (2, "boom"), (3, "bang"), (4, "boom bang")], kind).coalesce(1)
    assert by_id(score_with(bad, [Lengths(), Ones()])) == {1: (3.0, "lengths"), 2: (1.0, "ones"), 3: (4.0, "lengths"), 4: (None, "lengths")}
    with pytest.raises(Exception, match="every scorer failed"):
        score_with(bad, [Lengths(), Ones()], required=True).collect()
    assert by_id(score_with(bad.filter("id < 4"), [Lengths(), Ones()], required=True))[3] == (4.0, "lengths")


def test_signals_count_events_once(spark):
    from pyspark.sql import functions as F

    t = at("2024-01-01T10:00:00")
    rows = [(i, "A", "2024-01-01", "bank cuts outlook on weak demand", t, "NEGATIVE", 8.0, 1.0) for i in range(8)] + [(8, "A", "2024-01-01", "new plant opens early in spring", t, "POSITIVE", 8.0, 1.0), (9, "A", "2024-01-01", "record order from abroad wins praise", None, "POSITIVE", 8.0, 1.0), (10, "A", "2024-01-01", "odd label", t, "MAYBE", 8.0, 1.0)]
    df = spark.createDataFrame(rows, "news_id long, ticker string, day string, headline string, published_at timestamp, sentiment string, conviction double, relevance double")
    c = event_clusters(df)
    s = ticker_signals(c, reference=F.lit("2024-01-01 10:00:00").cast("timestamp")).first()
    assert s.articles == 10 and s.events == 3 and s.sentiment == "POSITIVE" and (s.positive, s.negative, s.neutral) == (2, 8, 0)
    assert s.direction == pytest.approx((-1 + 1 + 0.5) / 2.5)
    w = spark.range(1).select(recency_weight(F.lit(None).cast("timestamp"), F.lit(t)).alias("w")).first().w
    assert w == 0.5
