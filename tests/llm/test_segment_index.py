import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotemill.llm import segment_index as X
from quotemill.llm.segment_index import SegmentIndex, accept_batches, article_keys, distinct_sets, edits, page_url, probed_segments, repeats, stored_segments
from quotemill.llm.wordsets import COUNT_BITS, as_fraction

NEWS = "news_id long, batch_no int, headline string, url string, provider string, article_id string, words string, ord int"
WORDS = re.compile(r"[^\W_]+")


def wordset(t):
    return frozenset(WORDS.findall((t or "").lower()))


def near(a, b, t=0.75):
    return bool(a and b) and len(a & b) / len(a | b) >= t


def brute(history, incoming):
    """One row after the other."""
    accepted = [(wordset(h), u, (p, i)) for _, _, h, u, p, i, *_ in history]
    found = []
    ok = lambda x: x is not None and x.strip() != ""
    for r in sorted(incoming, key=lambda r: (r[1], r[0])):
        s = wordset(r[2])
        if any(near(s, a) or (ok(r[3]) and r[3] == u) or (ok(r[4]) and ok(r[5]) and (r[4], r[5]) == k) for a, u, k in accepted):
            found.append(r[0])
        else:
            accepted.append((s, r[3], (r[4], r[5])))
    return found


def articles(n, seed, start=0, batch=None):
    r = random.Random(seed)
    out = []
    for i in range(n):
        base = ["alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven", "red green blue cyan"][r.randint(0, 2)].split()
        text = [w if r.random() > 0.12 else r.choice("uno dos tres cuatro".split()) for w in base]
        head = r.choice([None, "", "  ", "!!!"]) if r.random() < 0.1 else " ".join(text) + (" " + r.choice("xy") if r.random() < 0.3 else "")
        out.append((start + i, batch or r.randint(1, 3), head, r.choice([None, "", " ", *[f"http://x.example/{k}" for k in range(60)]]), r.choice([None, "", "p", "q"]), r.choice([None, "", *map(str, range(60))]), "clash", 7))
    return out


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("in_order,broadcast,prune", [(50_000, 1_000_000, 64), (0, 0, 2), (0, 1_000_000, 2)])
def test_against_one_after_the_other(spark, tmp_path, monkeypatch, seed, in_order, broadcast, prune):
    """In one task and in rounds, with slots broadcast to and shuffled, some slots read and all."""
    monkeypatch.setattr(X, "PRUNE_FROM", prune)
    monkeypatch.setattr(X, "MAX_IN_ORDER", in_order)
    monkeypatch.setattr(X, "MAX_BROADCAST", broadcast)
    old, new = articles(60, seed), articles(80, seed + 50, start=1000)
    index = SegmentIndex.build(spark.createDataFrame(old, NEWS), f"{tmp_path}/index", rows_per_slot=40)
    assert index.slots > 1
    got = sorted(r.news_id for r in repeats(index, spark.createDataFrame(new, NEWS)).collect())
    assert got == sorted(brute(old, new))


def test_batches_by_append_give_the_same(spark, tmp_path, monkeypatch):
    old, new = articles(40, 7), articles(60, 8, start=1000)
    path = f"{tmp_path}/index"
    SegmentIndex.build(spark.createDataFrame(old, NEWS), path, rows_per_slot=30)
    found = []
    for b in (1, 2, 3):
        index = SegmentIndex.load(spark, path)
        rows = spark.createDataFrame([r for r in new if r[1] == b], NEWS)
        hit = [r.news_id for r in repeats(index, rows).collect()]
        found += hit
        index.append(rows.filter(~F.col("news_id").isin(hit) if hit else F.lit(True)), str(b))
    assert sorted(found) == sorted(brute(old, new))
    # One at a time, two together, all together.
    sizes_ = [sum(r[1] == b for r in new) for b in (1, 2, 3)]
    for most, appended in ((1, 3), (sizes_[0] + sizes_[1], 2), (1000, 1)):
        monkeypatch.setattr(X, "ROWS_AT_ONCE", most)
        again = SegmentIndex.build(spark.createDataFrame(old, NEWS), f"{tmp_path}/{most}")
        assert sorted(r.news_id for r in accept_batches(again, spark.createDataFrame(new, NEWS)).collect()) == sorted(found)
        assert len(SegmentIndex.load(spark, f"{tmp_path}/{most}").batches) == 1 + appended


def sizes(index):
    return {n: (index.table(n).count(), index.table(n).distinct().count()) for n in X.TABLES}


def test_appended_index_is_the_built_one(spark, tmp_path):
    rows = articles(90, 3)
    whole = SegmentIndex.build(spark.createDataFrame(rows, NEWS), f"{tmp_path}/whole", rows_per_slot=50)
    path = f"{tmp_path}/parts"
    index = SegmentIndex.build(spark.createDataFrame(rows[:30], NEWS), path, rows_per_slot=50)
    for k in (1, 2):
        # A batch that is appended again, with rows that are stored already, adds nothing twice.
        for _ in range(2):
            index = SegmentIndex.load(spark, path).append(spark.createDataFrame(rows[20 : 30 + 30 * k], NEWS), f"k{k}")
    got, want = sizes(index), sizes(whole)
    assert all(a == b for a, b in got.values()) and {n: got[n][0] for n in ("sets", "keys")} == {n: want[n][0] for n in ("sets", "keys")}
    assert sizes(SegmentIndex.load(spark, path)) == got and sizes(index.compact(f"{tmp_path}/compact")) == got
    assert got["segments"][0] == want["segments"][0]


def test_what_is_not_marked_as_done_is_not_read(spark, tmp_path):
    path = f"{tmp_path}/index"
    index = SegmentIndex.build(spark.createDataFrame(articles(20, 3), NEWS), path)
    before = sizes(index)
    new = spark.createDataFrame([(1, 1, "quite another headline", "u", "p", "i", None, 1)], NEWS)
    done = index.append(new, "b")
    (tmp_path / "index" / "done" / "b").unlink()
    assert sizes(SegmentIndex.load(spark, path)) == before and sizes(done)["sets"][0] == before["sets"][0] + 1
    with pytest.raises(ValueError):
        index.append(new, "base")


def test_rows_read_do_not_grow_with_history(spark, tmp_path, monkeypatch):
    """Ten times the history has ten times the slots; a batch reads those it touches."""
    monkeypatch.setattr(X, "PRUNE_FROM", 2)
    r = random.Random(9)
    vocab = [f"w{i}" for i in range(20_000)]
    read = []
    for n in (600, 6000):
        rows = [(i, 1, " ".join(r.choices(vocab, k=8)), None, None, None, None, 1) for i in range(n)]
        index = SegmentIndex.build(spark.createDataFrame(rows, NEWS), f"{tmp_path}/{n}", rows_per_slot=40)
        batch = distinct_sets(article_keys(spark.createDataFrame(rows[:2], NEWS)))
        probes = X._segments(batch, index.counts, index.t, probed_segments)
        stored, _ = index._touched("segments", probes, X._slot("segments", index.slots))
        read.append(stored.count())
    assert read[1] < 2 * read[0]


def test_a_very_long_headline_costs_what_its_words_do():
    r = np.random.default_rng(1)
    lengths = np.array([100_000, 7, 12, 0, 9])
    words = np.concatenate([r.choice(10**9, n, replace=False) for n in lengths]).astype(np.int64)
    counts = r.integers(0, 50, 1 << COUNT_BITS)
    start = time.perf_counter()
    p = probed_segments(words, lengths, counts, as_fraction(0.75))
    assert time.perf_counter() - start < 1.0 and set(p["row"].tolist()) == {0, 1, 2, 4}


def test_segments_lose_no_pair():
    """Whatever the order of words: sets within the bound share a segment that both sides compute."""
    r = np.random.default_rng(1)
    t = as_fraction(0.75)
    counts = r.integers(0, 50, 1 << COUNT_BITS)
    for _ in range(300):
        a = r.choice(40, r.integers(1, 20), replace=False).astype(np.int64)
        b = np.unique(np.concatenate([a[r.random(len(a)) > 0.12], r.choice(np.arange(40, 60), r.integers(0, 3)).astype(np.int64)]))
        if not len(b):
            continue
        both = len(np.intersect1d(a, b))
        if both * 7 < (len(a) + len(b)) * 3:
            continue
        s, p = (f(x, np.array([len(x)]), counts, t) for f, x in ((stored_segments, a), (probed_segments, b)))
        most = edits(len(a), len(b), t)
        keys = {(k, bool(z)): i for k, z, i in zip(s["seg"], s["rest"], s["pos"])}
        assert any((k, bool(z)) in keys and keys[k, bool(z)] + i <= most for k, z, i in zip(p["seg"], p["rest"], p["pos"]))


def test_page_url(spark):
    same = ["http://www.Tallow.example/read?lang=en&p=12#top", "https://tallow.example/read?p=12&utm_source=feed", "https://WWW.TALLOW.EXAMPLE/read/?p=12", " https://tallow.example/read?ref=a&p=12&x=1 "]
    other = ["https://tallow.example/read?p=13", "https://tallow.example/Read?p=12", "https://a.tallow.example/read?p=12", "https://tallow.example/read?p=12&id=4", "https://tallow.example/read"]
    df = spark.createDataFrame([(x,) for x in same + other + [None, "", "  "]], "u string").select(page_url(F.col("u")).alias("k"))
    got = [r.k for r in df.collect()]
    assert len(set(got[: len(same)])) == 1 and len(set(got[: len(same) + len(other)])) == 1 + len(other) and got[-3:] == [None, None, None]


def test_empty_hot_and_long(spark, tmp_path):
    none = spark.createDataFrame([], NEWS)
    index = SegmentIndex.build(none, f"{tmp_path}/index")
    assert repeats(index, none).count() == 0 and accept_batches(index, none).count() == 0
    hot = [(i, 1, "the very same headline", f"u{i}", "p", f"i{i}", None, 1) for i in range(300)]
    got = repeats(index, spark.createDataFrame(hot, NEWS))
    assert got.count() == 299 and got.filter("news_id = 0").count() == 0
    long = [(1, 1, " ".join(f"w{i}" for i in range(5000)), None, None, None, None, 1), (2, 1, " ".join(f"w{i}" for i in range(300, 5000)), None, None, None, None, 1)]
    assert [r.news_id for r in repeats(index, spark.createDataFrame(long, NEWS)).collect()] == [2]
    assert distinct_sets(article_keys(spark.createDataFrame(hot, NEWS))).count() == 1
