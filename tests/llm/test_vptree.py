import random
import re

import numpy as np
import pytest

from quotemill.llm import vptree as V
from quotemill.llm.vptree import Shard, classes, expanded_pairs, near_duplicates, suffix_fingerprints
from quotemill.llm.wordsets import COUNT_BITS, as_fraction, rare_first

KIND = "news_id long, headline string, snippet string, sid string, words int"


def corpus(n, seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    out = []
    for i in range(n):
        if out and r.random() < 0.5:
            _, h, s, *_ = out[r.randrange(len(out))]
            ws = [w if r.random() > 0.1 else r.choice(vocab) for w in ((h or "") + " " + (s or "")).split()] or ["w1"]
            out.append((i, " ".join(ws[:3]), " ".join(ws[3:]) or "w2", "clash", 1))
        else:
            out.append((i, r.choice([None, "", " ", "..."]) if r.random() < 0.1 else " ".join(r.choices(vocab, k=3)), " ".join(r.choices(vocab, k=r.randint(1, 14))), "clash", 1))
    return out + out[:3]


def brute(rows, t):
    sets = [(i, frozenset(re.findall(r"[^\W_]+", f"{h} {s}".lower()))) for i, h, s, *_ in rows if h and s and h.strip() and s.strip()]
    return sorted(tuple(sorted((a, b))) for k, (a, x) in enumerate(sets) for b, y in sets[k + 1 :] if a != b and x and y and len(x & y) / len(x | y) >= t)


@pytest.mark.parametrize("t,leaf,block,small", [(0.65, 2048, 8192, 64), (0.65, 8, 16, 2), (0.5, 4, 8, 1), (0.8, 16, 8192, 4)])
def test_all_pairs(spark, t, leaf, block, small, monkeypatch):
    for k, v in (("LEAF", leaf), ("BLOCK", block), ("SMALL", small)):
        monkeypatch.setattr(V, k, v)
    rows = corpus(200, 11)
    got = expanded_pairs(*near_duplicates(spark.createDataFrame(rows, KIND), similarity=t)).collect()
    # Repeated keys pair as rows do; a key is never its own partner.
    assert sorted(tuple(r) for r in got) == brute(rows, t)


def shards(sets, t, order=None):
    """Every shard of some sets as (ids, Shard), with the similar pairs for which its word is the first shared one."""
    counts = np.zeros(1 << COUNT_BITS, np.int64)
    sizes = np.array([len(x) for x in sets])
    words, row, pos, _ = rare_first(np.concatenate(sets).astype(np.int64), sizes, counts if order is None else order)
    fp = suffix_fingerprints(words, row)
    sorted_sets = np.split(words, np.cumsum(sizes)[:-1])
    want = {}
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            both = np.intersect1d(sets[a], sets[b])
            if len(both) * (t.numerator + t.denominator) >= (sizes[a] + sizes[b]) * t.numerator and len(both):
                want.setdefault(next(w for w in sorted_sets[a].tolist() if w in set(both.tolist())), set()).add((a, b))
    for w in np.unique(words):
        at = np.flatnonzero(words == w)
        yield row[at], Shard(fp[at], sizes[row[at]], pos[at], t), want.get(int(w), set())


def near_sets(n, r, size=40):
    base = [r.choice(60, size, replace=False) for _ in range(12)]
    return [np.unique(np.where(r.random(size) < 0.12, r.integers(60, 90, size), base[i % 12])) for i in range(n)]


@pytest.mark.parametrize("leaf", [4, 16, 1024])
def test_shards_hold_every_pair_at_its_first_shared_word(leaf, monkeypatch):
    monkeypatch.setattr(V, "LEAF", leaf)
    t, r, found = as_fraction(0.65), np.random.default_rng(2), 0
    for ids, shard, want in shards(near_sets(150, r), t):
        shard.search(np.arange(len(ids)))
        got = {tuple(sorted((int(ids[i]), int(ids[j])))) for i, j in zip(*shard.pairs())}
        assert want <= got
        found += len(want)
        # The same across two halves of it.
        two = Shard(shard.fp, shard.len, shard.pos, t)
        two.search_between(np.arange(0, len(ids), 2), np.arange(1, len(ids), 2))
        mixed = {tuple(sorted((int(ids[i]), int(ids[j])))) for i, j in zip(*two.pairs())}
        half = {int(x): k % 2 for k, x in enumerate(ids)}
        assert {p for p in want if half[p[0]] != half[p[1]]} <= mixed
    assert found > 300


def test_vantage_points_prune():
    """The radius is small where the shard's word stands late, and trees then compare a part of the pairs."""
    r = np.random.default_rng(4)
    n, t = 6000, as_fraction(0.65)
    fp = r.integers(0, 2**63, (n, V.FP_WORDS)).astype(np.uint64)
    group = np.repeat(np.arange(n // 4), 4)
    fp = fp[group] ^ np.where(np.arange(n) % 4 == 1, np.uint64(4), np.uint64(0))[:, None]
    shard = Shard(fp, np.full(n, 60), np.full(n, 11), t)
    shard.search(np.arange(n))
    whole = Shard(fp, np.full(n, 60), np.full(n, 11), t)
    whole._compare(np.arange(n), np.arange(n), whole._radius(np.arange(n), np.arange(n)), True)
    key = lambda s: {tuple(sorted(p)) for p in zip(*map(np.ndarray.tolist, s.pairs()))}
    assert key(shard) == key(whole) and len(key(shard)) >= n // 4 * 6 and shard.tested < 0.7 * whole.tested


@pytest.mark.parametrize("pos,piece", [(9, 50), (10, 1 << 20), (11, 50), (12, 1 << 20)])
def test_equal_parts_find_every_pair_and_pass_the_others_over(pos, piece, monkeypatch):
    monkeypatch.setattr(V, "PIECE", piece)
    r = np.random.default_rng(pos)
    n, t, bound = 4000, as_fraction(0.65), 24 - 2 * pos
    fp = r.integers(0, 2**64, (n, V.FP_WORDS), dtype=np.uint64)
    # Every second record is as far from the one before it as the bound allows.
    for i in range(1, n, 2):
        fp[i] = fp[i - 1]
        for bit in r.choice(64 * V.FP_WORDS, bound, replace=False):
            fp[i, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    length, at = np.full(n, 60), np.full(n, pos)
    want = {(i, i + 1) for i in range(0, n, 2)}
    shard, halves = Shard(fp, length, at, t), Shard(fp, length, at, t)
    shard.search(np.arange(n))
    halves.search_between(np.arange(0, n, 2), np.arange(1, n, 2))
    for s in (shard, halves):
        assert {tuple(sorted((int(i), int(j)))) for i, j in zip(*s.pairs())} == want
    assert shard.tested < 0.2 * n * n / 2 and halves.tested < 0.2 * n * n / 4


def test_equal_fingerprints_are_not_joined_part_by_part():
    """Where parts tell nothing, all are compared, once."""
    n, t = 3000, as_fraction(0.65)
    shard = Shard(np.zeros((n, V.FP_WORDS), np.uint64), np.full(n, 60), np.full(n, 12), t)
    shard.search(np.arange(n))
    assert len(shard.pairs()[0]) == n * (n - 1) // 2 and shard.tested <= n * (n + V.CHUNK)


def test_classes_of_slack_leave_out_what_lengths_and_positions_exclude():
    r = np.random.default_rng(9)
    n, t = 4000, as_fraction(0.65)
    fp = r.integers(0, 2**64, (n, V.FP_WORDS), dtype=np.uint64)
    fp[1::2] = fp[::2]
    length, pos = r.integers(45, 76, n), r.integers(0, 21, n)
    shard = Shard(fp, length, pos, t)
    shard.search(np.arange(n))
    i, j = np.triu_indices(n, 1)
    fits = shard.fits(i, j)
    assert {tuple(sorted(x)) for x in zip(*map(np.ndarray.tolist, shard.pairs()))} == set(zip(i[fits].tolist(), j[fits].tolist())) and fits.sum() > 100
    assert shard.tested < 0.75 * len(i)


def test_fingerprint_distance_is_a_lower_bound():
    r = np.random.default_rng(3)
    for _ in range(50):
        a, b = (np.unique(r.integers(0, 200, r.integers(1, 80))).astype(np.int64) for _ in range(2))
        fp = suffix_fingerprints(np.concatenate([[-1], a, [-2], b]), np.repeat([0, 1], [len(a) + 1, len(b) + 1]))
        assert np.bitwise_count(fp[0] ^ fp[len(a) + 1]).sum() <= len(np.setxor1d(a, b))


def test_classes_hot_and_empty(spark):
    none = spark.createDataFrame([], KIND)
    members, links = near_duplicates(none)
    assert classes(members, links).count() == 0 and expanded_pairs(members, links).count() == 0
    hot = [(i, "the same headline", "and the same text", None, 1) for i in range(400)] + [(1000 + i, "the same headline", f"and the same text {i}", None, 1) for i in range(20)] + [(5000, "quite other words", "in both of the parts", None, 1)]
    members, links = near_duplicates(spark.createDataFrame(hot, KIND))
    got = {r.news_id: r for r in classes(members, links).collect()}
    assert got[7].class_id == 0 and got[7].class_size == 400 and got[7].links == 20 and got[5000].links == 0
    assert links.count() == 20 + 190


@pytest.mark.parametrize("t", [0.5, 0.65, 0.8])
def test_short_sets_at_the_bound(t):
    t = as_fraction(t)
    far = Shard(np.zeros((1, V.FP_WORDS), np.uint64), np.array([30]), np.array([0]), t).far
    # Pairs of n and n + 1 words may differ by more words than pairs of m and m words, though those are longer.
    n, m = next((n, m) for n in range(4, 30) for m in range(n + 1, n + 3) if far[2 * n + 1] > far[2 * m])
    kept = (2 * n + 1 - far[2 * n + 1]) // 2
    r = np.random.default_rng(5)
    sets = []
    for _ in range(60):
        x = r.choice(10**6, 2 * n, replace=False)
        sets += [np.append(x[: n - 1], 5), np.concatenate([[5], x[: kept - 1], 10**6 + x[: n + 1 - kept]])]
    sets += [np.append(r.choice(10**6, m - 1, replace=False), 5) for _ in range(20)]
    seen = 0
    for ids, shard, want in shards(sets, t):
        shard.search(np.arange(len(ids)))
        assert want <= {tuple(sorted((int(ids[i]), int(ids[j])))) for i, j in zip(*shard.pairs())}
        seen += len(want)
    assert len(sets) > V.SMALL and seen >= 60
