import datetime as dt

import numpy as np

import pytest

from quotemill.operators.spikes import SpikeModel, flag_many, forward_backward, implausible, run_lengths
from tests.helpers import at


def series(n=200, seed=1):
    r = np.random.default_rng(seed)
    return np.round(100 * np.exp(np.cumsum(r.normal(0, 0.01, n))), 2), np.round(np.exp(r.normal(11, 0.3, n)))


def flag_series(close, volume, m=SpikeModel()):
    x = np.asarray(close, float)
    moves = np.abs(np.diff(np.log(x[x > 0])))
    return flag_many([(x, np.asarray(volume, float), float(np.median(moves[moves > 0])))], m)


def flags(close, volume):
    f = flag_series(close, volume)
    return {i: v for i, v in enumerate(f["close_flag"]) if v != "normal"}, {i: v for i, v in enumerate(f["volume_flag"]) if v != "normal"}


def test_plain_series_has_no_flags():
    for seed in range(8):
        assert flags(*series(seed=seed)) == ({}, {})


def test_spikes_that_come_back():
    c, v = series()
    c[50] *= 1.5
    c[100:102] *= 0.6
    c[150:153] *= 1.4  # stays too long to be a spike
    v[30] *= 80
    v[31] *= 3
    v[70] = 1
    v[120:124] *= 6  # busy days
    got = flags(c, v)
    assert got == ({50: "spike", 100: "spike", 101: "spike"}, {30: "spike", 70: "spike"})


def test_levels_splits_and_bounds():
    c, v = series()
    c[90:] /= 4
    c[20], c[21], v[40] = 0.0, -3.0, -5.0
    c[10] = np.nan
    v[60] = np.nan
    assert flags(c, v) == ({20: "out_of_range", 21: "out_of_range"}, {40: "out_of_range"})


def test_stuck_needs_five():
    c, v = series()
    c[20:24] = 99.9
    c[60:65] = 101.01
    v[100:107] = 5000.0
    got = flags(c, v)
    assert set(got[0]) == set(range(60, 65)) and set(got[0].values()) == {"stuck"}
    assert {i for i, k in got[1].items() if k == "stuck"} == set(range(100, 107))


def test_run_lengths():
    assert run_lengths(np.array([1, 1, np.nan, np.nan, 2, 2, 2])).tolist() == [2, 2, 1, 1, 3, 3, 3]
    assert run_lengths(np.empty(0)).tolist() == []


def test_blocks_agree_with_one_pass(spark):
    c, v = series(400, 4)
    c[[50, 99, 100, 250]] *= 1.6
    c[195:203] = 77.7
    v[[101, 301]] *= 90
    data = [(i, " ab", at("2020-01-01") + dt.timedelta(days=i), float(c[i]), float(v[i]), "x") for i in range(400)]
    df = spark.createDataFrame(data, "bar_id long, ticker string, timestamp timestamp, close double, volume double, close_flag string")
    small = {r.bar_id: (r.close_flag, r.volume_flag) for r in implausible(df, model=SpikeModel(block=64, halo=64)).collect()}
    whole = flag_series(c, v)
    assert small == {i: (whole["close_flag"][i], whole["volume_flag"][i]) for i in range(400)}


def test_flags_do_not_depend_on_the_block(spark):
    """The usual move is that of the whole source, though its first half is calmer than the second."""
    r = np.random.default_rng(6)
    sd = np.where(np.arange(5000) < 2500, 0.004, 0.02)
    c = np.round(100 * np.exp(np.cumsum(r.normal(0, 1, 5000) * sd)), 4)
    v = np.round(np.exp(r.normal(11, 0.3, 5000)))
    c[r.choice(5000, 60, replace=False)] *= 1.08
    c[3000] *= 2
    data = [(i, "AB", at("2010-01-01") + dt.timedelta(days=i), float(c[i]), float(v[i])) for i in range(5000)]
    df = spark.createDataFrame(data, "bar_id long, ticker string, timestamp timestamp, close double, volume double").cache()
    flags = [{r.bar_id: (r.close_flag, r.volume_flag) for r in implausible(df, model=SpikeModel(block=b)).collect()} for b in (512, 4096)]
    assert flags[0] == flags[1] and flags[0][3000][0] == "spike" and len(flags[0]) == 5000
    whole = flag_series(c, v)
    assert flags[0] == {i: (whole["close_flag"][i], whole["volume_flag"][i]) for i in range(5000)}


def test_forward_backward_is_the_posterior_over_all_paths():
    import itertools

    r = np.random.default_rng(2)
    m = SpikeModel(start=0.1, stay_spike=0.2, stay_stuck=0.5, stay_out=0.3)
    a, ss, st, so = m.start, m.stay_spike, m.stay_stuck, m.stay_out
    step = np.array([[1 - 3 * a, a, a, a], [1 - ss - a, ss, a / 2, a / 2], [1 - st - a, a / 2, st, a / 2], [1 - so - a, a / 2, a / 2, so]])
    emit = r.random((3, 5, 4))
    emit[1, 3:] = 1.0  # a shorter series
    got = forward_backward(emit, m)
    for k, n in ((0, 5), (1, 3), (2, 5)):
        want = np.zeros((n, 4))
        for path in itertools.product(range(4), repeat=n):
            p = step[0][path[0]] * emit[k, 0, path[0]]
            for i in range(1, n):
                p *= step[path[i - 1], path[i]] * emit[k, i, path[i]]
            for i in range(n):
                want[i, path[i]] += p
        assert got[k, :n] == pytest.approx(want / want.sum(axis=1, keepdims=True))


def test_nulls_and_empty(spark):
    kind = "bar_id long, ticker string, timestamp timestamp, close double, volume double"
    assert implausible(spark.createDataFrame([], kind)).count() == 0
    rows = [(1, None, at("2024-01-01"), 1.0, 1.0), (2, "A", None, -1.0, 1.0), (3, "A", at("2024-01-01"), None, None), (None, "A", at("2024-01-02"), -1.0, None), (4, "A", at("2024-01-02"), 2.0, 1.0), (4, "A", at("2024-01-02"), 2.0, 1.0)]
    got = sorted([(r.bar_id, r.close_flag) for r in implausible(spark.createDataFrame(rows, kind)).collect()], key=str)
    assert got == sorted([(1, "normal"), (2, "normal"), (3, "normal"), (None, "out_of_range"), (4, "normal"), (4, "normal")], key=str)
