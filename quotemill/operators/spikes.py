"""Implausible readings by a hidden Markov model per source."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotemill.functions.columns import entity_key
from quotemill.session import broadcast_within, cut, ship

NORMAL, SPIKE, STUCK, OUT = range(4)
#: Steps of a doubling by which moves are counted.
MOVE_STEPS = 4096
#: Sources whose usual moves may be broadcast: two numbers each.
MAX_BROADCAST_SOURCES = 200_000
#: Bars whose blocks are judged together.
ROWS_AT_ONCE = 50_000
KINDS = np.array(["normal", "spike", "stuck", "out_of_range"], dtype=object)


@dataclass(frozen=True)
class SpikeModel:
    """Emission and transition parameters; scores are in units of a source's usual movement."""

    block: int = 512  # bars of a source that one task looks at
    halo: int = 128  # further bars on either side, for context only
    start: float = 0.002  # chance that a normal bar is followed by each other state
    stay_spike: float = 0.02
    stay_stuck: float = 0.9
    stay_out: float = 0.2
    same_by_chance: float = 0.01  # chance that a normal value repeats its neighbour exactly
    price_scale: float = 0.75  # usual size of a two-sided price move, in median moves
    price_top: float = 1e4
    volume_scale: float = 0.33  # usual size of a log volume ratio
    volume_top: float = 16.0
    volume_near: int = 10  # bars on either side that give the ordinary volume
    max_spike: int = 2  # bars after which a spike must have come back
    returned: float = 0.5  # part of the move that may remain after a clear spike
    returned_late: float = 0.95  # and after others, where the level changed meanwhile
    clear: float = 8.0  # score from which a spike is told first
    apart: float = 0.5  # part of the move by which a spike must leave the level around it
    level_near: int = 5  # bars on either side that give the level of prices
    least_move: float = 0.02  # a price move below 2 % is never a spike
    run: int = 5  # equal values that count as stuck


def _excursions(x: np.ndarray, usual: float, returned: float, m: SpikeModel) -> np.ndarray:
    """For each log price, its least distance in usual moves to the prices before and after an excursion of at most max_spike bars that it is part of; 0 where more than `returned` of the move remains."""
    s = np.zeros(len(x))
    for n in range(1, m.max_spike + 1):
        if len(x) < n + 2:
            break
        before, after = x[: -n - 1], x[n + 1 :]
        inside = np.stack([x[1 + j : len(x) - n + j] for j in range(n)])
        up = np.minimum(inside - before, inside - after).min(axis=0)
        down = np.minimum(before - inside, after - inside).min(axis=0)
        dev = np.maximum(up, down)
        ok = (dev > m.least_move) & (np.abs(after - before) <= returned * dev)
        dev = np.where(ok, dev / usual, 0.0)
        for j in range(n):
            np.maximum(s[1 + j : len(x) - n + j], dev, out=s[1 + j : len(x) - n + j])
    # A normal bar between two spikes is far from both, but not from the level around it.
    k = m.level_near
    padded = np.concatenate([np.full(k, np.nan), x, np.full(k, np.nan)])
    near = np.stack([padded[j : j + len(x)] for j in range(2 * k + 1) if j != k])
    s[np.abs(x - _middle(near)) < m.apart * s * usual] = 0.0
    return s


def _middle(near: np.ndarray) -> np.ndarray:
    """Median of each column without its NaN; NaN where there is nothing else."""
    near = np.sort(near, axis=0)
    n = np.count_nonzero(~np.isnan(near), axis=0)
    at = np.arange(near.shape[1])
    return (near[np.maximum(n - 1, 0) // 2, at] + near[n // 2, at]) / 2


def price_scores(close: np.ndarray, m: SpikeModel, usual: float) -> np.ndarray:
    """How far each close lies, in the source's usual moves, from the closes both before and after its excursion. Clear excursions are told first; the others are then measured without them, and may come back to a level that changed meanwhile. NaN where there is no positive close."""
    score = np.full(len(close), np.nan)
    at = np.flatnonzero(close > 0)
    x = np.log(close[at])
    s = np.zeros(len(x))
    if len(x) >= 3:
        usual = max(usual if usual == usual else 0.0, 1e-4)
        s = _excursions(x, usual, m.returned, m)
        rest = s < m.clear
        if rest.sum() >= 3:
            s[rest] = _excursions(x[rest], usual, m.returned_late, m)
    score[at] = s
    return score


def volume_scores(volume: np.ndarray, m: SpikeModel) -> np.ndarray:
    """Absolute log ratio of each volume to the median of the ordinary bars around it; NaN without a volume, 0 without neighbours."""
    score = np.full(len(volume), np.nan)
    at = np.flatnonzero(volume >= 0)
    v = volume[at]
    n, k = len(v), m.volume_near
    if n:
        padded = np.full(n + 2 * k, np.nan)
        padded[k : k + n] = np.where(v > 0, v, np.nan)
        near = np.stack([padded[j : j + n] for j in range(2 * k + 1) if j != k])
        usual = _middle(near)
        score[at] = np.where(np.isnan(usual), 0.0, np.abs(np.log((v + 1) / (usual + 1))))
    return score


def run_lengths(x: np.ndarray) -> np.ndarray:
    """Length of the run of equal consecutive values each bar belongs to; 1 for null."""
    out = np.ones(len(x), dtype=np.int64)
    if len(x):
        new = np.ones(len(x), dtype=bool)
        new[1:] = ~(x[1:] == x[:-1])
        starts = np.flatnonzero(new)
        lengths = np.diff(np.append(starts, len(x)))
        out = np.repeat(lengths, lengths)
    return out


def forward_backward(emit: np.ndarray, m: SpikeModel) -> np.ndarray:
    """Posterior of the four states for each bar of many series at once: emit and the result are series x bars x states. Likelihoods are scaled freely per bar; where all are 1, as after the end of a shorter series, a bar tells nothing."""
    a, ss, st, so = m.start, m.stay_spike, m.stay_stuck, m.stay_out
    # States other than normal fall back to normal; straight changes among them go through `a`.
    step = np.array([[1 - 3 * a, a, a, a], [1 - ss - a, ss, a / 2, a / 2], [1 - st - a, a / 2, st, a / 2], [1 - so - a, a / 2, a / 2, so]])

    def scaled(v: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
        z = v.sum(axis=1, keepdims=True)
        return np.where(z > 0, v / np.where(z > 0, z, 1.0), otherwise)

    n, length, _ = emit.shape
    out = np.empty(emit.shape)
    p = np.broadcast_to(step[0], (n, 4))
    for i in range(length):
        out[:, i] = scaled(p * emit[:, i], p)
        p = out[:, i] @ step
    b = np.ones((n, 4))
    for i in range(length - 1, -1, -1):
        out[:, i] = scaled(out[:, i] * b, out[:, i])
        b = scaled((emit[:, i] * b) @ step.T, np.ones(4))
    return out


def _emissions(score: np.ndarray, same: np.ndarray, bad: np.ndarray, scale: float, log_uniform: bool, top: float, m: SpikeModel) -> np.ndarray:
    q = np.where(np.isnan(score), 0.0, score)
    ordinary = np.exp(-np.minimum(q / scale, 600.0)) / scale
    wild = (1 / (np.maximum(q, 1.0) * math.log(top)) if log_uniform else np.full(len(q), 1 / top))
    wild = np.where(q > 0, wild, 1e-6)
    repeat, fresh = m.same_by_chance, 1 - m.same_by_chance
    by_chance = np.where(same, repeat, fresh)
    held = np.where(same, 0.999, 0.001)
    e = np.stack([ordinary * by_chance, wild * by_chance, ordinary * held, np.full(len(q), 1e-12)], axis=1)
    e[np.isnan(score)] = 1.0
    e[bad] = (0.0, 0.0, 0.0, 1.0)
    e /= e.max(axis=1, keepdims=True)
    return e


def flag_many(series: list[tuple[np.ndarray, np.ndarray, float]], m: SpikeModel = SpikeModel()) -> dict[str, np.ndarray]:
    """Flags of the bars of several series, one after the other. Each is (close, volume, usual move of its source), in order of time, NaN where there is no reading."""
    sizes = [len(c) for c, _, _ in series]
    inside = np.arange(max(sizes, default=0)) < np.array(sizes, dtype=np.int64)[:, None]
    out = {}
    for name, scale, log_uniform, top in (("close", m.price_scale, True, m.price_top), ("volume", m.volume_scale, False, m.volume_top)):
        emit = np.ones((*inside.shape, 4))
        values, runs, bads = [], [], []
        with np.errstate(invalid="ignore", divide="ignore"):
            for k, (close, volume, usual) in enumerate(series):
                x = close if name == "close" else volume
                bad = x <= 0 if name == "close" else x < 0
                score = np.where(bad, 0.0, price_scores(close, m, usual) if name == "close" else volume_scores(volume, m))
                run = run_lengths(x)
                emit[k, : len(x)] = _emissions(score, run > 1, bad, scale, log_uniform, top, m)
                values.append(x), runs.append(run), bads.append(bad)
        post = forward_backward(emit, m)[inside]
        x, run, bad = (np.concatenate(v) if v else np.empty(0) for v in (values, runs, bads))
        state = np.where(post[:, NORMAL] < 0.5, 1 + post[:, 1:].argmax(axis=1), NORMAL)
        state[np.isnan(x)] = NORMAL
        # Exact checks: a stuck value must really have been repeated often enough, a hard bound really be broken.
        state[(state == STUCK) & (run < m.run)] = NORMAL
        state[(state == OUT) & ~bad.astype(bool)] = NORMAL
        out |= {f"{name}_flag": KINDS[state], f"{name}_odds": 1 - post[:, NORMAL]}
    return out


def _previous(c: str, w: Window):
    """The last positive value before a row."""
    return F.last(F.when(F.col(c) > 0, F.col(c)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))


def _numbered(bars: DataFrame) -> DataFrame:
    """bars with __rn, the rank of each bar in its source, __all, the number of its bars, and __move, the absolute log move of its close from the last positive one: what holds within a month and what the months before bring, so that no task sorts a whole source."""
    within = Window.partitionBy("__e", "__m").orderBy("__t", "__id")
    rows = bars.withColumns({"__rn": F.row_number().over(within) - 1, "__prev": _previous("__c", within)})
    months = bars.groupBy("__e", "__m").agg(F.count("*").alias("__size"), F.max_by(F.col("__c"), F.when(F.col("__c") > 0, F.struct("__t", "__id"))).alias("__last"))
    months = months.withColumn("__last", F.when(F.col("__last") > 0, F.col("__last")))
    by_month = Window.partitionBy("__e").orderBy("__m")
    offsets = months.select(
        "__e",
        "__m",
        F.coalesce(F.sum("__size").over(by_month.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        F.sum("__size").over(Window.partitionBy("__e")).alias("__all"),
        _previous("__last", by_month).alias("__carried"),
    )
    out = rows.join(offsets, ["__e", "__m"])
    return out.select("__e", "__id", "__t", "__c", "__v", (F.col("__rn") + F.col("__before")).alias("__rn"), "__all", F.when(F.col("__c") > 0, F.abs(F.ln(F.col("__c") / F.coalesce("__prev", "__carried")))).alias("__move"))


def usual_moves(numbered: DataFrame) -> DataFrame:
    """__e, __usual: the median of each source's moves other than zero, to one part in 6000. Moves are counted by steps of their logarithm, so that a source has a bounded number of counts however many bars it has."""
    step = F.floor(F.log2("__move") * MOVE_STEPS)
    counts = numbered.filter("__move > 0").groupBy("__e", step.alias("__k")).agg(F.count("*").alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy("__e").orderBy("__k"))
    ranked = counts.select("__e", "__k", upto.alias("__upto"), F.sum("__n").over(Window.partitionBy("__e")).alias("__of"))
    return ranked.filter(F.col("__upto") * 2 >= F.col("__of")).groupBy("__e").agg(F.pow(F.lit(2.0), (F.min("__k") + 0.5) / MOVE_STEPS).alias("__usual"))


def implausible(bars: DataFrame, *, key: str = "bar_id", entity: str = "ticker", at: str = "timestamp", close: str = "close", volume: str = "volume", model: SpikeModel = SpikeModel()) -> DataFrame:
    """key, entity, at, close_flag, volume_flag ('normal', 'spike', 'stuck', 'out_of_range'), close_odds, volume_odds of every bar.

    Each of close and volume is read as the emissions of a hidden Markov model with four
    states. Normal bars emit small scores, spikes scores of any size, stuck bars repeat
    their neighbour's value, and a broken hard bound (close <= 0, volume < 0) can only
    come from the last state. The forward-backward posterior gives the flag; a stuck run
    must then be at least `run` bars long, counted exactly. A price score measures the
    distance to the closes both before and after an excursion of at most two bars in
    the source's usual moves, the median over all its bars, so a change of level or a split scores 0. A volume
    score is the log ratio to the median of the ten bars on either side, so a few busy
    days stay ordinary.

    A source is cut into blocks of `block` bars with `halo` bars of context on either
    side: no task sees more than block + 2 halo bars of it. Only runs longer than the
    halo are judged by a part of their length, which is still far above `run`.

    Null (or NaN) readings are never flagged, break a run of equal values and are passed
    over by the other scores. Bars without entity or time are returned as normal, with
    null odds. Ties in time are ordered by key. Equal rows are separate bars. An empty
    input gives no rows; extra columns are ignored.
    """
    ship(bars.sparkSession)
    bars = bars.select(F.col(key).alias("__id"), entity_key(F.col(entity)).alias("__e"), F.col(at).alias("__t"), F.col(close).cast("double").alias("__c"), F.col(volume).cast("double").alias("__v"))
    known = bars.filter("__e is not null and __t is not null").withColumn("__m", F.trunc("__t", "month"))
    b, h = model.block, model.halo
    rn = F.col("__rn")
    first, last = F.greatest(F.floor((rn - h) / b), F.lit(0)), F.least(F.floor((rn + h) / b), F.floor((F.col("__all") - 1) / b))
    # Used twice: for the usual moves and for the flags.
    numbered = cut(_numbered(known))
    spread = numbered.join(broadcast_within(usual_moves(numbered), MAX_BROADCAST_SOURCES), "__e", "left").withColumn("__block", F.explode(F.sequence(first, last)))
    spread = spread.select("__e", "__block", "__rn", "__id", "__t", "__c", "__v", "__usual").repartition("__e", "__block").sortWithinPartitions("__e", "__block", "__rn")
    kind = f"__id {dict(bars.dtypes)['__id']}, __e string, __t timestamp, close_flag string, volume_flag string, close_odds double, volume_odds double"

    def judged(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        t = t.combine_chunks()
        c, v, usual = (t[x].to_numpy().astype(float) for x in ("__c", "__v", "__usual"))
        ends = np.append(starts[1:], len(t))
        flags = flag_many([(c[i:j], v[i:j], usual[i]) for i, j in zip(starts, ends)], model)
        cols = {x: t[x] for x in ("__id", "__e", "__t")} | {x: pa.array(flags[x]) for x in ("close_flag", "volume_flag", "close_odds", "volume_odds")}
        own = pa.array(t["__rn"].to_numpy() // b == t["__block"].to_numpy())
        return pa.table(cols).filter(own).combine_chunks()

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            if len(held) < ROWS_AT_ONCE:
                continue
            starts = _starts(held)
            # The last block may go on in the next batch.
            if len(starts) > 1:
                yield from judged(held.slice(0, int(starts[-1])), starts[:-1]).to_batches()
                held = held.slice(int(starts[-1]))
        if held is not None and len(held):
            yield from judged(held, _starts(held)).to_batches()

    flagged = spread.mapInArrow(run, kind)
    rest = bars.filter("__e is null or __t is null").select("__id", "__e", "__t", F.lit("normal").alias("close_flag"), F.lit("normal").alias("volume_flag"), F.lit(None).cast("double").alias("close_odds"), F.lit(None).cast("double").alias("volume_odds"))
    out = flagged.unionByName(rest)
    return out.withColumnsRenamed({"__id": key, "__e": entity, "__t": at})


def _starts(t: pa.Table) -> np.ndarray:
    """Where each block of a source begins, in a table sorted by both."""
    e, block = t["__e"].combine_chunks(), t["__block"].to_numpy()
    new = np.ones(len(t), dtype=bool)
    new[1:] = pc.not_equal(e.slice(1), e.slice(0, len(e) - 1)).to_numpy(zero_copy_only=False) | (block[1:] != block[:-1])
    return np.flatnonzero(new)
