"""Irregular readings onto the regular slots of trading sessions."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.functions.columns import DAY_US, entity_key, finite, floor_div
from quotemill.session import broadcast_within, cut

#: Sessions that may be broadcast: over a century of trading days, about 3 MB.
MAX_BROADCAST_SESSIONS = 50_000


def _shifted(power: int, moment: str, k: int | Column) -> Column:
    """Sum of (x + k)^power times the weights in `moment`, from the sums about the slot's own centre."""
    return sum((F.col(f"__{moment}{p}") * (comb(power, p) * F.pow(F.lit(1.0) * k, F.lit(power - p))) for p in range(power)), F.col(f"__{moment}{power}"))


def regular_grid(
    readings: DataFrame,
    sessions: DataFrame,
    *,
    entity: str = "ticker",
    at: str = "timestamp",
    value: str = "close",
    session_date: str = "session_date",
    open_at: str = "open_at",
    close_at: str = "close_at",
    slot_seconds: int = 900,
    reach: int = 1,
    min_support: float = 1.0,
    min_weight: float = 0.1,
) -> DataFrame:
    """One row per entity, session with at least one usable reading, and slot of that session.

    Columns: entity, session_date, slot_start (timestamp), n_readings (usable readings in
    the slot itself), value (estimate at the slot's centre), weight, support, status
    ('read': the slot has a reading; 'filled': only its neighbours do, and they suffice;
    'missing': value is null).

    The estimate is a local linear regression at the slot's centre with the compact
    kernel 1 - (d / h)^2, h = (reach + 1/2) slots, so that exactly the readings of the
    slot and of `reach` slots on either side count. The kernel is a polynomial: its
    weighted sums follow from the sums of x^0..x^4 and y x^0..y x^3 of each slot, which
    are all that is shuffled. Where the readings lie on one side or too close together
    for a slope, the local mean takes its place. support is the effective number of
    readings, (sum w)^2 / sum w^2; below min_support, or with a sum of weights below
    min_weight, a slot without a reading is 'missing'.

    Readings are combined by entity, session and slot before the first shuffle, so a busy
    entity costs no more than its slots. Neighbours are found by slot number.

    A session covers open_at <= t < close_at and is cut from open_at on; a last part shorter
    than a slot is a slot too. Sessions with a null or no length are skipped. Readings with
    a null or blank entity, null time, or null, NaN or infinite value, or outside all
    sessions, take no part; equal rows each count. Empty inputs give no rows. Extra
    columns are ignored.
    """
    slot = slot_seconds * 1_000_000
    r = readings.select(entity_key(F.col(entity)).alias("__e"), F.unix_micros(F.col(at)).alias("__t"), finite(F.col(value).cast("double")).alias("__y")).filter("__e is not null and __t is not null and __y is not null")
    s = sessions.select(F.col(session_date).alias("__sd"), F.unix_micros(F.col(open_at)).alias("__o"), F.unix_micros(F.col(close_at)).alias("__c")).filter("__o < __c").distinct()
    # Sessions are told by number, so that the sums below carry one key for three.
    s = broadcast_within(cut(s.withColumn("__id", F.row_number().over(Window.orderBy("__sd", "__o", "__c")))), MAX_BROADCAST_SESSIONS)
    days = s.withColumn("__day", F.explode(F.sequence(floor_div(F.col("__o"), DAY_US), floor_div(F.col("__c") - 1, DAY_US))))
    inside = r.withColumn("__day", floor_div(F.col("__t"), DAY_US)).join(broadcast_within(days, 2 * MAX_BROADCAST_SESSIONS), "__day").filter("__t >= __o and __t < __c")

    k = floor_div(F.col("__t") - F.col("__o"), slot)
    placed = inside.select("__e", "__id", k.cast("int").alias("__k"), "__y", (F.pmod(F.col("__t") - F.col("__o"), F.lit(slot)) / F.lit(slot) - 0.5).alias("__x"))
    powers = [F.lit(1.0), F.col("__x")]
    while len(powers) < 5:
        powers.append(powers[-1] * F.col("__x"))
    slots = placed.groupBy("__e", "__id", "__k").agg(
        F.count("*").alias("__n"),
        *[F.sum(powers[p]).alias(f"__a{p}") for p in range(1, 5)],
        *[F.sum(F.col("__y") * powers[p]).alias(f"__b{p}") for p in range(4)],
    )

    # Each occupied slot speaks for itself, for the empty slots up to the next one, and to its neighbours.
    by_slot = Window.partitionBy("__e", "__id").orderBy("__k")
    last = floor_div(F.col("__c") - F.col("__o") - 1, slot).cast("int")
    # The explicit repartition lets the window and the sums below share one shuffle.
    told = (
        slots.repartition("__e", "__id")
        .withColumn("__a0", F.col("__n").cast("double"))
        .withColumn("__next", F.lead("__k").over(by_slot))
        .withColumn("__from", F.when(F.lag("__k").over(by_slot).isNull(), 0).otherwise(F.col("__k")).cast("int"))
        .join(s, "__id")
        .withColumn("__upto", F.coalesce(F.col("__next") - 1, last))
        .withColumn(
            "__to",
            F.explode(
                F.concat(
                    F.transform(F.sequence(F.greatest(F.col("__k") - reach, F.lit(0)), F.least(F.col("__k") + reach, last)), lambda g: F.struct(g.alias("g"), F.lit(1.0).alias("says"))),
                    F.transform(F.sequence("__from", "__upto"), lambda g: F.struct(g.alias("g"), F.lit(0.0).alias("says"))),
                )
            ),
        )
    )
    says, g = F.col("__to.says"), F.col("__to.g")
    delta = F.col("__k") - g
    h2 = (reach + 0.5) ** 2
    d = [_shifted(p, "a", delta) for p in range(5)]
    e = [_shifted(p, "b", delta) for p in range(4)]
    sums = {
        "n": F.when(delta == 0, F.col("__n")).otherwise(0) * says.cast("long"),
        "w0": says * (d[0] - d[2] / h2),
        "w1": says * (d[1] - d[3] / h2),
        "w2": says * (d[2] - d[4] / h2),
        "q": says * (d[0] - 2 * d[2] / h2 + d[4] / (h2 * h2)),
        "y0": says * (e[0] - e[2] / h2),
        "y1": says * (e[1] - e[3] / h2),
        "left": F.when((says > 0) & (d[1] < 0), 1).otherwise(0),
        "right": F.when((says > 0) & (d[1] > 0), 1).otherwise(0),
    }
    grid = told.select("__e", "__id", "__sd", "__o", g.alias("__g"), *[c.alias(f"__{n}") for n, c in sums.items()]).groupBy("__e", "__id", "__g").agg(F.first("__sd").alias("__sd"), F.first("__o").alias("__o"), *[F.sum(f"__{n}").alias(f"__{n}") for n in sums])

    w0, det = F.col("__w0"), F.col("__w0") * F.col("__w2") - F.col("__w1") * F.col("__w1")
    enough_weight = w0 >= 1e-12
    support = F.when(enough_weight, w0 * w0 / F.col("__q")).otherwise(0.0)
    slope_known = (F.col("__left") > 0) & (F.col("__right") > 0) & (det > 0.01 * w0 * w0)
    fit = F.when(slope_known, (F.col("__w2") * F.col("__y0") - F.col("__w1") * F.col("__y1")) / F.when(slope_known, det)).otherwise(F.col("__y0") / F.when(enough_weight, w0))
    read = F.col("__n") > 0
    # A hair below the bound, so that one whole reading is not lost to rounding.
    suffices = enough_weight & (support >= min_support - 1e-9) & (w0 >= min_weight)
    return grid.select(
        F.col("__e").alias(entity),
        F.col("__sd").alias(session_date),
        F.timestamp_micros(F.col("__o") + F.col("__g").cast("long") * slot).alias("slot_start"),
        F.col("__n").alias("n_readings"),
        F.when(read | suffices, fit).alias("value"),
        w0.alias("weight"),
        support.alias("support"),
        F.when(read, "read").when(suffices, "filled").otherwise("missing").alias("status"),
    )


def unread_slots(grid: DataFrame, *, entity: str = "ticker") -> DataFrame:
    """The slots that the regression had to fill from their neighbours, or to mark as missing for want of support; slot_start in whole seconds since 1970 UTC."""
    filled = (F.col("status") == "filled") & F.col("value").isNotNull() & (F.col("support") > 0)
    missing = (F.col("status") == "missing") & F.col("value").isNull() & (F.col("weight") >= 0)
    return grid.filter(filled | missing).select(entity, floor_div(F.unix_micros("slot_start"), 1_000_000).alias("slot_start"))
