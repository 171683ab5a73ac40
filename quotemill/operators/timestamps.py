"""Time stamps of mixed formats and zones, normalised to UTC instants."""

from __future__ import annotations

from dataclasses import dataclass
from zoneinfo import available_timezones

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.functions.columns import blank_to_null
from quotemill.session import broadcast_within, cut, ship

#: Hours east of UTC that a zone abbreviation stands for by itself.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 1, "BST": 1, "CET": 1, "CEST": 2, "EET": 2, "EEST": 3, "MSK": 3,
    "IST": 5.5, "SGT": 8, "HKT": 8, "AWST": 8, "JST": 9, "KST": 9, "ACST": 9.5, "ACDT": 10.5, "AEST": 10, "AEDT": 11, "NZST": 12, "NZDT": 13,
    "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "AKST": -9, "AKDT": -8, "HST": -10,
}
#: Further zones that some use the same abbreviation for.
ALSO = {"IST": 2, "BST": 6, "CST": 8, "EST": 10, "AMT": -4, "ECT": -5}
#: Names that mean the local time of a place.
LOCAL_NAMES = {"ET": "America/New_York"}
#: The English months.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
MONTHS_LONG = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]

MAX_BROADCAST_FEEDS = 10_000
ROWS_PER_BLOCK = 250_000
#: Blocks whose tables one task chains; more are chained level by level.
FAN = 1024

_ZONE = r"[A-Za-z]+(?:[_+-][A-Za-z0-9]+)*(?:/[A-Za-z0-9_+-]+)+|(?:(?:UTC|GMT|utc|gmt)\s?)?[+-]\d{1,2}(?::?\d{2})?(?:\[[^\]]*\])?|[A-Za-z]{1,5}"
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?\s*([AaPp]\.?[Mm]\.?(?![A-Za-z]))?(?:\s*[Uu]hr)?\s*(" + _ZONE + r")?"
_TAIL = r"(?:(?:,?\s+(?:at\s+)?|,)" + _TIME + r")?$"
_DAYNAME = r"(?:[A-Za-z]{3,9}\.?,\s*)?"
#: Shape, pattern and the group each of year, month, day, hour, minute, second, fraction, am/pm, zone is in.
_SHAPES = [
    ("iso", r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?:(?:[Tt]|\s+)" + _TIME + r")?$", "1 2 3 4 5 6 7 8 9"),
    ("compact", r"^(\d{4})(\d{2})(\d{2})(?:[Tt\s](\d{2}):?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?()\s*(" + _ZONE + r")?)?$", "1 2 3 4 5 6 7 8 9"),
    ("dotted", r"^(\d{1,2})\.(\d{1,2})\.(\d{4}|\d{2})" + _TAIL, "3 2 1 4 5 6 7 8 9"),
    ("day_month", r"^" + _DAYNAME + r"(\d{1,2})(?:st|nd|rd|th)?[\s-]([A-Za-z]{3,9})\.?,?[\s-](\d{4}|\d{2})" + _TAIL, "3 2 1 4 5 6 7 8 9"),
    ("month_day", r"^" + _DAYNAME + r"([A-Za-z]{3,9})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})" + _TAIL, "3 1 2 4 5 6 7 8 9"),
]
_SLASHED = r"^(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})" + _TAIL
_SEP = "\u0001"


@dataclass(frozen=True)
class Penalties:
    """Costs of a path through a feed's records, in order of receipt."""

    switch: float = 1.0  # another format than the record before
    backward: float = 2.0  # an earlier instant than the record before
    rule: float = 1000.0  # an interpretation that the feed's rules don't name first; more than neighbours can make good


def _fields(s: Column, pattern: str, order: str) -> Column:
    """The nine parts of a text of the given shape as strings, empty where absent."""
    return F.split(F.regexp_replace(s, pattern, _SEP.join(f"${g}" for g in order.split())), _SEP, -1)


def _number(c: Column, kind: str = "int") -> Column:
    return F.when(c == "", F.lit(0).cast(kind)).otherwise(c.try_cast(kind))


def _micros(fraction: Column) -> Column:
    """The first six digits of a decimal fraction; finer ones are cut off."""
    return F.rpad(F.substring(fraction, 1, 6), 6, "0").try_cast("long")


def _local(p: list[Column]) -> Column:
    """Microseconds of the wall clock time in p, as if it were UTC; null for impossible dates and times."""
    month_names = F.create_map(*[x for names in (MONTHS, MONTHS_LONG) for i, m in enumerate(names) if not (names is MONTHS_LONG and m == "may") for x in (F.lit(m), F.lit(i + 1))], F.lit("sept"), F.lit(9))
    year = F.when(F.length(p[0]) == 2, p[0].try_cast("int") + 2000).otherwise(p[0].try_cast("int"))
    month = F.coalesce(p[1].try_cast("int"), month_names[F.lower(p[1])])
    half = F.lower(F.substring(p[7], 1, 1))
    h = _number(p[3])
    hour = F.when(half == "", h).when(h.between(1, 12), F.pmod(h, F.lit(12)) + F.when(half == "p", 12).otherwise(0))
    whole = F.try_make_timestamp(year, month, p[2].try_cast("int"), hour, _number(p[4]), _number(p[5], "decimal(16,6)"), F.lit("UTC"))
    return F.unix_micros(whole) + F.when(p[6] == "", F.lit(0).cast("long")).otherwise(_micros(p[6]))


def _instants(local: Column, off: Column, zone: Column, whole_day: Column) -> tuple[Column, Column]:
    """The instant of a local time, and the later one where it occurs twice; null where the clock skipped it."""
    wall = F.timestamp_micros(local)
    utc = F.to_utc_timestamp(wall, zone)
    us = F.unix_micros(utc)
    exists = (F.from_utc_timestamp(utc, zone) == wall) | whole_day
    # Where the clock is set back within three hours, the same wall clock time may come again.
    in_3h = us + 3 * 3_600_000_000
    set_back = F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(in_3h), zone)) - in_3h < local - us
    later = F.coalesce(*[F.when(F.from_utc_timestamp(F.timestamp_micros(us + m * 60_000_000), zone) == wall, us + m * 60_000_000) for m in (60, 30, 120)])
    return F.when(off.isNotNull(), local - off * 1_000_000).when(exists, us), F.when(off.isNull() & exists & set_back, later)


def interpreted(df: DataFrame, stamp: str, zone: str, date_order: str, out: str = "readings", penalties: Penalties = Penalties()) -> DataFrame:
    """df with all valid interpretations of a stamp as array of (fmt string, utc_us long, cost double); empty if there is none.

    Digits alone are an epoch time in seconds, milli-, micro- or nanoseconds (a fraction
    may follow); the unit that fits their number (up to 11, 14, 17, more) costs nothing,
    the others break a rule. Eight digits are a date. A slashed date that doesn't start
    with the year is read both ways; against the feed's date_order at the cost of a broken
    rule, at none where that is null. A local time that occurs twice gives both instants,
    the later one at that cost; one that the clock skipped gives none. So do abbreviations
    that stand for two zones. A stamp that states no instant by the rules has no
    interpretation that breaks one.

    The steps are columns of their own, each made once: shape, fields, wall clock time,
    zone, instants.
    """
    c = {x: F.col(f"__{x}") for x in ("s", "shape", "p", "local", "swapped", "off", "also", "zoned", "token")}
    x = df.withColumn("__s", F.regexp_replace(F.col(stamp), r"^[\s ﻿]+|[\s ﻿]+$", ""))
    shape = F.when(c["s"].rlike(r"^\d+(\.\d+)?$") & ~c["s"].rlike(r"^\d{8}$"), "epoch")
    for name, pattern, _ in _SHAPES:
        shape = shape.when(c["s"].rlike(pattern), name)
    x = x.withColumn("__shape", shape.when(c["s"].rlike(_SLASHED), "slash"))
    fields = F.when(c["shape"] == "slash", _fields(c["s"], _SLASHED, "3 1 2 4 5 6 7 8 9"))
    for name, pattern, groups in _SHAPES:
        fields = fields.when(c["shape"] == name, _fields(c["s"], pattern, groups))
    x = x.withColumn("__p", fields)
    p = [c["p"][k] for k in range(9)]
    swapped = [p[0], p[2], p[1], *p[3:]]
    x = x.withColumns({"__local": _local(p), "__swapped": F.when(c["shape"] == "slash", _local(swapped)), "__token": F.upper(F.regexp_replace(p[8], r"\[[^\]]*\]$", ""))})
    offset_at = r"^(?:UTC|GMT)?\s?([+-])(\d{1,2}):?(\d{2})?$"
    hours = lambda table: F.create_map(*[v for k, h in table.items() for v in (F.lit(k), F.lit(int(h * 3600)))])[c["token"]].cast("long")
    stated = F.when(F.regexp_extract(c["token"], offset_at, 1) == "-", -1).otherwise(1) * (F.regexp_extract(c["token"], offset_at, 2).cast("long") * 3600 + _number(F.regexp_extract(c["token"], offset_at, 3)) * 60)
    names = F.create_map(*[v for k, z in LOCAL_NAMES.items() for v in (F.lit(k), F.lit(z))])
    named = F.when(c["token"] == "", F.col(zone)).when(c["token"].contains("/"), F.regexp_replace(p[8], r"\[[^\]]*\]$", "")).otherwise(names[c["token"]])
    x = x.withColumns({"__off": F.when(c["token"].rlike(offset_at), stated).otherwise(hours(ABBREVIATIONS)), "__also": hours(ALSO), "__zoned": named})
    known = sorted(z for z in available_timezones() if "/" in z or z == "UTC")
    x = x.withColumn("__zoned", F.when(c["zoned"].isin(known), c["zoned"]))
    day = p[3] == ""
    (first, later), (first2, later2) = _instants(c["local"], c["off"], c["zoned"], day), _instants(c["swapped"], c["off"], c["zoned"], day)
    digits, fraction = F.regexp_extract(c["s"], r"^(\d+)", 1), F.regexp_extract(c["s"], r"^\d+\.(\d+)$", 1)
    n = F.length(digits)
    units = [("epoch_s", 6, n <= 11), ("epoch_ms", 3, (n > 11) & (n <= 14)), ("epoch_us", 0, (n > 14) & (n <= 17)), ("epoch_ns", -3, n > 17)]
    micros = {unit: F.when(c["shape"] == "epoch", F.when(n + shift > 0, F.rpad(F.concat(digits, fraction), n + shift, "0").try_cast("long")).otherwise(F.lit(0).cast("long"))) for unit, shift, _ in units}
    x = x.withColumns({"__u1": first, "__u2": later, "__v1": first2, "__v2": later2, **{f"__{unit}": us for unit, us in micros.items()}})
    order, rule = F.upper(F.trim(F.col(date_order))), penalties.rule
    # Without a (readable) order a slashed date may be either.
    order = F.when(order.isin("MDY", "DMY"), order)
    against = lambda declared: F.when(order != declared, F.lit(rule)).otherwise(F.lit(0.0))
    fmt = F.when(c["shape"] == "slash", "slash_mdy").otherwise(c["shape"])
    base = F.when(c["shape"] == "slash", against("MDY")).otherwise(F.lit(0.0))
    one = lambda fmt, us, cost: F.when(us.isNotNull(), F.struct(fmt.alias("fmt"), us.alias("utc_us"), cost.alias("cost")))
    dmy, cost = F.lit("slash_dmy"), against("DMY")
    readings = [
        one(fmt, F.col("__u1"), base),
        one(fmt, F.col("__u2"), base + rule),
        one(dmy, F.col("__v1"), cost),
        one(dmy, F.col("__v2"), cost + rule),
        one(fmt, F.when(c["also"].isNotNull(), c["local"] - c["also"] * 1_000_000), base + rule),
        *[one(F.lit(unit), F.col(f"__{unit}"), F.when(fits, F.lit(0.0)).otherwise(F.lit(rule))) for unit, _, fits in units],
    ]
    # What breaks a rule is a reading only beside one that keeps it: by the rules alone the stamp must state an instant.
    slash = c["shape"] == "slash"
    kept = F.coalesce(F.when(~slash | order.isNull() | (order == "MDY"), F.col("__u1")), F.when(slash & (order.isNull() | (order == "DMY")), F.col("__v1")), *[F.when(fits, F.col(f"__{unit}")) for unit, _, fits in units])
    made = [f"__{k}" for k in ("s", "shape", "p", "local", "swapped", "token", "off", "also", "zoned", "u1", "u2", "v1", "v2", *[u for u, _, _ in units])]
    return x.withColumn(out, F.array_compact(F.array(*[F.when(kept.isNotNull(), r) for r in readings]))).drop(*made)


def _step(prev: tuple, nxt: tuple, p: Penalties) -> np.ndarray:
    """Costs from every candidate of one record to every candidate of the next."""
    (pf, pu), (nf, nu) = prev, nxt
    return p.switch * (pf[:, None] != nf[None, :]) + p.backward * (pu[:, None] > nu[None, :])


class _Run:
    """Candidates of consecutive records of one feed: formats, instants, costs."""

    def __init__(self, fmt, us, cost):
        self.states = [(np.asarray(f), np.asarray(u, dtype=np.int64)) for f, u in zip(fmt, us)]
        self.cost = [np.asarray(c, dtype=float) for c in cost]

    def table(self, p: Penalties) -> np.ndarray:
        """Least cost from each candidate of the first record to each of the last (min-plus product along the run)."""
        m = np.where(np.eye(len(self.cost[0])) > 0, self.cost[0][None, :], np.inf)
        for i in range(1, len(self.cost)):
            m = (m[:, :, None] + _step(self.states[i - 1], self.states[i], p)[None, :, :]).min(axis=1) + self.cost[i][None, :]
        return m

    def best(self, p: Penalties, first: int | None, last: int | None) -> list[int]:
        """Viterbi: the cheapest candidate of every record, with those at the ends given or free. Ties go to the candidate named first."""
        keep = lambda c, k: c if k is None else np.where(np.arange(len(c)) == k, c, np.inf)
        costs = list(self.cost)
        costs[0] = keep(costs[0], first)
        costs[-1] = keep(costs[-1], last)
        v, back = costs[0], []
        for i in range(1, len(costs)):
            t = v[:, None] + _step(self.states[i - 1], self.states[i], p)
            back.append(t.argmin(axis=0))
            v = t.min(axis=0) + costs[i]
        k = int(v.argmin())
        out = [k]
        for b in reversed(back):
            k = int(b[k])
            out.append(k)
        return out[::-1]


_BLOCK = "__feed string, __part int, ff array<string>, fu array<long>, lf array<string>, lu array<long>, m array<double>"
_ENDS = "__feed string, __part int, a int, b int"


class _Chain:
    """The tables of consecutive blocks of a feed: least costs between the candidates of each block's first and last record."""

    def __init__(self, pdf: pd.DataFrame, p: Penalties):
        self.pdf, self.p = pdf.sort_values("__part"), p
        self.first = [(np.asarray(f), np.asarray(u, dtype=np.int64)) for f, u in zip(self.pdf["ff"], self.pdf["fu"])]
        self.last = [(np.asarray(f), np.asarray(u, dtype=np.int64)) for f, u in zip(self.pdf["lf"], self.pdf["lu"])]
        self.tables = [np.asarray(m, dtype=float).reshape(len(f[1]), len(g[1])) for m, f, g in zip(self.pdf["m"], self.first, self.last)]

    def joined(self, part: int) -> pd.DataFrame:
        """All of them as one block: the min-plus product of their tables and of the steps between them."""
        m = self.tables[0]
        for i in range(1, len(self.tables)):
            step = _step(self.last[i - 1], self.first[i], self.p)
            m = (m[:, :, None] + step[None, :, :]).min(axis=1)
            m = (m[:, :, None] + self.tables[i][None, :, :]).min(axis=1)
        row = [self.pdf["__feed"].iloc[0], part, list(self.first[0][0]), self.first[0][1], list(self.last[-1][0]), self.last[-1][1], m.ravel()]
        return pd.DataFrame([row], columns=["__feed", "__part", "ff", "fu", "lf", "lu", "m"])

    def ends(self, a: int | None = None, b: int | None = None) -> pd.DataFrame:
        """The candidates at both ends of every block on the cheapest path, between the given ones (or any) at the outer ends."""
        at = lambda v, k: v if k is None else np.where(np.arange(len(v)) == k, v, np.inf)
        v, back = at(np.zeros(len(self.first[0][1])), a), []
        for i, m in enumerate(self.tables):
            t = v[:, None] + m
            into, v = t.argmin(axis=0), t.min(axis=0)
            after = None
            if i + 1 < len(self.tables):
                t = v[:, None] + _step(self.last[i], self.first[i + 1], self.p)
                after, v = t.argmin(axis=0), t.min(axis=0)
            back.append((into, after))
        j = int(at(v, b).argmin())
        out = []
        for i in range(len(self.tables) - 1, -1, -1):
            k = int(back[i][0][j])
            out.append((k, j))
            if i:
                j = int(back[i - 1][1][k])
        out.reverse()
        return pd.DataFrame({"__feed": self.pdf["__feed"].to_numpy(), "__part": self.pdf["__part"].to_numpy(), "a": [e[0] for e in out], "b": [e[1] for e in out]})


def _block_ends(blocks: DataFrame, n: int, p: Penalties) -> DataFrame:
    """For each block (n of them at most in a feed), the candidates at its ends on the feed's cheapest path: blocks are joined by FAN to a level until FAN are left, and what is chosen there is handed down."""
    if n <= FAN:
        return blocks.groupBy("__feed").applyInPandas(lambda pdf: _Chain(pdf, p).ends(), _ENDS)
    fan = FAN
    above = F.expr(f"__part div {fan}").cast("int").alias("__up")
    joined = cut(blocks.groupBy("__feed", above).applyInPandas(lambda pdf: _Chain(pdf, p).joined(int(pdf["__part"].iloc[0]) // fan), _BLOCK))
    given = _block_ends(joined, -(-n // fan), p).select(F.coalesce("__feed", F.lit("\0")).alias("f"), F.col("__part").alias("u"), "a", "b")
    down = blocks.groupBy(F.coalesce("__feed", F.lit("\0")).alias("f"), above.alias("u")).cogroup(given.groupBy("f", "u"))
    return down.applyInPandas(lambda pdf, up: _Chain(pdf, p).ends(int(up["a"].iloc[0]), int(up["b"].iloc[0])), _ENDS)


def normalise_timestamps(
    df: DataFrame,
    feeds: DataFrame,
    *,
    key: str = "rec_id",
    feed: str = "feed",
    stamps: tuple[str, ...] = ("published_at", "timestamp"),
    received: str = "received_at",
    zone: str = "zone",
    date_order: str = "date_order",
    penalties: Penalties = Penalties(),
) -> DataFrame:
    """key, feed, fmt, utc_us (long), instant (timestamp), readings (valid interpretations): one row per record whose stamp states an instant.

    The stamp is the first of `stamps` that isn't null. All valid interpretations of it
    are generated as an array; a Viterbi path through each feed's records, in order of
    receipt (then key), chooses among them: changing the format or going back in time
    costs, and departing from the feed's declared rules costs more than any neighbours
    could make good. So where a feed declares its rules they decide, on the path like all
    else; where it declares none, its records are read by their neighbours.

    A feed is not one task: records are range-partitioned by feed, receipt and key into
    blocks of bounded size. Each block gives the least cost between the candidates of its
    first and last record (a min-plus table of a few numbers); tables of consecutive
    blocks are joined, level by level, and each block then finds its own part of the path
    between the ends that are handed down to it. The path is the same as that of one pass
    over the whole feed.

    Records with a null key are kept, ordered last among equals. Without a (known) feed or
    zone, only stamps with a zone of their own and epoch times state an instant, and
    slashed dates are read either way. Null, blank and impossible stamps give no row;
    equal rows give a row each. Records with null receipt come first in their feed. Empty
    tables give no rows; extra columns are ignored.
    """
    known = feeds.select(F.col(feed).alias("__feed"), F.col(zone).alias("__zone"), F.col(date_order).alias("__order")).filter("__feed is not null").dropDuplicates(["__feed"])
    rows = df.select(F.col(key).alias("__key"), F.col(feed).alias("__feed"), F.col(received).alias("__at"), F.coalesce(*[F.col(c) for c in stamps]).alias("__stamp"))
    rows = rows.filter(blank_to_null(F.col("__stamp")).isNotNull()).join(broadcast_within(known, MAX_BROADCAST_FEEDS), "__feed", "left")
    # Rows without an interpretation are dropped after the cut: a filter before it would have all of them made twice.
    read = interpreted(rows, "__stamp", "__zone", "__order", "__c", penalties)
    kept = cut(read.select("__key", "__feed", "__at", F.size("__c").alias("__n"), F.col("__c.fmt").alias("__fmt"), F.col("__c.utc_us").alias("__us"), F.col("__c.cost").alias("__cost"))).filter("__n > 0")
    spark = df.sparkSession
    ship(spark)
    blocks = max(1, kept.count() // ROWS_PER_BLOCK + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Kept on disk, so that both passes below see the same blocks.
    order = [F.col("__feed").asc_nulls_first(), F.col("__at").asc_nulls_first(), F.col("__key").asc_nulls_last()]
    placed = cut(kept.repartitionByRange(blocks, *order).sortWithinPartitions(*order, "__us").withColumn("__part", F.spark_partition_id()))

    def segments(batches):
        """(feed, rows of that feed) of one block, in order."""
        parts = [b for b in batches if len(b)]
        if parts:
            block = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]
            name = block["__feed"].astype(object).where(block["__feed"].notna(), None).to_numpy()
            part = block["__part"].to_numpy()
            cuts = np.flatnonzero(np.append(True, (name[1:] != name[:-1]) | (part[1:] != part[:-1])))
            for a, b in zip(cuts, np.append(cuts[1:], len(block))):
                yield name[a], block.iloc[a:b]

    def run_of(seg: pd.DataFrame) -> _Run:
        return _Run(seg["__fmt"], seg["__us"], seg["__cost"])

    def tables(batches):
        out = []
        for name, seg in segments(batches):
            at = np.flatnonzero((seg["__us"].str.len() == 1).to_numpy())
            if len(at):
                # A record with one reading fixes the path: only what lies before the first and after the last one is open.
                a, b = run_of(seg.iloc[: at[0] + 1]), run_of(seg.iloc[at[-1] :])
                m = a.table(penalties) + b.table(penalties)
            else:
                a = b = run_of(seg)
                m = a.table(penalties)
            out.append((name, int(seg["__part"].iloc[0]), list(a.states[0][0]), a.states[0][1], list(b.states[-1][0]), b.states[-1][1], m.ravel()))
        if out:
            yield pd.DataFrame(out, columns=["__feed", "__part", "ff", "fu", "lf", "lu", "m"])

    def choose(batches):
        for _, seg in segments(batches):
            pick = _path(seg, int(seg["a"].iloc[0]), int(seg["b"].iloc[0]), penalties)
            # The place of each pick among all candidates of the block.
            count = seg["__us"].str.len().to_numpy()
            flat = np.cumsum(count) - count + pick
            fmt, us = np.concatenate(seg["__fmt"].to_numpy()), np.concatenate(seg["__us"].to_numpy())
            yield pd.DataFrame({"__key": seg["__key"], "__feed": seg["__feed"], "__fmt": fmt[flat], "__us": us[flat].astype(np.int64), "__n": seg["__n"]})

    ends = cut(_block_ends(placed.mapInPandas(tables, _BLOCK), blocks, penalties))
    ends = broadcast_within(ends.select(F.col("__feed").alias("__f"), F.col("__part").alias("__q"), "a", "b"), MAX_BROADCAST_FEEDS)
    kinds = dict(placed.dtypes)
    bounded = placed.join(ends, F.col("__feed").eqNullSafe(F.col("__f")) & (F.col("__part") == F.col("__q"))).select(*placed.columns, "a", "b")
    bounded = bounded.sortWithinPartitions("__part", *order, "__us")
    done = bounded.mapInPandas(choose, f"__key {kinds['__key']}, __feed string, __fmt string, __us long, __n int")
    return done.select(F.col("__key").alias(key), F.col("__feed").alias(feed), F.col("__fmt").alias("fmt"), F.col("__us").alias("utc_us"), F.timestamp_micros("__us").alias("instant"), F.col("__n").alias("readings"))


def _path(seg: pd.DataFrame, first: int, last: int, p: Penalties) -> np.ndarray:
    """The candidate of each record of a block on the cheapest path between given ends."""
    n = len(seg)
    count = seg["__us"].str.len().to_numpy()
    pick = np.zeros(n, dtype=np.int64)
    pick[0], pick[-1] = first, last
    fixed = count == 1
    fixed[0] = fixed[-1] = True
    # Records between two fixed ones are open by themselves: all of them at once.
    alone = np.flatnonzero(~fixed[1:-1] & fixed[:-2] & fixed[2:]) + 1
    if len(alone):
        starts = np.cumsum(count) - count
        fmt, us, cost = (np.concatenate(seg[c].to_numpy()) for c in ("__fmt", "__us", "__cost"))
        size = count[alone]
        at = np.repeat(starts[alone] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        before, after = (np.repeat(starts[alone + d] + pick[alone + d], size) for d in (-1, 1))
        total = cost[at] + p.switch * ((fmt[at] != fmt[before]).astype(float) + (fmt[at] != fmt[after])) + p.backward * ((us[before] > us[at]).astype(float) + (us[at] > us[after]))
        least = np.minimum.reduceat(total, np.cumsum(size) - size)
        best = np.flatnonzero(total == np.repeat(least, size))
        owner = np.repeat(np.arange(len(alone)), size)[best]
        firsts = np.append(True, owner[1:] != owner[:-1])
        pick[alone] = best[firsts] - (np.cumsum(size) - size)
    rest = ~fixed
    rest[alone] = False
    open_ = np.flatnonzero(rest)
    if len(open_):
        # Each longer stretch of open records, with the fixed ones on both sides.
        new = np.flatnonzero(np.append(True, np.diff(open_) > 1))
        for s, e in zip(open_[new], np.append(open_[new[1:] - 1], open_[-1])):
            part = seg.iloc[s - 1 : e + 2]
            pick[s - 1 : e + 2] = _Run(part["__fmt"], part["__us"], part["__cost"]).best(p, int(pick[s - 1]), int(pick[e + 1]))
    return pick
