"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotemill.llm.bpe import DEFAULT_VOCABULARY, count_tokens
from quotemill.session import broadcast_within, cut

#: Sources whose shares are broadcast; of more, both sides are shuffled.
MAX_BROADCAST = 10_000
#: Documents of a slice of the shuffled order, which one task adds up. There are as many slices as the documents need.
ROWS_PER_SLICE = 100_000
#: Slices of virtual time by which the cut is narrowed at a time, and the uses around it that are ordered in one task.
SLICES = 1024
EDGE_ROWS = 10_000


def _reach(sources: DataFrame, budget: int) -> float:
    """The virtual time at which the sources, each until it is used up, have given `budget` tokens. One row per source is sorted; only the result reaches the driver."""
    by_end = Window.orderBy("end", "source")
    rest = F.sum("share").over(by_end.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    spent = F.coalesce(F.sum(F.col("end") * F.col("share")).over(by_end.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    # What is given by the end of each source: what the earlier ones had, and the others' share of the time.
    timed = sources.withColumn("end", F.col("tokens") * F.col("repeats") / F.col("share")).select("end", "source", rest.alias("rest"), spent.alias("spent"))
    open_ = timed.filter(F.col("spent") + F.col("end") * F.col("rest") >= budget)
    at, last = open_.agg(F.min_by((F.lit(float(budget)) - F.col("spent")) / F.col("rest"), F.struct("end", "source"))).first()[0], timed.agg(F.max("end")).first()[0]
    return at if at is not None else last or 0.0


def _edge(rows: DataFrame, budget: int, high: float) -> tuple[DataFrame, int, float, float]:
    """The rows with finish in [low, high) among which the running total of tokens passes the budget, what is left of it there, and the bounds. Slices of virtual time are narrowed until few rows are left, or all that are finish at one time; one total per slice reaches the driver."""
    low, left = 0.0, budget
    while True:
        width = (high - low) / SLICES
        sliced = rows.filter((F.col("finish") >= low) & (F.col("finish") < high)).withColumn("__slice", F.least(F.greatest(F.floor((F.col("finish") - low) / width), F.lit(0)), F.lit(SLICES - 1)).cast("int"))
        found = {r[0]: (int(r[1]), r[2], r[3], r[4]) for r in sliced.groupBy("__slice").agg(F.sum("n_tokens"), F.count("*"), F.min("finish"), F.max("finish")).collect()}
        passed = None
        for k in sorted(found):
            if found[k][0] > left:
                passed = k
                break
            left -= found[k][0]
        if passed is None:
            return rows.limit(0), left, high, high
        _, n, least, most = found[passed]
        later = [found[k][2] for k in sorted(found) if k > passed]
        low, high = least, later[0] if later else max(most * (1 + 1e-15), math.nextafter(most, math.inf))
        if n <= EDGE_ROWS or least == most:
            return sliced.filter(F.col("__slice") == passed).drop("__slice"), left, low, high


def mix_sources(
    documents: DataFrame,
    targets: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    share: str = "target_share",
    max_repeats: str = "max_repeats",
    budget: int | None = None,
    seed: int = 7,
    vocabulary: str = DEFAULT_VOCABULARY,
    token_counts: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The mix and its report.

    Mix: key, source, use (1 to max_repeats), n_tokens, finish; in order of finish. Report:
    source, target_share, max_repeats, n_docs, source_tokens, mixed_tokens, uses,
    most_uses, actual_share, off_target (actual less target share: what sources that have
    nothing leave to the others), sets_budget (without a given budget: the source that is
    used up first and so bounds the mix), one row for every target.

    Each document of a source comes at a pseudo-random place given by its key and the seed.
    Its virtual finish time is the running total of tokens of its source, all earlier uses
    of the source included, divided by the target share: a source of twice the share
    passes through twice the tokens in the same virtual time. The mix is what finishes
    first, up to `budget` tokens in all; the document that would exceed it and all later
    ones are left out. Without a budget it is the largest one at which every source that
    has any tokens still meets its share; beyond it, a source that has been used
    max_repeats times gives no more and the others take its place in proportion.

    No source is one task: running totals are totals of slices of the shuffled order plus
    those within a slice, and slices hold about ROWS_PER_SLICE documents whatever the size
    of a source. The cut is found by totals of slices of virtual time, narrowed until
    about EDGE_ROWS uses are left to be ordered one by one. Sources are rows of a table,
    of any number.

    Documents without tokens have nothing to give and are left out, as are those of null or
    unlisted sources. Targets with a null source, no positive share or no positive
    max_repeats give nothing and are reported with 0. Repeated rows are separate documents,
    ordered by key and size. If a source is listed twice, the larger share counts. Empty
    tables give an empty mix. token_counts (key, source, n_tokens) spares the counting.
    """
    spark = documents.sparkSession
    listed = targets.select(F.col(source).alias("source"), F.col(share).cast("double").alias("share"), F.col(max_repeats).cast("int").alias("repeats"))
    usable = listed.filter("source is not null and share > 0 and repeats > 0").groupBy("source").agg(F.max_by("repeats", "share").alias("repeats"), F.max("share").alias("share"))
    if token_counts is None:
        token_counts = count_tokens(documents.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("text")).join(broadcast_within(usable.select("source"), MAX_BROADCAST), "source", "left_semi"), vocabulary=vocabulary)
    else:
        token_counts = token_counts.select(F.col(key).alias("key"), F.col(source).alias("source"), "n_tokens").join(broadcast_within(usable.select("source"), MAX_BROADCAST), "source", "left_semi")
    place = F.xxhash64(F.col("key"), F.lit(seed))
    sized = cut(token_counts.filter("n_tokens > 0").withColumn("place", place))
    n_docs, longest = sized.agg(F.count("*"), F.max("n_tokens")).first()
    bits = max(1, (n_docs // ROWS_PER_SLICE).bit_length())
    sized = sized.withColumn("slice", F.shiftrightunsigned("place", 64 - bits).cast("int"))

    # One row per source and slice: what came before each slice, and the whole source.
    slices = sized.groupBy("source", "slice").agg(F.sum("n_tokens").alias("size"), F.count("*").alias("docs"))
    whole = Window.partitionBy("source")
    before = slices.select("source", "slice", F.coalesce(F.sum("size").over(whole.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("size").over(whole).alias("total"), F.sum("docs").over(whole).alias("n_docs"))
    before = cut(before.join(broadcast_within(usable, MAX_BROADCAST), "source"))
    sources = cut(before.groupBy("source").agg(F.first("total").alias("tokens"), F.first("share").alias("share"), F.first("repeats").alias("repeats"), F.first("n_docs").alias("n_docs")))
    capacity = F.col("tokens") * F.col("repeats") / F.col("share")
    least, shares, n_sources, first_out = sources.agg(F.min(capacity), F.sum("share"), F.count("*"), F.min_by("source", F.struct(capacity, "source"))).first()
    given = budget is not None
    if not given:
        budget = int((least or 0) * (shares or 0) + 1e-6)
    # A document counts as it finishes, so at this time the budget is reached but for one unfinished document of each source.
    high = _reach(sources, budget) + n_sources * (longest or 0) / max(shares or 0.0, 1e-12) + 1.0

    within = Window.partitionBy("source", "slice").orderBy("place", "key", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    placed = sized.join(before.drop("n_docs"), ["source", "slice"]).withColumn("upto", F.col("before") + F.sum("n_tokens").over(within))
    uses = F.least(F.col("repeats"), F.floor(F.lit(high) * F.col("share") / F.col("total")).cast("int") + 1)
    queued = placed.withColumn("use", F.explode(F.sequence(F.lit(1), uses))).withColumn("finish", ((F.col("use") - 1) * F.col("total") + F.col("upto")) / F.col("share"))
    queued = queued.filter(F.col("finish") < high).select("key", "source", "use", "n_tokens", "finish")

    edge, left, lo, hi = _edge(queued, budget, high)
    if lo < high:
        # Their order decides which of them still fit.
        order = Window.partitionBy(F.lit(0)).orderBy("finish", "source", "key", "use", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
        last = edge.withColumn("run", F.sum("n_tokens").over(order)).filter(F.col("run") <= left).drop("run")
        mix = queued.filter(F.col("finish") < lo).unionByName(last)
    else:
        mix = queued
    mix = cut(mix)
    taken = mix.groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"), F.count("*").alias("uses"), F.max("use").alias("most_uses"))
    total = sum(r[0] or 0 for r in taken.agg(F.sum("mixed_tokens")).collect())
    zero = lambda c: F.coalesce(c, F.lit(0))
    report = (
        listed.join(sources.select("source", "tokens", "n_docs"), "source", "left")
        .join(taken, "source", "left")
        .select(
            "source",
            F.col("share").alias("target_share"),
            F.col("repeats").alias("max_repeats"),
            zero(F.col("n_docs")).alias("n_docs"),
            zero(F.col("tokens")).alias("source_tokens"),
            zero(F.col("mixed_tokens")).alias("mixed_tokens"),
            zero(F.col("uses")).alias("uses"),
            zero(F.col("most_uses")).alias("most_uses"),
            (zero(F.col("mixed_tokens")) / F.lit(float(max(total, 1)))).alias("actual_share"),
            (zero(F.col("mixed_tokens")) / F.lit(float(max(total, 1))) - F.coalesce("share", F.lit(0.0))).alias("off_target"),
            F.coalesce(F.lit(not given) & (F.col("source") == F.lit(first_out)), F.lit(False)).alias("sets_budget"),
        )
    )
    out = mix.select(F.col("key").alias(key), F.col("source").alias(source), "use", "n_tokens", "finish")
    return out.orderBy("finish", source, key, "use"), report
