"""Similar word sets within groups: pairs, components and order-dependent removal, in DataFrame operations."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.session import cut


#: Buckets of the word counts that order words: so many numbers, whatever the size of the table.
BUCKETS = 1 << 14


def _rare_first(rows: DataFrame, words: str) -> DataFrame:
    """rows with the words (array<long>) of each in one order for all, rare ones first by the counts of their hash buckets."""
    bucket = lambda w: F.pmod(w, F.lit(BUCKETS)).cast("int")
    found = rows.select(F.explode(F.transform(words, bucket)).alias("b")).groupBy("b").count().collect()
    counts = [0] * BUCKETS
    for b, n in found:
        counts[b] = n
    # One row of BUCKETS numbers.
    table = F.broadcast(rows.sparkSession.createDataFrame([(counts,)], "__counts array<long>"))
    ordered = F.array_sort(F.transform(words, lambda w: F.struct(F.get("__counts", bucket(w)), w.alias("w"))))
    return rows.crossJoin(table).withColumn(words, F.transform(ordered, lambda x: x["w"])).drop("__counts")


def similar_pairs(df: DataFrame, *, key: str, words: str, similarity: float, within: tuple[str, ...] = ()) -> DataFrame:
    """a, b (keys, a < b), overlap: all pairs of one group whose word sets overlap by at least `similarity`.

    Two sets that reach it share one of the first words of each, when words are ordered
    from rare to common, so only those words meet in a join, within their group. A pair
    comes out where the joined word is the first that both share, and is counted exactly
    there; words travel as 64-bit hashes. Rows without words, or with a null in their
    group, pair with nothing.
    """
    t = Fraction(similarity).limit_denominator(10_000)
    p, q = t.numerator, t.denominator
    groups = [f"__g{i}" for i in range(len(within))]
    rows = df.select(F.col(key).alias("__id"), F.transform(words, lambda w: F.xxhash64(w)).alias("__w"), *[F.col(c).alias(g) for g, c in zip(groups, within)])
    # Used for the counts and for the join.
    rows = cut(rows).filter(F.size("__w") > 0)
    n = F.size("__w")
    prefix = _rare_first(rows, "__w").select("__id", *groups, "__w", F.explode(F.slice("__w", 1, (n - F.ceil(n * p / q) + 1).cast("int"))).alias("__x"))
    a, b = prefix.alias("a"), prefix.alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("__x", *groups)] + [F.col("a.__id") < F.col("b.__id")]
    na, nb = F.size("a.__w"), F.size("b.__w")
    met = a.join(b, on).filter((na * q >= nb * p) & (nb * q >= na * p))
    met = met.select(F.col("a.__id").alias("a"), F.col("b.__id").alias("b"), F.col("a.__x").alias("__x"), (na + nb).alias("__n"), F.array_intersect("a.__w", "b.__w").alias("__both"))
    both = F.size("__both")
    return met.filter((F.get("__both", F.lit(0)) == F.col("__x")) & (both * (p + q) >= F.col("__n") * p)).select("a", "b", (both / (F.col("__n") - both)).alias("overlap"))


def components(nodes: DataFrame, pairs: DataFrame, *, key: str) -> DataFrame:
    """key, component: the least key each node is connected to. Labels spread along pairs and jump to the labels of labels, so rounds grow with the logarithm of the longest path; only nodes that have a pair take part in them."""
    ways = pairs.select(F.explode(F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("w"))
    both = cut(ways.select("w.a", "w.b").distinct())
    labels = cut(both.select(F.col("a").alias("n")).distinct().withColumn("l", F.col("n")))
    open_ = not labels.isEmpty()
    while open_:
        seen = both.join(labels, both["b"] == labels["n"]).groupBy("a").agg(F.min("l").alias("m"))
        spread = labels.join(seen, labels["n"] == seen["a"], "left").select("n", "l", F.least("l", F.coalesce("m", "l")).alias("m"))
        jump = labels.select(F.col("n").alias("m"), F.col("l").alias("j"))
        nxt = cut(spread.join(jump, "m").select("n", "l", F.least("m", "j").alias("x")))
        open_ = not nxt.filter("l <> x").isEmpty()
        labels = nxt.select("n", F.col("x").alias("l"))
    return nodes.select(F.col(key).alias("k")).join(labels, F.col("k") == F.col("n"), "left").select(F.col("k").alias(key), F.coalesce("l", "k").alias("component"))


def first_come(nodes: DataFrame, pairs: DataFrame, *, key: str) -> DataFrame:
    """key, kept: rows in order of key, each kept unless it pairs with a row kept before. A row is settled once all rows before it that it pairs with are; each round settles at least the first open row of every connected group."""
    open_ = cut(pairs.select(F.least("a", "b").alias("e"), F.greatest("a", "b").alias("l")).distinct())
    out = nodes.select(F.col(key).alias("n")).limit(0)
    dropped = out
    while not open_.isEmpty():
        free = open_.select(F.col("e").alias("n")).distinct().join(open_.select(F.col("l").alias("n")).distinct(), "n", "left_anti")
        gone = cut(open_.join(free, open_["e"] == free["n"], "left_semi").select(F.col("l").alias("n")).distinct())
        dropped = dropped.unionByName(gone)
        kept = free.select(F.col("n").alias("k"))
        rest = open_.join(kept, open_["e"] == kept["k"], "left_anti")
        # A dropped row removes nothing and need not be settled again.
        open_ = cut(rest.join(gone, rest["e"] == gone["n"], "left_anti").join(gone, rest["l"] == gone["n"], "left_anti"))
    d = dropped.distinct().withColumn("d", F.lit(True))
    return nodes.select(F.col(key).alias("n")).join(d, "n", "left").select(F.col("n").alias(key), F.col("d").isNull().alias("kept"))
