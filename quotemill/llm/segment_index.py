"""Checking new batches against all history with a segment index for bounded edit distance."""

from __future__ import annotations

from dataclasses import dataclass, replace
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.functions.columns import blank_to_null
from quotemill.llm.wordsets import as_fraction, bucket_counts, flat, overlap_at_least, rare_first, shared, word_hashes, wide_set_id
from quotemill.session import cut, listed, remove, ship, touch

#: Rows of a slot of the index when it is built. The number of slots grows with the history, so that what a batch of a given size reads doesn't.
ROWS_PER_SLOT = 1_000_000
#: Slots are folders; beyond so many they grow instead.
MAX_SLOTS = 4096
#: From so many slots on, a batch looks for those that it touches; fewer are read whole.
PRUNE_FROM = 64
#: Rows of a batch that are broadcast to the stored rows of the slots they touch; of larger batches both sides are shuffled.
MAX_BROADCAST = 1_000_000
#: Rows of waiting batches that are taken together: the start of the jobs of a small batch costs more than what they do.
ROWS_AT_ONCE = 10_000
#: New rows that one task settles in their order; more are settled in rounds over all tasks, with the same result.
MAX_IN_ORDER = 50_000

SID = "struct<a: long, b: long>"
#: What is kept of all accepted articles, each table in folders batch=.../kind=.../slot=...
TABLES = {"sets": f"sid {SID}, words array<long>", "segments": f"sid {SID}, seg long, pos int, len int, rest boolean", "keys": "key string"}

_URL = r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?([^/?#\s]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def page_url(url: Column, keep: tuple[str, ...] = ("id", "p")) -> Column:
    """url without what doesn't change the page: scheme, case of the host, a leading www., a final slash of the path, fragment, and query parameters other than `keep`. Null for null, empty and blank."""
    u = F.trim(blank_to_null(url))
    host = F.regexp_replace(F.lower(F.regexp_extract(u, _URL, 1)), r"^www\.", "")
    path = F.regexp_replace(F.trim(F.regexp_extract(u, _URL, 2)), "/$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(u, _URL, 3), "&"), lambda x: x.rlike(f"^(?:{'|'.join(keep)})(?:=|$)")))
    return F.when(u.isNotNull(), F.concat_ws("?", F.concat(host, path), F.when(F.size(query) > 0, F.array_join(query, "&"))))


def edits(len_a, len_b, t: Fraction):
    """Most words by which two sets with an overlap of at least t can differ: the bound on the edit distance of their sorted words."""
    p, q = t.numerator, t.denominator
    return ((len_a + len_b) * (q - p)) // (q + p)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h.astype(np.uint64)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _suffix_sums(words: np.ndarray, row: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each word, a hash of the words from it to the end of its row (words of a row are in one fixed order)."""
    if not len(words):
        return words.astype(np.uint64)
    total = np.cumsum(_mix(words), dtype=np.uint64)
    ends = np.cumsum(lengths)
    return total[np.repeat(ends - 1, lengths)] - total + _mix(words)


def stored_segments(words: np.ndarray, lengths: np.ndarray, counts: np.ndarray, t: Fraction) -> dict[str, np.ndarray]:
    """Segments under which each set is stored.

    A set of n words in rare-first order is a string over words, cut into e + 1 segments,
    where e is the most edits that any partner may need: e segments of one word, the
    rarest, and one of all that remain. Whatever e words are deleted, one segment is left
    whole. Each is stored with its position and the length of its set.
    """
    w, row, pos, _ = rare_first(words, lengths, counts)
    n = lengths[row]
    # The longest partner has n / t words.
    most = edits(n, n * t.denominator // t.numerator, t)
    single, rest = pos < most, pos == most
    tail = _suffix_sums(w, row, lengths)
    seg = np.where(single, w.astype(np.int64), _mix(tail + np.uint64(0x9E3779B97F4A7C15)).view(np.int64))
    keep = single | rest
    return {"row": row[keep], "seg": seg[keep], "pos": pos[keep], "len": n[keep], "rest": rest[keep]}


def _tails(n: int, t: Fraction) -> np.ndarray:
    """Positions in a set of n words from which on it may equal the remainder of a partner within the bound."""
    p, q = t.numerator, t.denominator
    m = np.arange(-(-n * p // q), n * q // p + 1)
    gone = edits(m, m * q // p, t)
    # A stored set of m words with its first `gone` deleted equals the last m - gone words.
    pos = n - m + gone
    return np.unique(pos[(pos >= 0) & (pos < n) & (gone + pos <= edits(m, n, t))])


def probed_segments(words: np.ndarray, lengths: np.ndarray, counts: np.ndarray, t: Fraction) -> dict[str, np.ndarray]:
    """Substrings of each new set that may equal a stored segment: its rarest words one by one, and its ends of the lengths that a remainder of a partner can have within the bound."""
    w, row, pos, _ = rare_first(words, lengths, counts)
    n = lengths[row]
    most = edits(n, n * t.denominator // t.numerator, t)
    single = pos <= most
    tail = _mix(_suffix_sums(w, row, lengths) + np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
    starts = np.cumsum(lengths) - lengths
    at = [np.add.outer(starts[lengths == k], _tails(int(k), t)).ravel() for k in np.unique(lengths) if k]
    at = np.concatenate(at) if at else np.empty(0, np.int64)
    both = lambda x, y: np.concatenate([x[single], y[at]])
    return {"row": both(row, row), "seg": both(w, tail), "pos": both(pos, pos), "len": both(n, n), "rest": np.concatenate([np.zeros(single.sum(), dtype=bool), np.ones(len(at), dtype=bool)])}


def _segments(sets: DataFrame, counts: np.ndarray, t: Fraction, cutter) -> DataFrame:
    def run(batches):
        for b in batches:
            words, lengths = flat(b.column("words"))
            s = cutter(words, lengths, counts, t)
            sid = b.column("sid").take(pa.array(s["row"]))
            yield pa.RecordBatch.from_arrays([sid, pa.array(s["seg"].astype(np.int64)), pa.array(s["pos"].astype(np.int32)), pa.array(s["len"].astype(np.int32)), pa.array(s["rest"])], names=["sid", "seg", "pos", "len", "rest"])

    return sets.select("sid", "words").mapInArrow(run, f"sid {SID}, seg long, pos int, len int, rest boolean")


def _slot(table: str, slots: int) -> Column:
    h = {"sets": F.col("sid.a"), "segments": F.col("seg"), "keys": F.xxhash64("key")}[table]
    return F.pmod(h, F.lit(slots)).cast("int")


def _met(stored: DataFrame, probes: DataFrame, t: Fraction) -> DataFrame:
    """(sid, other): pairs of a probing and a stored set that share a segment within the bound, each once."""
    p, q = t.numerator, t.denominator
    a, b = stored.alias("a"), probes.alias("b")
    la, lb, pa_, pb = F.col("a.len"), F.col("b.len"), F.col("a.pos"), F.col("b.pos")
    # If this is the first segment that both share, all words before it were deleted or inserted.
    fits = (la * p <= lb * q) & (lb * p <= la * q) & (pa_ + pb <= F.floor((la + lb) * (q - p) / (q + p)))
    on = (F.col("a.seg") == F.col("b.seg")) & (F.col("a.rest") == F.col("b.rest"))
    return a.join(b, on).filter(fits).select(F.col("b.sid").alias("sid"), F.col("a.sid").alias("other")).distinct()


def _verified(pairs: DataFrame, mine: DataFrame, theirs: DataFrame, t: Fraction) -> DataFrame:
    """The pairs (sid, other) whose overlap reaches the bound, by their words."""
    mine = mine.select("sid", F.col("words").alias("__mine"))
    theirs = theirs.select(F.col("sid").alias("other"), F.col("words").alias("__theirs"))
    return pairs.join(mine, "sid").join(theirs, "other").filter(overlap_at_least(shared("__mine", "__theirs"), F.size("__mine"), F.size("__theirs"), t)).select("sid", "other")


@dataclass(frozen=True)
class SegmentIndex:
    """The word sets of all accepted articles, the segments of those, and their keys, in a shared folder.

    Each table lies in slots by the hash of what is looked up (segment, set, key), and a
    batch reads only the slots that it touches, once there are PRUNE_FROM. There it is broadcast to the stored rows,
    which are never shuffled, sorted or rewritten; a batch beyond MAX_BROADCAST rows is
    joined by a shuffle of both. Slots are numbered when the index is built, about
    ROWS_PER_SLOT rows each.

    A batch is written into folders of its own and counts once its mark below `done` is
    there. Appending it again writes the same folders again.
    """

    spark: SparkSession
    path: str
    slots: int
    counts: np.ndarray  # fixes the order of words for the life of the index
    t: Fraction
    batches: tuple[str, ...]  # what is done

    @staticmethod
    def build(accepted: DataFrame, path: str, similarity: float = 0.75, rows_per_slot: int = ROWS_PER_SLOT) -> "SegmentIndex":
        """A new index of the given articles; whatever lies at path is deleted."""
        t = as_fraction(similarity)
        ship(accepted.sparkSession)
        articles = article_keys(accepted)
        sets = cut(distinct_sets(articles))
        counts = bucket_counts(sets)
        segments = cut(_segments(sets, counts, t, stored_segments))
        return SegmentIndex._new(accepted.sparkSession, path, counts, t, rows_per_slot, {"sets": sets, "segments": segments, "keys": one_key_each(articles)})

    @staticmethod
    def _new(spark: SparkSession, path: str, counts: np.ndarray, t: Fraction, rows_per_slot: int, tables: dict[str, DataFrame]) -> "SegmentIndex":
        remove(spark, path)
        slots = min(MAX_SLOTS, 1 << max(0, tables["segments"].count() // rows_per_slot).bit_length())
        order = spark.createDataFrame([(counts.tolist(), t.numerator, t.denominator, slots)], "counts array<long>, p long, q long, slots int")
        order.coalesce(1).write.parquet(f"{path}/order")
        return SegmentIndex(spark, path, slots, counts, t, ())._write("base", tables)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "SegmentIndex":
        ship(spark)
        order = spark.read.parquet(f"{path}/order").first()
        return SegmentIndex(spark, path, order["slots"], np.array(order["counts"], dtype=np.int32), Fraction(order["p"], order["q"]), tuple(listed(spark, f"{path}/done")))

    def _write(self, batch: str, parts: dict[str, DataFrame]) -> "SegmentIndex":
        """Writes the tables of a batch in one go, one file for each kind and slot, and marks it as done."""
        rows = None
        for name, df in parts.items():
            part = df.withColumns({"kind": F.lit(name), "slot": _slot(name, self.slots)})
            rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
        rows.repartition("kind", "slot").write.mode("overwrite").partitionBy("kind", "slot").parquet(f"{self.path}/tables/batch={batch}")
        touch(self.spark, f"{self.path}/done/{batch}")
        return replace(self, batches=tuple(sorted({*self.batches, batch})))

    def table(self, name: str, slots: list[int] | None = None) -> DataFrame:
        """The rows of all batches that are done, of the given slots only."""
        df = self.spark.read.schema(f"{TABLES[name]}, batch string, kind string, slot int").parquet(f"{self.path}/tables")
        df = df.filter(F.col("batch").isin(*self.batches) & (F.col("kind") == name))
        if slots is not None and len(slots) < self.slots:
            df = df.filter(F.col("slot").isin(slots))
        return df.drop("batch", "kind", "slot")

    def _touched(self, name: str, probes: DataFrame, slot: Column, most: int | None = None) -> tuple[DataFrame, DataFrame]:
        """The stored rows of the slots that the probes touch, and the probes, to be broadcast if they are within the bound. most: their number at most, if it is known. No more numbers than slots reach the driver."""
        slots = None
        if self.slots >= PRUNE_FROM:
            most, slots = probes.agg(F.count("*"), F.collect_set(slot)).first()
        elif most is None:
            most = probes.count()
        return self.table(name, slots), F.broadcast(probes) if most <= MAX_BROADCAST else probes

    def near(self, sets: DataFrame, probes: DataFrame | None = None, most: int | None = None) -> DataFrame:
        """(sid, other): pairs of a given set and a stored one, the same or another, whose overlap reaches the bound, each once."""
        if probes is None:
            probes = cut(_segments(sets, self.counts, self.t, probed_segments))
        stored, probing = self._touched("segments", probes, _slot("segments", self.slots), most)
        met = _met(stored, probing, self.t)
        pairs = met.select(F.col("other").alias("sid"), F.col("sid").alias("__mine"))
        if self.slots > 1:
            # Few of them, which are broadcast to the stored sets.
            pairs = cut(pairs)
            words, pairs = self._touched("sets", pairs, _slot("sets", self.slots))
        else:
            words = self.table("sets")
        return _verified(pairs.select(F.col("__mine").alias("sid"), F.col("sid").alias("other")), sets, words, self.t)

    def known_keys(self, keys: DataFrame, most: int | None = None) -> DataFrame:
        """The given keys (column key) that are stored."""
        stored, mine = self._touched("keys", keys, _slot("keys", self.slots), most)
        return stored.join(mine, "key").select("key").distinct()

    def append(self, accepted: DataFrame, batch: str, new: bool = False) -> "SegmentIndex":
        """The index with the sets, segments and keys of newly accepted articles, as far as they aren't stored (new: none of them is, as after `repeats`); only these are cut into segments and written. The same batch may be appended again after a failure."""
        if "/" in batch or batch == "base":
            raise ValueError(f"no name for a batch: {batch}")
        before = replace(self, batches=tuple(b for b in self.batches if b != batch))
        articles = article_keys(accepted)
        sets, keys = distinct_sets(articles), one_key_each(articles)
        if not new:
            stored, mine = before._touched("sets", sets.select("sid"), _slot("sets", self.slots))
            sets = sets.join(stored.join(mine, "sid").select("sid"), "sid", "left_anti")
            stored, mine = before._touched("keys", keys, _slot("keys", self.slots))
            keys = keys.join(stored.join(mine, "key").select("key"), "key", "left_anti")
        return self._write(batch, {"sets": sets, "segments": _segments(sets, self.counts, self.t, stored_segments), "keys": keys})

    def compact(self, path: str) -> "SegmentIndex":
        """The same index at another path, with one file for each slot instead of one for each slot and batch; the slots are numbered anew."""
        return SegmentIndex._new(self.spark, path, self.counts, self.t, ROWS_PER_SLOT, {name: self.table(name) for name in TABLES})


def article_keys(news: DataFrame, *, url: str = "url", provider: str = "provider", article_id: str = "article_id", headline: str = "headline") -> DataFrame:
    """news with words (array<long>), sid (null without words) and keys (array<string> of page url and of provider and article_id)."""
    u, a = page_url(F.col(url)), F.when(blank_to_null(F.col(provider)).isNotNull() & blank_to_null(F.col(article_id)).isNotNull(), F.concat(F.col(provider), F.lit("\u0001"), F.col(article_id)))
    keys = F.filter(F.array(F.concat(F.lit("u\u0001"), u), F.concat(F.lit("a\u0001"), a)), lambda k: k.isNotNull())
    out = news.withColumn("words", word_hashes(F.col(headline))).withColumn("keys", keys)
    return out.withColumn("sid", F.when(F.size("words") > 0, wide_set_id(F.col("words"))))


def distinct_sets(articles: DataFrame) -> DataFrame:
    return articles.filter("sid is not null").select("sid", "words").dropDuplicates(["sid"])


def one_key_each(articles: DataFrame) -> DataFrame:
    return articles.select(F.explode("keys").alias("key")).distinct()


def repeats(index: SegmentIndex, incoming: DataFrame, *, key: str = "news_id", batch: str = "batch_no") -> DataFrame:
    """key, batch, why: the incoming rows that repeat an article accepted before.

    Rows are taken in the order batch, key. A row is a case if an accepted one has its page
    url, its provider and article_id, or a headline with an overlap of at least the
    index's similarity; otherwise it is accepted itself. Any number of batches can be
    given at once: the result is that of one row after the other. why is 'history' where
    an article of the index is repeated, else 'batch'.

    History is only probed: new headlines look up segments, new keys look up keys. Rows
    that history doesn't decide are settled among themselves: up to MAX_IN_ORDER of them
    by one pass in their order, more in rounds, as many as the longest chain of rows that
    each repeat a rejected one. Equal keys and equal headlines are met by their least row,
    never as pairs.

    Null, empty and blank urls, ids, providers and headlines match nothing. Rows with the
    same batch and key are settled alike. Null keys or batches come first. Empty tables
    give no rows; extra columns are ignored.
    """
    rows = article_keys(incoming.select(key, batch, "url", "provider", "article_id", "headline"))
    rows = cut(rows.select(F.struct(F.col(batch).alias("batch"), F.col(key).alias("key")).alias("ord"), "words", "sid", "keys"))
    n, n_words = rows.agg(F.count("*"), F.sum(F.size("words"))).first()
    sets = distinct_sets(rows)
    probes = cut(_segments(sets, index.counts, index.t, probed_segments))
    # A set has no more probes than words and ends.
    old = index.near(sets, probes, 2 * (n_words or 0)).select("sid").distinct().withColumn("old_set", F.lit(True))
    each = rows.select("ord", F.explode("keys").alias("key"))
    old_keys = each.join(index.known_keys(each.select("key").distinct(), 2 * n), "key", "left_semi").select("ord").distinct().withColumn("old_key", F.lit(True))
    met = _met(_segments(sets, index.counts, index.t, stored_segments), probes, index.t).filter("sid <> other")
    around = _verified(met, sets, sets, index.t).groupBy("sid").agg(F.collect_set(_set_key(F.col("other"))).alias("near"))
    none = F.array().cast("array<string>")
    own = F.concat("keys", F.when(F.col("sid").isNotNull(), F.array(_set_key(F.col("sid")))).otherwise(none))
    known = rows.join(old, "sid", "left").join(old_keys, "ord", "left").join(around, "sid", "left")
    known = cut(known.select("ord", own.alias("own"), F.concat(own, F.coalesce("near", none)).alias("heard"), (F.coalesce("old_set", F.lit(False)) | F.coalesce("old_key", F.lit(False))).alias("case")))
    fresh = known.filter("not case").drop("case")
    late = _in_order(fresh) if n <= MAX_IN_ORDER else _in_rounds(fresh)
    name = lambda df, why: df.select(F.col("ord.key").alias(key), F.col("ord.batch").alias(batch), F.lit(why).alias("why"))
    return name(known.filter("case"), "history").unionByName(name(late, "batch"))


def _in_order(fresh: DataFrame) -> DataFrame:
    """ord of the rows (ord, own, heard) that hear an own key of an accepted row with a smaller ord: one pass in one task, for no more than MAX_IN_ORDER rows."""

    def run(batches):
        accepted: set[str] = set()
        now, late, held = None, False, []
        for b in batches:
            hit = []
            ords = b.column("ord").to_pylist()
            for o, own, heard in zip(ords, b.column("own").to_pylist(), b.column("heard").to_pylist()):
                # Rows with the same batch and key don't decide each other.
                if o != now:
                    for k in held:
                        accepted.update(k)
                    now, held = o, []
                late = not accepted.isdisjoint(heard)
                hit.append(late)
                if not late:
                    held.append(own)
            yield pa.RecordBatch.from_arrays([b.column("ord").filter(pa.array(hit, type=pa.bool_()))], names=["ord"])

    return fresh.repartition(1).sortWithinPartitions("ord").mapInArrow(run, f"ord {dict(fresh.dtypes)['ord']}")


def _in_rounds(fresh: DataFrame) -> DataFrame:
    """The same for any number of rows. A row is settled as soon as every earlier row that it could repeat is; each round settles at least the first open row of every group, and all copies of a newly accepted row at once."""
    several = fresh.select("ord", F.explode("own").alias("k")).groupBy("k").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi")).select("k", "lo", "hi")
    touched = fresh.select("ord", F.explode("heard").alias("k")).join(several, "k").filter("lo <> ord or hi <> ord").select("ord").distinct()
    # Only rows that some other new row could decide stay open.
    open_rows = cut(fresh.join(touched, "ord", "left_semi"))
    late = open_rows.select("ord").limit(0)
    rounds = 0
    while not open_rows.isEmpty():
        first = open_rows.select(F.explode("own").alias("k"), "ord").groupBy("k").agg(F.min("ord").alias("o"))
        # A row without keys of its own hears none.
        waits = open_rows.select("ord", F.explode_outer("heard").alias("k")).join(first, "k", "left").groupBy("ord").agg(F.coalesce(F.min("o") < F.col("ord"), F.lit(False)).alias("waits"))
        state = cut(open_rows.join(waits, "ord"))
        # What no earlier open row could still decide is accepted, and what repeats it is a case.
        taken = state.filter("not waits").select(F.explode("own").alias("k"), "ord").groupBy("k").agg(F.min("ord").alias("t"))
        waiting = state.filter("waits")
        hit = waiting.select("ord", F.explode("heard").alias("k")).join(taken, "k").filter("t < ord").select("ord").distinct().withColumn("hit", F.lit(True))
        state = cut(waiting.join(hit, "ord", "left").select("ord", "own", "heard", F.coalesce("hit", F.lit(False)).alias("hit")))
        late = late.unionByName(state.filter("hit").select("ord"))
        rounds += 1
        if rounds % 8 == 0:
            late = cut(late)
        open_rows = state.filter("not hit").select("ord", "own", "heard")
    return late


def _set_key(sid: Column) -> Column:
    return F.concat(F.lit("s\u0001"), sid.cast("string"))


def accept_batches(index: SegmentIndex, incoming: DataFrame, *, key: str = "news_id", batch: str = "batch_no") -> DataFrame:
    """key, batch, why: repeats of one batch after the other, as they would arrive. Each batch probes the stored index, its cases are kept, and what it adds is appended before the next one comes. Batches are taken in order, null first; waiting ones that are small go together, up to ROWS_AT_ONCE rows, which changes no result. Of an empty table the result is empty."""
    waiting = incoming.groupBy(batch).count().orderBy(F.col(batch).asc_nulls_first()).collect()
    groups: list[list] = []
    size = 0
    for b, n in waiting:
        if not groups or size + n > ROWS_AT_ONCE:
            groups.append([])
            size = 0
        groups[-1].append(b)
        size += n
    cases = None
    for group in groups:
        known = [b for b in group if b is not None]
        rows = incoming.filter(F.col(batch).isin(known) | (F.col(batch).isNull() & F.lit(None in group)))
        found = cut(repeats(index, rows, key=key, batch=batch))
        cases = found if cases is None else cases.unionByName(found)
        # A key that is null or given more than once is settled alike within its batch.
        gone = found.select(F.col(key).alias("__k"), F.col(batch).alias("__b")).distinct()
        accepted = rows.join(gone, F.col(key).eqNullSafe(F.col("__k")) & F.col(batch).eqNullSafe(F.col("__b")), "left_anti")
        index = index.append(accepted, f"b{group[0]}-{group[-1]}", new=True)
    return repeats(index, incoming, key=key, batch=batch) if cases is None else cases
