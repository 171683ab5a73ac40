"""Near-duplicate records: exact pairs from vantage-point trees over Hamming fingerprints."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.llm.wordsets import as_fraction, bucket_counts, flat, overlap_at_least, rare_first, set_id, shared, word_hashes
from quotemill.session import cut, ship

#: 64-bit words of a fingerprint.
FP_WORDS = 2
#: Cells of no more pairs than the square of this are compared at once, larger ones parted at a vantage point.
LEAF = 1024
#: Records that are compared with others at a time.
CHUNK = 256
#: Records of one shard that are searched in one piece; larger shards are split into pairs of blocks.
BLOCK = 32768
#: Cells of so few records are compared all at once instead of one after the other.
SMALL = 64
#: Pairs that equal parts of fingerprints bring up at a time.
PIECE = 1 << 20


def suffix_fingerprints(words: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Parity fingerprints of the words that come after each word in its row: each word flips one of 128 bits. Two sets that differ in d words have fingerprints at most d bits apart, so a bound on differing words is a bound on Hamming distance."""
    bit = (words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(57)
    one = np.uint64(1) << (bit & np.uint64(63))
    flips = np.stack([np.where(bit >> np.uint64(6) == k, one, np.uint64(0)) for k in range(FP_WORDS)], axis=1)
    upto = np.bitwise_xor.accumulate(flips, axis=0) if len(words) else flips
    last = np.flatnonzero(np.append(row[1:] != row[:-1], True)) if len(row) else np.empty(0, np.int64)
    return upto[np.repeat(last, np.diff(np.append(-1, last)))] ^ upto


class Shard:
    """Records of one shard, all of which have its word: the length of each, the position of the word, and the fingerprint of the words after it.

    If the word is the first that two records share, the words before it differ, and of
    those after it no more may differ than the bound leaves: that is the radius. It is the
    sum of what either record leaves, a share of its length less its position, so records
    are searched by pairs of classes of that slack.
    """

    def __init__(self, fp: np.ndarray, length: np.ndarray, pos: np.ndarray, t: Fraction):
        self.fp, self.len, self.pos = fp, length.astype(np.int64), pos.astype(np.int64)
        self.rest = self.len - self.pos
        sums = np.arange(2 * int(self.len.max(initial=0)) + 1)
        p, q = t.numerator, t.denominator
        #: Words that sets of lengths a and b may differ by, as a function of a + b.
        self.far = sums - 2 * -((-sums * p) // (p + q))
        #: The same for sums up to a + b: far falls by one between some of them.
        self.far_within = np.maximum.accumulate(self.far)
        #: What a record leaves of the bound, in parts of p + q: no two fit at a distance above the sum of theirs.
        self.unit = p + q
        self.slack = self.len * (q - p) - self.pos * self.unit
        self.tested = 0
        self.out: list[tuple[np.ndarray, np.ndarray]] = []

    def distance(self, i: int, at: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.fp[at] ^ self.fp[i]).sum(axis=1, dtype=np.int64)

    def fits(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs may reach the bound if the shard's word is the first that they share."""
        d = np.bitwise_count(self.fp[i] ^ self.fp[j]).sum(axis=1, dtype=np.int64)
        return self.pos[i] + self.pos[j] + np.maximum(d, np.abs(self.rest[i] - self.rest[j])) <= self.far[self.len[i] + self.len[j]]

    def _by_slack(self, at: np.ndarray) -> list[np.ndarray]:
        """Records whose slack is the same in whole words, in order of the number of words after the shard's."""
        of = self.slack[at] // self.unit
        order = np.lexsort((self.rest[at], of))
        return np.split(at[order], np.flatnonzero(np.diff(of[order])) + 1)

    def search(self, at: np.ndarray) -> None:
        """Pairs within `at`."""
        groups = self._by_slack(at)
        for k, a in enumerate(groups):
            for b in groups[k:]:
                self.meet(a, b, self._radius(a, b), a is b)

    def search_between(self, at: np.ndarray, other: np.ndarray) -> None:
        """Pairs of a record in `at` and one in `other`."""
        others = self._by_slack(other)
        for a in self._by_slack(at):
            for b in others:
                self.meet(a, b, self._radius(a, b), False)

    def _radius(self, a: np.ndarray, b: np.ndarray) -> int:
        if not len(a) or not len(b):
            return -1
        by_slack = (int(self.slack[a].max()) + int(self.slack[b].max())) // self.unit
        return min(by_slack, int(self.far_within[self.len[a].max() + self.len[b].max()] - self.pos[a].min() - self.pos[b].min()))

    def meet(self, a: np.ndarray, b: np.ndarray, r: int, same: bool) -> None:
        """Pairs of a and b (of a, if same), each in order of rest, within the radius. Where equal parts of fingerprints tell too little, a vantage point parts a at its median distance from it, and to each part come those of b that the triangle inequality lets reach it."""
        if r < 0 or not len(a) or not len(b) or self._join(a, b, r, same):
            return
        if len(a) * len(b) > LEAF * LEAF and len(a) > 1:
            v = int(a[len(a) // 2])
            da = self.distance(v, a)
            db = da if same else self.distance(v, b)
            mid = int(np.median(da))
            inner = da <= mid
            if inner.all():
                inner, mid = da < mid, mid - 1
            to_inner, to_outer = db <= mid + r, db > mid - r
            # Where the bound lets nearly all pass, parting them only costs.
            if inner.any() and not inner.all() and to_inner.sum() + to_outer.sum() <= 1.9 * len(b):
                if same:
                    self.meet(a[inner], a[inner], r, True)
                    self.meet(a[~inner], a[~inner], r, True)
                    self.meet(a[inner & (da > mid - r)], a[~inner & (da <= mid + r)], r, False)
                else:
                    self.meet(a[inner], b[to_inner], r, False)
                    self.meet(a[~inner], b[to_outer], r, False)
                return
        self._compare(a, b, r, same)

    def _join(self, a: np.ndarray, b: np.ndarray, r: int, same: bool) -> bool:
        """The same from equal parts of fingerprints: of r + 1 parts one has no bit that differs. False, and nothing done, where comparing all costs less."""
        n, bits = r + 1, 64 * FP_WORDS // (r + 1)
        # In pairs compared: sorting and looking up both sides for each part, and what chance brings together.
        if len(a) * len(b) <= n * (40_000 + 60 * (len(a) + len(b)) + 6 * len(a) * len(b) * 2.0 ** (-bits / 2)):
            return False
        met = []
        for k in range(n):
            ka, ia = self._parts(a, k * bits, bits)
            kb, ib = (ka, ia) if same else self._parts(b, k * bits, bits)
            lo = np.searchsorted(kb, ka)
            met.append((ia, ib, lo, np.searchsorted(kb, ka, side="right") - lo))
        if sum(int(m[3].sum()) for m in met) * 6 > len(a) * len(b):
            return False
        for ia, ib, lo, count in met:
            has = np.flatnonzero(count)
            ia, lo, count = ia[has], lo[has], count[has]
            upto = np.cumsum(count)
            begin = 0
            while begin < len(ia):
                # At least one record at a time, with all that it meets.
                before = int(upto[begin - 1]) if begin else 0
                end = max(begin + 1, int(np.searchsorted(upto, before + PIECE, side="right")))
                c = count[begin:end]
                i = np.repeat(ia[begin:end], c)
                j = ib[np.arange(len(i)) + np.repeat(lo[begin:end] - (upto[begin:end] - c - before), c)]
                begin = end
                if same:
                    keep = i < j
                    i, j = i[keep], j[keep]
                self.tested += len(i)
                i, j = a[i], b[j]
                for w in range(FP_WORDS):
                    keep = np.bitwise_count(self.fp[i, w] ^ self.fp[j, w]) <= r
                    i, j = i[keep], j[keep]
                keep = self.fits(i, j)
                if keep.any():
                    self.out.append((i[keep], j[keep]))
        return True

    def _parts(self, at: np.ndarray, first: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Bits of the fingerprints from `first` on, 32 at most, in order, and whose they are."""
        w, shift = divmod(first, 64)
        part = self.fp[at, w] >> np.uint64(shift)
        if shift + bits > 64:
            part |= self.fp[at, w + 1] << np.uint64(64 - shift)
        part &= np.uint64((1 << min(bits, 32)) - 1)
        key = np.sort((part << np.uint64(32)) | np.arange(len(at), dtype=np.uint64))
        return key >> np.uint64(32), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def _compare(self, a: np.ndarray, b: np.ndarray, r: int, same: bool) -> None:
        rest, low, high = self.rest[b], self.fp[:, 0], self.fp[:, 1]
        # One half of the fingerprint tells little at a large distance.
        both = r > 12
        ylow, yhigh = low[b], high[b] if both else None
        for k in range(0, len(a), CHUNK):
            x = a[k : k + CHUNK]
            # The words after the shard's can't differ by less than their numbers do.
            lo = np.searchsorted(rest, self.rest[x[0]] - r)
            hi = np.searchsorted(rest, self.rest[x[-1]] + r, side="right")
            if same:
                lo = max(lo, k)
            xlow = low[x][:, None]
            for m in range(lo, hi, 2048):
                end = min(m + 2048, hi)
                self.tested += len(x) * (end - m)
                d = np.bitwise_count(xlow ^ ylow[m:end])
                if both:
                    d += np.bitwise_count(high[x][:, None] ^ yhigh[m:end])
                near = (d <= r).ravel().nonzero()[0]
                if not len(near):
                    continue
                i, j = near // (end - m) + k, near % (end - m) + m
                if same:
                    keep = i < j
                    i, j = i[keep], j[keep]
                i, j = a[i], b[j]
                keep = self.fits(i, j)
                if keep.any():
                    self.out.append((i[keep], j[keep]))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.out:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate([i for i, _ in self.out]), np.concatenate([j for _, j in self.out])


def similar_sets(sets: DataFrame, similarity: float, counts: np.ndarray | None = None) -> DataFrame:
    """(sid_a, sid_b), sid_a < sid_b: all pairs of different word sets whose overlap is at least `similarity`; sets has sid and words, each sid once. counts: how often words of each hash bucket occur, in these sets or in more."""
    ship(sets.sparkSession)
    t = as_fraction(similarity)
    p, q = t.numerator, t.denominator
    if counts is None:
        counts = bucket_counts(sets)

    def shards(batches):
        """Each set goes to one shard for every word of its prefix, rare words first. Sets whose overlap reaches the bound share a word of their prefixes, so some shard holds both, and the boundary between shards needs no other search."""
        for batch in batches:
            words, lengths = flat(batch.column("words"))
            sid = batch.column("sid").to_numpy(zero_copy_only=False)
            w, row, pos, c = rare_first(words, lengths, counts)
            fp = suffix_fingerprints(w, row)
            n = lengths[row]
            keep = (pos <= n - -(-n * p // q)) & (c > 1)
            w, row, pos, c, n, fp = w[keep], row[keep], pos[keep], c[keep], n[keep], fp[keep]
            # Shards that outgrow a block are spread over all pairs of blocks.
            parts = np.maximum(1, -(-c // BLOCK))
            rep = np.repeat(np.arange(len(w)), parts)
            other = np.arange(len(rep)) - np.repeat(np.cumsum(parts) - parts, parts)
            mine = (sid[row].astype(np.uint64) % parts.astype(np.uint64)).astype(np.int64)[rep]
            lo, hi = np.minimum(mine, other), np.maximum(mine, other)
            cols = [w[rep], (lo << 32) | hi, sid[row[rep]], (n[rep] << 32) | (pos[rep] << 1) | (mine != lo), *fp[rep].view(np.int64).T]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in cols], names=["w", "cell", "sid", "at", *[f"f{i}" for i in range(FP_WORDS)]])

    cells = sets.select("sid", "words").mapInArrow(shards, "w long, cell long, sid long, at long, " + ", ".join(f"f{i} long" for i in range(FP_WORDS)))
    cells = cells.repartition("w", "cell").sortWithinPartitions("w", "cell")

    def search(batches):
        kept = None
        for b in batches:
            if not b.num_rows:
                continue
            t_ = pa.Table.from_batches([b]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([b])])
            done, kept = _complete(t_)
            if done is not None:
                yield _search_cells(done, t)
        if kept is not None and len(kept):
            yield _search_cells(kept, t)

    found = cells.mapInArrow(search, "sid_a long, sid_b long").distinct()
    a = sets.select(F.col("sid").alias("sid_a"), F.col("words").alias("__a"))
    b = sets.select(F.col("sid").alias("sid_b"), F.col("words").alias("__b"))
    near = found.join(a, "sid_a").join(b, "sid_b")
    return near.filter(overlap_at_least(shared("__a", "__b"), F.size("__a"), F.size("__b"), t)).select("sid_a", "sid_b")


def _cell_starts(t: pa.Table) -> np.ndarray:
    w, cell = t["w"].to_numpy(), t["cell"].to_numpy()
    new = np.ones(len(w), dtype=bool)
    new[1:] = (w[1:] != w[:-1]) | (cell[1:] != cell[:-1])
    return np.flatnonzero(new)


def _complete(t: pa.Table) -> tuple[pa.Table | None, pa.Table]:
    """The cells of a sorted stream that are whole, and the last one, to which more may come. A cell is at most two blocks."""
    at = int(_cell_starts(t)[-1])
    return (t.slice(0, at) if at else None), t.slice(at)


def _search_cells(t: pa.Table, sim: Fraction) -> pa.RecordBatch:
    t = t.combine_chunks()
    starts = _cell_starts(t)
    ends = np.append(starts[1:], len(t))
    cell, sid, at = (t[c].to_numpy() for c in ("cell", "sid", "at"))
    length, pos, upper = at >> 32, (at & 0xFFFFFFFF) >> 1, (at & 1) > 0
    apart = (cell >> 32) != (cell & 0xFFFFFFFF)
    fp = np.stack([t[f"f{i}"].to_numpy().view(np.uint64) for i in range(FP_WORDS)], axis=1)
    sizes = ends - starts
    left_ids, right_ids = [], []
    for i, j in _small_cells(fp, length, pos, np.repeat(np.arange(len(starts)), sizes), np.repeat(sizes, sizes), upper, apart, sim):
        left_ids.append(sid[i])
        right_ids.append(sid[j])
    for s, e in zip(starts[sizes > SMALL], ends[sizes > SMALL]):
        shard = Shard(fp[s:e], length[s:e], pos[s:e], sim)
        if apart[s]:
            shard.search_between(np.flatnonzero(~upper[s:e]), np.flatnonzero(upper[s:e]))
        else:
            shard.search(np.arange(e - s))
        i, j = shard.pairs()
        left_ids.append(sid[s:e][i])
        right_ids.append(sid[s:e][j])
    a = np.concatenate(left_ids) if left_ids else np.empty(0, np.int64)
    b = np.concatenate(right_ids) if right_ids else np.empty(0, np.int64)
    lo_, hi_ = np.minimum(a, b), np.maximum(a, b)
    if len(lo_):
        lo_, hi_ = np.unique(np.stack([lo_, hi_], axis=1), axis=0).T
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(lo_)), pa.array(np.ascontiguousarray(hi_))], names=["sid_a", "sid_b"])


def _small_cells(fp, length, pos, cell, size, upper, apart, t: Fraction):
    """Pairs of the cells of at most SMALL records, all cells at once: each record with the next, the one after it, and so on."""
    at = np.flatnonzero((size > 1) & (size <= SMALL))
    if not len(at):
        return
    shard = Shard(fp[at], length[at], pos[at], t)
    cell, upper, apart = cell[at], upper[at], apart[at]
    for off in range(1, SMALL):
        i = np.flatnonzero(cell[:-off] == cell[off:])
        if not len(i):
            return
        j = i + off
        keep = ~apart[i] | (upper[i] != upper[j])
        i, j = i[keep], j[keep]
        keep = shard.fits(i, j)
        yield at[i[keep]], at[j[keep]]


def text_sets(df: DataFrame, texts: tuple[str, ...], *, key: str) -> DataFrame:
    """key, words (sorted) of the rows whose texts all have something other than white space; the texts are joined by blanks."""
    whole = None
    for c in texts:
        has = F.col(c).rlike(r"(?U)\S")
        whole = has if whole is None else whole & has
    return df.filter(whole).select(F.col(key).alias("key"), F.array_sort(word_hashes(F.concat_ws(" ", *[F.col(c) for c in texts]))).alias("words"))


def near_duplicates(df: DataFrame, *, key: str = "news_id", texts: tuple[str, ...] = ("headline", "snippet"), similarity: float = 0.65) -> tuple[DataFrame, DataFrame]:
    """(members, links): members has key and sid, the id of the row's word set; links has sid_a, sid_b of all pairs of different sets with an overlap of at least `similarity`.

    Rows with equal word sets are one member class and are never compared with each other.
    A fingerprint is the parity of words in 128 bits; Hamming distance between
    fingerprints never exceeds the number of differing words, so the bound on overlap
    gives a radius and no pair is lost. Records are partitioned into shards by the words
    of a prefix, rare words first, which any two similar sets share. Where the shard's
    word is the first that two sets share, all words before it differ: the radius is the
    bound less both positions, and it is the fingerprints of the words after it that must
    lie within it. Large shards are parted at vantage points, pruned by the triangle
    inequality with that radius. What is left is counted exactly on the sets.

    Null or blank texts take no part, nor do texts without a letter or digit. Repeated
    keys are separate rows. Empty tables give no rows; extra columns are ignored.
    """
    # Rows without words are dropped after the cut: a filter before it would have the words made twice.
    rows = cut(text_sets(df, texts, key=key).withColumns({"sid": set_id(F.col("words")), "check": set_id(F.col("words"), -1)})).filter(F.size("words") > 0)
    # Counts of all rows serve as well as those of distinct sets, and need no shuffle.
    counts = bucket_counts(rows)
    seed = 0
    while not rows.groupBy("sid").agg((F.min("check") < F.max("check")).alias("two")).filter("two").isEmpty():
        # Two sets got the same id: all are drawn again.
        seed += 1
        rows = rows.withColumn("sid", set_id(F.col("words"), seed))
    return rows.select(F.col("key").alias(key), "sid"), similar_sets(rows.select("sid", "words").dropDuplicates(["sid"]), similarity, counts)


def expanded_pairs(members: DataFrame, links: DataFrame, *, key: str = "news_id") -> DataFrame:
    """key_a, key_b, smaller first: every pair of rows, those of equal sets included. As long as what is asked for."""
    a, b = members.select(F.col(key).alias("ka"), F.col("sid").alias("sid_a")), members.select(F.col(key).alias("kb"), F.col("sid").alias("sid_b"))
    across = links.join(a, "sid_a").join(b, "sid_b").select("ka", "kb")
    several = members.groupBy("sid").count().filter("count > 1").select("sid")
    copies = members.join(several, "sid", "left_semi")
    same = copies.select("sid", F.col(key).alias("ka")).join(copies.select("sid", F.col(key).alias("kb")), "sid").filter("ka < kb").select("ka", "kb")
    return across.select(F.least("ka", "kb").alias(f"{key}_a"), F.greatest("ka", "kb").alias(f"{key}_b")).unionByName(same.select(F.col("ka").alias(f"{key}_a"), F.col("kb").alias(f"{key}_b")))


def classes(members: DataFrame, links: DataFrame, *, key: str = "news_id") -> DataFrame:
    """key, class_id (least key of the rows with the same word set), class_size, links (other classes that are similar)."""
    reps = members.groupBy("sid").agg(F.min(key).alias("class_id"), F.count("*").alias("class_size"))
    degree = links.select(F.col("sid_a").alias("sid")).unionByName(links.select(F.col("sid_b").alias("sid"))).groupBy("sid").agg(F.count("*").alias("links"))
    known = reps.join(degree, "sid", "left").select("sid", "class_id", "class_size", F.coalesce("links", F.lit(0)).alias("links"))
    return members.join(known, "sid").select(key, "class_id", "class_size", "links")
