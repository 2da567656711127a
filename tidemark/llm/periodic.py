"""Operator 12: periodic run detection by internal pattern matching.

A run is a stretch of consecutive words with smallest period q, long enough and not
extendable. If its first words up to a period before its end are at least
``block + stride - 1`` many, an aligned block lies among them and occurs again q
words later. So every aligned block asks for its own occurrences in the window of
periods that belongs to its length, which doubles from level to level:

* Prefix doubling sorts the suffixes of all documents of a batch. At the level of 2^k
  words the suffixes that begin with a block are an interval of the suffix array;
  suffixes that are alone in theirs are settled and take no further part, so ordinary
  text stops at four words.
* A wavelet matrix over the suffix array (bit vectors with sampled counts) counts and
  selects positions of an interval in a window: range successor, for all blocks of a
  level at once.
* Windows are cut to the length of a block. Occurrences of a block in such a window are
  an arithmetic progression, so the first, the second and the count give them all, and
  each is a candidate period.

Neighbouring blocks with one candidate period merge into a chain; what is missing at its
ends, less than a stride, is measured by the classes of shorter blocks. A stretch found with several periods has the smallest. Nothing is hashed:
words are numbered by a dictionary, so the result is exact.

Memory of a task follows the words of a batch (``BATCH_WORDS`` or one document), times
the levels that its repeats reach.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

#: Words of the documents that are searched together; a longer document is searched alone.
BATCH_WORDS = 400_000


class WaveletMatrix:
    """Counts and selects by value in intervals of a fixed array of numbers from 0 to below ``top``."""

    def __init__(self, values: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        at = values
        for b in range(self.bits - 1, -1, -1):
            one = (at >> b & 1).astype(bool)
            packed = np.packbits(one, bitorder="little")
            words = np.frombuffer(packed.tobytes() + bytes(8 - len(packed) % 8 + 8), np.uint64)
            self.words.append(words)
            self.counts.append(np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64))).astype(np.int32 if len(values) < 1 << 31 else np.int64))
            self.zeros.append(int(len(at) - one.sum()))
            at = np.concatenate((at[~one], at[one]))

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        """Set bits before ``i``."""
        w = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[level][w] + np.bitwise_count(self.words[level][w] & below)

    def below(self, lo: np.ndarray, hi: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many of values[lo:hi] are under ``value``."""
        found = np.zeros(len(lo), np.int64)
        over = value >= 1 << self.bits
        v = np.where(over, 0, np.maximum(value, 0))
        a, z = lo.astype(np.int64), hi.astype(np.int64)
        for level in range(self.bits):
            one = (v >> (self.bits - 1 - level) & 1).astype(bool)
            a1, z1 = self._ones(level, a), self._ones(level, z)
            found += np.where(one, (z - z1) - (a - a1), 0)
            a = np.where(one, self.zeros[level] + a1, a - a1)
            z = np.where(one, self.zeros[level] + z1, z - z1)
        return np.where(over, hi - lo, found)

    def select(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The ``k``-th smallest (from 0) of values[lo:hi]."""
        found = np.zeros(len(lo), np.int64)
        a, z, k = lo.astype(np.int64), hi.astype(np.int64), k.astype(np.int64)
        for level in range(self.bits):
            a1, z1 = self._ones(level, a), self._ones(level, z)
            none = (z - z1) - (a - a1)
            one = k >= none
            k = np.where(one, k - none, k)
            a = np.where(one, self.zeros[level] + a1, a - a1)
            z = np.where(one, self.zeros[level] + z1, z - z1)
            found = found << 1 | one
        return found


def _first_ranks(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Classes of single words within documents: the number of smaller (document, word) pairs."""
    key = doc.astype(np.int64) * (int(words.max(initial=0)) + 1) + words
    order = np.argsort(key, kind="stable")
    s = key[order]
    new = np.concatenate(([True], s[1:] != s[:-1]))
    rank = np.empty(len(key), np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    return rank


def _levels(least: int, n: int) -> dict[int, tuple[int, int, int]]:
    """k -> (stride, smallest, largest period): blocks of 2^k words for all periods up to n / 2.

    A run of period q has max(least - q, q) words that equal the ones q later, half of
    ``least`` at fewest; a block at a multiple of the stride lies inside if these are
    2^k + stride - 1 or more. The lowest level serves all short periods.
    """
    room, k, q = (least + 1) // 2, 0, 1
    while (2 << k) + (1 << k) - 1 <= room:
        k += 1
    stride, levels = min(1 << k, room - (1 << k) + 1), {}
    while 2 * q <= n:
        to = min((4 << k) - 2, n // 2)
        levels[k] = stride, q, to
        q, k = to + 1, k + 1
        stride = 1 << k
    return levels


def find_runs(words: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of ``least`` words or more, by start and period.

    ``words`` are numbers from 0, ``doc`` the ascending document of each word; starts
    are positions in ``words`` and runs never cross documents.
    """
    none = (np.empty(0, np.int64),) * 3
    n = len(words)
    longest = int(np.bincount(doc).max()) if n else 0
    if longest < least:
        return none
    levels = _levels(least, longest)
    rank = _first_ranks(words, doc)
    held, k, lowest = _shared(rank), 0, min(levels)
    classes, shared, asked = [], held[:0], []
    while len(held) and k <= max(levels):
        classes.append(Classes(rank, held))
        if k == lowest:
            shared = held  # all later classes are parts of these
        if k in levels:
            stride, q0, q1 = levels[k]
            at = held[held % stride == 0]
            asked.append((k, stride, q0, q1, at, rank[at], _sizes(rank, held, at)))
        held = _double(rank, held, 1 << k)
        k += 1
    if not asked:
        return none
    # classes are intervals of this order, whatever the order inside the longest ones
    array = shared[np.argsort(rank[shared], kind="stable")]
    first = np.sort(rank[shared])  # place in the whole suffix array of each entry
    tree = WaveletMatrix(array, n)
    found = []
    for k, stride, q0, q1, at, lo, size in asked:
        a = np.searchsorted(first, lo)
        p, q = _candidates(tree, at, a, a + size, 1 << k, q0, q1)
        if len(p):
            found.append(_stretches(classes[:k], p, q, 1 << k, stride, least))
    if not found:
        return none
    start, end, period = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    keep = np.ones(len(start), bool)
    keep[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[keep], end[keep], period[keep]
    order = np.lexsort((period, start))
    return start[order], (end - start)[order], period[order]


class Classes:
    """Which positions begin with the same 2^k words: a number for each that is not alone."""

    def __init__(self, rank: np.ndarray, held: np.ndarray):
        self.n, self.held, self.dense = len(rank), held, None
        self.own = rank[held].astype(np.int32 if len(rank) < 1 << 31 else np.int64)
        if 4 * len(held) > len(rank):
            self.dense = np.full(len(rank), -1, self.own.dtype)
            self.dense[held] = self.own
            self.held = self.own = None

    def _of(self, x: np.ndarray) -> np.ndarray:
        inside = (x >= 0) & (x < self.n)
        if self.dense is not None:
            return np.where(inside, self.dense[np.where(inside, x, 0)], -1)
        i = np.minimum(np.searchsorted(self.held, x), len(self.held) - 1)
        return np.where(inside & (self.held[i] == x), self.own[i], -1)

    def same(self, x: np.ndarray, q: np.ndarray) -> np.ndarray:
        """1 where ``x`` and ``x + q`` begin alike, else 0."""
        c = self._of(x)
        return ((c >= 0) & (c == self._of(x + q))).astype(np.int64)


def _shared(rank: np.ndarray) -> np.ndarray:
    """Positions whose class has two members or more."""
    return np.flatnonzero(np.bincount(rank, minlength=len(rank))[rank] > 1)


def _sizes(rank: np.ndarray, held: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Members of the classes of ``at``; ``held`` has all positions that are not alone."""
    own = np.sort(rank[held])
    return np.searchsorted(own, rank[at], "right") - np.searchsorted(own, rank[at], "left")


def _double(rank: np.ndarray, held: np.ndarray, h: int) -> np.ndarray:
    """Refine the classes of the first h words to 2 h words in place; positions still not alone.

    A class keeps the number of smaller suffixes as its rank, so classes of other
    positions stay right. The end of the text is smaller than any word.
    """
    n = len(rank)
    after = held + h
    second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
    order = np.lexsort((second, rank[held]))
    p, r, s = held[order], rank[held][order], second[order]
    new_class = np.concatenate(([True], r[1:] != r[:-1]))
    new = new_class | np.concatenate(([True], s[1:] != s[:-1]))
    at = np.arange(len(p))
    inside = at - at[new_class][np.cumsum(new_class) - 1]  # place within the old class
    rank[p] = r + inside[new][np.cumsum(new) - 1]
    count = np.diff(np.append(np.flatnonzero(new), len(p)))
    return np.sort(p[np.repeat(count > 1, count)])


def _candidates(tree: WaveletMatrix, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, block: int, q0: int, q1: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, period): occurrences of the block at each position q0 to q1 words later.

    Where the next occurrence is d words later, at most half a block, d is the period of the
    block and no two occurrences are nearer. Left out is then a multiple q of d with q / d
    occurrences up to it: the words up to there repeat after d, so q is not the smallest period.
    """
    places, periods = [], []
    so_far = tree.below(lo, hi, at + 1)
    follows = np.flatnonzero(so_far < hi - lo)
    at, lo, hi, so_far = at[follows], lo[follows], hi[follows], so_far[follows]
    near = tree.select(lo, hi, so_far) - at
    for a in range(q0, q1 + 1, block):
        z = min(q1, a + block - 1)
        before = tree.below(lo, hi, at + a)
        count = tree.below(lo, hi, at + z + 1) - before
        some = np.flatnonzero(count)
        if not len(some):
            continue
        p, c, f = at[some], count[some], before[some]
        one = tree.select(lo[some], hi[some], f)
        step = np.zeros(len(some), np.int64)
        more = np.flatnonzero(c > 1)
        step[more] = tree.select(lo[some][more], hi[some][more], f[more] + 1) - one[more]
        owner = np.repeat(np.arange(len(some)), c)
        member = np.arange(len(owner)) - np.repeat(np.cumsum(c) - c, c)
        q = (one - p)[owner] + member * step[owner]
        d = near[some][owner]
        upto = (f - so_far[some])[owner] + member + 1  # occurrences after the block, up to this one
        keep = (q == d) | (q % d != 0) | (upto != q // d) | (2 * d > block)
        places.append(p[owner][keep])
        periods.append(q[keep])
    if not places:
        return at[:0], at[:0]
    return np.concatenate(places), np.concatenate(periods)


def _stretches(classes: list[Classes], p: np.ndarray, q: np.ndarray, block: int, stride: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the maximal stretches around the candidates that are long enough."""
    order = np.lexsort((p, q))
    p, q = p[order], q[order]
    new = np.concatenate(([True], (q[1:] != q[:-1]) | (p[1:] != p[:-1] + stride)))
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(p)) - 1
    a, z, q = p[head], p[tail] + block, q[head]  # words a to z equal the ones q later
    # a chain holds every aligned block of its stretch, so it is short of it by less than a stride
    fit = z - a + 2 * stride >= np.maximum(least - q, q)
    a, z, q = a[fit], z[fit], q[fit]
    for k in range(len(classes) - 1, -1, -1):
        a = a - (classes[k].same(a - (1 << k), q) << k)
        z = z + (classes[k].same(z, q) << k)
    end = z + q
    fit = end - a >= np.maximum(least, 2 * q)
    return a[fit], end[fit], q[fit]


def periodic_runs(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = 12, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
    batch_words: int = BATCH_WORDS,
) -> DataFrame:
    """(doc_id, runs, collapsed): all runs of ``least`` words or more, and the text without their repeats.

    Words lie between ASCII white space. ``runs`` is an array of (start, length, period)
    by start and period, starts counted in words from 0. ``collapsed`` has the
    words, joined by one blank, without those that some run holds after its first period.
    A null or empty text has no words and no runs; rows that repeat are searched
    each for itself; a null id is carried. ``rewrite`` may change the words of a document
    first. Empty input gives an empty table, other columns are ignored.
    """

    def flush(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        sizes = np.array([len(t) for t in texts], np.int64)
        begin = np.concatenate(([0], np.cumsum(sizes)))
        flat = [w for t in texts for w in t]
        numbers = pa.array(flat, pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(len(texts)), sizes)
        start, length, period = find_runs(numbers, doc, least)
        owner = doc[start]
        # words after the first period of a run: +1 where they begin, -1 where they end
        edge = np.zeros(len(flat) + 1, np.int64)
        np.add.at(edge, start + period, 1)
        np.add.at(edge, start + length, -1)
        drop = np.cumsum(edge[:-1]) > 0
        kept = []
        for i, t in enumerate(texts):
            gone = drop[begin[i] : begin[i + 1]]
            kept.append(b" ".join(t if not gone.any() else [t[j] for j in np.flatnonzero(~gone)]))
        ends = pa.array(np.searchsorted(owner, np.arange(len(texts) + 1)), pa.int32())
        one = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start - begin[owner], length, period)], ["start", "length", "period"])
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(ends, one), pa.array(kept, pa.binary())], ["doc_id", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, n = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                words = (t.as_py() or b"").split()
                if rewrite is not None:
                    words = rewrite(i, words)
                if ids and n + len(words) > batch_words:
                    yield flush(ids, texts)
                    ids, texts, n = [], [], 0
                ids.append(i)
                texts.append(words)
                n += len(words)
        if ids:
            yield flush(ids, texts)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    found = rows.mapInArrow(run, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """One document in ten gets a periodic tail; place and period follow from its id. A null id gets none."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), rewrite=planted)
    first = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    best = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), first.alias("b"), lines.alias("lines"), "collapsed")
    return best.select(
        "doc_id", "n_runs", (-F.col("b.start")).alias("start"), F.col("b.length").alias("length"), (-F.col("b.period")).alias("period"),
        F.expr("1000 * b.length div -b.period").alias("exponent_milli"), F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


#: DuckDB: every pair of equal words at one distance, joined to stretches. CRC-32 is the reflected polynomial 0xEDB88320, bit by bit.
OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), hashed AS (
  SELECT doc_id, w, len(w)::BIGINT AS n, xor(4294967295, list_reduce(
      list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) AS h
  FROM d
), placed AS (
  SELECT *, h // 10 AS g, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM hashed
), cut AS (
  SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM placed
), words AS (
  SELECT doc_id, i, CASE WHEN h % 10 = 0 AND i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM cut)
), same AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i
), joined AS (
  SELECT doc_id, q, min(i) AS s, max(i) + 1 + q AS e
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same) GROUP BY doc_id, q, island
), runs AS (
  SELECT doc_id, s, e, min(q) AS q FROM joined WHERE e - s >= greatest(12, 2 * q) GROUP BY doc_id, s, e
), dropped AS (
  SELECT DISTINCT r.doc_id, x.i FROM runs r JOIN words x ON x.doc_id = r.doc_id AND x.i >= r.s + r.q AND x.i < r.e
), of_runs AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' ORDER BY s, q) AS lines,
    first({'s': s, 'len': e - s, 'q': q} ORDER BY e - s DESC, s, q) AS best
  FROM runs GROUP BY doc_id
), collapsed AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s AS start, best.len AS length, best.q AS period, 1000 * best.len // best.q AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN of_runs USING (doc_id) LEFT JOIN collapsed USING (doc_id)
"""
