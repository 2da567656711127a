"""Operator 2: repeated byte strings by a partitioned suffix array.

A full suffix array of the corpus is neither needed nor affordable: two equal strings
of ``length`` bytes hold the same minimizer, the smallest hash among their 24-byte
grams. Every start position belongs to the run of starts with the same minimizer
occurrence; a run's bytes are its context. So

1.  contexts are keyed by minimizer; those whose whole bytes occur twice repeat at
    every start, by hash, without moving text;
2.  where different contexts share a minimizer, one copy of each meets the others,
    and their suffixes are sorted deep-shallow: a multikey quicksort over eight-byte
    symbols down to a shallow depth, then blind tries, built level by level with the
    skip and the branching byte of each node, order the groups with long common
    prefixes. Suffixes that end in one leaf at depth ``length`` are repeated strings.

Starts found are turned into byte spans of their documents, by a second scan that
sends only contexts a filter of fixed size may hold, merged and removed. A context is
known by the 64-bit hash of its minimizer and the 64-bit hash of its bytes, a row by
128 bits of its id and text. All steps are keyed by content: a passage in a third of the corpus sends at most two rows
per context and task to step 1, is sorted once in step 2, and hot minimizers are
dealt out as block pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bitmap, cut, map_groups, set_bits, table

LENGTH, GRAM = 200, 24
#: Bytes that one vectorised step holds, and contexts that a task remembers.
CHUNK, SEEN = 1 << 19, 1 << 20
SHALLOW = 24
_B = 0x9E3779B97F4A7C15
_LOW = np.uint64((1 << 24) - 1)


def _gram_hashes(a: np.ndarray) -> np.ndarray:
    """Hash of each 24-byte gram of ``a`` (24 = 8 + 16)."""
    h = {1: a.astype(np.uint64) + np.uint64(1)}
    for k in (2, 4, 8, 16):
        half = h[k // 2]
        h[k] = half[: -(k // 2)] * np.uint64(pow(_B, k // 2, 1 << 64)) + half[k // 2 :]
    n = len(a) - GRAM + 1
    x = h[8][:n] * np.uint64(pow(_B, 16, 1 << 64)) + h[16][8 : 8 + n]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def _runs(a: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, last start, minimizer) of each run of starts in ``a``."""
    h = _gram_hashes(a)
    key = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)  # ties: the leftmost gram
    width = length - GRAM + 1
    m, span = key, 1
    while span * 2 <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < width:
        m = np.minimum(m[: len(h) - width + 1], m[width - span :])
    at = (m & _LOW).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return first, np.append(first[1:], len(at)) - 1, h[at[first]]


def document_runs(text: bytes, length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of a whole text, a bounded piece of starts at a time."""
    n = len(text) - length + 1
    for lo in range(0, max(0, n), CHUNK):
        hi = min(n, lo + CHUNK)
        first, last, m = _runs(np.frombuffer(text, np.uint8, hi - lo + length - 1, lo), length)
        yield first + lo, last + lo, m


def _contexts(batches: Iterator[pa.RecordBatch], length: int, bits: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """(m, c, k, k2, at, n): contexts by minimizer and hash, of row (k, k2), n starts from at.

    Without ``bits`` a context comes at most twice from what the task remembers; with
    ``bits`` every one comes that the filter of wanted ``c`` may hold.
    """
    seen: dict[int, int] = {}
    digest = xxhash.xxh3_64_intdigest
    for b in batches:
        cols: list[list] = [[], [], [], [], [], []]
        for k, k2, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            t = text.as_py()
            if t is None or len(t) < length:
                continue
            for first, last, m in document_runs(t, length):
                c = np.array([digest(t[s : e + length]) for s, e in zip(first.tolist(), last.tolist())], np.uint64).view(np.int64)
                if bits is not None:
                    keep = np.flatnonzero(set_bits(c, bits))
                else:
                    keep = []
                    for i, h in enumerate(c.tolist()):
                        times = seen.get(h, 0)
                        if times > 1:
                            continue
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen[h] = times + 1
                        keep.append(i)
                if len(keep):
                    for col, v in zip(cols, (m.view(np.int64)[keep], c[keep], np.full(len(keep), k), np.full(len(keep), k2), first[keep], (last - first + 1)[keep])):
                        col.append(v)
            if sum(len(x) for x in cols[0]) > 50_000:
                yield _batch(cols)
                cols = [[], [], [], [], [], []]
        if cols[0]:
            yield _batch(cols)


def _batch(cols: list[list]) -> pa.RecordBatch:
    whole = [np.concatenate(c) for c in cols]
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in whole[:5]), pa.array(whole[5].astype(np.int32))], ["m", "c", "k", "k2", "at", "n"])


def _word_at(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each position as one big-endian number."""
    w = np.zeros(len(at), np.uint64)
    for i in range(8):
        w = (w << np.uint64(8)) | buf[at + i]
    return w


def repeated_starts(buf: np.ndarray, suffixes: np.ndarray, groups: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """True for suffixes whose first ``length`` bytes equal another one's of their group.

    ``buf`` is padded with 8 bytes. Deep-shallow: multikey quicksort to SHALLOW
    bytes, then blind tries over what is left.
    """
    found = np.zeros(len(suffixes), bool)
    live, group, depth = np.arange(len(suffixes)), groups, 0
    while depth + 8 <= min(SHALLOW, length) and len(live):  # multikey quicksort, eight bytes a symbol
        symbol = _word_at(buf, suffixes[live] + depth)
        order = np.lexsort((symbol, group))
        live, group, symbol = live[order], group[order], symbol[order]
        live, group = _split(live, group, symbol)
        depth += 8
    if not len(live):
        return found
    depths = np.full(len(live), depth, np.int64)  # of each suffix's trie node
    while len(live):
        head = live[np.concatenate(([True], group[1:] != group[:-1]))][group]  # the first suffix of the node
        common = _common(buf, suffixes[live], suffixes[head], depths, length)
        skip = np.full(int(group[-1]) + 1, length, np.int64)
        np.minimum.at(skip, group, common)
        skip = skip[group]  # where the node branches
        done = skip >= length
        found[live[done]] = True
        live, group, skip = live[~done], group[~done], skip[~done]
        branch = buf[suffixes[live] + skip]
        order = np.lexsort((branch, group))
        live, group, branch, depths = live[order], group[order], branch[order], skip[order]
        many, group = _split(np.arange(len(live)), group, branch)
        live, depths = live[many], depths[many]
    return found


def _split(live: np.ndarray, group: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Drop members that stand alone; number the groups that remain."""
    if not len(live):
        return live, group
    new = np.concatenate(([True], (group[1:] != group[:-1]) | (symbol[1:] != symbol[:-1])))
    ids = np.cumsum(new) - 1
    many = (np.bincount(ids) > 1)[ids]
    live, ids = live[many], ids[many]
    if len(ids):
        ids = np.cumsum(np.concatenate(([0], (ids[1:] != ids[:-1]).astype(np.int64))))
    return live, ids


def _common(buf: np.ndarray, a: np.ndarray, b: np.ndarray, depth: np.ndarray, length: int) -> np.ndarray:
    """Length of the common prefix of suffixes a and b, known to be at least ``depth``."""
    out = depth.copy()
    at = np.flatnonzero((a != b) & (out < length))
    out[a == b] = length
    while len(at):
        x = _word_at(buf, a[at] + out[at]) ^ _word_at(buf, b[at] + out[at])
        same = x == 0
        differ = np.flatnonzero(~same)
        if len(differ):
            out[at[differ]] += _leading_zero_bytes(x[differ])
        at = at[same]
        out[at] += 8
        at = at[out[at] < length]
    return np.minimum(out, length)


def _leading_zero_bytes(x: np.ndarray) -> np.ndarray:
    n = np.zeros(len(x), np.int64)
    for i in range(1, 8):
        n += (x >> np.uint64(64 - 8 * i)) == 0
    return n


def _sort_suffixes(groups: Iterator[tuple[pa.Table, np.ndarray]], length: int) -> Iterator[pa.RecordBatch]:
    """Spans of repeated starts: (m, c, a, b), starts a <= i < b of the context."""
    for whole, starts in groups:
        lo = 0
        while lo < len(starts) - 1:  # whole groups, about 4096 contexts at a time
            hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + 4096, "right")) - 1)
            part = whole.slice(int(starts[lo]), int(starts[hi] - starts[lo]))
            n = part.column("n").to_numpy().astype(np.int64)
            raw = part.column("bytes").to_pylist()
            sizes = np.array([len(r) for r in raw], np.int64)
            offset = np.cumsum(sizes) - sizes
            buf = np.frombuffer(b"".join(raw) + bytes(length + 8), np.uint8)
            first = np.cumsum(n) - n
            context = np.repeat(np.arange(len(n)), n)
            local = np.arange(int(n.sum())) - first[context]
            of = np.repeat(np.arange(hi - lo), np.diff(starts[lo : hi + 1]))
            hit = repeated_starts(buf, offset[context] + local, of[context], length)
            at = np.flatnonzero(hit)
            if len(at):
                new = np.concatenate(([True], (context[at][1:] != context[at][:-1]) | (at[1:] != at[:-1] + 1)))
                i = np.flatnonzero(new)
                a, b = at[i], at[np.append(i[1:], len(at)) - 1]
                m, c = part.column("m").to_numpy(), part.column("c").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(m[context[a]]), pa.array(c[context[a]]), pa.array(local[a].astype(np.int32)), pa.array((local[b] + 1).astype(np.int32))],
                    ["m", "c", "a", "b"],
                )
            lo = hi


def _fetch(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[list] = [[], [], [], []]
        for text, wanted in zip(b.column(0), b.column(1).to_pylist()):
            t = text.as_py()
            for w in wanted:
                for col, v in zip(out, (w["m"], w["c"], w["n"], t[w["at"] : w["at"] + w["n"] + length - 1])):
                    col.append(v)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary())], ["m", "c", "n", "bytes"]
        )


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(k, k2, spans): byte spans [a, b) of row (k, k2) covered by repeated strings, unmerged.

    ``docs`` is (k, k2, text): a 128-bit row key and the text as bytes. Rows that agree
    in the key have the same bytes; they give one row with the spans of one of them.
    """
    schema = "m long, c long, k long, k2 long, at long, n int"
    texts = docs.select("k", "k2", "text")
    dealt = texts.mapInArrow(lambda it: _contexts(it, length), schema).repartition("m")
    contexts = dealt.groupBy("m", "c").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("k", "k2", "at", "n")).alias("one"))
    kinds = F.count(F.lit(1)).over(Window.partitionBy("m"))  # the rows lie together already
    contexts = cut(contexts.withColumn("kinds", kinds).where("times > 1 OR kinds > 1"))
    wanted = contexts.where("kinds > 1").select("m", "c", "one.*").groupBy("k", "k2").agg(F.collect_list(F.struct("m", "c", "at", "n")).alias("wanted"))
    pieces = texts.join(wanted, ["k", "k2"]).select("text", "wanted").mapInArrow(lambda it: _fetch(it, length), "m long, c long, n int, bytes binary")
    part = map_groups(pieces, ["m"], "c", lambda g: _sort_suffixes(g, length), "m long, c long, a int, b int", block_rows=2048)
    starts = part.unionByName(contexts.where("times > 1").select("m", "c", F.lit(0).alias("a"), F.col("one.n").alias("b")))
    starts = cut(starts.groupBy("m", "c").agg(F.collect_set(F.struct("a", "b")).alias("starts")))
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(starts.select(F.col("c").alias("v"))))
    places = texts.mapInArrow(lambda it: _contexts(it, length, bits.value), schema)
    hit = places.join(starts, ["m", "c"]).select("k", "k2", F.expr(f"transform(starts, x -> struct(at + x.a AS a, at + x.b + {length - 1} AS b))").alias("s"))
    return hit.groupBy("k", "k2").agg(F.flatten(F.collect_set("s")).alias("spans"))


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes; touching spans are one run."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]])


def remove_repeated(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, spans, kept): what repeats in each document, and the bytes left.

    Each byte covered by a string of ``length`` bytes that also starts anywhere else,
    in the same or another document, goes; strings are judged on the input. Null texts
    are empty. Rows stay one by one: rows with equal id and text are copies of each
    other. ``kept`` need not be valid UTF-8. Empty input gives an empty table. Other
    columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    rows = rows.withColumns({"k": F.xxhash64("doc_id", "text"), "k2": F.xxhash64(F.lit(1), "doc_id", "text")})
    spans = repeated_spans(rows, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, kept = [], []
            for t, s in zip(b.column(1), b.column(2).to_pylist()):
                merged = merge_spans([(x["a"], x["b"]) for x in s or ()])
                found.append([{"a": x, "b": y} for x, y in merged])
                kept.append(remove_spans(t.as_py(), merged))
            span = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, span), pa.array(kept, pa.binary())], ["doc_id", "spans", "kept"])

    joined = rows.join(spans, ["k", "k2"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, spans array<struct<a:long,b:long>>, kept binary")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"])
    return found.select(
        "doc_id",
        (F.octet_length("kept") + removed).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


#: DuckDB: every 200-byte string that starts twice, as gaps and islands of starts.
OP2_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents
), starts AS (
  SELECT r, p, md5(array_slice(b, p + 1, p + 200)) AS k FROM (SELECT r, b, unnest(range(0, octet_length(b) - 199)) AS p FROM d)
), twice AS (
  SELECT k FROM starts GROUP BY k HAVING count(*) > 1
), hit AS (
  SELECT r, p, p - lag(p) OVER (PARTITION BY r ORDER BY p) AS step FROM starts SEMI JOIN twice USING (k)
), run AS (
  SELECT r, p, sum(CASE WHEN step <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY p) AS g FROM hit
), span AS (
  SELECT r, min(p) AS a, max(p) + 200 AS z FROM run GROUP BY r, g
), piece AS (
  SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM span
), cuts AS (
  SELECT r, sum(z - a) AS n_removed, count(*) AS n_spans, max(z) AS last, string_agg(hex(array_slice(b, before + 1, a)), '' ORDER BY a) AS kept
  FROM piece JOIN d USING (r) GROUP BY r
)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, '') || hex(array_slice(b, coalesce(last, 0) + 1, octet_length(b))))) AS kept_sha256
FROM d LEFT JOIN cuts USING (r)
"""
