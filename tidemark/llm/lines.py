"""Operator 6: fuzzy line dedup by MinHash.

Lines are signed over their character shingles; bands of the signature are the keys
of candidate groups. Within a group lines are verified by the exact Jaccard index of
their shingle sets and joined; the links form components over all lines by
distributed union-find, and one line of each component stays: the first by document
id, text hash and position.

One pass over the texts splits, hashes and signs the lines and writes a narrow table
(places, hashes, bands) of which later steps read columns. Equal lines are one node,
known by the 128-bit hash of their bytes. Signing dedups inside a task, so a line that
fills a third of the corpus is signed and sent once for each task. Only lines that
share a band with a different line have their text fetched, by a second pass: both
steps go through Bloom filters of fixed size, and when these fill up more lines
travel, none is lost. Groups are compared row by row, pairs
that an earlier band holds or that are connected already are skipped, so a group of
near-identical lines costs about one comparison per line; hot groups are dealt out in
blocks, of which only lines outside the largest component visit each other's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import bitmap, connected_components, cut, link_groups, set_bits, stored, table

SHINGLE_CHARS = 8
#: 10 bands of 4 rows find a pair at similarity 0.8 with 0.995, at 0.9 with 0.9999.
BANDS, BAND_ROWS = 10, 4
THRESHOLD = 0.8
#: Characters that one step of signing holds, rows that one batch holds, and lines that a task remembers.
CHUNK_CHARS, BATCH_LINES, SEEN = 1 << 16, 20_000, 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def line_hash(line: bytes) -> tuple[int, int]:
    """The 128-bit hash of a line as two signed longs, as the table of lines has it."""
    h1, h2 = np.frombuffer(xxhash.xxh3_128_digest(line), ">i8").tolist()
    return h1, h2


def shingles(line: str, q: int = SHINGLE_CHARS) -> set[str]:
    """Character shingles; a shorter line is its own only shingle."""
    return {line[i : i + q] for i in range(len(line) - q + 1)} if len(line) > q else {line}


def jaccard(a: set, b: set) -> float:
    n = len(a & b)
    return n / (len(a) + len(b) - n)


def band_keys(lines: list[str], q: int = SHINGLE_CHARS, bands: int = BANDS, rows: int = BAND_ROWS, seed: int = 3) -> np.ndarray:
    """A (lines, bands) array of 64-bit keys: MinHash minima folded band by band."""
    n = len(lines)
    sizes = np.array([len(x) for x in lines], np.int64)
    padded = np.maximum(sizes, q)
    ends = np.cumsum(padded)
    starts = ends - padded
    h = np.zeros(int(ends[-1]) + q - 1, np.uint64)
    flat = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    h[np.arange(len(flat)) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)] = flat
    h += np.uint64(1)
    width = 1
    while width < q:  # hashes of runs of 1, 2, 4, ... characters
        step = min(width, q - width)
        h = h[:-step] * np.uint64(pow(int(_BASE), step, 1 << 64)) + h[step:] if step == width else h[:-step] * _BASE + h[step:]
        width += step
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h = (h >> np.uint64(32)).astype(np.uint32)
    count = padded - q + 1
    first = np.cumsum(count) - count
    h = h[np.repeat(starts - first, count) + np.arange(int(count.sum()))]  # windows inside one line
    a = np.random.default_rng(seed).integers(0, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    keys = np.empty((n, bands), np.uint64)
    x = np.empty_like(h)
    for band in range(bands):
        acc = np.full(n, band + 1, np.uint64)
        for r in range(band * rows, band * rows + rows):
            np.multiply(h, a[r], out=x)
            acc = (acc ^ np.minimum.reduceat(x, first).astype(np.uint64)) * _BASE
            acc ^= acc >> np.uint64(29)
        keys[:, band] = acc
    return keys


def _lines(text: str | None) -> Iterator[tuple[int, str, bytes]]:
    """(number, line, hash) of the lines of a text that are not blank."""
    digest = xxhash.xxh3_128_digest
    for i, line in enumerate((text or "").split("\n")):
        if line and not line.isspace():
            yield i, line, digest(line.encode("utf-8", "surrogatepass"))


def _longs(hashes: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(hashes), ">i8").astype(np.int64).reshape(-1, 2)


class _Batch:
    """Lines on their way to the table; fresh ones with a signature."""

    def __init__(self):
        self.places: list[tuple[int, int, int]] = []
        self.hashes: list[bytes] = []
        self.fresh: list[bool] = []
        self.unsigned: list[str] = []
        self.held = 0
        self.keys: list[np.ndarray] = []

    def sign(self, line: str | None = None) -> None:
        if line is not None:
            self.unsigned.append(line)
            self.held += len(line)
        if self.unsigned and (line is None or self.held > CHUNK_CHARS):
            self.keys.append(band_keys(self.unsigned))
            self.unsigned, self.held = [], 0

    def emit(self) -> pa.RecordBatch:
        self.sign()
        doc, t, number = zip(*self.places)
        h = _longs(self.hashes)
        ends = np.concatenate(([0], np.cumsum(np.where(self.fresh, BANDS, 0)))).astype(np.int32)
        keys = np.concatenate(self.keys).view(np.int64).ravel() if self.keys else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(doc, pa.int64()), pa.array(t, pa.int64()), pa.array(number, pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys))],
            ["doc_id", "t", "line_no", "h1", "h2", "keys"],
        )


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every line that is not blank; keys where the task does not remember the line."""
    seen: set[bytes] = set()
    out = _Batch()
    for b in batches:
        for doc, t, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            for i, line, h in _lines(text.as_py()):
                new = h not in seen
                if new:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(h)
                    out.sign(line)
                out.places.append((doc, t, i))
                out.hashes.append(h)
                out.fresh.append(new)
                if len(out.places) >= BATCH_LINES:
                    yield out.emit()
                    out = _Batch()
    if out.places:
        yield out.emit()


def _fetch(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(h1, h2, line) of lines whose first hash may be wanted, each once while remembered."""
    seen: set[bytes] = set()
    for b in batches:
        lines: list[str] = []
        hashes: list[bytes] = []
        for text in b.column(0):
            for _, line, h in _lines(text.as_py()):
                lines.append(line)
                hashes.append(h)
            if len(lines) >= BATCH_LINES:
                yield from _wanted(lines, hashes, bits, seen)
                lines, hashes = [], []
        if lines:
            yield from _wanted(lines, hashes, bits, seen)


def _wanted(lines: list[str], hashes: list[bytes], bits: np.ndarray, seen: set[bytes]) -> Iterator[pa.RecordBatch]:
    if len(seen) >= SEEN:
        seen.clear()
    found = []
    for i in np.flatnonzero(set_bits(_longs(hashes)[:, 0], bits)).tolist():
        if hashes[i] not in seen:
            seen.add(hashes[i])
            found.append(i)
    if found:
        h = _longs([hashes[i] for i in found])
        yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array([lines[i] for i in found], pa.string())], ["h1", "h2", "line"])


def text_key(text: str = "text"):
    """Tells texts of one id apart."""
    return F.xxhash64(F.col(text).cast("string"))


def line_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, t, line_no, h1, h2, keys) of every line that is not blank, written once.

    ``keys`` is empty where the same task signed an equal line.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_key(text).alias("t"), F.col(text).cast("string").alias("text"))
    return stored(rows.mapInArrow(_split, "doc_id long, t long, line_no int, h1 long, h2 long, keys array<long>"), "lines")


def _candidates(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (h1, h2, keys) of which a key may be shared, and those keys."""
    for b in batches:
        keys = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
        hit = set_bits(keys, bits)
        some = hit.any(axis=1)
        if not some.any():
            continue
        kept = b.filter(pa.array(some))
        hit, keys = hit[some], keys[some]
        ends = np.concatenate(([0], np.cumsum(hit.sum(axis=1)))).astype(np.int32)
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[hit]))], ["h1", "h2", "keys", "shared"])


def _encoded(lines: list[str]) -> list[np.ndarray] | None:
    """The lines as bytes, one a character, or None where they hold over 256 characters."""
    try:
        raw = [x.encode("latin-1") for x in lines]
    except UnicodeEncodeError:
        alphabet = sorted(set().union(*lines))
        if len(alphabet) > 256:
            return None
        code = {ord(c): i for i, c in enumerate(alphabet)}
        raw = [x.translate(code).encode("latin-1") for x in lines]
    return [np.frombuffer(x, np.uint8) for x in raw]


class _Sets:
    """Shingle sets of the lines of one group, made when asked for.

    Eight one-byte characters are a number of 64 bits, so sets are sorted arrays and
    stay exact. Groups with more characters use sets of strings.
    """

    def __init__(self, lines: list[str]):
        self.lines, self.raw, self.made = lines, None, {}

    def get(self, i: int):
        own = self.made.get(i)
        if own is None:
            if self.raw is None:
                self.raw = _encoded(self.lines) or False
            if self.raw:
                x = self.raw[i]
                own = np.sort(np.ndarray((max(0, len(x) - SHINGLE_CHARS + 1),), "<u8", x, strides=(1,)))
                own = own[np.concatenate((own[:1] == own[:1], own[1:] != own[:-1]))]
            else:
                own = shingles(self.lines[i])
            self.made[i] = own
        return own

    def alike(self, i: int, j: int) -> bool:
        a, b = self.get(i), self.get(j)
        n, m = len(a), len(b)
        if min(n, m) < THRESHOLD * max(n, m):
            return False
        if self.raw:
            both = np.concatenate((a, b))
            both.sort()
            shared = int(np.count_nonzero(both[1:] == both[:-1]))
        else:
            shared = len(a & b)
        return shared >= THRESHOLD * (n + m - shared)


def _verify(groups: Iterator[tuple[pa.Table, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Links within groups; a pair is verified under the first band that it shares."""
    for whole, starts in groups:
        ids, texts, key = whole.column("id").to_numpy(), whole.column("line").to_pylist(), whole.column("key").to_numpy()
        keys = whole.column("keys").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        blk, diag = whole.column("blk").to_numpy(), whole.column("diag").to_numpy()
        band = np.argmax(keys == key[:, None], axis=1)
        chars = np.array([len(t) for t in texts])
        links: list[tuple[int, int]] = []
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
            if hi - lo == 2:
                b = band[lo]
                if b and (keys[lo, :b] == keys[lo + 1, :b]).any():
                    continue
            sets = _Sets(texts[lo:hi])
            part = np.arange(hi - lo)
            for i in range(hi - lo - 1):
                x = lo + i
                open_ = part[i + 1 :] != part[i]
                if not open_.any():
                    continue
                if not diag[x]:
                    open_ &= blk[x + 1 : hi] != blk[x]
                if band[lo]:
                    open_ &= ~(keys[x + 1 : hi, : band[lo]] == keys[x, : band[lo]]).any(axis=1)
                if chars[x] < SHINGLE_CHARS:
                    continue  # its own only shingle, which no other line has
                for j in (np.flatnonzero(open_) + i + 1).tolist():
                    if part[i] != part[j] and chars[lo + j] >= SHINGLE_CHARS and sets.alike(i, j):
                        links.append((int(ids[x]), int(ids[lo + j])))
                        part[part == part[j]] = part[i]
        if links:
            a, b = np.array(links, np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["src", "dst"])


def line_components(lines: DataFrame, texts: DataFrame) -> DataFrame:
    """(h1, h2, comp): components of different lines that are alike; others are absent.

    ``lines`` is the ``line_table`` of the one column of ``texts``.
    """
    spark = lines.sparkSession
    signed = lines.where(F.size("keys") > 0).select("h1", "h2", "keys")
    posted = signed.select("h1", F.explode("keys").alias("key")).repartition("key")
    shared = posted.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select(F.col("key").alias("v"))
    keys = spark.sparkContext.broadcast(bitmap(shared))
    near = signed.mapInArrow(lambda it: _candidates(it, keys.value), "h1 long, h2 long, keys array<long>, shared array<long>")
    near = cut(near.groupBy("h1", "h2").agg(F.first("keys").alias("keys"), F.first("shared").alias("shared")))
    wanted = spark.sparkContext.broadcast(bitmap(near.select(F.col("h1").alias("v"))))
    found = texts.mapInArrow(lambda it: _fetch(it, wanted.value), "h1 long, h2 long, line string")
    named = found.groupBy("h1", "h2").agg(F.first("line").alias("line")).join(near, ["h1", "h2"])
    named = cut(named.withColumn("id", F.monotonically_increasing_id()))
    rows = named.select("id", "line", "keys", F.explode("shared").alias("key"))
    links = link_groups(rows, ["key"], "id", _verify, block_rows=2048)
    comps = connected_components(links)
    return named.select("id", "h1", "h2").join(comps, "id").select("h1", "h2", F.col("component_id").alias("comp"))


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, t, line_nos): the lines to drop from each text that has any.

    Of all lines that are equal or alike, directly or through others, the first by
    (document id, text hash ``t``, line number) stays. Blank lines are no lines. Lines
    of documents with a null id are neither dropped nor kept for others. Repeated rows
    of one id and text count as one document; texts that share an id are cut each by
    its own lines. Empty input gives an empty table.
    """
    known = docs.where(F.col(doc_id).isNotNull())
    lines = line_table(known, doc_id, text)
    comps = cut(line_components(lines, known.select(F.col(text).cast("string").alias("text"))))
    places = lines.select("doc_id", "t", "line_no", "h1", "h2")
    place = F.struct("doc_id", "t", "line_no")
    nodes = places.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    nodes = nodes.join(comps, ["h1", "h2"], "left").where("comp IS NOT NULL OR first <> last")
    alone = nodes.where("comp IS NULL").select("h1", "h2", F.col("first").alias("keeper"))
    firsts = nodes.where("comp IS NOT NULL").groupBy("comp").agg(F.min("first").alias("keeper"))
    grouped = nodes.where("comp IS NOT NULL").join(firsts, "comp").select("h1", "h2", "keeper")
    keepers = cut(alone.unionByName(grouped))
    dropped = places.join(keepers, ["h1", "h2"]).where(F.col("keeper") != place)
    return dropped.groupBy("doc_id", "t").agg(F.array_sort(F.collect_set("line_no")).alias("line_nos"))


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated lines taken out of the text; all rows and columns stay.

    A text whose lines all repeat becomes empty; null stays null.
    """
    cuts = repeated_lines(docs, doc_id, text).select(
        F.col("doc_id").alias("__cut_id"), F.col("t").alias("__cut_text"), F.map_from_entries(F.transform("line_nos", lambda i: F.struct(i, F.lit(True)))).alias("__cut")
    )
    joined = docs.join(cuts, (docs[doc_id] == cuts["__cut_id"]) & (text_key(text) == cuts["__cut_text"]), "left")
    kept = F.filter(F.split(F.col(text), "\n", -1), lambda line, i: F.try_element_at(F.col("__cut"), i).isNull())
    return joined.withColumn(text, F.when(F.col("__cut").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).select(*docs.columns)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", text_key().alias("t"), F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).alias("n_lines"))
    cuts = repeated_lines(docs).withColumnsRenamed({"doc_id": "cut_id", "t": "cut_text"})
    out = lines.join(cuts, (F.col("doc_id") == F.col("cut_id")) & (F.col("t") == F.col("cut_text")), "left")
    return out.select("doc_id", "n_lines", F.coalesce(F.size("line_nos"), F.lit(0)).alias("n_removed"), F.coalesce("line_nos", F.array().cast("array<int>")).alias("removed_lines"))
