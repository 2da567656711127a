"""Operator 3: embedding near-duplicates by iterative quantisation.

Rotations are learned on a bounded, seeded sample: vectors are centred, projected on
principal axes and rotated so that the signs of the projections quantise them with
the least error (ITQ alternates between signs and the orthogonal Procrustes
rotation), which balances the bits. Several rotations from different starts give one
long binary code, cut into disjoint substrings, one Hamming table for each. Vectors
that agree in a substring meet in that table's bucket.

Substrings have as many bits as keep buckets at ``BUCKET_ROWS`` vectors on average,
whatever the number of vectors, and tables are as many as let 98 per cent of pairs at
the least cosine meet: on pairs made from the sample in random directions and between
sample vectors, and on the sample's own. Centring turns pairs of off-centre vectors
further apart; where the most tables do not reach that share, substrings get shorter,
and if that leaves too few bits to save comparisons, all pairs are compared.

Postings carry codes, not vectors: in a bucket, pairs whose sketches (bits of the same
code) are near enough, again by the sample, are candidates. Only vectors with a
candidate go to the rerank of their bucket, which takes the original vectors in double
precision, so no wrong link is kept. A pair is counted in the first table in which it
meets.

All rows are indexed; vectors of a length that few have are compared directly, all such
lengths in one pass. Equal vectors are one entry with a count. Buckets are compared
as blocks; only counts per vector and the links that join two parts leave a task, and
hot buckets are dealt out as block pairs. Vectors travel as they are stored (float
components as 4 bytes) and are normalised in double precision where they are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import Forest, connected_components, cut, map_groups, pairs_of_groups, table

SAMPLE_ROWS = 10_000
#: Vectors of a bucket on average, and the most Hamming tables and bits of a substring.
#: At cosine 0.95 a bit of centred vectors agrees with 0.9, so 8 bits need 8 tables, 16 bits 20.
BUCKET_ROWS, TABLES, TABLE_BITS = 512, 40, 28
#: Bits of a sketch, and the share of pairs at the least cosine whose sketches must be near enough.
SKETCH_BITS, SKETCH_RECALL = 256, 0.999
#: Share of pairs at the least cosine that meet, and sample pairs to measure it on.
LEAST_RECALL, TRIAL_PAIRS = 0.98, 4000
#: Vectors of one length that are compared with each other without codes; lengths with more are indexed, so many in one plan.
DIRECT_ROWS, LENGTHS_AT_ONCE = 256, 8


def learn_rotations(sample: np.ndarray, bits: int, seed: int = 5, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection of ``bits`` columns) by ITQ, several rotations side by side."""
    mean = sample.mean(0)
    x = sample - mean
    d = x.shape[1]
    _, axes = np.linalg.eigh(x.T @ x / max(1, len(x)) + 1e-12 * np.eye(d))
    axes = axes[:, ::-1]
    rng = np.random.default_rng(seed)
    v = x @ axes
    out = []
    while sum(o.shape[1] for o in out) < bits:
        r, _ = np.linalg.qr(rng.standard_normal((d, d)))
        for _ in range(rounds):
            u, _, wt = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ wt).T
        out.append(axes @ r)
    return mean, np.hstack(out)[:, :bits]


def trial_pairs(sample: np.ndarray, least_cosine: float, seed: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sets of pairs of unit vectors at or just above ``least_cosine``, of 100 pairs or more each."""
    rng = np.random.default_rng(seed)
    n = len(sample)
    side = np.sqrt(max(0.0, 1 - least_cosine**2))
    u = sample[rng.integers(0, n, TRIAL_PAIRS)]
    trials = []
    for w in (rng.standard_normal(u.shape), sample[rng.integers(0, n, TRIAL_PAIRS)] - sample[rng.integers(0, n, TRIAL_PAIRS)]):
        w = w - (w * u).sum(1)[:, None] * u
        norm = np.linalg.norm(w, axis=1)
        some = norm > 1e-6
        trials.append((u[some], least_cosine * u[some] + side * w[some] / norm[some, None]))
    own: list[tuple[np.ndarray, np.ndarray]] = []
    for a in range(0, n, 512):
        cosine = sample[a : a + 512] @ sample[a:].T
        i, j = np.nonzero((cosine >= least_cosine) & (cosine < least_cosine + 0.2 * (1 - least_cosine)))
        own.append((i[j > i] + a, j[j > i] + a))
        if sum(len(i) for i, _ in own) >= TRIAL_PAIRS:
            break
    i, j = (np.concatenate(x)[:TRIAL_PAIRS] for x in zip(*own))
    trials.append((sample[i], sample[j]))
    return [t for t in trials if len(t[0]) >= 100]


def fitting_tables(same: list[np.ndarray], most_tables: int, most_bits: int) -> tuple[int, int]:
    """(tables, bits of a substring) with which the pairs meet.

    ``same`` holds per set of pairs the bits that agree, ``most_tables`` substrings of
    ``most_bits`` each. Bits are kept as long as the tables suffice.
    """
    bits, lead = most_bits, []
    for x in same:
        lead.append(np.cumprod(x.reshape(len(x), most_tables, most_bits), axis=2).sum(2))  # leading bits that agree
        bits = min(bits, int(np.quantile(lead[-1].max(1), 1 - LEAST_RECALL, method="lower")))
    tables = 1
    for x in lead:
        met = np.maximum.accumulate(x >= bits, axis=1).mean(0)
        tables = max(tables, int(np.argmax(met >= LEAST_RECALL)) + 1 if met[-1] >= LEAST_RECALL else most_tables)
    return tables, bits


def _floats(vectors: DataFrame, embedding: str) -> bool:
    kind = vectors.schema[embedding].dataType
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows at length one, in double precision; very large components do not overflow."""
    v = v.astype(float)
    v = v / np.abs(v).max(1)[:, None]
    return v / np.linalg.norm(v, axis=1)[:, None]


def unit_vectors(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, usable, v): v has a usable vector's components, raw, as floats if stored so, else as doubles."""
    e = F.col(embedding)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), e.cast("array<float>" if _floats(vectors, embedding) else "array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("v", lambda x: x != 0)
    return rows.withColumn("usable", F.coalesce(F.col("v").isNotNull() & ~bad & some, F.lit(False)))


def near_vectors(
    vectors: DataFrame,
    *,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    least_cosine: float = 0.95,
    tables: int = TABLES,
    bucket_rows: int = BUCKET_ROWS,
    sample_rows: int = SAMPLE_ROWS,
    direct_rows: int = DIRECT_ROWS,
    seed: int = 5,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row.

    Null or zero vectors and vectors with null or non-finite components link with
    nothing; vectors of different lengths do not link. Every row is a vector of its
    own: rows with equal vectors link with each other, also under one id, and each
    counts in ``n_links`` of the others. Empty input gives an empty table. Other
    columns are ignored.
    """
    spark = vectors.sparkSession
    rows = cut(unit_vectors(vectors, vec_id, embedding).withColumn("vh", F.when(F.col("usable"), F.sha2(F.array_join(F.transform("v", lambda x: x.cast("string")), ","), 256))))
    reps = cut(
        rows.where("usable").groupBy("vh").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
        .withColumn("rep_key", F.monotonically_increasing_id())
    )
    large = F.col("n") > direct_rows
    sizes = reps.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.collect_list(F.when(large, F.struct("d", "n")))).alias("counts"), F.count(F.when(~large, 1)).alias("small")).first()
    width = "<f4" if _floats(vectors, embedding) else "<f8"
    found = []
    if sizes["small"]:
        own = reps.where(~F.size("v").isin(sorted(sizes["counts"]))) if sizes["counts"] else reps
        found.append(_met(_post_all(own, width), least_cosine, width, "<u2"))
    for d in sorted(sizes["counts"]):
        own = reps.where(F.size("v") == d)
        sample = np.array([r["v"] for r in own.orderBy(F.xxhash64(F.lit(seed), F.col("vh"))).limit(sample_rows).select("v").collect()], float)
        found.append(_links(spark, own, _unit(sample), least_cosine, tables, bucket_rows, sizes["counts"][d], seed, width))
        if len(found) == LENGTHS_AT_ONCE:
            found = [cut(reduce(DataFrame.unionByName, found))]
    if not found:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links = cut(reduce(DataFrame.unionByName, found))  # (a, b, n): b is null in counts; n is null in links
    counts = links.where("b IS NULL").groupBy(F.col("a").alias("c_key")).agg(F.sum("n").alias("linked"))
    joins = links.where("b IS NOT NULL").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    comps = connected_components(joins)
    placed = reps.select("vh", "rep", "rep_key", "copies").join(comps, reps.rep_key == comps.id, "left").withColumn("comp", F.coalesce("component_id", "rep_key"))
    least = placed.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = (
        placed.select("vh", "rep_key", "copies", "comp").join(least, "comp")
        .join(counts, F.col("rep_key") == F.col("c_key"), "left")
        .select("vh", "component_id", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))
    )
    out = rows.select("vec_id", "vh").join(named, "vh", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def _links(spark: SparkSession, reps: DataFrame, sample: np.ndarray, least_cosine: float, tables: int, bucket_rows: int, n_vectors: int, seed: int, width: str) -> DataFrame:
    wanted = min(TABLE_BITS, max(2, math.ceil(math.log2(max(1, n_vectors / bucket_rows)))))
    mean, projection = learn_rotations(sample, max(tables * wanted, SKETCH_BITS), seed)
    trials = [(((a - mean) @ projection >= 0), ((b - mean) @ projection >= 0)) for a, b in trial_pairs(sample, least_cosine, seed)]
    used, bits = fitting_tables([(a == b)[:, : tables * wanted] for a, b in trials], tables, wanted) if trials else (tables, wanted)
    if used >= 1 << bits:
        return _met(_post_all(reps, width), least_cosine, width, "<u2")
    reach = max((int(np.quantile((a != b)[:, :SKETCH_BITS].sum(1), SKETCH_RECALL, method="higher")) for a, b in trials), default=SKETCH_BITS)
    columns = (np.arange(used)[:, None] * wanted + np.arange(bits)).ravel()
    model = spark.sparkContext.broadcast((mean, projection[:, :SKETCH_BITS], projection[:, columns]))
    weights = (1 << np.arange(bits)).astype(np.int64)
    code_width = "<u2" if bits <= 16 else "<u4"

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, sketching, coding = model.value
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            v = _unit(np.array(b.column("v").flatten().to_numpy(zero_copy_only=False), width).reshape(n, -1)) - mean
            keys = (v @ coding >= 0).reshape(n, used, bits) @ weights
            code = _fixed(keys.astype(code_width))
            sketch = _fixed(np.packbits(v @ sketching >= 0, axis=1))
            for t in range(used):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, t, np.int32)), pa.array(keys[:, t].astype(np.int32)), b.column("rep_key"), code, sketch],
                    ["tab", "bucket", "rep_key", "code", "sketch"],
                )

    def near(groups: Iterator[tuple[pa.Table, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """Members of buckets with a partner whose sketch is near and that they meet first here."""
        for whole, starts in groups:
            n = whole.num_rows
            tab, blk, diag = whole.column("tab").to_numpy(), whole.column("blk").to_numpy(), whole.column("diag").to_numpy()
            sketch = np.frombuffer(b"".join(whole.column("sketch").to_pylist()), np.uint64).reshape(n, -1)
            codes = np.frombuffer(b"".join(whole.column("code").to_pylist()), code_width).reshape(n, -1)
            some = np.zeros(n, bool)
            for i, j in pairs_of_groups(starts):
                open_ = diag[i] | (blk[i] != blk[j])
                i, j = i[open_], j[open_]
                close = np.bitwise_count(sketch[i] ^ sketch[j]).sum(1, dtype=np.int64) <= reach
                i, j = i[close], j[close]
                first = np.argmax(codes[i] == codes[j], axis=1) == tab[i]
                some[i[first]] = some[j[first]] = True
            if some.any():
                yield from whole.select(["tab", "bucket", "rep_key", "code"]).filter(pa.array(some)).combine_chunks().to_batches()

    posted = reps.select("rep_key", "v").mapInArrow(post, "tab int, bucket int, rep_key long, code binary, sketch binary")
    candidates = map_groups(posted, ["tab", "bucket"], "rep_key", near, "tab int, bucket int, rep_key long, code binary", block_rows=2048)
    candidates = cut(candidates.dropDuplicates(["tab", "rep_key"]))
    wanted_vectors = reps.select("rep_key", "copies", "v").join(candidates, "rep_key").mapInArrow(
        lambda it: _packed(it, width), "tab int, bucket int, rep_key long, copies long, code binary, vec binary"
    )
    return _met(wanted_vectors, least_cosine, width, code_width)


def _fixed(rows: np.ndarray) -> pa.Array:
    """A binary array of the rows of a matrix."""
    raw = np.ascontiguousarray(rows)
    step = raw.nbytes // max(1, len(raw))
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer((np.arange(len(raw) + 1) * step).astype(np.int32)), pa.py_buffer(raw)])


def _packed(batches: Iterator[pa.RecordBatch], width: str) -> Iterator[pa.RecordBatch]:
    """Vectors of one length as bytes."""
    for b in batches:
        if b.num_rows:
            vec = np.array(b.column("v").flatten().to_numpy(zero_copy_only=False), width).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("tab", "bucket", "rep_key", "copies", "code")), _fixed(vec)], ["tab", "bucket", "rep_key", "copies", "code", "vec"])


def _post_all(reps: DataFrame, width: str) -> DataFrame:
    """Every vector in one bucket for its length, for exact comparison."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            vec = [np.array(v, width).tobytes() for v in b.column("v").to_pylist()]
            size = np.array([len(v) // np.dtype(width).itemsize for v in vec], np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(n, np.int32)), pa.array(size), b.column("rep_key"), b.column("copies"), pa.array([b"\0\0"] * n, pa.binary()), pa.array(vec, pa.binary())],
                ["tab", "bucket", "rep_key", "copies", "code", "vec"],
            )

    return reps.select("rep_key", "copies", "v").mapInArrow(post, "tab int, bucket int, rep_key long, copies long, code binary, vec binary")


def _met(posted: DataFrame, least_cosine: float, width: str, code_width: str) -> DataFrame:
    """(a, b, n): links (n null) and counts (b null) of vectors that meet in a bucket and pass the rerank."""

    def compare(groups: Iterator[tuple[pa.Table, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for whole, starts in groups:
            n = whole.num_rows
            key, copies = whole.column("rep_key").to_numpy(), whole.column("copies").to_numpy()
            tab, blk, diag = whole.column("tab").to_numpy(), whole.column("blk").to_numpy(), whole.column("diag").to_numpy()
            vecs = whole.column("vec").to_pylist()
            alike = len({len(v) for v in vecs}) == 1
            x = _unit(np.frombuffer(b"".join(vecs), width).reshape(n, -1)) if alike else None
            codes = np.frombuffer(b"".join(whole.column("code").to_pylist()), code_width).reshape(n, -1)
            linked, forest = np.zeros(n, np.int64), Forest(n)
            for lo, hi in zip(starts[:-1], starts[1:]):
                own = x[lo:hi] if alike else _unit(np.frombuffer(b"".join(vecs[lo:hi]), width).reshape(hi - lo, -1))
                for a in range(lo, hi - 1, 512):
                    b = min(hi, a + 512)
                    i, j = np.nonzero(own[a - lo : b - lo] @ own[a - lo :].T >= least_cosine)
                    keep = j > i
                    i, j = i[keep] + a, j[keep] + a
                    if not len(i):
                        continue
                    keep = np.argmax(codes[i] == codes[j], axis=1) == tab[lo]
                    keep &= diag[i] | (blk[i] != blk[j])
                    i, j = i[keep], j[keep]
                    np.add.at(linked, i, copies[j])
                    np.add.at(linked, j, copies[i])
                    for p, q in zip(i.tolist(), j.tolist()):
                        forest.join(p, q)
            some = np.flatnonzero(linked)
            a = [key[some]] + ([key[[p for p, _ in forest.links]]] if forest.links else [])
            b = [None] * len(some) + (key[[q for _, q in forest.links]].tolist() if forest.links else [])
            counts = linked[some].tolist() + [None] * len(forest.links)
            if b:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(b, pa.int64()), pa.array(counts, pa.int64())], ["a", "b", "n"])

    return map_groups(posted, ["tab", "bucket"], "rep_key", compare, "a long, b long, n long", block_rows=2048)


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
