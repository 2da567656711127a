"""Operator 9: benchmark decontamination by MinHash containment search.

A short test item inside a long document has a tiny Jaccard similarity to it, so
the search works on containment |item & document| / |item| instead. Items are
partitioned by their number of distinct shingles; the signature of a partition
holds the smallest hashes of an item, as many as its largest member needs so that
an item of which at least ``threshold`` lies in a document cannot have all of its
signature outside that document: n - ceil(threshold * n) + 1. Documents look up
their shingle hashes in the signatures of each partition whose items they are long
enough to hold; every hit is verified by the exact
containment of the shingles themselves, so the result has neither misses nor
false hits.

Items are broadcast in blocks of a checked size, one pass over the documents for
each block; documents are never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

#: UTF-8 bytes of item text that one broadcast block may hold, on average; as sets of
#: shingles they take some twenty times that in each worker.
BLOCK_BYTES = 4 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case."""
    return (text or b"").lower().split()


def shingles_of(words: list[bytes], k: int) -> set[bytes]:
    return {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set()


def signature_size(n: int, threshold: float) -> int:
    """Hashes that an item of ``n`` shingles needs so that none is missed."""
    return n - math.ceil(threshold * n - 1e-9) + 1


def _word_hashes(words: list[bytes], seen: dict[bytes, int]) -> np.ndarray:
    out = np.empty(len(words), np.uint64)
    digest = xxhash.xxh3_64_intdigest
    for i, w in enumerate(words):
        h = seen.get(w)
        if h is None:
            h = seen[w] = digest(w)
        out[i] = h
    return out


def _shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash for each run of ``k`` words, in order."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = hashes[:n].copy()
    for j in range(1, k):
        acc = (acc ^ (acc >> np.uint64(29))) * _MIX + hashes[j : j + n]
    return acc ^ (acc >> np.uint64(32))


def _index(items: list[tuple[int, bytes | None]], k_words: int, threshold: float) -> dict:
    """Per shingle length a list of size partitions: (least shared shingles, sorted signature hashes, their items)."""
    sizes: dict[int, list] = {}
    for item_id, text in items:
        words = words_of(text)
        k = min(k_words, len(words))
        if k:
            sizes.setdefault(k, []).append((item_id, words, shingles_of(words, k)))
    index = {}
    for k, members in sizes.items():
        parts: dict[int, list] = {}
        for m in members:
            parts.setdefault(len(m[2]).bit_length(), []).append(m)
        index[k] = []
        for part in parts.values():
            most = max(signature_size(len(m[2]), threshold) for m in part)
            least = min(math.ceil(threshold * len(m[2]) - 1e-9) for m in part)
            hashes, owners = [], []
            for item_id, words, sh in part:
                h = np.unique(_shingle_hashes(_word_hashes(words, {}), k))[:most]
                hashes.append(h)
                owners.extend([(item_id, sh)] * len(h))
            h = np.concatenate(hashes)
            order = np.argsort(h, kind="stable")
            index[k].append((least, h[order], [owners[i] for i in order]))
    return index


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    k_words: int = 5,
    threshold: float = 0.8,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles): items held by a document.

    A row for each pair in which at least ``threshold`` of the item's distinct
    ``k_words``-word shingles occur in the document. Items with fewer words count
    as one shingle of their own length; null or empty items and documents match
    nothing. Repeated rows give repeated pairs. Null ids are carried as null. Empty
    inputs give an empty table. Other columns are ignored.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    wanted = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("binary").alias("text"))
    n_bytes = wanted.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    blocks = max(1, math.ceil(n_bytes / block_bytes))
    found = None
    for i in range(blocks):
        block = wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i)
        index = spark.sparkContext.broadcast(_index([(r["item_id"], r["text"]) for r in block.collect()], k_words, threshold))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            seen: dict[bytes, int] = {}
            for b in batches:
                out: list[tuple] = []
                for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                    if len(seen) > 500_000:
                        seen.clear()
                    _search(d, words_of(t.as_py()), index.value, threshold, seen, out)
                if out:
                    cols = list(zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "n_shared", "n_shingles"])

        part = source.mapInArrow(run, "doc_id long, item_id long, n_shared long, n_shingles long")
        found = part if found is None else found.unionByName(part)
    return found


def _search(doc, words, index, threshold, seen, out) -> None:
    if not words:
        return
    hashes = _word_hashes(words, seen)
    for k, parts in index.items():
        own = _shingle_hashes(hashes, k)
        if not len(own):
            continue
        own = np.unique(own)
        candidates: dict[int, tuple] = {}
        for least, signature, owners in parts:
            if len(own) < least:
                continue  # too short for any item of this size
            at = np.minimum(np.searchsorted(signature, own), len(signature) - 1)
            hit = own[signature[at] == own]
            if len(hit):
                lo, hi = np.searchsorted(signature, hit, "left"), np.searchsorted(signature, hit, "right")
                candidates |= {id(owners[j]): owners[j] for a, b in zip(lo, hi) for j in range(a, b)}
        if not candidates:
            continue
        mine = shingles_of(words, k)
        for item_id, sh in candidates.values():
            shared = len(sh & mine)
            if shared >= threshold * len(sh) - 1e-9:
                out.append((doc, item_id, shared, len(sh)))


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that contain an item; all columns stay.

    Documents with a null id are kept.
    """
    key = options.get("doc_id", "doc_id")
    bad = contained_items(docs, items, **options).select(F.col("doc_id").alias("__leaked")).where("__leaked IS NOT NULL").distinct()
    return docs.join(bad, docs[key] == bad["__leaked"], "left_anti")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("containment", F.round(F.col("n_shared") / F.col("n_shingles"), 6))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM benchmark
), ix AS (
  SELECT item_id, w, least(5, len(w)) AS k FROM i WHERE len(w) > 0
), ish AS (
  SELECT DISTINCT item_id, k, array_to_string(w[p : p + k - 1], ' ') AS s
  FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM ix)
), n AS (
  SELECT item_id, count(*) AS n_shingles FROM ish GROUP BY item_id
), ks AS (
  SELECT DISTINCT k FROM ix
), dsh AS (
  SELECT DISTINCT doc_id, k, array_to_string(w[p : p + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d CROSS JOIN ks WHERE len(w) >= k)
), hit AS (
  SELECT dsh.doc_id, ish.item_id, count(*) AS n_shared FROM dsh JOIN ish USING (k, s) GROUP BY ALL
)
SELECT doc_id, item_id, n_shared, n_shingles, round(n_shared / n_shingles, 6) AS containment
FROM hit JOIN n USING (item_id) WHERE n_shared >= 0.8 * n_shingles - 1e-9
"""
