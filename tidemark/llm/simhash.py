"""Operator 10: SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint is eight positional bytes. Two fingerprints at distance 4 or less
differ in at most four bytes, so they share at least four positional bytes, the guaranteed
minimum of matches. Lists of single positional bytes would each hold 1/256 of all
fingerprints, lists of pairs 1/65,536; the index posts every distinct fingerprint under each of the 56
choices of three positions, so a list holds 1/16,777,216 of them and is short at any
size. For the pairs of a list the positional bytes that they share are tallied: most share
the three of the list and no other and go by the count alone, the rest are verified by the
Hamming distance of whole fingerprints. A pair that meets in several lists is linked
under the first choice that it shares.

Equal fingerprints (copies) are one entry with the smallest document id. Inside a
list only links that join two parts are kept, so a large group of near copies yields
a tree, not all its pairs; hot lists are dealt out in blocks, of which only
fingerprints outside the largest component visit each other's.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import BLOCK_ROWS, Forest, connected_components, cut, link_groups, pairs_of_groups, table
from tidemark.llm.xxh64_sql import xxh64_ctes

#: Choices of three of the eight byte positions, as bit masks; 0 is the lowest byte.
CHOICES = list(combinations(range(8), 3))
MASKS = [sum(0xFF << (8 * p) for p in c) for c in CHOICES]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes | None, shingle_words: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of UTF-8 bytes; no words give 0."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle_words:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1])).tolist()
    ends = (ends - 1).tolist()
    digest = xxhash.xxh64_digest
    k = shingle_words - 1
    votes = np.zeros(64, np.int64)
    n = len(words) - k
    for a in range(0, n, 1 << 16):  # bounded memory for very long texts
        raw = b"".join([digest(joined[s:e], seed) for s, e in zip(starts[a : min(n, a + (1 << 16))], ends[k + a :])])
        votes += np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle_words: int = 4, carried: list[str] | None = None) -> DataFrame:
    """(doc_id, fp) and the ``carried`` longs: a row per document, fp as a signed long; null text gives 0."""
    carried = carried or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle_words) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), *b.columns[2:]], ["doc_id", "fp", *carried])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"), *carried)
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in ["doc_id", "fp", *carried]))


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """Positional bytes that are zero in each of the differences ``x``."""
    return np.count_nonzero(x.view(np.uint8).reshape(-1, 8) == 0, axis=1)


def near_links(fps: DataFrame, max_bits: int = 4, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(src, dst): links that connect all distinct ``fp`` within ``max_bits`` <= 4.

    Every two fingerprints within the distance end in one component.
    """
    if max_bits > 4:
        raise ValueError("four shared bytes are guaranteed for up to 4 differing bits")
    entries = F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("posting")) for i, m in enumerate(MASKS)]))
    posted = fps.select("fp", entries.alias("e")).select(F.col("e.choice").alias("choice"), F.col("e.posting").alias("posting"), "fp")
    masks = np.array(MASKS, np.uint64)

    def run(groups: Iterator[tuple[pa.Table, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for whole, starts in groups:
            fp = whole.column("fp").to_numpy().view(np.uint64)
            choice = whole.column("choice").to_numpy()
            blk, diag = whole.column("blk").to_numpy(), whole.column("diag").to_numpy()
            forest = Forest(len(fp))
            for i, j in pairs_of_groups(starts):
                x = fp[i] ^ fp[j]
                near = np.flatnonzero((shared_bytes(x) >= 8 - max_bits) & (diag[i] | (blk[i] != blk[j])))
                near = near[np.bitwise_count(x[near]) <= max_bits]
                if not len(near):
                    continue
                i, j, x = i[near], j[near], x[near]
                first = np.argmax((x[:, None] & masks[None, :]) == 0, axis=1)  # the first choice the pair shares
                for k in np.flatnonzero(first == choice[i]):
                    forest.join(int(i[k]), int(j[k]))
            if forest.links:
                a, b = np.array(forest.links).T
                yield pa.RecordBatch.from_arrays([pa.array(fp[a].view(np.int64)), pa.array(fp[b].view(np.int64))], ["src", "dst"])

    return link_groups(posted, ["choice", "posting"], "fp", run, block_rows)


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle_words: int = 4, max_bits: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest id reachable.

    Null and empty texts have fingerprint 0 and link with each other and with any
    fingerprint near 0. Repeated rows stay repeated. A null id keeps its row with
    the component of its fingerprint. Empty input gives an empty table. Only the id
    and text columns are read, so other columns cannot clash.
    """
    fps = cut(fingerprints(docs, doc_id, text, shingle_words))
    groups = fingerprint_groups(fps, max_bits)
    return fps.join(groups, "fp").select("doc_id", "fp", "component_id")


def fingerprint_groups(fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """(fp, group, component_id) of each distinct ``fp``: its component's smallest fingerprint and id."""
    reps = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    comps = connected_components(near_links(reps.select("fp"), max_bits))
    grouped = reps.join(comps, reps.fp == comps.id, "left").select("fp", "rep", F.coalesce("component_id", "fp").alias("group"))
    least = grouped.groupBy("group").agg(F.min("rep").alias("component_id"))
    return grouped.select("fp", "group").join(least, "group").select("fp", "group", "component_id")


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component; all columns stay.

    The row with the smallest id stays, of rows with that id the one whose text and
    then whose whole row has the smallest hash. Rows that share an id but no near text
    are judged apart. Rows with a null id stay as they are.
    """
    named = docs.where(F.col(doc_id).isNotNull())
    key = F.xxhash64(F.col(text).cast("string"))
    fps = cut(fingerprints(named.withColumn("__key", key), doc_id, text, carried=["__key"]))
    placed = fps.join(fingerprint_groups(fps), "fp")
    kept = placed.groupBy("group").agg(F.min(F.struct("doc_id", "__key")).alias("one")).select(F.col("one.doc_id").alias("__kept"), F.col("one.__key").alias("__text")).distinct()
    rows = named.join(kept, (named[doc_id] == kept["__kept"]) & (key == kept["__text"]))
    whole = F.struct(*[named[c] for c in named.columns])
    one = rows.groupBy("__kept", "__text").agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias("__row")).select("__row.*")
    return one.unionByName(docs.where(F.col(doc_id).isNull()))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: DuckDB: fingerprints bit by bit, all pairs of distinct fingerprints, and what is reachable over them.
OP10_SQL = (
    r"""WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT r, array_to_string(w[p : p + 3], ' ') AS s FROM (SELECT r, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS p FROM d WHERE len(w) > 0)
), ds AS MATERIALIZED (SELECT DISTINCT s FROM sh), """
    + xxh64_ctes("ds", 42)
    + ", votes AS (SELECT r, count(*) AS n, "
    + ", ".join(f"sum(((h >> {b}) & 1)::INT) AS b{b}" for b in range(64))
    + " FROM sh JOIN xx USING (s) GROUP BY r), fps AS MATERIALIZED (SELECT doc_id, coalesce(fp, 0::UBIGINT) AS fp FROM d LEFT JOIN (SELECT r, ("
    + " + ".join(f"CASE WHEN b{b} * 2 > n THEN {2**b}::UHUGEINT ELSE 0::UHUGEINT END" for b in range(64))
    + """)::UBIGINT AS fp FROM votes) USING (r)
), nodes AS MATERIALIZED (SELECT fp, min(doc_id) AS least FROM fps GROUP BY fp
), edges AS MATERIALIZED (SELECT x.fp AS a, y.fp AS b FROM nodes x JOIN nodes y ON bit_count(xor(x.fp, y.fp)::BIT) <= 4
), reach AS (SELECT a, b FROM edges UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a
), comp AS (SELECT a AS fp, min(least) AS component_id FROM reach JOIN nodes ON nodes.fp = reach.b GROUP BY a)
SELECT doc_id, lpad(lower(to_hex(fp)), 16, '0') AS fingerprint, component_id FROM fps JOIN comp USING (fp)
"""
)
