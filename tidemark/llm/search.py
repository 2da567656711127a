"""Operator 13: ranked lexical search by reversed search.

The items are the small side, so they are indexed and the corpus streams past them:
an inverted index over the items' terms is broadcast, every task walks its documents'
term counts through it and keeps a bounded heap of the best documents for each item,
and the heaps are merged, first within groups of tasks, then whole.

A first pass counts terms, documents and the documents of each item term; it writes
what a document shares with the items (term numbers and counts), so texts are read
and cut into terms once for each block of items. Items are dealt into blocks whose postings
are counted before they are collected; a block holds at most ``postings`` of them,
unless one item alone has more.

Scores are whole numbers: a document's length counts relative to the mean length, a
term's weight falls with the documents that hold it, and its occurrences saturate.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored, table

#: Postings (item, term) of one broadcast block: some 100 MB in a worker.
BLOCK_POSTINGS = 1_000_000
#: Groups of tasks whose heaps are merged first.
MERGE_GROUPS = 256
#: Numbers that one step of the score sums may hold.
STEP_CELLS = 1 << 21
#: Bytes that end a term become blanks, A-Z become a-z; all bytes of other scripts stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Sums of scores are exact in doubles below this.
_EXACT = 1 << 53


def terms_of(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all other scripts' characters, A-Z in lower case."""
    return (text or b"").translate(_FOLD).split()


def term_weight(documents: int, holding: int) -> int:
    """floor(1000 ln((2 N + 2) / (2 df + 1)))."""
    return math.floor(1000 * math.log((2.0 * documents + 2) / (2.0 * holding + 1)))


def length_part(terms: int, documents: int, all_terms: int) -> int:
    """The part m of a document's length in its score, 100 for one of the mean length."""
    return 100 - 75 + 75 * terms * documents // all_terms


def _item_terms(items: DataFrame) -> DataFrame:
    """(item_id, tag, term, n): terms of the distinct (item_id, text); ``tag`` tells texts of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, tag, text in zip(b.column(0), b.column(1), b.column(2)):
                counts = Counter(terms_of(text.as_py()))
                n = len(counts)
                cols = [pa.array([i.as_py()] * n, pa.int64()), pa.array([tag.as_py()] * n, pa.string()), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["item_id", "tag", "term", "n"])

    tagged = items.withColumn("tag", F.md5("text")).select("item_id", "tag", "text").distinct()
    return tagged.mapInArrow(run, "item_id long, tag string, term binary, n long")


def _blocks(terms: DataFrame, most: int) -> tuple[DataFrame, int]:
    """``terms`` with ``block``, and the number of blocks: each of ``most`` postings at most, or one item alone."""
    total = terms.count()
    n = 1 if total <= most else math.ceil(2 * total / most)
    while True:
        dealt = terms.withColumn("block", F.pmod(F.xxhash64("item_id", "tag"), F.lit(n)))
        if n == 1:
            return dealt, n
        of_items = dealt.groupBy("block", "item_id", "tag").agg(F.count(F.lit(1)).alias("p"))
        over = of_items.groupBy("block").agg(F.sum("p").alias("p"), F.count(F.lit(1)).alias("items")).where((F.col("p") > most) & (F.col("items") > 1))
        if over.limit(1).count() == 0:
            return dealt, n
        n *= 2


class ItemIndex:
    """The inverted index of one block: for each term the items that hold it, and how often."""

    def __init__(self, rows: list[tuple[int | None, str, bytes, int]]):
        self.items = sorted({(r[0] is None, r[0] or 0, r[1]) for r in rows})
        self.terms = {t: i for i, t in enumerate(sorted({r[2] for r in rows}))}
        at = {x: i for i, x in enumerate(self.items)}
        term = np.array([self.terms[r[2]] for r in rows], np.int64)
        item = np.array([at[r[0] is None, r[0] or 0, r[1]] for r in rows], np.int64)
        order = np.lexsort((item, term))
        self.item, self.n = item[order], np.array([r[3] for r in rows], np.int64)[order]
        self.start = np.searchsorted(term[order], np.arange(len(self.terms) + 1))
        #: the largest sum of repeats over an item's terms
        self.most = int(np.bincount(item, np.array([r[3] for r in rows], float)).max()) if rows else 0


class Heaps:
    """The ``k`` best (score, doc_id) of each item; ties go to the smaller id, null ids last."""

    def __init__(self, k: int, items: int):
        self.k = k
        self.least = np.ones(items, np.int64)  # a score below it cannot enter
        self.rows = tuple(np.empty(0, t) for t in (np.int64, np.int64, bool, np.int64))  # item, score, null, id

    def offer(self, item: np.ndarray, score: np.ndarray, null: np.ndarray, doc: np.ndarray) -> None:
        fit = score >= self.least[item]
        if not fit.any():
            return
        rows = [np.concatenate(x) for x in zip(self.rows, (item[fit], score[fit], null[fit], doc[fit]))]
        order = np.lexsort((rows[3], rows[2], -rows[1], rows[0]))
        rows = [x[order] for x in rows]
        first = np.searchsorted(rows[0], rows[0])  # where the row's item starts
        rank = np.arange(len(order)) - first
        full = rank == self.k - 1
        self.least[rows[0][full]] = rows[1][full]
        self.rows = tuple(x[rank < self.k] for x in rows)


def _shared_terms(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts): each document's number of terms, and those that items hold."""
    known = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value
        for b in batches:
            n, size, term, count = [], [], [], []
            for t in b.column(1):
                own = terms_of(t.as_py())
                held = [(number[w], c) for w, c in Counter(own).items() if w in number]
                n.append(len(own))
                size.append(len(held))
                term += [x[0] for x in held]
                count += [x[1] for x in held]
            ends = pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(term, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(count, pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])

    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<long>")


def _best_of_block(docs: DataFrame, rows: list, k: int) -> DataFrame:
    """(item_id, tag, score, doc_id, part): the heaps of every task."""
    spark = docs.sparkSession
    index = ItemIndex(rows)
    shared = stored(_shared_terms(docs, index.terms), "search-terms")
    sizes = shared.agg(F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.sum("n").alias("terms")).first()
    documents, all_terms = int(sizes["documents"]), int(sizes["terms"] or 0)
    held = shared.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()  # at most a row for each term of the block
    weight = np.full(len(index.terms), term_weight(documents, 0), np.int64)
    for term, df in held:
        weight[term] = term_weight(documents, df)
    carried = spark.sparkContext.broadcast((index, weight))
    wide = int(weight.max(initial=0)) * 1_000_000 * max(index.most, 1) >= _EXACT  # a score holds at most a million weights a term

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, weight = carried.value
        heaps = Heaps(k, len(index.items))
        for b in batches:
            _walk(b, index, weight, documents, all_terms, heaps, wide)
        item, score, null, doc = heaps.rows
        names = [index.items[i] for i in item.tolist()]
        cols = [
            pa.array([None if x[0] else x[1] for x in names], pa.int64()), pa.array([x[2] for x in names], pa.string()), pa.array(score),
            pa.array([None if x else d for x, d in zip(null.tolist(), doc.tolist())], pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(cols, ["item_id", "tag", "score", "doc_id"])

    found = shared.where(F.size("terms") > 0).mapInArrow(run, "item_id long, tag string, score long, doc_id long")
    return found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)))


def _walk(b: pa.RecordBatch, index: ItemIndex, weight: np.ndarray, documents: int, all_terms: int, heaps: Heaps, wide: bool) -> None:
    """Score the documents of a batch against all items of the block, some documents at a time."""
    lists = b.column(2).flatten().to_numpy(zero_copy_only=False)
    counts = b.column(3).flatten().to_numpy(zero_copy_only=False)
    ends = np.concatenate(([0], np.cumsum(b.column(2).value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
    null = b.column(0).is_null().to_numpy(zero_copy_only=False)
    ids = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)
    m = np.array([length_part(n, documents, all_terms) for n in b.column(1).to_pylist()], np.int64)
    doc = np.repeat(np.arange(len(ids)), np.diff(ends))
    part = weight[lists] * ((1_000_000_000 * counts) // (1000 * counts + 8 * m[doc]))
    size = index.start[lists + 1] - index.start[lists]
    work = np.concatenate(([0], np.cumsum(size)))[ends]  # postings before each document
    n_items, a = len(index.items), 0
    while a < len(ids):
        step = min(len(ids), a + max(1, STEP_CELLS // max(1, n_items)))
        z = max(a + 1, min(step, int(np.searchsorted(work, work[a] + STEP_CELLS, "right")) - 1))
        lo, hi = ends[a], ends[z]
        own = size[lo:hi]
        at = np.arange(own.sum()) + np.repeat(index.start[lists[lo:hi]] - np.concatenate(([0], np.cumsum(own)[:-1])), own)
        cell = np.repeat(doc[lo:hi] - a, own) * n_items + index.item[at]
        add = np.repeat(part[lo:hi], own) * index.n[at]
        if wide:
            score = np.zeros((z - a) * n_items, np.int64)
            np.add.at(score, cell, add)
        else:
            score = np.bincount(cell, add, (z - a) * n_items).astype(np.int64)
        score = score.reshape(z - a, n_items)
        d, i = np.nonzero(score >= heaps.least)
        if len(d):
            heaps.offer(i, score[d, i], null[a + d], ids[a + d])
        a = z


def search(
    docs: DataFrame, items: DataFrame, *, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    postings: int = BLOCK_POSTINGS,
) -> DataFrame:
    """(item_id, tag, rank, doc_id, score): the ``k`` best documents of each item, score above 0.

    Every row of ``docs`` is a document of its own, ids that repeat included, and counts
    in the statistics. Equal scores are ordered by ascending doc_id, null ids last. Items
    are the distinct pairs of id and text: rows that repeat one give one list, an id with
    several texts a list for each, told apart by ``tag`` (the text's MD5). Null or empty
    texts have no terms and match nothing. Empty inputs give an empty table. Other
    columns are ignored.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    wanted = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("binary").alias("text")).where("text IS NOT NULL")
    terms = stored(_item_terms(wanted), "search-items")
    dealt, n = _blocks(terms, postings)
    found = None
    for i in range(n):
        rows = [tuple(r) for r in dealt.where(F.col("block") == i).select("item_id", "tag", "term", "n").collect()]
        if not rows and (found is not None or i < n - 1):
            continue
        rows = [(r[0], r[1], bytes(r[2]), r[3]) for r in rows]
        one = _best_of_block(source, rows, k)
        found = one if found is None else found.unionByName(one)
    best = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for by in (["item_id", "tag", "part"], ["item_id", "tag"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*best))).where(F.col("rank") <= k)
    return found.select("item_id", "tag", "rank", "doc_id", "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", "doc_id", "score")


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), i AS (
  SELECT DISTINCT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms, text
  FROM benchmark
), q AS (
  SELECT item_id, text, unnest(terms) AS term FROM i
), lengths AS (
  SELECT doc_id, len(terms)::BIGINT AS n FROM d WHERE len(terms) > 0
), sizes AS (
  SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM lengths
), tf AS (
  SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM d) GROUP BY ALL
), df AS (
  SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term
), w AS (
  SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, sizes
), m AS (
  SELECT doc_id, 100 - 75 + (75 * n * big_n) // big_l AS m FROM lengths, sizes
), parts AS (
  SELECT tf.doc_id, tf.term, w * ((1000000000 * tf) // (1000 * tf + 8 * m)) AS part
  FROM tf JOIN w USING (term) JOIN m ON m.doc_id = tf.doc_id WHERE tf.term IN (SELECT term FROM q)
), scored AS (
  SELECT item_id, text, doc_id, sum(part)::BIGINT AS score FROM q JOIN parts USING (term) GROUP BY ALL
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""
