"""Helpers that several corpus operators share.

``cut``                  ends lineage in the shared checkpoint folder.
``map_groups``           runs a vectorised function over complete key groups,
                         splitting hot groups into block pairs.
``link_groups``          the same where only the components of the links count:
                         hot groups cost in proportion to their rows.
``bitmap``               a filter of fixed size for values that later steps want.
``connected_components`` distributed union-find over an edge table.
"""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one key that a single task compares with each other; larger groups
#: are dealt to several tasks, one for each pair of blocks.
BLOCK_ROWS = 4096
#: One row in so many is counted to see which keys may be hot; fewer than so many of a key in the sample tell nothing.
SAMPLE_ONE_IN, LEAST_SAMPLED = 64, 8
#: Keys that are broadcast at most; they are no more than rows / block rows.
MOST_SUSPECTS = 100_000
#: Bits of a filter that keeps rows from travelling in vain (16 MB).
BITMAP_BITS, BITMAP_PIECES = 1 << 27, 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one only where none is set and Spark runs on this machine."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it from there; ends its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


class Bitmap:
    """Compressed pieces of a bit array, which is what ``value`` of its broadcast is in a task; the driver never unpacks it."""

    def __init__(self, pieces: dict[int, bytes]):
        self.pieces = pieces

    def __reduce__(self):
        return unpacked, (self.pieces,)


def unpacked(pieces: dict[int, bytes]) -> np.ndarray:
    out = np.zeros((BITMAP_PIECES, BITMAP_BITS // BITMAP_PIECES // 32), np.uint32)
    for i, words in pieces.items():
        out[i] = np.frombuffer(zlib.decompress(words), np.uint32)
    return out.ravel()


def bitmap(values: DataFrame) -> Bitmap:
    """A one-hash Bloom filter of the column ``v`` (long), to be broadcast, of at most a fixed size whatever the input.

    Tasks fill and compress the pieces that values are dealt to; the driver only passes them on.
    """
    at = F.col("v").bitwiseAND(F.lit(BITMAP_BITS - 1))
    piece = BITMAP_BITS // BITMAP_PIECES

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, np.ndarray] = {}
        for b in batches:
            own, bit = b.column(0).to_numpy(), b.column(1).to_numpy()
            for i in np.unique(own).tolist():
                words = pieces.setdefault(i, np.zeros(piece // 32, np.uint32))
                x = bit[own == i] % piece
                np.bitwise_or.at(words, x >> 5, np.uint32(1) << (x & 31).astype(np.uint32))
        if pieces:
            yield pa.RecordBatch.from_arrays([pa.array(list(pieces), pa.int32()), pa.array([zlib.compress(w.tobytes(), 1) for w in pieces.values()], pa.binary())], ["i", "words"])

    dealt = values.select(F.floor(at / piece).cast("int").alias("i"), at.alias("at")).repartition("i")
    found = dealt.mapInArrow(fill, "i int, words binary").collect()  # at most about BITMAP_BITS / 8 bytes
    return Bitmap({r["i"]: bytes(r["words"]) for r in found})


def set_bits(values: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """True where a ``bitmap`` may hold the value."""
    at = values & (BITMAP_BITS - 1)
    return (bits[at >> 5] >> (at & 31).astype(np.uint32) & np.uint32(1)).astype(bool)


def held_out(doc_id: str = "doc_id") -> Column:
    """Ids that never train: crc32 of the id as text is divisible by 5."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, seed: int) -> DataFrame:
    """(text, label) of at most ``rows`` labelled documents, written once.

    The labels are drawn by a seeded hash of the id, at most ``rows`` of them, and
    broadcast, so documents are only scanned. An id that repeats gives one row, of its
    smallest text and label. Null labels, null ids and ids held out give none.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.min(label).alias(label)).orderBy(F.xxhash64(F.lit(seed), F.col("doc_id")), "doc_id").limit(rows)
    drawn = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id", label).agg(F.min("text").alias("text"))
    return cut(drawn.select("text", label))


def complete_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Yield (table, starts): tables holding only whole groups of ``keys``.

    The input is sorted by ``keys``. ``starts`` has each group's first row and
    the number of rows at its end. The last group of a batch is held back until
    the next batch shows where it ends.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        same = held and all(held[-1].column(k)[-1] == batch.column(k)[-1] for k in keys)
        held.append(batch)
        if same:
            continue
        whole = pa.Table.from_batches(held)
        starts = _starts(whole, keys)
        last = int(starts[-2])
        if last:
            yield whole.slice(0, last), starts[:-1]
        held = whole.slice(last).combine_chunks().to_batches()
    if held:
        whole = pa.Table.from_batches(held)
        yield whole, _starts(whole, keys)


def _starts(whole: pa.Table, keys: list[str]) -> np.ndarray:
    n = whole.num_rows
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        v = whole.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), n)


def _by_heat(rows: DataFrame, keys: list[str], block_rows: int) -> tuple[DataFrame, DataFrame]:
    """(rows of keys with 2 to ``block_rows`` rows, lying together; rows of hot keys with ``nb``, their number of blocks).

    A sample, counted with map-side combining, shows which keys are hot before anything is dealt by
    key, so their rows go to blocks in their first exchange. The sample only places rows: a
    key that it misses is under about two blocks, counted exactly, and split after that.
    """
    seen = F.count(F.lit(1))
    guess = rows.sample(fraction=1 / SAMPLE_ONE_IN, seed=5).groupBy(*keys).agg(seen.alias("__seen")).where((F.col("__seen") >= LEAST_SAMPLED) & (F.col("__seen") * SAMPLE_ONE_IN > block_rows))
    guess = cut(guess.select(*keys, F.ceil(F.col("__seen") * SAMPLE_ONE_IN / block_rows).cast("int").alias("nb")))
    found = guess.limit(MOST_SUSPECTS + 1).count()
    hot = None
    if found:
        small_side = F.broadcast(guess) if found <= MOST_SUSPECTS else guess
        hot = rows.join(small_side, keys)
        rows = rows.join(small_side, keys, "left_anti")
    dealt = rows.repartition(*keys)
    counted = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_key")).where("n_key > 1")
    met = dealt.join(counted, keys)
    missed = met.where(F.col("n_key") > block_rows).withColumn("nb", F.ceil(F.col("n_key") / block_rows).cast("int")).drop("n_key")
    return met.where(F.col("n_key") <= block_rows).drop("n_key"), missed if hot is None else missed.unionByName(hot)


def map_groups(
    rows: DataFrame,
    keys: list[str],
    salt: str,
    fn: Callable[[Iterator[tuple[pa.Table, np.ndarray]]], Iterator[pa.RecordBatch]],
    schema: str,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Apply ``fn`` to all groups of ``keys`` with two rows or more.

    Groups of up to ``block_rows`` rows go to ``fn`` whole. Larger ones are cut
    into blocks by a hash of ``salt`` and every pair of blocks becomes a group of
    its own, so no task holds more than about two blocks of a hot key and every
    two rows of a key still meet in exactly one group. ``fn`` sees the columns
    ``blk`` (the row's block) and ``diag`` (true: compare all rows; false: compare
    only rows of different blocks).
    """
    few, hot = _by_heat(rows, keys, block_rows)

    def run(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.RecordBatch]:
        yield from fn(complete_groups(batches, by))

    small = few.withColumns({"blk": F.lit(0), "diag": F.lit(True)}).sortWithinPartitions(*keys).mapInArrow(lambda it: run(it, keys), schema)
    big = (
        hot.withColumn("blk", F.pmod(F.xxhash64(salt), F.col("nb")).cast("int"))
        .withColumn(
            "cell",
            F.explode(F.expr("transform(sequence(0, nb - 1), j -> least(blk, j) * nb + greatest(blk, j))")),
        )
        .withColumn("diag", F.expr("cell div nb = cell % nb"))
        .drop("nb")
        .repartition(*keys, "cell")
        .sortWithinPartitions(*keys, "cell")
        .mapInArrow(lambda it: run(it, [*keys, "cell"]), schema)
    )
    return small.unionByName(big)


def link_groups(
    rows: DataFrame,
    keys: list[str],
    node: str,
    fn: Callable[[Iterator[tuple[pa.Table, np.ndarray]]], Iterator[pa.RecordBatch]],
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(src, dst): links with the same components as all links ``fn`` finds in groups of ``keys``.

    ``node`` names the rows (a long; src and dst are of its values) and ``fn`` is as in
    ``map_groups``. Groups of more than ``block_rows`` rows are first linked block by
    block. Two rows of a hot group that are still apart are not both in its largest
    component, so only rows outside that component visit the other blocks of their
    group, in parts of at most about ``block_rows``. A hot group of rows that belong
    together costs about one copy a row, whatever its size.
    """
    few, hot = _by_heat(rows, keys, block_rows)
    hot = hot.withColumn("blk", F.pmod(F.xxhash64(node), F.col("nb")).cast("int"))

    def run(batches: Iterator[pa.RecordBatch], by: list[str], mark: bool = False) -> Iterator[pa.RecordBatch]:
        if mark:  # a row without dst tells that there are hot groups
            first = next(batches, None)
            if first is None:
                return
            yield pa.RecordBatch.from_arrays([first.column(node).slice(0, 1), pa.nulls(1, pa.int64())], ["src", "dst"])
            batches = chain([first], batches)
        yield from fn(complete_groups(batches, by))

    schema = "src long, dst long"
    small = few.withColumns({"blk": F.lit(0), "diag": F.lit(True)}).sortWithinPartitions(*keys).mapInArrow(lambda it: run(it, keys), schema)
    by_block = [*keys, "blk"]
    blocks = (
        hot.drop("nb")
        .withColumn("diag", F.lit(True))
        .repartition(*by_block)
        .sortWithinPartitions(*by_block)
        .mapInArrow(lambda it: run(it, by_block, True), schema)
    )
    found = cut(small.unionByName(blocks))
    links = found.where("dst IS NOT NULL")
    if found.where("dst IS NULL").limit(1).count() == 0:
        return links
    comps = connected_components(links)
    named = hot.join(comps.withColumnsRenamed({"id": "__id", "component_id": "__comp"}), F.col(node) == F.col("__id"), "left")
    named = cut(named.withColumn("__comp", F.coalesce("__comp", node)).drop("__id"))
    sizes = named.groupBy(*keys, "nb", "__comp").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy(*keys, "nb").agg(F.max_by("__comp", "n").alias("__main"), (F.sum("n") - F.max("n")).alias("away"))
    main = main.where("away > 0").withColumn("nv", F.ceil(F.col("away") / block_rows).cast("int"))
    spread = main.withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).drop("away", "nb")
    placed = named.join(spread, by_block)
    visits = (
        placed.where("__comp <> __main")
        .withColumn("part", F.pmod(F.xxhash64(F.lit(1), node), F.col("nv")).cast("int"))
        .withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .where("cell <> blk")
        .withColumn("blk", F.lit(-1))
    )
    hosts = placed.withColumn("cell", F.col("blk")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("nv") - 1)))
    by_cell = [*keys, "cell", "part"]
    late = (
        hosts.unionByName(visits)
        .drop("nb", "nv", "__comp", "__main")
        .withColumn("diag", F.lit(False))
        .repartition(*by_cell)
        .sortWithinPartitions(*by_cell)
        .mapInArrow(lambda it: run(it, by_cell), schema)
    )
    return links.unionByName(late)


def pairs_of_groups(starts: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i, j), i < j, of rows in one group, about ``most`` at a time."""
    sizes = np.diff(starts)
    small = sizes <= 64
    # small groups together, by the distance between the two rows
    if small.any():
        left = np.repeat(starts[1:] - 1, sizes) - np.arange(starts[-1])  # rows that follow in the group
        left[np.repeat(~small, sizes)] = 0
        for d in range(1, int(sizes[small].max())):
            i = np.flatnonzero(left >= d)
            for a in range(0, len(i), most):
                yield i[a : a + most], i[a : a + most] + d
    for g in np.flatnonzero(~small):
        lo, hi = int(starts[g]), int(starts[g + 1])
        step = max(1, most // (hi - lo))
        for a in range(lo, hi - 1, step):
            b = min(hi - 1, a + step)
            i, j = np.meshgrid(np.arange(a, b), np.arange(a + 1, hi), indexing="ij")
            keep = j > i
            yield i[keep], j[keep]


class Forest:
    """Union-find over the rows of one task; keeps only the joining links."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.links.append((a, b))


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id per node: (src, dst) longs -> (id, component_id).

    Alternating large-star and small-star rounds: every round connects nodes to
    the smallest neighbour known so far, so the number of rounds grows with the
    logarithm of a component's diameter and each round is two grouped minima and
    two joins; rounds go on until every component is a star. Nodes without edges do
    not appear. Empty edges give an empty table.
    """
    links = cut(
        edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    )
    while _unsettled(links):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
        links = cut(small.distinct())
    roots = links.select(F.col("v").alias("id")).distinct().withColumn("component_id", F.col("id"))
    return links.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(roots)


def _unsettled(links: DataFrame) -> bool:
    """True while a node has two parents or a parent has a parent."""
    children = links.groupBy(F.col("u").alias("x")).agg(F.count(F.lit(1)).alias("parents"), F.lit(0).alias("leads"))
    parents = links.groupBy(F.col("v").alias("x")).agg(F.lit(0).cast("long").alias("parents"), F.lit(1).alias("leads"))
    seen = children.unionByName(parents).groupBy("x").agg(F.sum("parents").alias("parents"), F.max("leads").alias("leads"))
    return seen.where("parents > 1 OR (parents = 1 AND leads = 1)").limit(1).count() > 0
