"""Operator 7: mix sources to target weights by capped water-filling.

Targets share the total size among the sources in proportion to their weights.
A source whose share would exceed ``max_epochs`` times its size is clamped there
and the excess is shared among the others by weight, until none is above. That
fixed point is target = min(cap, level * weight) for one common level; ordering
the sources by cap / weight makes the clamped ones a prefix, so one running sum
over the (small, aggregated) source table finds the level exactly.

Documents then repeat floor(target / size) whole times, and the fraction left is
taken once more from documents in a seeded order until the words taken come as
near to the target as whole documents allow. A two-level running sum finds where
to stop: sums of hash buckets per source first, single documents only inside the
one bucket that the target falls into, so no window ever holds a whole source.

Everything is DataFrame code; texts are never shuffled, only (id, source, size). The
sources themselves are ordered in one task: use sources, not hosts or pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, table

#: Hash buckets per source for the first level of the running sum.
BUCKETS = 4096
#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_weights(sizes: DataFrame, source: str = "source") -> DataFrame:
    """Weights 1, 2, 3, 1, 2, 3, ... over the sources by code point, null last.

    ``sizes`` has one row per source; this is the only global ordering.
    """
    order = Window.orderBy(F.col(source).isNull(), F.col(source))
    return sizes.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double"))


def water_fill(sizes: DataFrame, max_epochs: float = 3.0) -> DataFrame:
    """(source, source_size, weight) -> the same with ``target``.

    Sources of size zero or weight zero get 0. Ties in cap / weight share a level.
    """
    live = sizes.withColumn("cap", F.col("source_size") * max_epochs)
    total = F.sum("source_size").over(Window.partitionBy())
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    usable = live.where("weight > 0 AND source_size > 0")
    stepped = (
        usable.withColumn("total", total)
        .withColumn("clamped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("passed", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("weights", F.sum("weight").over(Window.partitionBy()))
        .withColumn("level", (F.col("total") - F.col("clamped")) / (F.col("weights") - F.col("passed")))
        # the first source that the level leaves below its cap ends the clamped prefix
        .withColumn("open_level", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")))
        .withColumn("final", F.first("open_level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("target", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("weight"))))
    )
    rest = live.where("NOT coalesce(weight > 0 AND source_size > 0, false)").withColumn("target", F.lit(0.0))
    keep = ["source", "source_size", "weight", "target"]
    return stepped.select(*keep).unionByName(rest.select(*keep))


def mix(
    sized: DataFrame,
    *,
    doc_id: str = "doc_id",
    source: str = "source",
    size: str = "size",
    weights: DataFrame | None = None,
    max_epochs: float = 3.0,
    seed: int = 7,
) -> DataFrame:
    """How often each document is taken: (doc_id, size, source_size, target, taken, times).

    ``weights`` is (source, weight), unlisted sources weigh 0; None means the cycle
    1, 2, 3. A null source is a source of its own; a null size counts as 0. Repeated
    rows are separate documents in a tied, still reproducible, order: rows that agree
    in id and size are taken together or not at all. Empty input gives an empty table.
    Extra columns are ignored. taken = times * size, times <= max_epochs rounded up
    only where the whole part is below it.
    """
    docs = sized.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long")).alias("size")
    )
    name = F.concat_ws(":", F.lit(seed), F.col("doc_id"), F.col("size"))
    docs = docs.withColumn("h", F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)))
    docs = cut(docs)  # narrow; sizes are counted once
    buckets = cut(docs.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    sizes = buckets.groupBy("source").agg(F.sum("words").alias("source_size"))
    if weights is None:
        sizes = cyclic_weights(sizes)
    else:
        w = weights.select(F.col("source").alias("w_source"), F.col("weight").cast("double").alias("weight"))
        sizes = sizes.join(w, sizes.source.eqNullSafe(w.w_source), "left").select("source", "source_size", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    targets = (
        water_fill(sizes, max_epochs)
        .withColumn("whole", F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long"))
        .withColumn("left_over", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumnRenamed("source", "t_source")
    )
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    plan = (
        buckets.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0)))
        .join(targets, F.col("source").eqNullSafe(F.col("t_source")))
        .select(
            F.col("source").alias("p_source"), F.col("bucket").alias("p_bucket"), "before", "words", "source_size", "target", "whole", "left_over",
            F.when(F.col("before") + F.col("words") <= F.col("left_over"), 1).when(F.col("before") >= F.col("left_over"), 0).alias("all_or_none"),
        )
    )
    plan = cut(plan)
    placed = docs.join(plan, docs.source.eqNullSafe(plan.p_source) & (docs.bucket == plan.p_bucket))
    settled = placed.where("all_or_none IS NOT NULL").withColumn("extra", F.col("all_or_none").cast("long"))
    open_ = (
        placed.where("all_or_none IS NULL")
        .withColumn("upto", F.col("before") + F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("h").rangeBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("own", F.sum("size").over(Window.partitionBy("source", "bucket", "h")))
        .withColumn("extra", F.when(F.col("upto") - F.col("own") / 2 <= F.col("left_over"), 1).otherwise(0).cast("long"))
        .drop("upto", "own")
    )
    return settled.unionByName(open_).select(
        "doc_id", "source", "size", "source_size", "target",
        ((F.col("whole") + F.col("extra")) * F.col("size")).cast("long").alias("taken"),
        (F.col("whole") + F.col("extra")).cast("long").alias("times"),
    )


def repeat_documents(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The mix itself: every document as often as ``mix`` takes it.

    All columns stay and ``repetition`` (1, 2, ...) is added, in place of a column of
    that name; documents not taken and those without words are left out.
    """
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    times = mix(sized, **options).where("times > 0 AND size > 0").select(
        F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), F.col("times").alias("__times")
    ).distinct()
    same = docs[doc_id].eqNullSafe(times["__id"]) & docs[source].eqNullSafe(times["__source"]) & (word_count(docs[text]) == times["__size"])
    return docs.join(times, same).withColumn("repetition", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int")))).select(*[c for c in docs.columns if c != "repetition"], "repetition")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


#: DuckDB: the same fixed point and the same seeded order, without the two levels of the running sum.
OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), keyed AS (
  SELECT *, CAST('0x' || substr(md5(concat_ws(':', 7, doc_id, size)), 1, 15) AS BIGINT) AS h FROM d
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), live AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS DOUBLE) AS weight, source_size * CAST(3.0 AS DOUBLE) AS cap FROM sizes
), stepped AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
    coalesce(sum(cap) OVER w, 0.0) AS clamped, coalesce(sum(weight) OVER w, 0.0) AS passed
  FROM live WHERE source_size > 0
  WINDOW w AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT first((total - clamped) / (weights - passed) ORDER BY cap / weight, source IS NULL, source) AS level
  FROM stepped WHERE (total - clamped) / (weights - passed) * weight <= cap
), targets AS (
  SELECT source, source_size, coalesce(CASE WHEN source_size = 0 THEN 0.0 WHEN level IS NULL THEN cap ELSE least(cap, level * weight) END, 0.0) AS target
  FROM live CROSS JOIN (SELECT max(level) AS level FROM level)
), parts AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS whole FROM targets
), placed AS (
  SELECT doc_id, size, h, p.*, target - whole * source_size AS left_over FROM keyed k JOIN parts p ON k.source IS NOT DISTINCT FROM p.source
), summed AS (
  SELECT *, h % 4096 AS bucket, sum(size) OVER (PARTITION BY source, h % 4096) AS words,
    sum(size) OVER (PARTITION BY source ORDER BY h % 4096) - sum(size) OVER (PARTITION BY source, h % 4096) AS before,
    sum(size) OVER (PARTITION BY source ORDER BY h % 4096, h) AS upto, sum(size) OVER (PARTITION BY source, h) AS own
  FROM placed
)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE
    WHEN before + words <= left_over THEN 1 WHEN before >= left_over THEN 0
    WHEN upto - own / 2 <= left_over THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM summed
"""
