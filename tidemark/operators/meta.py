"""Meta-labelling with Spark ML."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def meta_labels(barriers: DataFrame) -> DataFrame:
    """y = 1 where the event's own direction reached its profit barrier first."""
    return barriers.withColumn("y", (F.col("label") == 1).cast("int"))


def fit_meta(train: DataFrame, features: list[str], label: str = "y", *, trees: bool = False, least_events: int = 50, least_share: float = 0.05) -> PipelineModel | None:
    """Median impute, then scale and logistic regression, or boosted trees; None when the
    sample is too small or one-sided."""
    n = train.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("share")).first()
    if n["n"] < least_events or not least_share <= (n["share"] or 0.0) <= 1 - least_share:
        return None
    imputed = [f"__imputed_{f}" for f in features]
    head = [Imputer(strategy="median", inputCols=features, outputCols=imputed), VectorAssembler(inputCols=imputed, outputCol="__raw")]
    tail = (
        [GBTClassifier(featuresCol="__raw", labelCol=label, maxIter=20, maxDepth=3, seed=1)]
        if trees else [StandardScaler(inputCol="__raw", outputCol="__x", withMean=True), LogisticRegression(featuresCol="__x", labelCol=label, regParam=0.01)]
    )
    return Pipeline(stages=head + tail).fit(train)


def predict(model: PipelineModel, events: DataFrame, out: str = "p") -> DataFrame:
    return model.transform(events).withColumn(out, vector_to_array("probability")[1]).select(*events.columns, out)


def modulate(df: DataFrame, p: str = "p", *, position: str = "position", gate: float | None = None) -> DataFrame:
    """Scale positions by the probability (null counts one half), or gate them at a threshold."""
    q = F.coalesce(F.col(p), F.lit(0.5))
    return df.withColumn(position, F.col(position) * (q if gate is None else (q >= gate).cast("double")))


def precision_recall(scored: DataFrame, p: str, label: str, threshold: float = 0.5) -> DataFrame:
    hit, real = F.col(p) >= threshold, F.col(label) == 1
    tp = F.count(F.when(hit & real, 1))
    return scored.agg((tp / F.nullif(F.count(F.when(hit, 1)), F.lit(0))).alias("precision"), (tp / F.nullif(F.count(F.when(real, 1)), F.lit(0))).alias("recall"), F.count(F.lit(1)).alias("n"))


#: Rows of one ranking task when values are dealt anew.
SHUFFLE_ROWS = 4096


def _shuffled_place(df: DataFrame, out: str, n: int, name: list, order: list[str]) -> DataFrame:
    """``df`` numbered from 0 by the MD5 of ``name`` and ``order``: one permutation of all rows.

    Rows are ranked within blocks of neighbouring hashes, about ``SHUFFLE_ROWS`` each; what lies
    before a block is a running sum over one small row a block.
    """
    blocks = max(1, -(-n // SHUFFLE_ROWS))
    digest = F.md5(F.concat_ws(":", *[F.lit(x) for x in name], *order))
    block = F.floor(F.conv(F.substring("__h", 1, 8), 16, 10).cast("long") * blocks / (1 << 32))
    d = df.withColumn("__h", digest).withColumn("__b", block)
    sizes = d.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("__b").orderBy("__h", *order)) - 1
    placed = d.withColumn("__i", inside).join(sizes.select("__b", before.alias("__o")), "__b")
    return placed.withColumn(out, F.col("__i") + F.col("__o")).drop("__h", "__b", "__i", "__o")


def permutation_importance(
    model: PipelineModel | Callable[[DataFrame], DataFrame], df: DataFrame, features: list[str], label: str, *, order: list[str], seed: int = 1, repeats: int = 1, score: str = "log_loss",
) -> DataFrame:
    """(feature, importance): how much worse ``model`` does when one feature's values are permuted.

    ``model`` is a fitted pipeline or a function that adds ``p``. With ``score`` "log_loss" the
    importance is the rise of the log loss of ``p`` on a 0/1 label, with "r2" the fall of the
    coefficient of determination. It is the mean over ``repeats`` permutations, each of all rows
    whatever their number. ``order`` names a row; rows that agree in it are permuted in any order.
    """
    eps, n = 1e-9, df.count()
    apply = model if callable(model) and not hasattr(model, "stages") else (lambda d: predict(model, d))

    def cost(d: DataFrame, name: str) -> DataFrame:
        d = apply(d)
        if score == "log_loss":
            q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col("p")))
            c = F.avg(-F.when(F.col(label) == 1, F.log(q)).otherwise(F.log(1 - q)))
        else:
            c = F.sum(F.pow(F.col(label) - F.col("p"), 2)) / F.nullif(F.var_pop(label) * F.count(label), F.lit(0.0))
        return d.agg(F.lit(name).alias("feature"), c.alias("cost"))

    at = _shuffled_place(df, "__at", n, [seed, "rows"], order)
    base = cost(df, "").select(F.col("cost").alias("base"))
    rows = None
    for f in features:
        for k in range(repeats):
            mixed = _shuffled_place(df.select(F.col(f).alias("__v"), *order), "__at", n, [seed, k, f], order).select("__at", "__v")
            one = cost(at.drop(f).join(mixed, "__at").withColumnRenamed("__v", f).select(*df.columns), f)
            rows = one if rows is None else rows.unionByName(one)
    mean = rows.groupBy("feature").agg(F.avg("cost").alias("cost"))
    return mean.join(F.broadcast(base)).select("feature", (F.col("cost") - F.col("base")).alias("importance"))


def decile_lift(scored: DataFrame, p: str, outcome: str, *, key: list[str]) -> DataFrame:
    d = scored.withColumn("decile", F.ntile(10).over(Window.partitionBy(*key).orderBy(p, outcome)))
    return d.groupBy(*key, "decile").agg(F.count(F.lit(1)).alias("n"), F.avg(outcome).alias("mean"))


def expanding_forest(events: DataFrame, features: list[str], target: str, *, order: str, cuts: tuple[float, ...] = (0.4, 0.55, 0.7, 0.85, 1.0)) -> DataFrame:
    """Scores of each later slice by trees fitted on all rows before it; slices end at quantiles of ``order``, a time."""
    s = F.col(order).cast("double")
    ends = events.agg(F.percentile(s, F.array(*[F.lit(c) for c in cuts])).alias("q")).first()["q"]
    if ends is None:
        return events.withColumns({"slice": F.lit(0.0), "score": F.lit(0.0)})
    at = events.withColumn("__s", s).na.fill(0.0, features)
    assembler = VectorAssembler(inputCols=features, outputCol="__x")
    out = None
    for k, lo in enumerate(cuts[:-1]):
        model = Pipeline(stages=[assembler, GBTRegressor(featuresCol="__x", labelCol=target, maxIter=10, maxDepth=3, seed=1, predictionCol="score")]).fit(at.where(F.col("__s") <= ends[k]))
        part = model.transform(at.where((F.col("__s") > ends[k]) & (F.col("__s") <= ends[k + 1]))).withColumn("slice", F.lit(lo)).select(*events.columns, "slice", "score")
        out = part if out is None else out.unionByName(part)
    return out


def behaviour_clusters(profiles: DataFrame, features: list[str], k: int = 4, seed: int = 1) -> DataFrame:
    """Symbols grouped on standardised behaviour features."""
    stages = [VectorAssembler(inputCols=features, outputCol="__raw"), StandardScaler(inputCol="__raw", outputCol="__x", withMean=True), KMeans(featuresCol="__x", k=k, seed=seed, predictionCol="cluster")]
    return Pipeline(stages=stages).fit(profiles).transform(profiles).drop("__raw", "__x")
