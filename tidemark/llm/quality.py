"""Operator 1: quality by hierarchical empirical Bayes.

A document classifier (ridge logistic regression on surface measures, fitted on a
bounded, documented sample of labelled rows) gives each document a probability of
being good. Grouped aggregation turns these into posteriors of the site: the global
mean is the prior of every host, a host's posterior the prior of its paths. The
strength of each prior is estimated from the spread between groups (empirical
Bayes), so sparse hosts and paths shrink to what is above them. A document's final
probability is its own odds shifted by the log odds of its path against the global
mean.

All documents enter the posteriors. Texts are measured once; only (host, path,
probability) and row keys are shuffled for the judgement.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, labelled_sample, table

SAMPLE_ROWS = 20_000
#: Sites that are broadcast at most; more are joined by a shuffle of narrow rows.
BROADCAST_SITES = 100_000
#: Bounds of a prior's strength, in documents.
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 10_000.0
_EPS = 1e-4

MEASURES = [
    "log_words", "word_bytes", "distinct_words", "upper", "digits", "marks", "rare_marks",
    "bars", "bangs", "line_words", "repeated_pairs", "stops",
]
_KIND = np.zeros(256, np.int64)  # 0 other, 1 upper, 2 digit, 3 sentence marks, 4 rare marks, 5 bar, 6 bang, 7 line end, 8 other letters
for _c in range(256):
    _ch = chr(_c)
    _KIND[_c] = (
        1 if "A" <= _ch <= "Z" else 2 if "0" <= _ch <= "9" else 3 if _ch in ".,;:?'\"-()" else 5 if _ch == "|" else 6 if _ch == "!" else 7 if _ch == "\n"
        else 8 if "a" <= _ch <= "z" or _c >= 128 else 0 if _ch in " \t\r\x0b\x0c" else 4
    )


def measure(text: bytes | None) -> np.ndarray:
    """Surface measures of a whole text; null and empty texts measure zero."""
    t = text or b""
    words = t.split()
    n = len(words)
    if not n:
        return np.zeros(len(MEASURES))
    kinds = np.bincount(_KIND[np.frombuffer(t, np.uint8)], minlength=9)
    size = len(t)
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:]))) if n > 1 else 1
    return np.array(
        [
            np.log1p(n), size / n / 10, distinct / n ** 0.8, kinds[1] / size * 10, kinds[2] / size * 10, kinds[3] / size * 10, kinds[4] / size * 10,
            kinds[5] / size * 10, kinds[6] / size * 10, np.log1p(n / (kinds[7] + 1)), 1 - pairs / max(1, n - 1) if n > 1 else 0.0,
            sum(t.count(m) for m in (b". ", b".\n")) / n * 10,
        ]
    )


class Classifier:
    """Logistic regression on standardised measures and their squares."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, beta: np.ndarray):
        self.mean, self.scale, self.beta = mean, scale, beta

    def design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.ones((len(z), 1)), z, z * z / 6])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.design(x) @ self.beta, -30, 30)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Classifier:
        """Newton steps with a ridge; without both labels the rate of label 1, or one half."""
        k = len(MEASURES)
        if len(y) == 0 or y.min() == y.max():
            rate = (y.sum() + 1) / (len(y) + 2)
            beta = np.zeros(2 * k + 1)
            beta[0] = np.log(rate / (1 - rate))
            return cls(np.zeros(k), np.ones(k), beta)
        out = cls(x.mean(0), np.maximum(x.std(0), 1e-6), np.zeros(2 * k + 1))
        d, beta = out.design(x), np.zeros(2 * k + 1)
        ridge = np.eye(2 * k + 1)
        ridge[0, 0] = 1e-3
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(d @ beta, -30, 30)))
            step = np.linalg.solve(d.T @ (d * (p * (1 - p))[:, None]) + ridge, d.T @ (y - p) - ridge @ beta)
            beta += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        out.beta = beta
        return out


def learn_classifier(labelled: DataFrame, *, text: str = "text", label: str = "quality") -> Classifier:
    """Fit on ``labelled`` (text, label in 0/1), which the caller bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [measure(t.as_py()).tolist() for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], ["x", "y"])

    rows = labelled.where(F.col(label).isin(0, 1)).select(F.col(text).cast("binary").alias("t"), F.col(label).cast("double").alias("y"))
    got = rows.mapInArrow(run, "x array<double>, y double").collect()  # bounded by the sample
    return Classifier.fit(np.array([r["x"] for r in got]).reshape(-1, len(MEASURES)), np.array([r["y"] for r in got]))


def document_evidence(docs: DataFrame, classifier: Classifier, *, text: str = "text", out: str = "evidence") -> DataFrame:
    """``docs`` with the classifier's probability as the column ``out``; all columns stay."""
    model = docs.sparkSession.sparkContext.broadcast((classifier.mean, classifier.scale, classifier.beta))
    p = F.pandas_udf(_probability(model), "double")
    return docs.withColumn(out, p(F.col(text).cast("binary")))


def _probability(model):
    import pandas as pd

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Classifier(*model.value)
        for texts in batches:
            yield pd.Series(own(np.stack([measure(t) for t in texts])) if len(texts) else np.empty(0))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return run


def _posterior(groups: DataFrame, prior: Column) -> DataFrame:
    """Beta-binomial shrinkage of ``good`` / ``n`` to ``prior``, one strength for all.

    The strength comes from the method of moments: expected binomial variance over
    the between-group variance that is left beyond it.
    """
    g = groups.withColumn("prior", prior)
    m = g.agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("n")).alias("n2"),
        F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - F.col("prior"), 2)).alias("spread"),
        F.sum(F.col("n") * F.col("prior") * (1 - F.col("prior"))).alias("within"),
    ).first()
    n, k = float(m["n"] or 0), int(m["k"])
    strength = MOST_STRENGTH
    if k > 1 and n:
        v = float(m["within"]) / n
        between = (float(m["spread"]) - k * v) / max(1e-9, n - float(m["n2"]) / n)
        if between > 0:
            strength = min(MOST_STRENGTH, max(LEAST_STRENGTH, v / between - 1))
    return g.withColumn("posterior", (F.col("good") + strength * F.col("prior")) / (F.col("n") + strength)).drop("prior")


def site_posteriors(scored: DataFrame, *, host: str, path: str, evidence: str = "evidence") -> DataFrame:
    """(host, path, n, host_posterior, path_posterior, global_mean).

    A null host or path is a group of its own. Empty input gives an empty table.
    """
    paths = cut(
        scored.groupBy(F.col(host).alias("host"), F.col(path).alias("path")).agg(F.count(F.lit(1)).alias("n"), F.sum(evidence).alias("good"))
    )
    total = paths.agg(F.sum("good").alias("g"), F.sum("n").alias("n")).first()
    mean = (float(total["g"] or 0) + 1) / (float(total["n"] or 0) + 2)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    hosts = _posterior(hosts, F.lit(mean)).select(F.col("host").alias("h_host"), F.col("posterior").alias("host_posterior"))
    joined = paths.join(hosts, F.col("host").eqNullSafe(F.col("h_host"))).drop("h_host")
    return _posterior(joined, F.col("host_posterior")).select(
        "host", "path", "n", "host_posterior", F.col("posterior").alias("path_posterior"), F.lit(mean).alias("global_mean")
    )


def logit(p: Column) -> Column:
    q = F.greatest(F.lit(_EPS), F.least(F.lit(1 - _EPS), p))
    return F.log(q / (1 - q))


def judge(docs: DataFrame, classifier: Classifier, *, keys: list[str], host: str = "source", path: str = "lang", text: str = "text", least: float = 0.5) -> DataFrame:
    """(keys, evidence, quality, keep), a row per row of ``docs``; texts are measured once.

    Null or empty texts get the classifier's value for zero measures. Repeated rows
    are kept apart; they all count in their site.
    """
    named = [F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)]
    narrow = docs.select(*named, F.col(host).alias("__host"), F.col(path).alias("__path"), F.col(text).alias("__text"))
    scored = cut(document_evidence(narrow, classifier, text="__text", out="__evidence").drop("__text"))
    sites = site_posteriors(scored, host="__host", path="__path", evidence="__evidence").select(
        "host", "path", (logit(F.col("path_posterior")) - logit(F.col("global_mean"))).alias("shift")
    )
    sites = cut(sites)
    if sites.limit(BROADCAST_SITES + 1).count() <= BROADCAST_SITES:
        sites = F.broadcast(sites)
    joined = scored.join(sites, F.col("__host").eqNullSafe(F.col("host")) & F.col("__path").eqNullSafe(F.col("path")), "left")
    odds = logit(F.col("__evidence")) + F.coalesce("shift", F.lit(0.0))
    return joined.withColumn("quality", 1 / (1 + F.exp(-odds))).select(
        *[F.col(f"__key{i}").alias(k) for i, k in enumerate(keys)], F.col("__evidence").alias("evidence"), "quality", (F.col("quality") >= least).alias("keep")
    )


def classify(docs: DataFrame, classifier: Classifier, *, host: str = "source", path: str = "lang", text: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` with ``__evidence``, ``__quality`` and ``__keep`` added.

    Rows are judged by host, path and text alone, as ``judge`` does. Columns of the
    input stay as they are, whatever their names, unless they begin with two
    underscores. Empty input gives an empty table.
    """
    parts = [x for c in (host, path, text) for x in (F.col(c).isNull(), F.col(c))]  # a hash passes over nulls
    keyed = docs.withColumns({"__k": F.xxhash64(*parts), "__k2": F.xxhash64(F.lit(1), *parts)})
    judged = judge(keyed, classifier, keys=["__k", "__k2"], host=host, path=path, text=text, least=least)
    judged = judged.dropDuplicates(["__k", "__k2"]).withColumnsRenamed({"evidence": "__evidence", "quality": "__quality", "keep": "__keep"})
    return keyed.join(judged, ["__k", "__k2"], "left").drop("__k", "__k2")


def quality_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, quality) of at most ``rows`` labelled documents; ids with crc32 % 5 = 0 never train."""
    return labelled_sample(docs, labels, "quality", rows, seed=13)


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents judged bad; all columns stay."""
    classifier = learn_classifier(quality_sample(docs, labels))
    return classify(docs, classifier, **options).where("__keep").select(*docs.columns)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    classifier = learn_classifier(quality_sample(docs, table(spark, sf_dir, "labels")))
    return judge(docs, classifier, keys=["doc_id"])
