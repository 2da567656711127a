"""Many recurrences of a key in one pass, vectorised.

``affine`` is y = a * y_before + b as a scan of the associative map (a, b): doubling steps over a
batch instead of a loop over its rows, with the last y carried to the next batch. ``Mean`` is
the recursive exponential mean in that form, ``Derived`` a column from those before it, so a chain of
smoothings (as the directional index has) is one stage of tasks. ``recurrences`` follows a
window over the same key and order and so adds no exchange; it streams the batches of a
key and keeps two numbers for each recurrence.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.grid import ordered


#: Runs of so many rows on average are cheaper in a loop.
SHORT = 32


class Mean(NamedTuple):
    """Recursive exponential mean of ``x``: nulls keep the value and age it; null until ``least`` values came."""

    out: str
    x: str
    alpha: float
    least: int = 1


class Derived(NamedTuple):
    """``fn`` of the arrays of the columns named, NaN for null."""

    out: str
    fn: Callable[..., np.ndarray]
    of: tuple[str, ...]


def wilder(out: str, x: str, n: int, least: int | None = None) -> Mean:
    return Mean(out, x, 1.0 / n, n if least is None else least)


def span(out: str, x: str, n: int, least: int = 1) -> Mean:
    return Mean(out, x, 2.0 / (n + 1), least)


def affine(a: np.ndarray, b: np.ndarray, before: float = 0.0) -> np.ndarray:
    """y_i = a_i * y_(i-1) + b_i with y_(-1) = ``before``, in log2(n) doubling steps."""
    if not len(a):
        return b.astype(float)
    a, y = a.astype(float), b.astype(float)
    if len(a) <= SHORT * (1 + np.count_nonzero(a == 0)):
        for i, (x, c) in enumerate(zip(a.tolist(), b.tolist())):
            before = y[i] = x * before + c if x else float(c)
        return y
    y[0] += a[0] * before
    a[0] = 0.0
    step = 1
    while step < len(y):
        y[step:] += np.where(a[step:] == 0, 0.0, a[step:] * y[:-step])  # a start keeps nothing, not even NaN
        a[step:] *= a[:-step]
        if not a[step:].any():
            break
        step *= 2
    return y


class _MeanState:
    """A ``Mean`` over the batches of one key."""

    def __init__(self, step: Mean):
        self.step, self.y, self.seen, self.age = step, 0.0, 0, 0

    def __call__(self, x: np.ndarray) -> np.ndarray:
        alpha, known = self.step.alpha, ~np.isnan(x)
        at = np.flatnonzero(known)
        count = self.seen + np.cumsum(known)
        out = np.full(len(x), self.y if self.seen else np.nan)
        if len(at):
            gap = np.diff(at, prepend=-1 - self.age)  # rows since the value before
            old = (1 - alpha) ** gap
            a, b = old / (old + alpha), alpha * x[at] / (old + alpha)
            if not self.seen:
                a[0], b[0] = 0.0, x[at[0]]
            y = affine(a, b, self.y)
            out[at[0] :] = y[np.cumsum(known)[at[0] :] - 1]
            self.y, self.age = float(y[-1]), len(x) - 1 - int(at[-1])
        else:
            self.age += len(x)
        self.seen = int(count[-1]) if len(x) else self.seen
        return np.where(count >= max(1, self.step.least), out, np.nan)


def recurrences(df: DataFrame, steps: list[Mean | Derived], *, key: list[str], ts: str = "ts", drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the column of each step, computed in order for each key; ``drop`` leaves columns out.

    Rows follow in the order of ``ts``; equal times of a key in any order.
    """
    names = [s.out for s in steps if s.out not in drop]
    inputs = {c for s in steps for c in ((s.x,) if isinstance(s, Mean) else s.of)} & set(df.columns)
    # the window deals rows by key; Spark may move it under one with a finer key, so the order is asked for (no sort where it holds)
    numbered = df.withColumn("__rn", F.row_number().over(ordered(key, ts))).sortWithinPartitions(*key, "__rn")
    kept = [f for f in numbered.schema.fields if f.name not in {"__rn", *drop, *[s.out for s in steps]}]
    schema = T.StructType([*kept, *[T.StructField(c, T.DoubleType()) for c in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, after = [_MeanState(s) if isinstance(s, Mean) else None for s in steps], 0
        for batch in batches:
            number = batch.column("__rn").to_numpy()
            if len(number) and (number[0] != after + 1 or (np.diff(number) != 1).any()):
                raise RuntimeError("rows of a key came out of order")
            after = int(number[-1]) if len(number) else after
            made = {c: batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in inputs}
            for s, state in zip(steps, states):
                made[s.out] = state(made[s.x]) if state else s.fn(*[made[c] for c in s.of])
            cols = [batch.column(f.name) for f in kept] + [pa.array(made[c], pa.float64(), from_pandas=True) for c in names]
            yield pa.RecordBatch.from_arrays(cols, [f.name for f in schema.fields])

    return numbered.groupBy(*key).applyInArrow(run, schema)


class Part(NamedTuple):
    """An indicator as columns before, recurrences and columns after; see ``together``."""

    before: dict[str, Column]
    steps: list[Mean | Derived]
    after: dict[str, Column]


def together(df: DataFrame, *parts: Part, key: list[str], ts: str = "ts") -> DataFrame:
    """``df`` with the indicators of all parts, their recurrences in one pass."""
    before = {n: c for p in parts for n, c in p.before.items()}
    steps: list[Mean | Derived] = []
    for s in (s for p in parts for s in p.steps):
        if s not in steps:
            steps.append(s)
    after = {n: c for p in parts for n, c in p.after.items()}
    own = [s.out for s in steps]
    done = recurrences(df.withColumns(before) if before else df, steps, key=key, ts=ts)
    done = done.withColumns(after) if after else done
    return done.drop(*[c for c in {*before, *own} if c.startswith("__") and c not in df.columns])
