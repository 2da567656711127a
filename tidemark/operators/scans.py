"""Recurrences that depend on the row before.

``affine_scan`` runs y = a * y_before + b. It streams sorted rows, one number of state
for each key; with ``block`` it is a block scan instead: blocks of a key run apart and
one short pass over block summaries hands the carry on, so one very long key is many
tasks. A block scan reads its input twice, so chains of them should be cut between.
``ordered_scan`` streams sorted rows of a key through a small state machine; its
memory does not grow with the key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.recurrences import Mean, affine, recurrences


def affine_scan(df: DataFrame, a: str, b: str, out: str, *, key: list[str], ts: str = "ts", block: int | None = None) -> DataFrame:
    """``df`` with y_i = a_i * y_(i-1) + b_i, y_(-1) = 0, per key in time order."""
    if block is None:
        return _streamed_affine(df, [(a, b, out, 0.0)], key=key, ts=ts)
    w = Window.partitionBy(*key).orderBy(ts)
    by = [*key, "__blk"]
    numbered = df.withColumn("__blk", F.floor((F.row_number().over(w) - 1) / block))
    scanned = _streamed_affine(numbered, [(a, b, "__scan_y", 0.0), (a, None, "__scan_a", 1.0)], key=by, ts=ts)
    ends = scanned.groupBy(*by).agg(F.max_by(F.struct(F.col("__scan_a").alias("a"), F.col("__scan_y").alias("y")), ts).alias("e")).select(*by, F.col("e.a").alias("__ea"), F.col("e.y").alias("__ey"))
    handed = _streamed_affine(ends, [("__ea", "__ey", "__upto", 0.0)], key=key, ts="__blk")
    carries = handed.select(*by, F.coalesce(F.lag("__upto").over(Window.partitionBy(*key).orderBy("__blk")), F.lit(0.0)).alias("__carry"))
    return scanned.join(carries, by).withColumn(out, F.col("__scan_y") + F.col("__scan_a") * F.col("__carry")).drop("__blk", "__scan_y", "__scan_a", "__carry")


def _streamed_affine(df: DataFrame, scans: list[tuple[str, str | None, str, float]], *, key: list[str], ts: str) -> DataFrame:
    """``df`` with y = a * y_before + b for each (a, b or None for 0, name of y, y before a key's first row), in one pass."""
    names = [name for *_, name, _ in scans]
    schema = T.StructType([*df.schema.fields, *[T.StructField(c, T.DoubleType()) for c in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = None, [0.0] * len(scans)
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)  # rows that begin a key
            for k in key:
                codes = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy()
                new[1:] |= codes[1:] != codes[:-1]
            new[0] = tuple(batch.column(k)[0].as_py() for k in key) != at
            at = tuple(batch.column(k)[-1].as_py() for k in key)
            value = lambda c: batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            made = []
            for i, (a, b, _, start) in enumerate(scans):
                x, c = value(a), value(b) if b else np.zeros(batch.num_rows)
                made.append(affine(np.where(new, 0.0, x), np.where(new, c + x * start, c) if start else c, last[i]))
                last[i] = float(made[-1][-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(y, pa.float64(), from_pandas=True) for y in made]], schema.names)

    return df.repartition(*key).sortWithinPartitions(*key, ts).mapInArrow(run, schema)


def ewm(df: DataFrame, x: str, alpha: float, out: str, *, key: list[str], ts: str = "ts", least: int = 1) -> DataFrame:
    """Recursive exponential mean (no bias adjustment); nulls carry the value and age it.

    Several means of one frame belong in one call of ``recurrences.recurrences``.
    """
    return recurrences(df, [Mean(out, x, alpha, least)], key=key, ts=ts)


def ema(df: DataFrame, x: str, span: int, out: str, *, key: list[str], ts: str = "ts", least: int = 1) -> DataFrame:
    return ewm(df, x, 2.0 / (span + 1), out, key=key, ts=ts, least=least)


def wilder(df: DataFrame, x: str, n: int, out: str, *, key: list[str], ts: str = "ts", least: int | None = None) -> DataFrame:
    return ewm(df, x, 1.0 / n, out, key=key, ts=ts, least=n if least is None else least)


def ordered_scan(df: DataFrame, order: list[str], cols: list[str], machine: Callable[[], Callable], out: T.StructType, *, key: list[str], long_keys: bool = False) -> DataFrame:
    """``df`` with the columns of ``out`` from a state machine over each key's rows.

    ``machine()`` makes a fresh step function for a key; step(*values of cols) returns
    a tuple for ``out``. Rows stream through in order; nothing of a key is gathered.
    ``long_keys`` is for keys of many rows: it follows a window over the same key and order
    without an exchange of its own, at the cost of one call for each key.
    """
    schema = T.StructType([*df.schema.fields, *out.fields])
    fields = [f.name for f in df.schema.fields]

    def steps(batch: pa.RecordBatch, now: Callable, values: list[list]) -> pa.RecordBatch:
        made = [now(*row) for row in zip(*values)]
        columns = list(zip(*made)) if made else [[]] * len(out.fields)
        kinds = [pa.float64() if isinstance(f.dataType, T.DoubleType) else pa.int64() if isinstance(f.dataType, T.LongType) else pa.bool_() for f in out.fields]
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in fields], *[pa.array(c, k) for c, k in zip(columns, kinds)]], schema.names)

    def known(batch: pa.RecordBatch) -> list[list]:
        return [[None if v is None or v != v else v for v in batch.column(c).to_pylist()] for c in cols]

    if long_keys:
        numbered = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).sortWithinPartitions(*key, "__rn")

        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            step, after = machine(), 0
            for batch in batches:
                number = batch.column("__rn").to_numpy()
                if len(number) and (number[0] != after + 1 or (np.diff(number) != 1).any()):
                    raise RuntimeError("rows of a key came out of order")
                after += len(number)
                yield steps(batch, step, known(batch))

        return numbered.groupBy(*key).applyInArrow(one, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, step = None, None
        for batch in batches:
            keys = list(zip(*[batch.column(k).to_pylist() for k in key])) if key else [()] * batch.num_rows
            rows = list(zip(*known(batch)))

            def follow(k, *row):
                nonlocal at, step
                if step is None or k != at:
                    at, step = k, machine()
                return step(*row)

            yield steps(batch, follow, [keys, *[list(c) for c in zip(*rows)]] if rows else [[]])

    return df.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, schema)


def cooldown(df: DataFrame, seconds: str, gap: float, *, key: list[str]) -> DataFrame:
    """Keep a row when ``seconds`` is at least ``gap`` after the last kept row of its key."""

    def machine():
        last = [None]

        def step(s):
            if last[0] is None or s - last[0] >= gap:
                last[0] = s
                return (True,)
            return (False,)

        return step

    return ordered_scan(df, [seconds], [seconds], machine, T.StructType([T.StructField("__k", T.BooleanType())]), key=key).where("__k").drop("__k")


def finite_scan(df: DataFrame, step: Callable, states: list[float], cols: list[str], out: str, *, key: list[str], ts: str, block_seconds: int) -> DataFrame:
    """``df`` with the state of a machine of few ``states``, each key in time blocks of its own.

    ``step(state, *values of cols)`` gives the next state; the first of ``states`` is the
    start. A block runs from every state at once; its map of start to end states is
    composed over the blocks before it, one small row a block, so a long key is as many
    tasks as it has blocks.
    """
    at = {s: i for i, s in enumerate(states)}
    blocked = df.withColumn("__blk", F.floor(F.unix_timestamp(ts) / block_seconds))
    n = len(states)

    def block_machine():
        now = list(states)

        def run(*values):
            now[:] = [step(s, *values) for s in now]
            return tuple(now)

        return run

    by = [*key, "__blk"]
    made = T.StructType([T.StructField(f"__s{i}", T.DoubleType()) for i in range(n)])
    scanned = ordered_scan(blocked, [ts], cols, block_machine, made, key=by)
    ends = scanned.groupBy(*by).agg(*[F.max_by(f"__s{i}", ts).alias(f"__e{i}") for i in range(n)])

    def carry_machine():
        now = [states[0]]

        def run(*ends):
            before, now[0] = now[0], ends[at[now[0]]]
            return (float(at[before]),)

        return run

    carry = ordered_scan(ends, ["__blk"], [f"__e{i}" for i in range(n)], carry_machine, T.StructType([T.StructField("__c", T.DoubleType())]), key=key).select(*by, "__c")
    state = F.element_at(F.array(*[F.col(f"__s{i}") for i in range(n)]), F.col("__c").cast("int") + 1)
    return scanned.join(carry, by).withColumn(out, state).drop("__blk", "__c", *[f"__s{i}" for i in range(n)])


def _hysteresis(pos, li, lo, si, so):
    if li is None or si is None:
        return 0.0
    if (pos > 0 and lo) or (pos < 0 and so):
        pos = 0.0
    if li and pos <= 0:
        return 1.0
    return -1.0 if si and pos >= 0 else pos


def latch(df: DataFrame, long_in: str, long_out: str, short_in: str, short_out: str, *, key: list[str], ts: str = "ts", out: str = "latched", block_seconds: int | None = None) -> DataFrame:
    """Hysteresis over -1, 0, 1: exits first, then entries, flips allowed; a null entry resets to 0.

    With ``block_seconds`` a key runs in time blocks of its own (``finite_scan``).
    """
    cols = [long_in, long_out, short_in, short_out]
    if block_seconds is not None:
        return finite_scan(df, _hysteresis, [0.0, 1.0, -1.0], cols, out, key=key, ts=ts, block_seconds=block_seconds)

    def machine():
        pos = [0.0]

        def step(*values):
            pos[0] = _hysteresis(pos[0], *values)
            return (pos[0],)

        return step

    return ordered_scan(df, [ts], cols, machine, T.StructType([T.StructField(out, T.DoubleType())]), key=key, long_keys=True)


def bracket_latch(
    df: DataFrame, enter: str, price: str, stop: str, target: str, max_hold: int, *, key: list[str], ts: str = "ts", out: str = "latched", trail: bool = False,
    exit_flag: str | None = None,
) -> DataFrame:
    """Enter on ``enter`` (-1, 0, 1); leave at a stop or target distance from the entry
    price, after ``max_hold`` bars, or on ``exit_flag``. With ``trail`` the stop follows
    the best price since entry. Distances are read at entry. No entry on the exit bar.
    """

    def machine():
        s = {"pos": 0, "entry": 0.0, "best": 0.0, "stop": 0.0, "target": 0.0, "held": 0}

        def step(sig, p, st, tg, *flag):
            if s["pos"] and p is not None:
                s["held"] += 1
                s["best"] = max(s["best"], p) if s["pos"] > 0 else min(s["best"], p)
                base = s["best"] if trail else s["entry"]
                gone = (p - base) * s["pos"] <= -s["stop"] or (not trail and (p - s["entry"]) * s["pos"] >= s["target"]) or s["held"] >= max_hold or bool(flag and flag[0])
                if gone:
                    s["pos"] = 0
                return (float(s["pos"]),)
            if not s["pos"] and sig and p is not None and st is not None and tg is not None:
                s.update(pos=int(sig), entry=p, best=p, stop=st, target=tg, held=0)
            return (float(s["pos"]),)

        return step

    cols = [enter, price, stop, target] + ([exit_flag] if exit_flag else [])
    return ordered_scan(df, [ts], cols, machine, T.StructType([T.StructField(out, T.DoubleType())]), key=key, long_keys=True)
