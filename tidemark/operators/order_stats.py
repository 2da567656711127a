"""Rolling quantiles and ranks by order-statistic structures, for windows of any length.

``rolling.rolling_quantile`` and ``rolling_rank_pct`` look at a whole frame for every row. Here a key is
dealt in blocks of rows with the rows that the first windows of a block reach back to; inside
a block the values of the window are kept in an indexable skip list, so a row costs the logarithm
of the window. A block holds twice the longer of ``block_rows`` and the window, whatever the key's length.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.chains import place_rows

BLOCK_ROWS = 16_384


def rolling_order(
    df: DataFrame, x: str, k: int, *, key: list[str], ts: str = "ts", quantiles: dict[str, float] | None = None, rank: str | None = None, least: int | None = None, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``df`` with quantiles (name -> q, linear) and the rank of ``x`` over the last ``k`` rows of its key.

    Null and NaN values count as rows of the window and enter nothing; with fewer than ``least`` (``k``
    by default) others the result is null. ``rank`` names the average-tie rank of the row's own
    value over the count, null where the value is. Times of a key are distinct.
    """
    quantiles, least = quantiles or {}, k if least is None else least
    size = max(block_rows, k - 1)
    names = [*quantiles, *([rank] if rank else [])]
    placed = place_rows(df.withColumn("__x", F.col(x).cast("double")), ts, key=key, out="__i")
    block = F.floor(F.col("__i") / size).cast("long")
    row = F.struct(*[F.col(c) for c in df.columns])
    own = placed.select(*key, block.alias("__b"), "__i", "__x", row.alias("__row"))
    back = placed.where(F.pmod("__i", F.lit(size)) > size - k).select(*key, (block + 1).alias("__b"), "__i", "__x", F.lit(None).cast(own.schema["__row"].dataType).alias("__row"))
    schema = T.StructType([T.StructField("__row", own.schema["__row"].dataType), *[T.StructField(c, T.DoubleType()) for c in names]])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("__i")
        window = pd.Series(table.column("__x").to_numpy(zero_copy_only=False)).rolling(k, min_periods=least)
        found = {c: window.quantile(q) for c, q in quantiles.items()}
        if rank:
            found[rank] = window.rank(pct=True)
        made = pa.table([table.column("__row"), *[pa.array(found[c], pa.float64(), from_pandas=True) for c in names]], names=["__row", *names])
        return made.filter(made.column("__row").is_valid())

    done = own.unionByName(back).groupBy(*key, "__b").applyInArrow(run, schema)
    return done.select("__row.*", *names)
