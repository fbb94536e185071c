"""Running values over long groups.

A window over one key runs in one task.  These scans cut a key into blocks of its order
column, scan the blocks in parallel and carry each block's result to the later ones; only
one summary row per block meets in a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 100_000


def _blocked(df: DataFrame, order: str, block: int) -> DataFrame:
    return df.withColumn("_block", F.floor(F.col(order) / block))


def running_count(
    df: DataFrame, keys: Sequence[str], order: str, flag: Column, name: str, block: int = BLOCK
) -> DataFrame:
    """Number of flagged rows up to and including this one, per key."""
    cut = _blocked(df.withColumn("_flag", flag.cast("long")), order, block)
    # rows, not values: rows of equal order are counted one by one
    inner = W.partitionBy(*keys, "_block").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    outer = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = (
        cut.groupBy(*keys, "_block")
        .agg(F.sum("_flag").alias("_sum"))
        .select(*keys, "_block", F.coalesce(F.sum("_sum").over(outer), F.lit(0)).alias("_carry"))
    )
    local = cut.withColumn("_local", F.sum("_flag").over(inner))
    return local.join(carried, [*keys, "_block"]).withColumn(name, F.col("_local") + F.col("_carry")).drop(
        "_flag", "_block", "_local", "_carry"
    )


def running_last(
    df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], suffix: str = "_before", block: int = BLOCK
) -> DataFrame:
    """Last non-null of each value strictly before this row, per key."""
    cut = _blocked(df, order, block)
    inner = W.partitionBy(*keys, "_block").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    outer = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    ends = cut.groupBy(*keys, "_block").agg(
        *[F.max_by(v, F.when(F.col(v).isNotNull(), F.col(order))).alias(f"_end_{v}") for v in values]
    )
    carried = ends.select(
        *keys, "_block", *[F.last(f"_end_{v}", ignorenulls=True).over(outer).alias(f"_carry_{v}") for v in values]
    )
    local = cut.withColumns({f"_local_{v}": F.last(v, ignorenulls=True).over(inner) for v in values})
    joined = local.join(carried, [*keys, "_block"]).withColumns(
        {f"{v}{suffix}": F.coalesce(f"_local_{v}", f"_carry_{v}") for v in values}
    )
    return joined.drop("_block", *[f"_local_{v}" for v in values], *[f"_carry_{v}" for v in values])
