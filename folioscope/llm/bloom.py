"""Bloom filters over a column, built and tested by Spark.

The filter has a greatest size that doesn't depend on the data, so it may be broadcast.  Beyond the
number of values it is made for it lets more values through; it never rejects one that is in it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HASHES = 3
BITS_PER_VALUE = 16
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28  # 128 kB to 32 MB


def _positions(value: Column, bits: int) -> list[Column]:
    """From 1 on, as the bitmap functions count."""
    return [F.pmod(F.xxhash64(value, F.lit(i)), F.lit(bits)) + 1 for i in range(HASHES)]


class Bloom:
    """Values of `column`, or with `repeated` only those that may occur in two rows at least.

    For `repeated`, a bit is set where two rows hit it.  A value that occurs twice has all its bits
    set; few others have.
    """

    def __init__(self, values: DataFrame, column: str, rows: int, repeated: bool = False):
        self.bits = LEAST_BITS
        while self.bits < min(MOST_BITS, rows * BITS_PER_VALUE):
            self.bits *= 2
        hits = values.select(F.explode(F.array(*_positions(F.col(column), self.bits))).alias("at"))
        if repeated:
            hits = hits.groupBy("at").count().filter("count > 1")
        blocks = hits.groupBy(F.expr("bitmap_bucket_number(at)").alias("block")).agg(
            F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("bitmap")
        )
        filled = np.zeros(self.bits // 8, np.uint8)
        for block, bitmap in blocks.toLocalIterator():  # at most MOST_BITS / 32768 rows of 4 kB
            start = (block - 1) * 4096
            filled[start : start + len(bitmap)] = np.frombuffer(bitmap, np.uint8)
        self.filled = values.sparkSession.sparkContext.broadcast(filled)

    def holds(self, value: Column) -> Column:
        """True for every value that is in the filter, and for few others; only `value` goes to Python."""
        filled = self.filled

        @F.pandas_udf("boolean")
        def test(positions: pd.DataFrame) -> pd.Series:
            found = np.ones(len(positions), bool)
            for name in positions.columns:
                at = positions[name].to_numpy(np.int64) - 1
                found &= (filled.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            return pd.Series(found)

        return test(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(_positions(value, self.bits))]))


def split(df: DataFrame, value: Column, bloom: Bloom, mark: str) -> tuple[DataFrame, DataFrame]:
    """(rows that are not in the filter, rows that may be); `mark` is a free column name."""
    marked = df.withColumn(mark, bloom.holds(value))
    return marked.filter(~F.col(mark)).drop(mark), marked.filter(F.col(mark)).drop(mark)
