"""Which ids a stream has taken already, in hash buckets with a Bloom filter each (M1).

A batch reads the filters of the buckets its ids fall in, and of those only the buckets where a filter
holds one of its ids.  Filters are built, joined and tested by bitmap functions.  They have 32768 bits per
bucket; an id that passes wrongly is compared with the ids themselves, so the answer is exact.  Buckets
should be many enough to hold some thousands of ids each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.session import path_exists, stage

BUCKETS = 256
BITS = 32_768  # of one bitmap
HASHES = 3


def _places(key: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(BITS)) for i in range(HASHES)]


def _has_bit(bitmap: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.call_function("getbit", byte, (place % 8).cast("int")) == 1


class SeenIds:
    """Ids below `root`, each with the batch that took it."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root, buckets

    def exists(self) -> bool:
        return path_exists(self.spark, f"{self.root}/ids")

    def _bucketed(self, ids: DataFrame) -> DataFrame:
        return ids.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int"))

    def _read(self, name: str, columns: str, batch_id: int) -> DataFrame:
        rows = self.spark.read.schema(f"{columns}, bucket int, batch_id long").parquet(f"{self.root}/{name}")
        return rows.filter(F.col("batch_id") != batch_id)

    def suspects(self, ids: DataFrame, batch_id: int) -> DataFrame:
        """(id, bucket) of `ids` that a filter of another batch holds."""
        given = self._bucketed(ids)
        touched = [r[0] for r in given.select("bucket").distinct().collect()]  # at most `buckets` numbers
        filters = self._read("filters", "bitmap binary", batch_id).filter(F.col("bucket").isin(touched))
        joined = filters.groupBy("bucket").agg(F.expr("bitmap_or_agg(bitmap)").alias("bitmap"))
        hits = [_has_bit(F.col("bitmap"), place) for place in _places(F.col("id"))]
        return given.join(F.broadcast(joined), "bucket").filter(hits[0] & hits[1] & hits[2]).select("id", "bucket")

    def known(self, ids: DataFrame, batch_id: int) -> DataFrame:
        """Those of ids(id) that another batch has taken."""
        if not self.exists():
            return ids.limit(0)
        maybe = stage(self.suspects(ids, batch_id), "suspects")
        asked = [r[0] for r in maybe.select("bucket").distinct().collect()]
        stored = self._read("ids", "id string", batch_id).filter(F.col("bucket").isin(asked))
        return maybe.select("id").join(stored.select("id"), "id", "left_semi")

    def add(self, ids: DataFrame, batch_id: int) -> None:
        """Record ids(id) for the batch; a replay overwrites what it recorded before."""
        rows = stage(self._bucketed(ids.distinct()).withColumn("batch_id", F.lit(batch_id).cast("long")), "seen")
        bits = rows.select("bucket", F.explode(F.array(*_places(F.col("id")))).alias("place"))
        bitmaps = bits.groupBy("bucket").agg(F.expr("bitmap_construct_agg(place)").alias("bitmap"))
        bitmaps = bitmaps.withColumn("batch_id", F.lit(batch_id).cast("long"))
        for name, table in (("filters", bitmaps), ("ids", rows)):
            (
                table.repartition("bucket")
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy("bucket", "batch_id")
                .parquet(f"{self.root}/{name}")
            )
