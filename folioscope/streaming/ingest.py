"""Incremental ingest: arriving documents to chunks, only unseen ids are added (M1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioscope.operators import chunk as ck
from folioscope.operators import segment as sg
from folioscope.session import path_exists, stage
from folioscope.streaming.seen import BUCKETS, SeenIds


def document_chunks(docs: DataFrame, rule: sg.HeadingRule, size: int = 700, overlap: int = 80) -> DataFrame:
    """Chunks of docs(doc_id, text), split at headings first."""
    chapters = sg.heading_sections(docs, "doc_id", rule)
    body = chapters.select("doc_id", "chapter_id", F.col("title").alias("chapter"), F.col("content").alias("text"))
    cut = ck.split_fixed(body, "text", size, overlap)
    return cut.withColumn(
        "chunk_id", F.concat_ws("_", "doc_id", "chapter_id", F.concat(F.lit("c"), F.col("chunk_no")))
    )


def ingest(
    docs: DataFrame,
    table: str,
    checkpoint: str,
    rule: sg.HeadingRule = sg.MARKDOWN,
    size: int = 700,
    overlap: int = 80,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Stream docs(doc_id, text) into the chunk table at `table`.

    Each micro-batch owns the partition `batch_id`: a replay overwrites it, so the result is
    the same however often a batch runs.  Ids other batches hold already are left out; they are looked up
    in buckets beside the table, so a batch reads what its own ids ask for.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = document_chunks(batch, rule, size, overlap).dropDuplicates(["chunk_id"])
        # staged: the ids are written after the table that this is the content of
        new = stage(new, "chunks")
        ids = new.select(F.col("chunk_id").alias("id"))
        seen = SeenIds(spark, f"{table}-ids", buckets)
        if not seen.exists() and path_exists(spark, table):  # a table from before there was an index of ids
            for stored in spark.read.parquet(table).select("batch_id").distinct().collect():
                own = spark.read.parquet(table).filter(F.col("batch_id") == stored.batch_id)
                seen.add(own.select(F.col("chunk_id").alias("id")), stored.batch_id)
        known = seen.known(ids, batch_id)
        unseen = stage(new.join(known.withColumnRenamed("id", "chunk_id"), "chunk_id", "left_anti"), "unseen")
        (
            unseen.withColumn("batch_id", F.lit(batch_id).cast("long"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id")
            .parquet(table)
        )
        seen.add(unseen.select(F.col("chunk_id").alias("id")), batch_id)

    return (
        docs.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
