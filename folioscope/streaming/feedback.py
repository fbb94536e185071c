"""Feedback stream: fold arriving actions into the current element state (M2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioscope.operators import feedback as fb

STATE = "graph_id string, target_type string, target_id string, field string, value string, seq long, batch_id long"


def follow(log: DataFrame, table: str, checkpoint: str, trail: str | None = None) -> StreamingQuery:
    """Stream the log into per-batch folds at `table`, and its actions into the audit table `trail`.

    A batch stores, per target and field, only the last value it set and its seq.  Folds of
    batches combine by max_by, so late, repeated or replayed actions give the batch result.
    """

    def fold(batch: DataFrame, batch_id: int) -> None:
        steps = fb.effects(batch)
        pairs = F.array(
            *[F.struct(F.lit(name).alias("field"), F.col(f"set_{name}").alias("value")) for name in ("status", "note")]
        )
        rows = steps.select(*fb.TARGET, "seq", F.inline(pairs)).filter(F.col("value").isNotNull())
        last = rows.groupBy(*fb.TARGET, "field").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))
        (
            last.withColumn("batch_id", F.lit(batch_id).cast("long"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id")
            .parquet(table)
        )

        if trail is not None:
            (
                steps.withColumn("batch_id", F.lit(batch_id).cast("long"))
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy("batch_id")
                .parquet(trail)
            )

    return (
        log.writeStream.foreachBatch(fold)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def audit_trail(spark: SparkSession, elements: DataFrame, trail: str) -> DataFrame:
    """Audit records of all streamed actions; a replayed batch has overwritten its own part."""
    log = spark.read.parquet(trail).drop("batch_id", "set_status", "set_note")
    return fb.audit(elements, log)


def current_state(spark: SparkSession, elements: DataFrame, table: str) -> DataFrame:
    """Elements with the streamed actions applied; equals the batch fold of the same log."""
    folds = spark.read.schema(STATE).parquet(table)
    last = folds.groupBy(*fb.TARGET).agg(
        *[
            F.max_by("value", F.when(F.col("field") == name, F.col("seq"))).alias(f"set_{name}")
            for name in ("status", "note")
        ]
    )
    joined = elements.join(last, fb.TARGET, "left")
    return joined.withColumns(
        {"status": F.coalesce("set_status", "status"), "note": F.coalesce("set_note", "note")}
    ).drop("set_status", "set_note")
