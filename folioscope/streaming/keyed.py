"""Feedback stream with state per target (M2).

Actions carry an event time.  One that comes again within `delay` is taken once, one that comes later
than that is left out, and late ones within it are put in their place: a target's state holds, for each
field, the value of the greatest seq and that seq.  The state of a target is all that a batch reads, so
its cost follows the actions that arrive, not the length of the log.

Each batch writes the targets it changed into its own partition of the table; a replay overwrites it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioscope.operators import feedback as fb

FIELDS = ("status", "note")
STATE = "status string, status_seq long, note string, note_seq long, actions long"
STATES = f"graph_id string, target_type string, target_id string, {STATE}"


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State of a target after the actions of a batch, whatever their order."""
    held = dict(zip(("status", "status_seq", "note", "note_seq", "actions"), state.get if state.exists else (None, None, None, None, 0)))
    for frame in frames:
        held["actions"] += len(frame)
        for field in FIELDS:
            rows = frame[frame[f"set_{field}"].notna()]
            if len(rows):
                last = rows.loc[rows["seq"].idxmax()]
                if held[f"{field}_seq"] is None or last["seq"] >= held[f"{field}_seq"]:
                    held[field], held[f"{field}_seq"] = last[f"set_{field}"], int(last["seq"])
    state.update(tuple(held.values()))
    columns = [*key, *held.values()]
    kinds = ["str", "str", "str", "str", "Int64", "str", "Int64", "Int64"]
    names = [c.split()[0] for c in STATES.split(", ")]
    yield pd.DataFrame({n: pd.Series([v], dtype=object if k == "str" else k) for n, v, k in zip(names, columns, kinds)})


def follow_keyed(log: DataFrame, table: str, checkpoint: str, delay: str = "1 hour", time: str = "ts") -> StreamingQuery:
    """Stream the log (graph_id, seq, target_type, target_id, action, comment, `time`) into the states at `table`.

    The actions of a graph are told apart by seq.
    """
    timed = log.withColumn(time, F.col(time).cast("timestamp"))
    taken = timed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["graph_id", "seq"])
    steps = fb.effects(taken).select(*fb.TARGET, "seq", *[f"set_{field}" for field in FIELDS])
    states = steps.groupBy(*fb.TARGET).applyInPandasWithState(_fold, STATES, STATE, "update", GroupStateTimeout.NoTimeout)

    def put(batch: DataFrame, batch_id: int) -> None:
        (
            batch.withColumn("batch_id", F.lit(batch_id).cast("long"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id")
            .parquet(table)
        )

    writer = states.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def keyed_states(spark: SparkSession, table: str) -> DataFrame:
    """The latest state of every target that had an action."""
    rows = spark.read.schema(f"{STATES}, batch_id long").parquet(table)
    names = [c.split()[0] for c in STATE.split(", ")]
    return rows.groupBy(*fb.TARGET).agg(F.max_by(F.struct(*names), "batch_id").alias("_s")).select(*fb.TARGET, "_s.*")


def current_state(elements: DataFrame, states: DataFrame) -> DataFrame:
    """Elements with the streamed actions applied; equals the batch fold of the actions that were taken."""
    last = states.select(*fb.TARGET, *[F.col(field).alias(f"set_{field}") for field in FIELDS])
    joined = elements.join(last, fb.TARGET, "left")
    fields = {field: F.coalesce(f"set_{field}", field) for field in FIELDS}
    return joined.withColumns(fields).drop(*[f"set_{field}" for field in FIELDS])
