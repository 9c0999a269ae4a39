"""An extension beyond the DSL: a stream whose micro-batches are merged into an engine's table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quernel.engine import Engine
from quernel.plans.expr import field_
from quernel.plans.statements import merge, select


def merge_stream(engine: Engine, stream: DataFrame, table: str, keys: tuple[str, ...], latest_by: str, checkpoint: str) -> StreamingQuery:
    """Upserts each micro-batch by key; of a key's rows in a batch the one with the largest ``latest_by`` counts.

    An engine with a folder is needed for snapshots that outlive a batch. A batch that is run again merges the same rows.
    """
    if not engine.folder:
        raise ValueError("streams need an engine with a folder")

    def take(batch: DataFrame, _: int) -> None:
        w = Window.partitionBy(*keys).orderBy(F.col(latest_by).desc())
        once = batch.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
        name = f"__batch_{table}"
        engine.frames[name.lower()] = once
        try:
            engine.execute(merge().into(table).table_unique_key(*keys).from_(select(*map(field_, once.columns)).from_(name)))
        finally:
            engine.frames.pop(name.lower(), None)

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
