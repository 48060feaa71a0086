"""Scoring a stream with a fitted auditor: the score is a projection, so it needs no state, window or watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.audit import Auditor


def score_stream(stream: DataFrame, auditor: Auditor, sink: str, checkpoint: str, trigger: dict | None = None):
    """Appends every micro-batch, scored, to a Parquet table; batches that are replayed overwrite their own folder."""

    def step(batch: DataFrame, number: int) -> None:
        auditor.score(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
