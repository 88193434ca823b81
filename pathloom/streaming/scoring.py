"""Predictions for a stream of pairs: every micro-batch goes through the static model, so there is no state to keep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from pathloom.plans.engine import Engine, Model


def score_stream(engine: Engine, model: Model, pairs: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes a, b, probability, predicted to out, one folder per batch; a batch that runs again replaces its folder.

    The tables that a batch needs on its way are deleted when its scores are written.
    """
    engine.adjacency()  # stays for all batches

    def one(batch: DataFrame, number: int) -> None:
        mark = len(engine.store.made)
        engine.predict(model, batch.select("a", "b").distinct()).write.mode("overwrite").parquet(f"{out}/batch={number}")
        engine.store.drop_since(mark)

    writer = pairs.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
