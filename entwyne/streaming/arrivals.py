"""Arriving S1 records against a standing pool, batch by batch.

Everything the engine decides is per S1 entity, so a batch of arrivals gives what a full run gives for these entities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from entwyne.functions.text import normalise
from entwyne.operators import blocking, decision, pairs
from entwyne.plans.resolve import simple_score


def resolve_stream(arrivals: DataFrame, pool_views: DataFrame, output: str, checkpoint: str, rule: decision.Rule = decision.PRODUCTION, config: blocking.BlockingConfig = blocking.BlockingConfig(), k: int = 80):
    """A started query that appends (source1_entity_id, cand_id, batch) to Parquet. A replayed batch replaces its own files."""
    frequency = blocking.token_frequency(pool_views).persist()

    def each(batch: DataFrame, number: int) -> None:
        queries = normalise(batch)
        found = pairs.rerank_top(blocking.candidates(queries, pool_views, config, frequency), queries, pool_views, k)
        decision.apply(found.withColumn("p", simple_score()), rule).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return arrivals.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
