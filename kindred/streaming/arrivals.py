"""Candidates for entities as they arrive, against targets that don't change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from kindred.config import DEFAULT, Settings
from kindred.operators import blocking, cleaning


def prepare_targets(targets: DataFrame, folder: str, settings: Settings = DEFAULT) -> None:
    """Writes postings and attributes of cleaned targets, which every micro-batch reads; run it again when targets change."""
    blocking.postings(targets, settings).write.mode("overwrite").parquet(f"{folder}/postings")
    blocking.attributes(targets).write.mode("overwrite").parquet(f"{folder}/attributes")


def link_arrivals(stream: DataFrame, targets: DataFrame, out: str, checkpoint: str, settings: Settings = DEFAULT) -> StreamingQuery:
    """Writes (s1_id, target_id, score, rank, batch) of each arriving micro-batch of raw rows (ord, entity_id, business_name,
    business_address, country) below out, a folder for each batch: a batch that is run again replaces its own. No state is
    kept. Postings and attributes of the targets are made once, before the stream starts, and are joined as static tables."""
    made, spark = f"{out.rstrip('/')}-targets", targets.sparkSession
    prepare_targets(targets, made, settings)
    posted, looked_up = spark.read.parquet(f"{made}/postings"), spark.read.parquet(f"{made}/attributes")

    def run(batch: DataFrame, number: int) -> None:
        found = blocking.candidates_from(cleaning.clean_table(batch), posted, looked_up, settings)
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
