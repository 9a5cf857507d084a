"""Incremental cleaning: the batch flow's columns over a stream of landing files.

Each micro-batch is cleaned, split and appended to two Parquet folders partitioned by batch, so that a batch that is run
again after a failure replaces what it wrote before. Ids are unique within a batch; latest() gives the current row per id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarrymill.operators.lookup import latest_per_key
from quarrymill.plans import cleaning as flow
from quarrymill.sources.files import text_schema


def landing(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Stream of raw text records from delimited files (.gz included) that appear in a folder."""
    reader = spark.readStream.schema(text_schema(flow.RAW_COLUMNS)).option("header", True).option("escape", '"')
    return reader.option("maxFilesPerTrigger", files_per_batch).csv(path)


def clean_stream(
    raw: DataFrame, brand_map: DataFrame, rules: flow.CatalogRules, out: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Start cleaning; with available_now the query ends when it has caught up, else it runs on."""

    def sink(batch: DataFrame, number: int) -> None:
        flags = flow.flagged(batch, brand_map, rules).persist()
        try:
            flow.clean(flags).write.mode("overwrite").parquet(f"{out}/clean/batch={number}")
            flow.to_quarantine(flags).write.mode("overwrite").parquet(f"{out}/quarantine/batch={number}")
        finally:
            flags.unpersist()

    writer = raw.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The current clean row of each id over all batches: the latest date, then the latest batch."""
    rows = spark.read.option("basePath", f"{out}/clean").parquet(f"{out}/clean")
    return latest_per_key(rows, ["product_id"], "date_added", ["batch", "price_zar", "cost_zar", "sku"]).select(
        *[F.col(c) for c in flow.CLEAN_COLUMNS]
    )
