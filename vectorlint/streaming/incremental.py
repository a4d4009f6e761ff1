"""Incremental validation with Structured Streaming.

The reference validates one uploaded file at a time and appends what it
finds to its registry.  Here newly arriving feature files (parquet with the
feature schema, or GeoJSONSeq) are read as a stream; every micro-batch is
validated with the batch runner and its violations are appended to the
registry's ``violations`` table with a run id and feature hashes.  Progress
lives in the stream checkpoint; a batch that is tried again replaces its own
rows, as they are appended under the dataset's name and the batch number.

Pair rules inside a micro-batch see only that batch's features: arriving
files are treated as whole datasets, as uploads are in the reference.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectorlint.plans.registry import RegistryStore, feature_hash
from vectorlint.plans.runners import validate


def start(spark: SparkSession, source: str, schema: T.StructType, dataset_type: str, registry_root: str,
          checkpoint_location: str, fmt: str = "parquet", available_now: bool = True, dataset: str | None = None):
    """Start the stream; returns the StreamingQuery.  With ``available_now``
    it processes what is there and stops (batch-like scheduling)."""
    dataset = dataset or hashlib.sha256(source.encode()).hexdigest()[:12]
    stream = spark.readStream.schema(schema).format(fmt).load(source)
    store = RegistryStore(spark, registry_root)

    def on_batch(batch: DataFrame, epoch_id: int) -> None:
        v = validate(batch, dataset_type)
        out = v.select(
            F.lit(f"{dataset_type}-{dataset}-{epoch_id}").alias("run_id"), F.col("error_type").alias("rule_id"),
            feature_hash(dataset_type).alias("feature_hash"), "fid", "part", "error_type", "message", "metric",
            F.lit("invalid").alias("status"), F.current_timestamp().alias("set_at"))
        store.append("violations", out, key=f"{dataset_type}-{dataset}-{epoch_id}")

    w = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
