"""SparkSession construction and checkpoint-directory handling."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "vectorlint",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Session with AQE (coalescing + skew-join splitting) and the UI off.

    On a cluster ``master`` stays None so spark-submit decides; locally the
    tests pass ``local[*]``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    cpus = os.cpu_count() or 8
    b = (b.config("spark.ui.enabled", "false")
          .config("spark.ui.showConsoleProgress", "false")
          .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
          .config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "4")
          .config("spark.sql.session.timeZone", "UTC")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true")
          .config("spark.driver.memory", os.environ.get("VECTORLINT_DRIVER_MEM", "16g")))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster sets it to shared storage.  Only a local session may do without
    (tests): it gets a scratch folder.  On a cluster a machine-local folder
    would be invisible to the executors, so an unset folder raises there.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder when the master is not local")
        d = tempfile.mkdtemp(prefix="vectorlint-ckpt-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def materialize(df, name: str):
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back: lineage ends there, so a lost executor costs nothing upstream."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/vectorlint/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df, key: str | None = None):
    """Give per-row-heavy geometry work enough tasks: when an input arrives
    in fewer partitions than the cluster has cores (a small file), hash it
    out over ``defaultParallelism`` partitions.  A multi-file input at scale
    already has more partitions than cores and is returned unchanged."""
    sc = df.sparkSession.sparkContext
    want = sc.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want, key) if key else df.repartition(want)
