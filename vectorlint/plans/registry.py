"""The issue registry: datasets, rules, runs, violations, statuses and the
current-state table, kept as parquet tables and updated by DataFrame jobs.

There is no MERGE on plain parquet, so every upsert here is a pure function
``old tables -> new table`` (anti join + union, or a full outer join), and
``RegistryStore`` writes each new version as a fresh snapshot folder under
the registry root (readers take the newest complete one): a path being read
is never overwritten.  All "latest per key" logic is an aggregate of
``max(struct(time, id, ...))`` (map-side partial aggregation), so one
feature with a huge status history is not gathered into one task.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorlint.operators.violations import comparable  # noqa: F401  (re-export for callers)

VIOLATION_KEY = ["run_id", "rule_id", "feature_hash"]


# ------------------------------------------------------------ identities --

def feature_hash(dtype: str | F.Column, fid="fid", error_type="error_type", message="message",
                 geom_key: F.Column | None = None) -> F.Column:
    """md5("dtype|index|error_type|message[|geometry key]")."""
    d = dtype if isinstance(dtype, F.Column) else F.lit(dtype)
    parts = [d, F.coalesce(F.col(fid).cast("string"), F.lit("")), F.coalesce(F.col(error_type), F.lit("")),
             F.coalesce(F.col(message), F.lit(""))]
    if geom_key is not None:
        parts.append(geom_key)
    return F.md5(F.concat_ws("|", *parts))


def dataset_id(dataset_type: F.Column, content_md5: F.Column) -> F.Column:
    """Q1 key: one dataset per (type, content hash), id derived from both."""
    return F.md5(F.concat_ws("|", dataset_type, content_md5))


# -------------------------------------------------------------- upserts ----

def upsert_datasets(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Q1: add (dataset_type, content_md5) rows not yet present."""
    inc = incoming.select("dataset_type", "content_md5").dropDuplicates()
    new = inc.join(existing.select("dataset_type", "content_md5"), ["dataset_type", "content_md5"], "left_anti")
    out = existing.select("dataset_type", "content_md5").unionByName(new)
    return out.withColumn("dataset_id", dataset_id(F.col("dataset_type"), F.col("content_md5")))


def upsert_rules(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Q2: one row per rule_key (null -> 'unknown'); rule_id = rule_key."""
    norm = lambda d: d.select(F.coalesce(F.col("rule_key"), F.lit("unknown")).alias("rule_key")).distinct()
    old, inc = norm(existing), norm(incoming)
    out = old.unionByName(inc.join(old, "rule_key", "left_anti"))
    return out.withColumn("rule_id", F.col("rule_key"))


def begin_run(runs: DataFrame, run_id: str, dataset: str, started_at) -> DataFrame:
    """Q3: append a 'running' row."""
    spark = runs.sparkSession
    row = spark.createDataFrame([(run_id, dataset, "running", started_at, None)], runs.schema)
    return runs.unionByName(row)


def finish_run(runs: DataFrame, run_id: str, status: str, finished_at) -> DataFrame:
    """Q3: close a run (succeeded / failed) by rewriting its row."""
    hit = F.col("run_id") == F.lit(run_id)
    return runs.select(
        "run_id", "dataset_id",
        F.when(hit, F.lit(status)).otherwise(F.col("status")).alias("status"), "started_at",
        F.when(hit, F.lit(finished_at).cast(runs.schema["finished_at"].dataType)).otherwise(F.col("finished_at")).alias("finished_at"))


def run_log(history: DataFrame) -> DataFrame:
    """Q3 from a status history: one row per run, first and last time."""
    return history.groupBy("run_id").agg(F.min("set_at").alias("started_at"), F.max("set_at").alias("finished_at"),
                                         F.lit("succeeded").alias("status"))


def write_violations(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Q4: insert-or-ignore on (run_id, rule_id, feature_hash): only the
    first incoming row per key (smallest status/row id), and only keys not
    already stored.  Null lat/lon are kept."""
    first = incoming.groupBy(*VIOLATION_KEY).agg(F.min(F.struct(*[c for c in incoming.columns if c not in VIOLATION_KEY])).alias("r"))
    new = first.select(*VIOLATION_KEY, "r.*")
    new = new.join(existing.select(*VIOLATION_KEY), VIOLATION_KEY, "left_anti")
    return existing.unionByName(new.select(*existing.columns))


def initial_status(new_violations: DataFrame, set_at) -> DataFrame:
    """Q5: every new violation starts as 'invalid', set by 'system'."""
    return new_violations.select(*VIOLATION_KEY, F.lit("invalid").alias("status"), F.lit("system").alias("set_by"),
                                 F.lit(set_at).alias("set_at"))


def latest_status(status: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Q6: newest status per violation, by set_at desc then status_id desc
    (``max`` of a struct: partial aggregation, skew-proof)."""
    key = key or VIOLATION_KEY
    g = status.groupBy(*key).agg(F.max(F.struct("set_at", "status_id", "status")).alias("m"))
    return g.select(*key, F.col("m.status").alias("status"), F.col("m.status_id").alias("status_id"),
                    F.col("m.set_at").alias("set_at"))


def reconcile_state(state: DataFrame, current: DataFrame, now) -> DataFrame:
    """Q7: new current-state table.  ``state``: (dataset_type, feature_hash,
    status, resolved_at, ...); ``current``: (dataset_type, feature_hash) found
    by this run.  Current hashes become 'invalid' (resolved_at cleared);
    hashes that were 'invalid' and are not current become 'resolved' at
    ``now``; everything else is kept."""
    k = ["dataset_type", "feature_hash"]
    cur = current.select(*k).distinct().withColumn("_cur", F.lit(True))
    j = state.select(*k, "status", "resolved_at").join(cur, k, "full_outer")
    ts = F.lit(now).cast("timestamp")
    return j.select(
        *k,
        F.when(F.col("_cur"), F.lit("invalid"))
         .when(F.col("status") == "invalid", F.lit("resolved")).otherwise(F.col("status")).alias("status"),
        F.when(F.col("_cur"), F.lit(None).cast("timestamp"))
         .when(F.col("status") == "invalid", ts).otherwise(F.col("resolved_at").cast("timestamp")).alias("resolved_at"))


def status_counts(latest: DataFrame) -> DataFrame:
    """Q8: rows per status."""
    return latest.groupBy("status").agg(F.count("*").alias("n"))


def status_counts_by_rule(latest: DataFrame, rule_col: str = "rule_id") -> DataFrame:
    """Q8: rows per (rule, status), largest first."""
    return latest.groupBy(rule_col, "status").agg(F.count("*").alias("n")).orderBy(F.desc("n"), rule_col, "status")


def default_run(runs: DataFrame) -> DataFrame:
    """Q9: newest run first; the default is the first succeeded one."""
    return runs.where("status = 'succeeded'").orderBy(F.desc("started_at"), F.desc("run_id")).limit(1)


def map_points(state: DataFrame, time_col: str = "set_at") -> DataFrame:
    """Q10: latest row per hash by time, without null, out-of-range or (0, 0)
    coordinates."""
    g = state.groupBy("feature_hash").agg(F.max(F.struct(time_col, "status", "lat", "lon")).alias("m"))
    p = g.select("feature_hash", "m.status", "m.lat", "m.lon")
    return p.where("lat IS NOT NULL AND lon IS NOT NULL AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 "
                   "AND NOT (lat = 0 AND lon = 0)")


def cascade_delete(runs: DataFrame, violations: DataFrame, status: DataFrame, dataset_ids: DataFrame):
    """Q12: drop the datasets' runs, then their violations and statuses."""
    r = runs.join(dataset_ids.select("dataset_id"), "dataset_id", "left_anti")
    v = violations.join(r.select("run_id"), "run_id", "left_semi")
    s = status.join(v.select(*VIOLATION_KEY), VIOLATION_KEY, "left_semi")
    return r, v, s


# ---------------------------------------------------------------- store ----

class RegistryStore:
    """Parquet snapshots under ``root`` (any Hadoop file system; shared
    storage on a cluster): ``root/<table>/v=<millis>-<uuid>/``.  Readers take
    the newest version that has a ``_SUCCESS`` marker, so a write never
    touches a folder that may be being read.  Appends go to
    ``root/<table>/append/`` with Spark's append commit."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _fs(self, path: str):
        return self._Path(path).getFileSystem(self._conf)

    def _folders(self, table: str, kind: str) -> list[str]:
        """Complete folders ``<kind>=<time>-<name>`` of a table, oldest first."""
        base = f"{self.root}/{table}"
        fs = self._fs(base)
        if not fs.exists(self._Path(base)):
            return []
        names = sorted(st.getPath().getName() for st in fs.listStatus(self._Path(base)) if st.isDirectory())
        return [n for n in names if n.startswith(f"{kind}=") and fs.exists(self._Path(f"{base}/{n}/_SUCCESS"))]

    def read(self, table: str) -> DataFrame | None:
        """The newest snapshot and every append made after it."""
        snaps = self._folders(table, "v")
        since = snaps[-1].partition("=")[2] if snaps else ""
        found = snaps[-1:] + [n for n in self._folders(table, "a") if n.partition("=")[2] > since]
        frames = [self.spark.read.parquet(f"{self.root}/{table}/{n}") for n in found]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None

    def write(self, table: str, df: DataFrame) -> str:
        ver = f"v={self._now()}-{uuid.uuid4().hex[:8]}"
        df.write.mode("errorifexists").parquet(f"{self.root}/{table}/{ver}")
        return ver

    def _now(self) -> str:
        import time
        return f"{int(time.time() * 1000):015d}"

    def append(self, table: str, df: DataFrame, key: str | None = None) -> None:
        """Q11: append rows, scalar columns only.  Rows appended under a
        ``key`` replace those of an earlier try with the same key."""
        scalar = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("struct", "array", "map")]
        name = f"a={self._now()}-{key or uuid.uuid4().hex[:8]}"
        if key is not None:
            base = f"{self.root}/{table}"
            fs = self._fs(base)
            before = [st.getPath().getName() for st in fs.listStatus(self._Path(base))] if fs.exists(self._Path(base)) else []
            name = next((n for n in before if n.startswith("a=") and n.partition("-")[2] == key), name)
        df.select(*scalar).write.mode("overwrite").parquet(f"{self.root}/{table}/{name}")
