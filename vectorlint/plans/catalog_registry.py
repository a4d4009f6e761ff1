"""Registered registry queries over the status history (B6) and the
feature hash (R9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectorlint.operators import network as N
from vectorlint.plans import registry as RG
from vectorlint.plans.catalog import register, with_
from vectorlint.plans.catalog_network import _N1
from vectorlint.sources import fixtures as FX

B6 = FX.status_history_sql()


def _hist(spark, sf):
    return FX.status_history(spark, sf)


@register("upsert_dataset", with_(B6, """
ex AS (SELECT DISTINCT rule_key AS dataset_type, feature_hash AS content_md5 FROM b6 WHERE run_id IN (0, 1)),
inc AS (SELECT DISTINCT rule_key AS dataset_type, feature_hash AS content_md5 FROM b6 WHERE run_id IN (2, 3)),
allr AS (SELECT * FROM ex UNION ALL (SELECT * FROM inc EXCEPT SELECT * FROM ex))""") +
          "\nSELECT dataset_type, content_md5, md5(dataset_type || '|' || content_md5) AS dataset_id FROM allr")
def q_upsert_dataset(spark, sf):
    """Q1: datasets seen in runs 0-1, then the (type, content) pairs of runs
    2-3 are upserted."""
    h = _hist(spark, sf).select(F.col("rule_key").alias("dataset_type"), F.col("feature_hash").alias("content_md5"), "run_id")
    ex = h.where("run_id IN (0, 1)").select("dataset_type", "content_md5").distinct()
    inc = h.where("run_id IN (2, 3)")
    return RG.upsert_datasets(ex, inc)


@register("upsert_rules", with_(B6, """
ex AS (SELECT DISTINCT coalesce(rule_key, 'unknown') AS rule_key FROM b6 WHERE run_id IN (0, 1)),
inc AS (SELECT DISTINCT coalesce(rule_key, 'unknown') AS rule_key FROM b6 WHERE run_id IN (2, 3))""") +
          "\nSELECT rule_key, rule_key AS rule_id FROM (SELECT * FROM ex UNION SELECT * FROM inc)")
def q_upsert_rules(spark, sf):
    """Q2."""
    h = _hist(spark, sf)
    return RG.upsert_rules(h.where("run_id IN (0, 1)"), h.where("run_id IN (2, 3)"))


@register("run_log", with_(B6) +
          "\nSELECT run_id, epoch_us(min(set_at)) AS started_us, epoch_us(max(set_at)) AS finished_us, 'succeeded' AS status "
          "FROM b6 GROUP BY run_id")
def q_run_log(spark, sf):
    """Q3: one closed run per run id."""
    r = RG.run_log(_hist(spark, sf))
    return r.select("run_id", F.unix_micros(F.col("started_at").cast("timestamp")).alias("started_us"),
                    F.unix_micros(F.col("finished_at").cast("timestamp")).alias("finished_us"), "status")


def _incoming(spark, sf):
    return _hist(spark, sf).select("run_id", F.col("rule_key").alias("rule_id"), "feature_hash", "status_id", "lat", "lon")


@register("write_violations", with_(B6, """
firsts AS (SELECT run_id, rule_key AS rule_id, feature_hash, min(status_id) AS status_id FROM b6 GROUP BY run_id, rule_key, feature_hash)""") +
          "\nSELECT f.run_id, f.rule_id, f.feature_hash, f.status_id, b.lat, b.lon FROM firsts f JOIN b6 b ON b.status_id = f.status_id")
def q_write_violations(spark, sf):
    """Q4: insert-or-ignore on (run, rule, hash) into an empty table."""
    inc = _incoming(spark, sf)
    empty = inc.limit(0)
    return RG.write_violations(empty, inc)


@register("initial_status", with_(B6) +
          "\nSELECT DISTINCT run_id, rule_key AS rule_id, feature_hash, 'invalid' AS status, 'system' AS set_by FROM b6")
def q_initial_status(spark, sf):
    """Q5: a first 'invalid' status for every new violation."""
    inc = _incoming(spark, sf)
    v = RG.write_violations(inc.limit(0), inc)
    return RG.initial_status(v, None).drop("set_at")


LATEST = """
lat0 AS (SELECT run_id, rule_key AS rule_id, feature_hash, status, status_id,
                row_number() OVER (PARTITION BY run_id, rule_key, feature_hash ORDER BY set_at DESC, status_id DESC) AS rn FROM b6),
latest AS (SELECT run_id, rule_id, feature_hash, status, status_id FROM lat0 WHERE rn = 1)"""


def _latest(spark, sf):
    h = _hist(spark, sf).withColumnRenamed("rule_key", "rule_id")
    return RG.latest_status(h)


@register("latest_status", with_(B6, LATEST) + "\nSELECT * FROM latest")
def q_latest_status(spark, sf):
    """Q6: newest status per violation (set_at desc, status_id desc)."""
    return _latest(spark, sf).drop("set_at")


@register("reconcile_state", with_(B6, """
prev AS (SELECT DISTINCT feature_hash FROM b6 WHERE run_id <= 2 AND status = 'invalid'),
cur AS (SELECT DISTINCT feature_hash FROM b6 WHERE run_id = 3)""") + """
SELECT coalesce(c.feature_hash, p.feature_hash) AS feature_hash,
       CASE WHEN c.feature_hash IS NOT NULL THEN 'invalid' ELSE 'resolved' END AS status
FROM prev p FULL OUTER JOIN cur c ON c.feature_hash = p.feature_hash""")
def q_reconcile_state(spark, sf):
    """Q7: what runs 0 to 2 found invalid, reconciled with what run 3 found."""
    h = _hist(spark, sf)
    state = (h.where("run_id <= 2 AND status = 'invalid'").select("feature_hash").distinct()
              .select(F.lit("events").alias("dataset_type"), "feature_hash", F.lit("invalid").alias("status"),
                      F.lit(None).cast("timestamp").alias("resolved_at")))
    cur = h.where("run_id = 3").select(F.lit("events").alias("dataset_type"), "feature_hash")
    return RG.reconcile_state(state, cur, "2025-01-01 00:00:00").select("feature_hash", "status")


@register("status_counts", with_(B6, LATEST) + "\nSELECT status, CAST(count(*) AS BIGINT) AS n FROM latest GROUP BY status")
def q_status_counts(spark, sf):
    """Q8: latest statuses by status."""
    return RG.status_counts(_latest(spark, sf))


@register("status_counts_by_rule", with_(B6, LATEST) +
          "\nSELECT rule_id, status, CAST(count(*) AS BIGINT) AS n FROM latest GROUP BY rule_id, status")
def q_status_counts_by_rule(spark, sf):
    """Q8: latest statuses by (rule, status), largest first."""
    return RG.status_counts_by_rule(_latest(spark, sf))


@register("viewer_default_run", with_(B6, """
runs AS (SELECT run_id, min(set_at) AS started_at FROM b6 GROUP BY run_id),
dflt AS (SELECT run_id FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 1)""") + """
SELECT b.run_id, round(avg(b.lat), 6) AS centre_lat, round(avg(b.lon), 6) AS centre_lon
FROM b6 b JOIN dflt d ON d.run_id = b.run_id GROUP BY b.run_id""")
def q_viewer_default_run(spark, sf):
    """Q9: the default (newest succeeded) run and the centre of its points."""
    h = _hist(spark, sf)
    d = RG.default_run(RG.run_log(h)).select("run_id")
    pts = h.join(d, "run_id", "left_semi")
    return pts.groupBy("run_id").agg(F.round(F.avg("lat"), 6).alias("centre_lat"), F.round(F.avg("lon"), 6).alias("centre_lon"))


@register("map_points", with_(B6, """
m0 AS (SELECT feature_hash, status, lat, lon,
              row_number() OVER (PARTITION BY feature_hash ORDER BY set_at DESC, status DESC, lat DESC, lon DESC) AS rn FROM b6)""") + """
SELECT feature_hash, status, lat, lon FROM m0
WHERE rn = 1 AND lat IS NOT NULL AND lon IS NOT NULL AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (lat = 0 AND lon = 0)""")
def q_map_points(spark, sf):
    """Q10: plottable latest point per hash."""
    return RG.map_points(_hist(spark, sf))


@register("cascade_delete", with_(B6) + """
SELECT run_id, CAST(count(DISTINCT (rule_key, feature_hash)) AS BIGINT) AS n_violations, CAST(count(*) AS BIGINT) AS n_status
FROM b6 WHERE run_id <> 1 GROUP BY run_id""")
def q_cascade_delete(spark, sf):
    """Q12: delete the dataset of run 1 with its runs, violations, statuses."""
    h = _hist(spark, sf)
    runs = RG.run_log(h).withColumn("dataset_id", F.concat(F.lit("d"), F.col("run_id").cast("string")))
    inc = _incoming(spark, sf)
    viol = RG.write_violations(inc.limit(0), inc)
    status = h.withColumnRenamed("rule_key", "rule_id")
    gone = runs.where("run_id = 1").select("dataset_id")
    r, v, s = RG.cascade_delete(runs, viol, status, gone)
    nv = v.groupBy("run_id").agg(F.count("*").alias("n_violations"))
    ns = s.groupBy("run_id").agg(F.count("*").alias("n_status"))
    return nv.join(ns, "run_id")


@register("feature_hash", with_(*_N1) + """
SELECT fid, md5('road|' || CAST(fid AS VARCHAR) || '|EndpointIsolated|Segment has endpoints that appear only once in the network') AS feature_hash
FROM cand""")
def q_feature_hash(spark, sf):
    """Registry hash of each road violation."""
    v = N.endpoint_isolated(FX.roads(spark, sf))
    return v.select("fid", RG.feature_hash("road").alias("feature_hash"))


@register("append_failed", with_(B6) + "\nSELECT run_id, rule_key, feature_hash, status_id FROM b6")
def q_append_failed(spark, sf):
    """Q11: runs 0-1 as a snapshot, run 2 appended, run 3 appended twice under
    one key (a batch tried again): read back, every row is there once."""
    import uuid

    from vectorlint.session import checkpoint_dir
    h = _hist(spark, sf).select("run_id", "rule_key", "feature_hash", "status_id")
    store = RG.RegistryStore(spark, f"{checkpoint_dir(spark).rstrip('/')}/vectorlint/registry-{uuid.uuid4().hex}")
    store.write("violations", h.where("run_id <= 1"))
    store.append("violations", h.where("run_id = 2"))
    for _ in range(2):
        store.append("violations", h.where("run_id >= 3"), key="run-3")
    return store.read("violations")
