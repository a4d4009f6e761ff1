"""Operator 13: Merkle dataset manifest, a content-addressed DAG with proofs.

A row is a leaf: H (lower-case hex SHA-256) of its fields ``FIELDS``, each
``-`` if null, else UTF-8 byte count, ``:`` and value.  The leaves of a source,
in the order of doc_id, are one tree: every ``FAN`` consecutive nodes (the last
run may be shorter) become H of their digests, until one is left, the subroot.
The subroots, in the order of the sources (null first, bytewise), are another
such tree, whose last node is the root of the dataset.

1. Places.  Rows are dealt to range partitions by (source, doc_id, leaf, place);
   a row's place in its source is its place within the partition plus the
   counts of the partitions before.  A source or an id that holds a third of
   all rows spreads over many partitions.
2. Store.  Runs of ``FAN ** LEVELS`` nodes are folded in one row each, so that a
   shuffle serves ``LEVELS`` levels.  Every fold leaves a record digest ->
   children; equal records are kept once, by height.
3. Descent.  Requests go down from the root level by level, by the digits of
   their places in base ``FAN``: a join with the store's records of that height
   by digest, one segment (own digit, digests of the unselected children) a
   level.  Requests with a common prefix travel as one row.  A path's reversed
   segments are the proof, from the leaf up.

Defined results: rows without a source are a source of their own; null ids come
first in a source, rows that repeat an id go by their leaf digest, rows equal in
all fields are leaves of their own; a lone leaf is its subroot, a lone subroot
the root; a proof without siblings is H of nothing; a row without id is never
tampered with; without rows no rows.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vectorlint.session import checkpoint_dir, materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 3
#: Levels folded in one row, of FAN ** LEVELS = 729 digests at most.
LEVELS = 6


def leaf_digest(**instead: Column) -> Column:
    """H of a row's fields; ``instead`` puts other columns in their place."""
    def field(name: str) -> Column:
        v = instead.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
    return F.sha2(F.concat(*[field(c) for c in FIELDS]), 256)


def _height(n: str) -> str:
    """Levels above ``n`` nodes: the smallest h with FAN ** h >= n."""
    return f"size(filter(sequence(0, 33), k -> pow({FAN}, k) < {n}))"


def _ranked(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` (a written table) with ``rank``, the place (from 0) within ``group`` by
    ``order``, and ``n``, the group's size; no task holds a whole group."""
    dealt = rows.withColumn("__place", F.monotonically_increasing_id()).repartitionByRange(group, *order, "__place")
    dealt = materialize(dealt.withColumn("__run", F.spark_partition_id()), name)
    runs, so_far = dealt.groupBy("__run", group).agg(F.count("*").alias("c")), Window.partitionBy(group).orderBy("__run")
    before = runs.select("__run", group, (F.sum("c").over(so_far) - F.col("c")).alias("__before"), F.sum("c").over(Window.partitionBy(group)).alias("n"))
    place = F.row_number().over(Window.partitionBy("__run", group).orderBy(*order, "__place")) - 1
    return dealt.withColumn("__in", place).join(before, ["__run", group]).withColumn("rank", F.col("__in") + F.col("__before")).drop("__in", "__run", "__before", "__place")


def _folded(nodes: DataFrame, base: int) -> DataFrame:
    """One row for each run of FAN ** LEVELS nodes (tree, rank, digest, n: nodes of
    the tree on this level): its top digest and the records of its levels."""
    x = (nodes.groupBy("tree", F.expr(f"rank div {FAN ** LEVELS}").alias("rank"))
         .agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "digest"))), lambda s: s["digest"]).alias("l0"), F.max("n").alias("n"))    # at most 729
         .withColumn("h", F.expr(_height("n"))))
    for j in range(1, LEVELS + 1):
        runs = f"transform(sequence(0, cast((size(l{j - 1}) - 1) div {FAN} as int)), i -> slice(l{j - 1}, i * {FAN} + 1, {FAN}))"
        x = x.withColumn(f"c{j}", F.expr(f"CASE WHEN h >= {j} THEN {runs} ELSE cast(array() as array<array<string>>) END"))
        x = x.withColumn(f"l{j}", F.expr(f"CASE WHEN h >= {j} THEN transform(c{j}, r -> sha2(array_join(r, ''), 256)) ELSE l{j - 1} END"))
    records = "flatten(array(" + ", ".join(f"transform(c{j}, (r, i) -> named_struct('height', {base + j}, 'digest', l{j}[i], 'children', r))" for j in range(1, LEVELS + 1)) + "))"
    return x.select("tree", "rank", F.expr(f"l{LEVELS}[0]").alias("digest"), "n", "h", F.expr(records).alias("records"))


def _build(nodes: DataFrame, height: int, name: str) -> tuple[DataFrame, DataFrame]:
    """(tree, digest) of every tree's last node, and the store (digest, children, height)."""
    tops, records = None, None
    for base in range(0, max(height, 1), LEVELS):
        runs = materialize(_folded(nodes, base), f"{name}-runs")
        top = runs.where(f"h <= {LEVELS}").select("tree", "digest")
        found = runs.select(F.explode("records").alias("r")).select("r.height", "r.digest", "r.children")
        tops, records = (top, found) if tops is None else (tops.unionByName(top), records.unionByName(found))
        nodes = runs.where(f"h > {LEVELS}").select("tree", "rank", "digest", F.expr(f"cast(ceil(n / {FAN ** LEVELS}) as bigint)").alias("n"))
    spark = nodes.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/vectorlint/{name}-store-{uuid.uuid4().hex}"
    records.dropDuplicates(["digest"]).write.partitionBy("height").parquet(path)
    return tops, spark.read.schema("digest string, children array<string>, height int").parquet(path)


@dataclass
class Manifest:
    """``leaves`` (tree, rank, doc_id, leaf, bent), ``trees`` (tree, source, n, h, top_rank,
    digest: subroot), the two stores, ``root`` (digest; no row without leaves) and their heights."""
    leaves: DataFrame
    trees: DataFrame
    store: DataFrame
    top_store: DataFrame
    root: DataFrame
    height: int
    top_height: int


def manifest(docs: DataFrame, bent: Column | None = None) -> Manifest:
    """Manifest of ``docs``; ``bent``: another leaf digest to be checked for each row."""
    leaf = leaf_digest()
    rows = docs.select("doc_id", F.concat(F.when(F.col("source").isNull(), "0").otherwise("1"), F.coalesce(F.col("source").cast("string"), F.lit(""))).alias("tree"),
                       leaf.alias("leaf"), (leaf if bent is None else bent).alias("bent"))
    leaves = materialize(_ranked(materialize(rows, "merkle-rows"), "tree", ["doc_id", "leaf"], "merkle-dealt"), "merkle-leaves")
    sizes = leaves.groupBy("tree").agg(F.count("*").alias("n")).withColumn("h", F.expr(_height("n")))
    sizes = materialize(sizes, "merkle-trees")
    most = sizes.agg(F.max("h").alias("h"), F.count("*").alias("trees")).first()
    height, top_height = most["h"] or 0, next(h for h in range(64) if FAN ** h >= max(most["trees"], 1))
    subroots, store = _build(leaves.select("tree", "rank", F.col("leaf").alias("digest"), "n"), height, "merkle")
    placed = _ranked(materialize(sizes.join(subroots, "tree").withColumn("all", F.lit(0)), "merkle-subroots"), "all", ["tree"], "merkle-subroots-dealt")
    trees = materialize(placed.select("tree", F.expr("CASE WHEN tree = '0' THEN NULL ELSE substr(tree, 2) END").alias("source"), "h", F.col("rank").alias("top_rank"), "digest"), "merkle-placed")
    tops = trees.select(F.lit("").alias("tree"), F.col("top_rank").alias("rank"), "digest", F.lit(most["trees"]).cast("bigint").alias("n"))
    root, top_store = _build(tops, top_height, "merkle-top")
    return Manifest(leaves, trees, store, top_store, root.select("digest"), height, top_height)


def _down(frontier: DataFrame, store: DataFrame, height: int, keys: list[str], wanted: DataFrame | None) -> DataFrame:
    """Requests one level down: (keys, rank, digest, path) of the children of nodes of ``height``."""
    x = frontier.join(store.where(F.col("height") == height).select("digest", "children"), "digest")
    x = x.select(*keys, "rank", "path", "children", F.posexplode("children").alias("digit", "child"))
    segment = F.struct("digit", F.expr("filter(children, (c, i) -> i <> digit)").alias("others"))
    x = x.select(*keys, (F.col("rank") * FAN + F.col("digit")).alias("rank"), F.col("child").alias("digest"), F.concat("path", F.array(segment)).alias("path"))
    if wanted is None:
        return x
    at = wanted.select(*keys, F.expr(f"rank div {FAN ** (height - 1)}").alias("rank")).distinct()
    return x.join(at, [*keys, "rank"], "left_semi")


def paths(m: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """(tree, rank, digest, path) of the requested leaves (tree, rank; None: of all).

    ``path`` holds the segments (digit, others) from the root down."""
    empty = F.expr("cast(array() as array<struct<digit: int, others: array<string>>>)")
    wanted_tops = None if requests is None else m.trees.join(requests.select("tree").distinct(), "tree", "left_semi").select(F.col("top_rank").alias("rank"))
    at = m.root.select(F.lit(0).cast("bigint").alias("rank"), "digest", empty.alias("path"))
    for height in range(m.top_height, 0, -1):
        at = _down(at, m.top_store, height, [], wanted_tops)
    tree = m.trees.select(F.col("top_rank").alias("rank"), "tree", "h")
    trees = materialize(at.join(tree, "rank").select("tree", F.lit(0).cast("bigint").alias("rank"), "digest", "path", "h"), "merkle-tops")
    start = {h: trees.where(F.col("h") == h).drop("h") for h in range(m.height + 1)}
    at = start[m.height]
    for height in range(m.height, 0, -1):
        at = _down(at, m.store, height, ["tree"], requests).unionByName(start[height - 1])
    return at if requests is None else at.join(requests.select("tree", "rank").distinct(), ["tree", "rank"], "left_semi")


def siblings_digest(path: str) -> Column:
    """H of a path's siblings, from the leaf up, left to right."""
    return F.expr(f"sha2(array_join(flatten(transform(reverse({path}), s -> s.others)), ''), 256)")


def fold_up(digest: str, path: str) -> Column:
    """The root that follows from a leaf's digest and its path."""
    return F.expr(f"aggregate(reverse({path}), {digest}, (d, s) -> sha2(concat(array_join(slice(s.others, 1, s.digit), ''), d, array_join(slice(s.others, s.digit + 1, {FAN}), '')), 256))")


def tampered() -> Column:
    """Digest of the row without its text's line feeds, where 2 divides the id's crc32."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    return leaf_digest(text=F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")))


def proofs(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified of every row."""
    m = manifest(docs, tampered())
    found = m.leaves.select("tree", "rank", "doc_id", "leaf", "bent").join(paths(m).select("tree", "rank", "path"), ["tree", "rank"])
    found = found.select("tree", "doc_id", "leaf", siblings_digest("path").alias("proof_sha256"), fold_up("bent", "path").alias("folded_root"))
    # One row a source; joined last, after the paths are gone.
    found = found.join(m.trees.select("tree", "source", F.col("digest").alias("subroot")), "tree").withColumn("root", m.root.scalar())
    return found.select("doc_id", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def oracle() -> str:
    """DuckDB twin of ``proofs``."""
    field = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
    digest = lambda text: "sha256(" + " || ".join(field.format(text if c == "text" else c) for c in FIELDS) + ")"
    crc = ("list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: "
           "list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))")
    up = f"""SELECT k, lvl + 1, idx // {FAN}, sha256(string_agg(digest, '' ORDER BY idx)), (n + {FAN - 1}) // {FAN} FROM {{0}} WHERE n > 1 GROUP BY k, lvl, idx // {FAN}, n"""
    climb = f"""SELECT c.k, c.leaf, c.lvl + 1, c.idx // {FAN}, sha256(string_agg(CASE WHEN x.idx = c.idx THEN c.acc ELSE x.digest END, '' ORDER BY x.idx)),
        c.proof || coalesce(string_agg(x.digest, '' ORDER BY x.idx) FILTER (WHERE x.idx <> c.idx), '')
      FROM {{0}} c JOIN {{1}} x ON x.k = c.k AND x.lvl = c.lvl AND x.idx // {FAN} = c.idx // {FAN} WHERE x.n > 1 GROUP BY c.k, c.leaf, c.lvl, c.idx, c.acc, c.proof"""
    return f"""
    WITH RECURSIVE base AS (
      SELECT doc_id, source, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS k, {digest('text')} AS leaf,
        CASE WHEN {crc} & 1 = 1 THEN {digest("replace(text, chr(10), '')")} ELSE {digest('text')} END AS bent FROM documents),
    placed AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY k) AS n FROM base),
    nodes(k, lvl, idx, digest, n) AS (SELECT k, 0, idx, leaf, n FROM placed UNION ALL {up.format('nodes')}),
    subs AS (SELECT k, digest, row_number() OVER (ORDER BY k) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
    tops(k, lvl, idx, digest, n) AS (SELECT 'top', 0, idx, digest, n FROM subs UNION ALL {up.format('tops')}),
    low(k, leaf, lvl, idx, acc, proof) AS (SELECT k, idx, 0, idx, bent, '' FROM placed UNION ALL {climb.format('low', 'nodes')}),
    ended AS (SELECT l.k, l.leaf, l.acc, l.proof, s.idx AS top, s.digest AS subroot FROM low l JOIN nodes x ON x.k = l.k AND x.lvl = l.lvl AND x.n = 1 JOIN subs s ON s.k = l.k),
    high(k, leaf, lvl, idx, acc, proof) AS (SELECT 'top', k || ' ' || leaf, 0, top, acc, proof FROM ended UNION ALL {climb.format('high', 'tops')}),
    root AS (SELECT lvl, digest FROM tops WHERE n = 1)
    SELECT p.doc_id, p.source, p.leaf, e.subroot, r.digest AS root, sha256(h.proof) AS proof_sha256, h.acc AS folded_root, h.acc = r.digest AS verified
    FROM placed p JOIN ended e ON e.k = p.k AND e.leaf = p.idx JOIN root r ON TRUE JOIN high h ON h.leaf = p.k || ' ' || p.idx AND h.lvl = r.lvl"""
