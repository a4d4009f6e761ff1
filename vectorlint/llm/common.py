"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that part words in the query contracts (ASCII white space).
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo ``parts`` (null ids: fold 0)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % parts, F.lit(0)).cast("int")


def row_key(*cols: str) -> Column:
    """64-bit key of a row's named columns, defined for nulls."""
    return F.xxhash64(*[F.col(c) for c in cols])


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else, whatever the locale or script."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bit_table(df: DataFrame, hashed: str, bits: int):
    """Broadcast table of 2^``bits`` flags, set at the leading bits of the
    64-bit hashes in column ``hashed``.  Its size is fixed: Spark folds the
    rows to at most 2^(bits-6) words before the driver sees them.  It is only
    a filter in front of an exact join: more rows let more strangers through."""
    lead = F.expr(f"shiftrightunsigned({hashed}, {64 - bits})")
    folded = (df.select(F.shiftright(lead, 6).cast("int").alias("at"), (lead.bitwiseAND(F.lit(63))).cast("int").alias("bit"))
              .groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("word")).collect())
    words = np.zeros(1 << bits - 6, np.int64)
    for r in folded:
        words[r[0]] = r[1]
    return df.sparkSession.sparkContext.broadcast(np.unpackbits(words.view(np.uint8), bitorder="little").astype(bool))


def merged(df: DataFrame) -> DataFrame:
    """Side of an equi-join whose other side, or itself, Spark would size too low:
    an exploded array counts as one element, ids in Parquet as what their file
    takes, of which a broadcast table needs ten times and more on the driver."""
    return df.hint("merge")


def join_classes(rows: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """Each of ``rows`` with the columns of its class (one row for each ``key`` that
    ``rows`` holds, with ``copies``, their number).  Classes of at least a thousandth
    of all rows, so at most a thousand, are broadcast; only the others are dealt by key."""
    total = classes.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).scalar()
    large, small = (classes.where(c).drop("copies") for c in (F.col("copies") * 1000 >= total, F.col("copies") * 1000 < total))
    return rows.join(F.broadcast(large), key).unionByName(rows.join(F.broadcast(large.select(key)), key, "left_anti").join(small, key))
