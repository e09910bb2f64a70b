"""Lookups in tables of a checked size, without moving the rows.

``lookup_in_arrays`` maps the elements of an array column through a small
table that travels to every task as one row of hash buckets. The size is
counted first; a larger table is joined instead (``vocab._map_array``), a
shuffle whose skewed partitions adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_ENTRIES = 200_000  # and
MOST_BYTES = 16 << 20   # of their keys and values: what every task may hold
BUCKETS = 4096
SALTS = 8


def salted_lookup(rows: DataFrame, table: DataFrame, row_key: str, table_key: str, how: str = "left", light: bool = False) -> DataFrame:
    """``rows`` joined with ``table`` (one row a key) where a few keys may hold
    most rows. A table counted as ``light`` travels to the rows, and none of them
    is moved. Otherwise the rows are salted by their content and the table is
    repeated for each salt, so no key meets in one task. The key of ``table`` is
    dropped."""
    t = table.withColumnRenamed(table_key, "_key")
    if light:
        return rows.join(F.broadcast(t), F.col(row_key) == F.col("_key"), how).drop("_key")
    t = t.withColumn("_salt_t", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    r = rows.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(SALTS)).cast("int"))
    return r.join(t, (F.col(row_key) == F.col("_key")) & (F.col("_salt") == F.col("_salt_t")), how).drop("_key", "_salt", "_salt_t")


def travels(table: DataFrame, src: str, dst: str, rows: int | None = None) -> bool:
    """Is the table light enough, in rows and in bytes, to be sent to every
    task? One aggregate; none where the caller knows of too many ``rows``."""
    if rows is not None and rows > MOST_ENTRIES:
        return False
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in (src, dst)), F.lit(0))
    n, held = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(size.cast("bigint")), F.lit(0))).first()
    return n <= MOST_ENTRIES and held <= MOST_BYTES


def bucketed(table: DataFrame, src: str, dst: str) -> DataFrame:
    """One row, ``_buckets``: an array of maps src -> dst by hash of src."""
    spark = table.sparkSession
    t = table.select(F.col(src).alias("_s"), F.col(dst).alias("_d")).where(F.col("_s").isNotNull()) \
        .withColumn("_b", F.pmod(F.xxhash64("_s"), F.lit(BUCKETS)).cast("int"))
    maps = t.groupBy("_b").agg(F.map_from_entries(F.collect_list(F.struct("_s", "_d"))).alias("_m"))
    every = spark.range(BUCKETS).select(F.col("id").cast("int").alias("_b")).join(maps, "_b", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("_b", F.map_entries("_m").alias("_e")))),
                                 lambda x: F.map_from_entries(x["_e"])).alias("_buckets"))


def looked_up(element: Column) -> Column:
    """The entry of an element in ``_buckets``; null where there is none."""
    at = F.pmod(F.xxhash64(element), F.lit(BUCKETS)).cast("int")
    return F.try_element_at(F.get(F.col("_buckets"), at), element)


def lookup_in_arrays(df: DataFrame, buckets: DataFrame, col: str, out_col: str, fill=None) -> DataFrame:
    """``df`` with ``out_col``: the elements of ``col`` mapped; those without
    an entry become ``fill``, or are dropped without one. No row is moved."""
    j = df.crossJoin(F.broadcast(buckets))  # one row of a counted size
    out = F.transform(F.col(col), lambda x: looked_up(x))
    out = F.filter(out, lambda x: x.isNotNull()) if fill is None else F.transform(out, lambda x: F.coalesce(x, F.lit(fill)))
    return j.withColumn(out_col, out).drop("_buckets")
