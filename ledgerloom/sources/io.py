"""Readers and writers (S1-S11): declared schemas, no inference.

File formats of the reference are CSV and JSON; on Spark the default sink is
parquet. Sequences are written as one row per (user, chunk), never one file
per user.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, fields, is_dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRANSACTION_SCHEMA = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("date", T.TimestampNTZType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("description", T.StringType()),
])

SPLIT_DATE_SCHEMA = T.StructType([
    T.StructField("client_id", T.LongType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("hour", T.IntegerType()),
    T.StructField("day", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("day_week", T.StringType()),
    T.StructField("merchant", T.StringType()),
    T.StructField("type", T.StringType()),
])

HISTORY_SCHEMA = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("transaction_history", T.StringType()),
])

FEATURE_CATALOG_SCHEMA = T.StructType([
    T.StructField("numerical_cols", T.ArrayType(T.StringType())),
    T.StructField("categorical_cols", T.ArrayType(T.StringType())),
    T.StructField("cat_cardinalities", T.MapType(T.StringType(), T.LongType())),
])

# Text values pandas' CSV reader turns into null by default.
PANDAS_NULL_TEXT = ["", "NA", "N/A", "NaN", "nan", "null", "NULL", "None", "<NA>", "n/a", "#N/A"]


def read_csv(spark: SparkSession, path: str, schema: T.StructType, *, null_text=None,
             multiline: bool = False) -> DataFrame:
    """CSV with a header and a declared schema; timestamps parse
    as TIMESTAMP_NTZ. ``null_text`` values become null (pandas-like)."""
    ts_fields = [f.name for f in schema.fields if isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType))]
    raw = T.StructType([T.StructField(f.name, T.StringType()) if f.name in ts_fields else f for f in schema.fields])
    df = (spark.read.schema(raw).option("header", True).option("multiLine", multiline)
          .option("escape", '"').csv(path))
    for name in ts_fields:
        df = df.withColumn(name, parse_timestamp(F.col(name)))
    if null_text:
        for f in schema.fields:
            if isinstance(f.dataType, T.StringType):
                df = df.withColumn(f.name, F.when(F.col(f.name).isin(*null_text), None).otherwise(F.col(f.name)))
    return df


# Timestamp spellings accepted on read: pandas' to_csv, Spark's CSV writer, a bare date.
TIMESTAMP_FORMATS = ["yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "yyyy-MM-dd"]


def parse_timestamp(c):
    """Text -> TIMESTAMP_NTZ, trying each accepted spelling; bad text -> null."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(fmt)) for fmt in TIMESTAMP_FORMATS]).cast("timestamp_ntz")


def read_transactions(spark: SparkSession, path: str, fmt: str = "parquet",
                      schema: T.StructType = TRANSACTION_SCHEMA) -> DataFrame:
    """Transactions from parquet (default) or CSV."""
    if fmt == "csv":
        return read_csv(spark, path, schema, null_text=PANDAS_NULL_TEXT)
    return spark.read.schema(schema).parquet(path) if schema is not None else spark.read.parquet(path)


def read_finetune_table(spark: SparkSession, path: str, schema: T.StructType, catalog: DataFrame | None = None,
                        fmt: str = "csv") -> DataFrame:
    """S3: the fine-tune table (one row per label with its tabular columns) with
    the caller's schema. With a feature ``catalog`` (S4) the schema must hold
    all its columns."""
    if catalog is not None:
        row = catalog.first()
        lost = sorted({*row["numerical_cols"], *row["categorical_cols"]} - set(schema.names))
        if lost:
            raise ValueError(f"the schema lacks catalog columns: {lost}")
    return read_csv(spark, path, schema, null_text=PANDAS_NULL_TEXT) if fmt == "csv" else spark.read.schema(schema).parquet(path)


def unread_dates(raw: DataFrame, parsed: DataFrame, key: str, date: str = "date") -> DataFrame:
    """One row, n_unread: non-empty date texts that parsed to null."""
    j = raw.select(key, F.col(date).alias("_raw")).join(parsed.select(key, F.col(date).alias("_date")), key)
    return j.agg(F.count(F.when((F.trim("_raw") != "") & F.col("_date").isNull(), 1)).alias("n_unread"))


def read_histories(spark: SparkSession, path: str) -> DataFrame:
    """One history string per user (quoted, may span lines)."""
    return read_csv(spark, path, HISTORY_SCHEMA, multiline=True)


def normalise_transactions(tx: DataFrame, amount: str = "amount", date: str = "date") -> DataFrame:
    """Drop null users, amounts rounded to 2 places by numpy's rule (the
    scaled value to the nearest integer, halves to even), timestamps also truncated to whole seconds, trimmed text."""
    out = tx.where(F.col("user_id").isNotNull())
    dt = out.schema[date].dataType
    if isinstance(dt, T.StringType):
        out = out.withColumn(date, F.try_to_timestamp(F.col(date)).cast("timestamp_ntz"))
    return (out.withColumn("date_seconds", F.date_trunc("second", F.col(date)).cast("timestamp_ntz"))
            .withColumn(amount, F.rint(F.col(amount) * 100) / 100)
            .withColumn("description", F.trim(F.col("description"))))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """Write a table. CSV gets a header (the reference's to_csv)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).option("escape", '"').csv(path)  # quotes doubled, as pandas writes them
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)


def write_sequences(seqs: DataFrame, path: str, key: str = "user_id") -> None:
    """One row per (user, chunk), clustered by user through a range
    shuffle so readers get sorted, non-overlapping files; never a file per user."""
    (seqs.repartitionByRange(key, "chunk").sortWithinPartitions(key, "chunk")
     .write.mode("overwrite").parquet(path))


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """The sequence table written by ``write_sequences``."""
    return spark.read.parquet(path)


def write_feature_catalog(catalog: DataFrame, path: str) -> None:
    """The one-row feature catalog as JSON."""
    catalog.coalesce(1).write.mode("overwrite").json(path)


def read_feature_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Feature catalog JSON with a declared schema."""
    return spark.read.schema(FEATURE_CATALOG_SCHEMA).option("multiLine", True).json(path)


def write_vocabulary(vocab: DataFrame, merges: DataFrame | None, path: str) -> None:
    """Vocabulary (token, id, is_special) and the ranked merge list."""
    vocab.write.mode("overwrite").parquet(f"{path}/vocab")
    if merges is not None:
        merges.write.mode("overwrite").parquet(f"{path}/merges")


def read_vocabulary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None]:
    """Load what ``write_vocabulary`` wrote."""
    vocab = spark.read.parquet(f"{path}/vocab")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/merges")
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    return vocab, spark.read.parquet(f"{path}/merges") if there else None  # a word vocabulary has none


def save_config(spark: SparkSession, config, path: str) -> None:
    """A run config (dataclass) as a one-row JSON table beside the artefact."""
    d = asdict(config) if is_dataclass(config) else dict(config)
    spark.createDataFrame([(json.dumps(d, sort_keys=True),)], "config string") \
        .coalesce(1).write.mode("overwrite").text(path)


def load_config(spark: SparkSession, cls, path: str):
    """Rebuild the dataclass from ``save_config`` output."""
    line = spark.read.text(path).first()[0]
    d = json.loads(line)
    names = {f.name for f in fields(cls)}
    return cls(**{k: v for k, v in d.items() if k in names})


# ---------------------------------------------------------------------------
# Tables laid out for a join

def write_bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int, sort: list[str] | None = None) -> None:
    """S5 for repeated joins: ``df`` as an external table at ``path``, dealt to
    ``buckets`` buckets by ``key``. A join on ``key`` with it then moves the other
    side only. Each task writes one bucket, so there is one file a bucket."""
    w = df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key, *(sort or []))
    w.option("path", path).saveAsTable(table)


def join_bucketed(rows: DataFrame, spark: SparkSession, table: str, key: str, how: str = "left") -> DataFrame:
    """J2 on a bucketed table: ``rows`` are dealt to its buckets, the table is read
    where it lies (no exchange, whatever its size)."""
    return rows.join(spark.table(table).hint("merge"), key, how)


# ---------------------------------------------------------------------------
# CSV with line breaks in quotes, several tasks a file

def read_csv_split(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> DataFrame:
    """S2 at size: CSV whose quoted fields may hold line breaks, read by as many
    tasks as its bytes need (Spark's ``multiLine`` reads a file in one task).

    A line break lies inside a field where the number of quotes before it in
    the file is odd (quotes in fields are doubled). So: the quotes of every
    split are counted; running parities over the splits of a file (one slim row
    each, broadcast) tell each split how it begins; each task then joins its
    lines to records. What a split's first lines add to a record of the split
    before, and a last record that is not closed, are fragments: at most two a
    split, put together by a small shuffle. Records become columns by
    ``from_csv``. The bytes are read twice and not shuffled. An empty
    unquoted field is null."""
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    per = lines.groupBy("file", "at").agg((F.sum(quotes) % 2).alias("_odd"))
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select("file", "at", (F.coalesce(F.sum("_odd").over(before), F.lit(0)) % 2 == 1).alias("_open"))
    marked = lines.join(F.broadcast(starts), ["file", "at"]).select("file", "at", "_open", "value")  # one row a split

    def join_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, held, began_open, first = None, [], False, False
        out: list[tuple] = []

        def close(end_of_split: bool) -> None:
            """The held lines as a record, or a fragment that neighbours complete."""
            nonlocal held, began_open
            if held:
                kind = 0 if not began_open and not end_of_split else 1 if not end_of_split else 3 if not began_open else 2
                out.append((*split, kind, "\n".join(held), first))
            held, began_open = [], False

        for batch in batches:
            for file, at, opened, value in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, at) != split:
                    close(True)
                    split, began_open, inside, first = (file, at), opened, opened, at == 0
                held.append(value)
                if value.count('"') % 2:
                    inside = not inside
                if not inside:
                    close(False)
                    first = False
            if out:
                yield _fragments(out)
                out = []
        close(True)
        if out:
            yield _fragments(out)

    rows = marked.mapInArrow(join_lines, "file string, at long, kind int, record string, first boolean")
    order = Window.partitionBy("file").orderBy("at", "kind")
    # kinds: 1 ends a record of earlier splits, 2 is inside one, 3 begins one that goes on
    pieces = rows.where("kind > 0").withColumn("_n", F.sum(F.when(F.col("kind") == 3, 1).otherwise(0)).over(order))
    whole = pieces.groupBy("file", "_n").agg(F.array_sort(F.collect_list(F.struct("at", "kind", "record"))).alias("_p"), F.max(F.when(F.col("kind") == 3, F.col("first"))).alias("first")) \
        .select(F.array_join(F.transform("_p", lambda x: x["record"]), "\n").alias("record"), "first")
    records = rows.where("kind = 0").select("record", "first").unionByName(whole)
    if header:
        records = records.where(~F.coalesce(F.col("first"), F.lit(False)))
    text = F.regexp_replace("record", "\r$", "")
    options = {"quote": '"', "escape": '"', "maxCharsPerColumn": "-1"}
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return records.where(F.length(text) > 0).select(F.from_csv(text, F.lit(ddl), options).alias("_r")).select("_r.*")


def _fragments(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=["file", "at", "kind", "record", "first"])
