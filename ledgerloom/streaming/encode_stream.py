"""Transaction encoding on a streaming DataFrame.

The reference has no streaming part. Its per-transaction encoders (sign,
amount bin, date tokens, words; the tagged and spaced strings) are plain
column expressions, so they run unchanged on ``readStream`` input; that is
all this module offers. Per-user sequence assembly aggregates over a whole
history and stays a batch job (``operators.sequence``) over the table the
stream appends to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.functions import encode as E
from ledgerloom.sources.tables import event_transactions

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])


def read_event_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 1) -> DataFrame:
    """Parquet files arriving in ``path`` as a stream (declared schema)."""
    return (spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
            .parquet(path))


def encode_events(events: DataFrame) -> DataFrame:
    """Per-event tokens of a (batch or streaming) events DataFrame, using the
    same view as the batch queries (signed amount, origin, description)."""
    tx = event_transactions(events)
    return tx.select("user_id", "tx_id", "date",
                     E.transaction_tokens("amount", "date", "description").alias("tokens"),
                     E.spaced_transaction_string("origin", "amount", "date", "description").alias("spaced"))


def start_token_sink(encoded: DataFrame, table_path: str, checkpoint_path: str,
                     trigger_once: bool = True) -> StreamingQuery:
    """Append encoded events to a parquet table; the streaming checkpoint
    makes the sink exactly-once across restarts."""
    w = (encoded.writeStream.format("parquet").option("path", table_path)
         .option("checkpointLocation", checkpoint_path).outputMode("append"))
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()
