"""Continuous scoring and first-seen filtering of arriving mail."""

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.joins import first_per_key

from ..functions.rules import with_rules
from ..functions.text import content_key


def mail_stream(spark: SparkSession, path, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Arriving mail as Parquet files; a stream is never inferred."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def scored_stream(stream: DataFrame, keep=("doc_id", "source")) -> DataFrame:
    """The batch rule projection, unchanged, on a stream: training and serving cannot drift apart."""
    return with_rules(stream).select(*keep, "score", "risk")


def first_seen(stream: DataFrame, arrival: str, text: str, delay: str = "1 hour") -> DataFrame:
    """Drop mails whose content key arrived before, within the watermark; state is bounded by the delay."""
    timed = stream.withColumn(arrival, F.col(arrival).cast("timestamp")).withColumn("content_key", content_key(F.col(text)))
    return timed.withWatermark(arrival, delay).dropDuplicatesWithinWatermark(["content_key"])


def first_so_far(stream: DataFrame, arrival: str, order: str, text: str) -> DataFrame:
    """(content_key, order, arrival): a row whenever a key is new or a row arrives that is earlier than all seen before it.

    State is one (time, order) per key. `settled` takes the earliest row per key, so the answer does not depend on
    batches, on the order of rows or on late ones. No state is ever dropped (a dropped key could only be found again by its
    copies), so give streams with very many keys the RocksDB state store. Ties go to the smallest `order` (a whole number); rows
    without a time count as the latest, and rows without text have no key and are left out.
    """
    us = F.coalesce(F.unix_micros(F.col(arrival).cast("timestamp")), F.lit(2**63 - 1))
    rows = stream.select(content_key(F.col(text)).alias("content_key"), us.alias("us"), F.col(order).cast("long").alias("n")).where("content_key IS NOT NULL AND n IS NOT NULL")

    def earliest(key, batches, state):
        before = tuple(state.get) if state.exists else None
        best = before
        for b in batches:  # a key's rows come in several frames
            us = b["us"].min()
            seen = int(us), int(b["n"][b["us"] == us].min())
            best = seen if best is None else min(best, seen)
        if best != before:
            state.update(best)
            yield pd.DataFrame({"content_key": [key[0]], "us": [best[0]], "n": [best[1]]})

    found = rows.groupBy("content_key").applyInPandasWithState(earliest, "content_key string, us long, n long", "us long, n long", "append", GroupStateTimeout.NoTimeout)
    when = F.when(F.col("us") < 2**63 - 1, F.timestamp_micros("us"))
    return found.select("content_key", F.col("n").alias(order), when.alias(arrival))


def settled(emitted: DataFrame, arrival: str, order: str) -> DataFrame:
    """The first mail per content key of what `first_so_far` wrote up to now."""
    rank = F.struct(F.col(arrival).isNull(), F.col(arrival), F.col(order))
    return first_per_key(emitted.withColumn("_rank", rank), "content_key", "_rank").drop("_rank")


def run_available(stream: DataFrame, out, checkpoint) -> None:
    """Process everything there is, write Parquet exactly once, stop."""
    query = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
