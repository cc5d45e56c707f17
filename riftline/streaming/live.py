"""The live view: windows over the event stream, run to completion over what is available."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import shared_dir

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of the events table, with event time and watermark."""
    rows = spark.readStream.schema(SCHEMA).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")


def drained(agg: DataFrame) -> DataFrame:
    """Runs an aggregate stream over everything available and returns its result.

    Executors write the result, and the query its state, in the shared folder. A batch of the
    complete mode holds the whole result, so each overwrites the one before.
    """
    spark = agg.sparkSession
    path, written = f"{shared_dir(spark)}/live-{uuid.uuid4().hex}", []

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/result")
        written.append(batch)

    query = agg.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(agg.schema).parquet(f"{path}/result") if written else spark.createDataFrame([], agg.schema)


def gathered(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over everything available; all that its batches gave, with column ``batch``.

    Executors write each batch to a folder of its own, which a batch that is run again overwrites; nothing is
    rewritten. With mode ``append``, an aggregate's windows come once, when the watermark has passed them, and leave the state.
    """
    spark = stream.sparkSession
    path, written = f"{shared_dir(spark)}/live-{uuid.uuid4().hex}", []

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/result/batch={batch}")
        written.append(batch)

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(schema).parquet(f"{path}/result") if written else spark.createDataFrame([], schema)


def counts(stream: DataFrame, width: str, slide: str | None = None) -> DataFrame:
    """Events and values per window and type."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = stream.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total")


def conflated(stream: DataFrame, width: str) -> DataFrame:
    """The last event of each key and window, by sequence number."""
    out = stream.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.max_by("user_id", "event_id").alias("last_user"), F.max("event_id").alias("last_event"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "last_user", "last_event")


def sessions(stream: DataFrame, gap: str) -> DataFrame:
    out = stream.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "user_id", "n")


def capped(rows: DataFrame, limit: int, window: str = "1 hour") -> DataFrame:
    """At most ``limit`` events of each window, by sequence number: for foreachBatch, which ranks a batch."""
    w = Window.partitionBy(F.window("ts", window)).orderBy("event_id")
    return rows.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= limit)


def stalls(throughput: DataFrame) -> DataFrame:
    """Hours whose last five counts are all under a fifth of the type's median."""
    med = throughput.groupBy("event_type").agg(F.median("n").alias("median_n"))
    w = Window.partitionBy("event_type").orderBy("start").rowsBetween(-4, 0)
    return throughput.join(med, "event_type").withColumn("most", F.max("n").over(w)).select("event_type", "start", (F.col("most") < 0.2 * F.col("median_n")).alias("stalled"))
