"""Structured Streaming variants: counters, windows and deduplication, run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from millrace.functions import text as T
from millrace.runtime import shared_dir


def source(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files at ``path``."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name.replace('.parquet', '')}[.]parquet")


def finish(df: DataFrame, mode: str, keys: list[str] | None = None, base: str | None = None) -> DataFrame:
    """Run a stream over what is there now and give its result.

    A batch writes its own folder, so a batch that is tried again replaces what it wrote. In complete mode the last batch
    holds the result, in update mode the last row of each of ``keys``, in append mode all rows. With a ``base`` folder of
    the caller's, a later run resumes from its checkpoint and goes on with what was written.
    """
    spark = df.sparkSession
    base = base or f"{shared_dir(spark)}/millrace/stream-{uuid.uuid4().hex}"

    def sink(batch: DataFrame, i: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={i}")

    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    rows = spark.read.schema(StructType([*df.schema.fields, StructField("batch", LongType())])).parquet(f"{base}/out")
    if mode == "complete":
        return rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch", "left_semi").select(*df.columns)
    if mode == "update":
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in df.columns if c not in keys)), "batch").alias("x")).select(*keys, "x.*").select(*df.columns)
    return rows.select(*df.columns)


def word_count(spark: SparkSession, path: str, base: str | None = None) -> DataFrame:
    """TK8's counter: words so far; update mode, so a batch writes only what changed."""
    x = source(spark, path).select(F.explode(T.words(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return finish(x, "update", ["w"], base)


def tumbling(spark: SparkSession, path: str, width: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Events by type and window, tumbling or sliding; rows later than ``late`` behind the latest are dropped, and windows
    behind the watermark leave the state."""
    x = source(spark, path).select("event_type", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    g = x.groupBy("event_type", F.window("ts", width, slide) if slide else F.window("ts", width)).agg(F.count("*").alias("n"))
    return finish(g, "update", ["event_type", "window"]).select("event_type", F.unix_timestamp("window.start").alias("started"), "n")


def sessions(spark: SparkSession, path: str, gap: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user that end after ``gap`` without an event."""
    x = source(spark, path).select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value").withWatermark("ts", late)
    g = x.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    done = g.select("user_id", F.col("w.start").alias("start"), "n")
    return finish(done, "complete").select("user_id", F.unix_timestamp("start").alias("started"), "n")


def dedup(spark: SparkSession, path: str, late: str = "60 days") -> DataFrame:
    """Different texts; copies are told apart within the watermark, which bounds the state."""
    x = source(spark, path).where("text is not null").select(F.md5("text").alias("h"), F.coalesce("ingested_at", "created_at", F.lit("1970-01-01").cast("timestamp_ntz")).cast("timestamp").alias("at"))
    return finish(x.withWatermark("at", late).dropDuplicatesWithinWatermark(["h"]), "append").agg(F.count("*").alias("n_texts"))


def corpus_counters(spark: SparkSession, path: str) -> DataFrame:
    """AG1 as a stream: documents, characters and bytes by source."""
    x = source(spark, path).groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"), F.sum(F.octet_length("text")).alias("bytes"))
    return finish(x, "update", ["source"])
