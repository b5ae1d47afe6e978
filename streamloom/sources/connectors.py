"""Change topics and files as sources, and sinks for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def topic(spark: SparkSession, servers: str, topics: list[str], stream: bool = True) -> DataFrame:
    """key and value as text, with topic and position, from the earliest offsets. Needs the Kafka package of Spark."""
    reader = spark.readStream if stream else spark.read
    raw = reader.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics)).option("startingOffsets", "earliest").load()
    return raw.select("topic", "partition", "offset", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def files(spark: SparkSession, path: str, schema: str, stream: bool = True, per_batch: int | None = None) -> DataFrame:
    """JSON change files; a stream reads them by time of change."""
    reader = (spark.readStream if stream else spark.read).schema(schema)
    return (reader.option("maxFilesPerTrigger", per_batch) if stream and per_batch else reader).json(path)


def slots(spark: SparkSession, url: str, **options: str) -> DataFrame:
    """The replication slots of a database over JDBC."""
    return spark.read.format("jdbc").options(url=url, dbtable="pg_replication_slots", **options).load()


def generate(spark: SparkSession, n: int) -> DataFrame:
    """``n`` rows with ids and random text."""
    return spark.range(n).withColumn("text", F.md5(F.rand().cast("string").cast("binary")))


def ddl(spark: SparkSession, n: int, template: str = "CREATE TABLE inventory.t_%s (id SERIAL PRIMARY KEY, value VARCHAR(255))") -> DataFrame:
    """``n`` statements from a template, with padded numbers."""
    return spark.range(1, n + 1).select("id", F.format_string(template, F.lpad(F.col("id").cast("string"), 3, "0")).alias("statement"))


def to_console(df: DataFrame, checkpoint: str | None = None):
    """A tap that prints what passes."""
    if not df.isStreaming:
        return df.show(truncate=False)
    writer = df.writeStream.format("console").option("truncate", "false")
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def to_callback(df: DataFrame, call: Callable[[DataFrame, int], None], checkpoint: str):
    """Each micro-batch to a function, with its id."""
    return df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(call).start()


def to_topic(df: DataFrame, servers: str, name: str, checkpoint: str):
    """Appends key and value to a topic, at least once."""
    return df.select("key", "value").writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", name).option("checkpointLocation", checkpoint).start()


def to_table(df: DataFrame, path: str, checkpoint: str, shape: Callable[[DataFrame], DataFrame] = lambda b: b):
    """Each micro-batch to its own folder by batch id: a repeated batch overwrites itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        shape(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).start()
