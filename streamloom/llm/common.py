"""What the operators of this subpackage share: reading, checkpoints, training splits and text batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch. Texts of 100 KB then take some 100 MB at most.
BATCH_ROWS = 1000
#: Partitions up to which one task adds up a block's rows.
FEW_PARTS = 64
_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir``, read by Spark, so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch; a session that set a bound of its own keeps the smaller one."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``, else the one set by hand; a temporary one, as in local tests, only where neither is."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if shared is None:
        shared = tempfile.mkdtemp(prefix="streamloom-")
        sc.setCheckpointDir(shared)
    return shared


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a Parquet table in the shared folder: smaller than a checkpoint of the rows."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes the tables that ``written`` has made so far: for jobs that have written their results."""
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def id_bucket(column: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null ids give null."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(c.cast("string").cast("binary")) % n


def is_bucket(column: str | Column, n: int, k: int) -> Column:
    """Whether the id falls into bucket ``k``; false for a null id."""
    return F.coalesce(id_bucket(column, n) == k, F.lit(False))


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that an operator is about to add; names match in any case, as Spark's do."""
    new = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in new])


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null reads as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def slices(texts: list[str], most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about ``most`` characters; a longer text gets a range of its own."""
    start = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64 (public domain constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def added_blocks(parts: DataFrame, read: Callable[[bytes], np.ndarray], dtype: type | str, finish: Callable[[np.ndarray], dict[str, bytes]] | None = None, schema: str = "block int, counts binary") -> DataFrame:
    """Rows (block int, counts binary) added up by block on the executors, as arrays of ``dtype``.

    ``read`` gives the array of an input row. Rows are added as they stream in, so a task holds one sum for each of its
    blocks and never a block's rows; where many partitions send rows, first within salted shares of a block. ``finish``
    makes the columns of ``schema`` from a sum, in the worker that has added it up: another step over the rows would keep a
    second worker beside it.
    """
    whole = lambda total: {"counts": total.tobytes()}

    def adding(read, finish):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals: dict[int, np.ndarray] = {}
            for b in batches:
                for block, raw in zip(b.column("block").to_pylist(), b.column("counts").to_pylist(), strict=True):
                    if block in totals:
                        totals[block] += read(raw)
                    else:
                        totals[block] = read(raw).astype(dtype)
            for block in list(totals):
                columns = finish(totals.pop(block))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *(pa.array([x], pa.binary()) for x in columns.values())], names=["block", *columns])

        return run

    sending = parts._jdf.queryExecution().toRdd().getNumPartitions()
    if sending > FEW_PARTS:
        salts = int(sending**0.5)
        parts = parts.withColumn("salt", F.spark_partition_id() % salts).repartition("block", "salt").select("block", "counts").mapInArrow(adding(read, whole), "block int, counts binary")
        read = lambda raw: np.frombuffer(raw, dtype)
    return parts.repartition("block").mapInArrow(adding(read, finish or whole), schema)


def summed_blocks(parts: DataFrame, dtype: str = "int64") -> dict[int, np.ndarray]:
    """Add up dense count blocks and fetch the sums: one array a block, its size set by the model's, never by the input."""
    rows = added_blocks(parts, lambda raw: np.frombuffer(raw, dtype), dtype).collect()
    return {r["block"]: np.frombuffer(bytes(r["counts"]), dtype) for r in rows}
