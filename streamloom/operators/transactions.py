"""Transactions of the source: commit positions, counts, completeness and the released frontier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamloom.functions.expressions import tx_id, tx_lsn


def stamp_commit_lsn(events: DataFrame, ends: DataFrame, hold_untracked: bool = False) -> DataFrame:
    """Events with the commit position of their transaction's END; those of open transactions are held back.

    Events without a transaction (tx_id -1 or null) get position 0, or are held back with ``hold_untracked``. The
    optimiser broadcasts ``ends`` where its size allows, and else shuffles by transaction.
    """
    known = events.drop("commit_lsn").join(ends.select("tx_id", "commit_lsn"), "tx_id")
    if hold_untracked:
        return known
    free = events.drop("commit_lsn").filter("tx_id is null or tx_id = -1").withColumn("commit_lsn", F.lit(0).cast("long"))
    return known.unionByName(free.select(*known.columns))


def ends_of(transactions: DataFrame) -> DataFrame:
    """END events (tx_id, commit_lsn, data_collections) from a transaction topic, whose ids are ``txId:lsn``; BEGINs go.

    A heartbeat is an END without collections: a transaction of no events, complete at once, that moves the frontier on.
    """
    none = F.array().cast("array<struct<data_collection:string,event_count:int>>")
    ended = transactions.filter("status = 'END'")
    return ended.select(tx_id(F.col("id")).alias("tx_id"), tx_lsn(F.col("id")).alias("commit_lsn"), F.coalesce("data_collections", none).alias("data_collections"))


def expected_of(collections: Column, table: str) -> Column:
    """How many events of ``table`` an END's data_collections announce; 0 if it isn't among them."""
    own = F.filter(collections, lambda c: c["data_collection"] == table)
    return F.aggregate(own, F.lit(0).cast("long"), lambda n, c: n + c["event_count"])


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("commit_lsn", "tbl").agg(F.count("*").alias("n"))


def expected_counts(ends: DataFrame) -> DataFrame:
    """commit_lsn, tbl, expected from END events with their data_collections; of one without any, a row with a null table and 0."""
    each = ends.select("commit_lsn", F.explode_outer("data_collections").alias("c"))
    return each.select("commit_lsn", F.col("c.data_collection").alias("tbl"), F.coalesce(F.col("c.event_count"), F.lit(0)).cast("long").alias("expected"))


def completeness(events: DataFrame, expected: DataFrame) -> DataFrame:
    """commit_lsn, complete: whether every table has as many events as the END says."""
    counts = event_counts(events)
    both = expected.join(counts, ["commit_lsn", "tbl"], "left")
    return both.groupBy("commit_lsn").agg(F.every(F.coalesce("n", F.lit(0)) == F.col("expected")).alias("complete"))


def frontier(complete: DataFrame) -> DataFrame:
    """The transactions that may be released: complete, as are all before them in commit order.

    The first incomplete position is one aggregate, so no global sort is needed.
    """
    first = complete.agg(F.min(F.when(~F.col("complete"), F.col("commit_lsn"))).alias("stop"))
    return complete.join(F.broadcast(first), F.col("stop").isNull() | (F.col("commit_lsn") < F.col("stop"))).select("commit_lsn")


def combined(a: DataFrame, b: DataFrame) -> DataFrame:
    """The joint frontier of two inputs: the smaller of their positions."""
    return a.agg(F.max("commit_lsn").alias("a")).join(b.agg(F.max("commit_lsn").alias("b"))).select(F.least("a", "b").alias("commit_lsn"))


__all__ = ["combined", "completeness", "ends_of", "event_counts", "expected_counts", "expected_of", "frontier", "stamp_commit_lsn"]
