"""Backfill of values that the source leaves out of update events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed value: what the source writes in place of an unchanged large column.
UNAVAILABLE = "__debezium_unavailable_value"


def backfill_over(events: DataFrame, column: str, key: str = "id", ts: str = "ts", order: str = "pos", days: int | None = 30, sentinel: str = UNAVAILABLE) -> DataFrame:
    """The last value that isn't null or the sentinel, by time and then ``order``, within ``days`` (None: ever).

    Events of the same time are told apart by ``order``, so no event sees a later one. Deletes stay as they are.
    """
    w = Window.partitionBy(key).orderBy(ts, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = F.col(column).isNotNull() & (F.col(column) != sentinel)
    held = F.last(F.when(known, F.struct(F.col(ts).alias("t"), F.col(column).alias("x"))), ignorenulls=True).over(w)
    last = held["x"] if days is None else F.when(held["t"] >= F.col(ts) - F.expr(f"INTERVAL {days} DAYS"), held["x"])
    return events.withColumn(column, F.when((F.col(column) == sentinel) & (F.col("op") != "d"), last).otherwise(F.col(column)))


def backfill_keyed(events: DataFrame, columns: list[str], key: str = "id", order: str = "pos", sentinel: str = UNAVAILABLE) -> DataFrame:
    """What a value kept per key gives: seeded by r and c, set by u (also to null), cleared by d."""
    w = Window.partitionBy(key).orderBy(order)
    out = events.withColumn("_epoch", F.count(F.when(F.col("op") == "d", 1)).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    held = Window.partitionBy(key, "_epoch").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    new = {}
    for c in columns:
        known = F.col("op").isin("r", "c") | ((F.col("op") == "u") & (F.col(c).isNull() | (F.col(c) != sentinel)))
        last = F.last(F.when(known, F.struct(F.col(c).alias("b"))), ignorenulls=True).over(held)["b"]
        new[c] = F.when((F.col("op") == "u") & (F.col(c) == sentinel), last).otherwise(F.col(c))
    return out.withColumns(new).drop("_epoch")


def backfill_envelope(events: DataFrame, columns: list[str], key: str = "id", order: str = "pos", sentinel: str = UNAVAILABLE) -> DataFrame:
    """The keyed backfill of fields of ``after``: the row is rebuilt with them; a delete keeps its null ``after``."""
    flat = events.withColumns({f"_f_{c}": F.col("after")[c] for c in columns} | {"_key": F.coalesce(F.col("after")[key], F.col("before")[key])})
    filled = backfill_keyed(flat, [f"_f_{c}" for c in columns], "_key", order, sentinel)
    after = F.col("after").withField(columns[0], F.col(f"_f_{columns[0]}"))
    for c in columns[1:]:
        after = after.withField(c, F.col(f"_f_{c}"))
    return filled.withColumn("after", F.when(F.col("after").isNotNull(), after)).select(*events.columns)


def reselect(events: DataFrame, current: DataFrame, columns: list[str], key: str = "id", sentinel: str = UNAVAILABLE) -> DataFrame:
    """Sentinels replaced by the row's current values in the source table; nulls stay. ``current``: one row a key."""
    now = current.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_now_{c}") for c in columns])
    joined = events.join(now, F.col(key) == F.col("_key"), "left")
    return joined.withColumns({c: F.when(F.col(c) == sentinel, F.col(f"_now_{c}")).otherwise(F.col(c)) for c in columns}).select(*events.columns)
