"""Conversions between append, changelog and upsert views of a table.

A changelog row carries its kind as a column: +I, -U, +U or -D. Rows are structs; ``pos`` orders the events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def expand_row_kinds(events: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """r, c: +I(after); u: -U(before) if there is one, +U(after); d: -D(before)."""
    one = lambda kind, row, n: F.struct(F.lit(kind).alias("row_kind"), F.col(row).alias("row"), F.lit(n).alias("part"))
    update = F.when(F.col(before).isNull(), F.array(one("+U", after, 1))).otherwise(F.array(one("-U", before, 0), one("+U", after, 1)))
    kinds = F.when(F.col("op").isin("r", "c"), F.array(one("+I", after, 0))).when(F.col("op") == "u", update).when(F.col("op") == "d", F.array(one("-D", before, 0)))
    rest = [F.col(f"`{c}`") for c in events.columns if c not in (before, after)]
    return events.select(*rest, F.explode(kinds).alias("_k")).select(*rest, "_k.row_kind", "_k.row", "_k.part")


def normalize(events: DataFrame, key: str, row: str, order: str = "pos") -> DataFrame:
    """One consistent history per key from events (key, op, row): repeats dropped, images before a change added.

    A create of a live key becomes an update, an update of an unknown key a create; a delete of one is dropped.
    """
    w = Window.partitionBy(key).orderBy(order)
    live = F.col("op") != "d"
    prev = F.lag(F.struct(live.alias("live"), F.col(row).alias("row"))).over(w)
    out = events.withColumn("_prev", prev).withColumn("_was", F.coalesce(F.col("_prev.live"), F.lit(False)))
    same = F.col("_was") & F.col("_prev.row").eqNullSafe(F.col(row))
    kept = out.filter((live & ~same) | (~live & F.col("_was")))
    op = F.when(~live, "d").when(F.col("_was"), "u").otherwise("c")
    return kept.select(key, order, op.alias("op"), F.when(F.col("_was"), F.col("_prev.row")).alias("before"), F.when(live, F.col(row)).alias("after"))


def to_upsert(changes: DataFrame, key: str) -> DataFrame:
    """+I and +U as the value, -D as a null value; -U goes."""
    return changes.filter("row_kind != '-U'").select(key, "pos", F.when(F.col("row_kind") != "-D", F.col("row")).alias("value"))


def to_envelope(changes: DataFrame, key: str) -> DataFrame:
    """+I and +U as creates with ``after``, -U and -D as deletes with ``before``."""
    new = F.col("row_kind").isin("+I", "+U")
    return changes.select(key, "pos", "part", "row_kind", F.when(new, "c").otherwise("d").alias("op"), F.when(~new, F.col("row")).alias("before"), F.when(new, F.col("row")).alias("after"))


def upsert_to_changelog(upserts: DataFrame, key: str, order: str = "pos") -> DataFrame:
    """Row kinds from values per key: null deletes; repeated values and deletes of unknown keys go."""
    events = upserts.select(key, order, F.when(F.col("value").isNull(), "d").otherwise("u").alias("op"), "value")
    return expand_row_kinds(normalize(events, key, "value", order))


def materialize(upserts: DataFrame, key: str, order: str = "pos") -> DataFrame:
    """The live rows: the last value of each key that isn't null."""
    last = upserts.groupBy(key).agg(F.max_by(F.struct("value"), order).alias("last"))
    return last.filter("last.value is not null").select(key, F.col("last.value").alias("value"))


def current_state(events: DataFrame, key: str, columns: list[str], order: str = "pos") -> DataFrame:
    """The last event's columns for each key that it didn't delete."""
    last = events.groupBy(key).agg(F.max_by(F.struct("op", *columns), order).alias("last"))
    return last.filter("last.op != 'd'").select(key, *[F.col(f"last.{c}").alias(c) for c in columns])


def last_of_batch(batch: DataFrame, key: str, order: str) -> DataFrame:
    """For upsert sinks: a micro-batch's last row per key."""
    return batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
