"""Transaction-consistent join of orders with their lines, and its nesting: one row for each order and transaction.

Orders are events (id, commit_lsn, seq, op, ...), lines (order_id, id, commit_lsn, seq, op, ...). Events are brought down to
one image for each key and transaction before the exchange by order id. An order's image as of a transaction is the last
one on its timeline, by one window; only lines are joined, and there the result is every line at every transaction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FOREVER = 2**63 - 1


def versions(events: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """The last image of each key in each transaction, valid in [lsn, nx)."""
    last = events.groupBy(*key, F.col("commit_lsn").alias("lsn")).agg(F.max_by(F.struct("op", *columns), "seq").alias("v"))
    w = Window.partitionBy(*key).orderBy("lsn")
    return last.select(*key, "lsn", F.coalesce(F.lead("lsn").over(w), F.lit(FOREVER)).alias("nx"), "v.*")


def touched(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Each order with the transactions that changed it or one of its lines."""
    both = orders.select(F.col("id").alias("order_id"), "commit_lsn").unionByName(lines.select("order_id", "commit_lsn"))
    return both.distinct()


def order_asof(orders: DataFrame, lines: DataFrame, columns: list[str]) -> DataFrame:
    """The order's image as of each transaction that touched it; after its delete only the delete itself counts."""
    image = F.struct("seq", F.col("commit_lsn").alias("lsn"), "op", *columns)
    own = orders.select(F.col("id").alias("order_id"), "commit_lsn", F.col("seq").alias("at"), image.alias("image"))
    none = lines.select("order_id", "commit_lsn", F.lit(None).cast(own.schema["at"].dataType).alias("at"), F.lit(None).cast(own.schema["image"].dataType).alias("image"))
    timeline = own.unionByName(none).groupBy("order_id", "commit_lsn").agg(F.max_by("image", "at").alias("image"))
    w = Window.partitionBy("order_id").orderBy("commit_lsn")
    seen = timeline.select("order_id", "commit_lsn", F.last("image", ignorenulls=True).over(w).alias("v")).filter("v is not null and (v.op != 'd' or v.lsn = commit_lsn)")
    return seen.select("order_id", "commit_lsn", (F.col("v.op") == "d").alias("deleted"), *[F.col(f"v.{c}").alias(c) for c in columns])


def lines_asof(orders: DataFrame, lines: DataFrame, columns: list[str]) -> DataFrame:
    """All lines' images as of each transaction that touched their order, deleted ones included."""
    lv = versions(lines, ["order_id", "id"], columns).withColumnsRenamed({"id": "line_id", "op": "line_op"})
    seen = touched(orders, lines).join(lv, "order_id").filter("lsn <= commit_lsn and commit_lsn < nx")
    return seen.select("order_id", "commit_lsn", "line_id", "line_op", *[F.col(c).alias(f"line_{c}") for c in columns])


def pairs(orders: DataFrame, lines: DataFrame, order_columns: list[str], line_columns: list[str], how: str = "inner") -> DataFrame:
    """Order images with line images, per transaction."""
    return order_asof(orders, lines, order_columns).join(lines_asof(orders, lines, line_columns), ["order_id", "commit_lsn"], how)


def nested(orders: DataFrame, lines: DataFrame, order_columns: list[str], line_columns: list[str], how: str = "inner") -> DataFrame:
    """One row for each order and transaction, with the live lines as an array in order of id.

    ``how='inner'`` leaves out orders that never had a line; with ``left`` they have an empty array.
    """
    p = pairs(orders, lines, order_columns, line_columns, how)
    line = F.struct(F.col("line_id").alias("id"), *[F.col(f"line_{c}").alias(c) for c in line_columns])
    live = F.when(F.coalesce(F.col("line_op") != "d", F.lit(False)) & ~F.col("deleted"), line)
    return p.groupBy("order_id", "commit_lsn", "deleted", *order_columns).agg(F.array_sort(F.collect_list(live)).alias("lines"))


def with_tombstones(aggregates: DataFrame, columns: list[str]) -> DataFrame:
    """Key and value for a sink: the value is null where the order was deleted."""
    from streamloom.functions.expressions import long_key

    value = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return aggregates.select(long_key(F.col("order_id")).alias("key"), F.when(~F.col("deleted"), value).alias("value"), "order_id", "commit_lsn")


def nested_left_join(orders: DataFrame, lines: DataFrame, key: str, parent: str, line_columns: list[str]) -> DataFrame:
    """A table nested into another: every parent row with the array of its child rows."""
    items = lines.groupBy(parent).agg(F.array_sort(F.collect_list(F.struct(*line_columns))).alias("lines"))
    return orders.join(items, orders[key] == items[parent], "left").select(*[orders[c] for c in orders.columns], F.coalesce("lines", F.array().cast(items.schema["lines"].dataType)).alias("lines"))


def unmatched_lines(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Line events whose order isn't known: the joins leave them out, and they are counted here."""
    return lines.join(orders.select(F.col("id").alias("order_id")).distinct(), "order_id", "left_anti").agg(F.count("*").alias("n"))
