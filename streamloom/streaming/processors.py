"""Stateful operators for streams (and batches): backfill, commit-order release of transactions, order aggregates.

They need the RocksDB state store; ``configure`` sets it. A released transaction's events all land in one micro-batch, so
no watermark is needed. The END topic must be read in commit order. Each gives what its batch counterpart gives,
however the input is split into micro-batches, and goes on from a checkpoint after a restart.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from streamloom.operators.backfill import UNAVAILABLE
from streamloom.operators.transactions import expected_of

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def configure(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class Backfill(StatefulProcessor):
    """The keyed backfill of some text columns: for each one value per key, seeded by r and c, set by u, cleared by d."""

    def __init__(self, columns: list[str], order: str = "pos", sentinel: str = UNAVAILABLE):
        self.columns, self.order, self.sentinel = columns, order, sentinel

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.values = handle.getMapState("values", "name string", "value string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = {k[0]: v[0] for k, v in self.values.iterator()}
        for r in sorted(rows, key=lambda r: r[self.order]):
            new = r.asDict()
            for c in self.columns:
                if r["op"] == "u" and r[c] == self.sentinel:
                    new[c] = held.get(c)
                elif r["op"] == "d":
                    held.pop(c, None)
                elif r["op"] in ("r", "c", "u"):
                    held[c] = r[c]
            yield Row(**new)
        self.values.clear()
        for name, value in held.items():
            self.values.updateValue((name,), (value,))

    def close(self) -> None:
        pass


def backfill_stream(events: DataFrame, columns: list[str], key: str = "id", order: str = "pos", sentinel: str = UNAVAILABLE) -> DataFrame:
    """events (key, order, op and the columns, of text; others stay as they are) with the sentinels replaced."""
    return events.groupBy(key).transformWithState(Backfill(columns, order, sentinel), events.schema, "append", "none")


def backfill_batches(events: DataFrame, path: str, checkpoint: str, column: str, **options):
    """The window form for a stream: each micro-batch by itself, appended to a table by batch id."""
    from streamloom.operators.backfill import backfill_over
    from streamloom.sources.connectors import to_table

    return to_table(events, path, checkpoint, lambda batch: backfill_over(batch, column, **options))


class Normalize(StatefulProcessor):
    """One consistent history per key, as the batch form makes it: repeats dropped, images before a change added."""

    def __init__(self, key: str, value: str, order: str = "pos"):
        self.value, self.order, self.row = value, order, Row(key, order, "op", "before", "after")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "value string, live boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        old, was = tuple(self.last.get()) if self.last.exists() else (None, False)
        for r in sorted(rows, key=lambda r: r[self.order]):
            new, live = r[self.value], r["op"] != "d"
            if (live and not (was and old == new)) or (was and not live):
                yield self.row(key[0], r[self.order], ("u" if was else "c") if live else "d", old if was else None, new if live else None)
            old, was = new, live
        self.last.update((old, was))

    def close(self) -> None:
        pass


def normalize_stream(events: DataFrame, key: str, value: str, order: str = "pos") -> DataFrame:
    """key, order, op, before, after from events (key, order, op and a value of text)."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, op string, before string, after string"
    return events.groupBy(key).transformWithState(Normalize(key, value, order), schema, "append", "none")


def upsert_stream(events: DataFrame, key: str, value: str, order: str = "pos") -> DataFrame:
    """The changes of an upsert topic: the last value of a key counts, a null deletes; repeats and deletes of unknown keys go."""
    op = F.when(F.col(value).isNull(), "d").otherwise("u")
    return normalize_stream(events.withColumn("op", op), key, value, order)


#: A released event, and an aggregate.
RELEASED = Row("tbl", "order_id", "id", "seq", "op", "v", "commit_lsn")
RELEASED_SCHEMA = "tbl string, order_id long, id long, seq long, op string, v double, commit_lsn long"
AGGREGATE = Row("order_id", "commit_lsn", "deleted", "v", "n_lines", "lines")
AGGREGATE_SCHEMA = "order_id long, commit_lsn long, deleted boolean, v double, n_lines long, lines string"


class Sequencer(StatefulProcessor):
    """Holds events until their transaction is complete, table by table, and all before it are; then releases them with its position.

    Events without a transaction (-1) go through at once at position 0, or are held for good (``hold_untracked``). A
    transaction's events of one micro-batch are one entry of the state.
    """

    def __init__(self, hold_untracked: bool = False):
        self.hold_untracked = hold_untracked

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pending = handle.getMapState("pending", "tx_id long, part long", "events string")
        self.ends = handle.getMapState("ends", "tx_id long", "commit_lsn long, orders long, lines long")
        self.counts = handle.getMapState("counts", "tx_id long", "parts long, orders long, lines long")

    def counted(self, tx: int) -> tuple:
        return tuple(self.counts.getValue((tx,))) if self.counts.containsKey((tx,)) else (0, 0, 0)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new: dict[int, list[tuple]] = {}
        for r in rows:
            if r["tbl"] == "end":
                self.ends.updateValue((r["tx_id"],), (r["commit_lsn"], r["orders"], r["lines"]))
            else:
                new.setdefault(r["tx_id"], []).append((r["tbl"], r["order_id"], r["id"], r["seq"], r["op"], r["v"]))
        for e in new.pop(-1, []) if not self.hold_untracked else []:
            yield RELEASED(*e, 0)
        for tx, events in new.items():
            parts, orders, lines = self.counted(tx)
            own = sum(e[0] == "orders" for e in events)
            self.pending.updateValue((tx, parts), (json.dumps(events),))
            self.counts.updateValue((tx,), (parts + 1, orders + own, lines + len(events) - own))
        for tx, (lsn, orders, lines) in sorted(((k[0], tuple(v)) for k, v in self.ends.iterator()), key=lambda x: x[1][0]):
            counted = self.counted(tx)
            if counted[1:] != (orders, lines):
                break
            for part in range(counted[0]):
                for e in json.loads(self.pending.getValue((tx, part))[0]):
                    yield RELEASED(*e, lsn)
                self.pending.removeKey((tx, part))
            self.ends.removeKey((tx,))
            if counted[0]:
                self.counts.removeKey((tx,))

    def close(self) -> None:
        pass


class OrderState(StatefulProcessor):
    """An order's header and its lines' images; one result for each transaction that touched it, once it has had a line (``how='left'``: in any case).

    Lines outlive the order's delete, as in the batch form: an order that is created again has them.
    """

    def __init__(self, how: str = "inner"):
        self.how = how

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.header = handle.getValueState("header", "v double")
        self.lines = handle.getMapState("lines", "id long", "q double, live boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        lines = {k[0]: tuple(v) for k, v in self.lines.iterator()}
        header = tuple(self.header.get()) if self.header.exists() else None
        changed = set()
        events = sorted(rows, key=lambda r: (r["commit_lsn"], r["seq"]))
        at = 0
        while at < len(events):
            lsn, gone = events[at]["commit_lsn"], False
            while at < len(events) and events[at]["commit_lsn"] == lsn:
                r = events[at]
                if r["tbl"] == "orders":
                    gone, header = r["op"] == "d", (r["v"],)
                else:
                    lines[r["id"]] = (r["v"], r["op"] != "d")
                    changed.add(r["id"])
                at += 1
            if header is not None and (lines or self.how == "left"):
                live = [] if gone else sorted((i, q) for i, (q, lives) in lines.items() if lives)
                yield AGGREGATE(key[0], lsn, gone, header[0], len(live), ",".join(f"{i}={int(q)}" for i, q in live))
            if gone:
                header = None
        for i in changed:
            self.lines.updateValue((i,), lines[i])
        if header is None:
            self.header.clear()
        else:
            self.header.update(header)

    def close(self) -> None:
        pass


def order_stream(orders: DataFrame, lines: DataFrame, ends: DataFrame, how: str = "inner", hold_untracked: bool = False) -> DataFrame:
    """Aggregates of orders with lines, once per transaction, in commit order.

    orders and lines: tx_id, order_id, id, seq, op, v; ends: tx_id, commit_lsn, data_collections (events by table).
    """
    zero = F.lit(0).cast("long")
    one = lambda df, tbl: df.select(F.lit(tbl).alias("tbl"), F.coalesce("tx_id", F.lit(-1)).cast("long").alias("tx_id"), "order_id", "id", F.col("seq").cast("long").alias("seq"), "op", F.col("v").cast("double").alias("v"), *[zero.alias(c) for c in ("commit_lsn", "orders", "lines")])
    counts = [expected_of(F.col("data_collections"), t).alias(t) for t in ("orders", "lines")]
    end = ends.select(F.lit("end").alias("tbl"), "tx_id", *[zero.alias(c) for c in ("order_id", "id", "seq")], F.lit("").alias("op"), F.lit(0.0).alias("v"), "commit_lsn", *counts)
    every = one(orders, "orders").unionByName(one(lines, "lines")).unionByName(end).withColumn("g", F.lit(0))
    released = every.groupBy("g").transformWithState(Sequencer(hold_untracked), RELEASED_SCHEMA, "append", "none")
    return released.groupBy("order_id").transformWithState(OrderState(how), AGGREGATE_SCHEMA, "append", "none")
