"""Change-event envelopes: decoding, validation, keys and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamloom.functions.expressions import full_match

SOURCE = "struct<version:string,connector:string,name:string,ts_ms:bigint,snapshot:string,db:string,sequence:string,schema:string,table:string,txId:bigint,lsn:bigint,xmin:bigint>"
TX_META = "status string, id string, event_count int, data_collections array<struct<data_collection:string,event_count:int>>, ts_ms bigint"
OPS = ("r", "c", "u", "d")


def envelope_schema(row: str) -> str:
    """The envelope around a row type, in DDL."""
    return f"before struct<{row}>, after struct<{row}>, source {SOURCE}, op string, ts_ms bigint, transaction struct<id:string>"


def decode(events: DataFrame, row: str, value: str = "value") -> DataFrame:
    """Envelope columns from JSON; events without a value (tombstones) are dropped, unknown fields ignored."""
    parsed = events.filter(F.col(value).isNotNull()).withColumn("e", F.from_json(value, envelope_schema(row)))
    return parsed.select(*[F.col(f"`{c}`") for c in events.columns if c != value], "e.*").withColumn("is_snapshot", F.coalesce(F.col("source.snapshot") != "false", F.lit(False)))


def decode_keyed(events: DataFrame, row: str, key_row: str, key: str = "key", value: str = "value") -> DataFrame:
    """Envelope columns from JSON with the fields of the JSON key, which stand over those of the value."""
    keyed = events.withColumn("_k", F.from_json(key, key_row)).drop(key)
    out = decode(keyed, row, value)
    names = [f.name for f in out.schema["_k"].dataType.fields]
    return out.select(*[F.col(f"_k.{n}").alias(n) for n in names], *[F.col(f"`{c}`") for c in out.columns if c != "_k" and c not in names])


def decode_flat(events: DataFrame, row: str, key_row: str, key: str = "key", value: str = "value") -> DataFrame:
    """Flat rows from a JSON key and value; fields of the key stand over those of the value."""
    parsed = events.withColumns({"_k": F.from_json(key, key_row), "_v": F.from_json(value, row)}).drop(key, value)
    names = [f.name for f in parsed.schema["_k"].dataType.fields]
    rest = [f.name for f in parsed.schema["_v"].dataType.fields if f.name not in names]
    return parsed.select(*[F.col(f"`{c}`") for c in parsed.columns if c not in ("_k", "_v")], *[F.col(f"_k.{n}").alias(n) for n in names], *[F.col(f"_v.{n}").alias(n) for n in rest])


def decode_any(events: DataFrame, value: str = "value") -> DataFrame:
    """The value as a variant, for payloads without a declared row; text that isn't JSON gives null."""
    return events.withColumn(value, F.try_parse_json(value))


def decode_transactions(events: DataFrame, value: str = "value") -> DataFrame:
    """The transaction topic: status, id, event_count, data_collections, ts_ms."""
    return events.select(F.from_json(value, TX_META).alias("e")).select("e.*")


def of_topic(events: DataFrame, topic: str) -> DataFrame:
    """The events of one of several topics that are read together."""
    return events.filter(F.col("topic") == topic)


def encode(key: list[str], value: list[str], drop_null: bool = False) -> list[Column]:
    """Key and value columns as JSON; the value keeps explicit nulls."""
    return [F.to_json(F.struct(*key)).alias("key"), F.to_json(F.struct(*value), {"ignoreNullFields": str(drop_null).lower()}).alias("value")]


def event_key(field: str) -> Column:
    """From ``before`` for deletes, else from ``after``, with the other image as fallback."""
    return F.when(F.col("op") == "d", F.col(f"before.{field}")).otherwise(F.coalesce(F.col(f"after.{field}"), F.col(f"before.{field}")))


def qualified_table() -> Column:
    return F.concat_ws(".", "source.schema", "source.table")


def metadata(events: DataFrame) -> DataFrame:
    """Ingestion time, source table and source properties as columns."""
    return events.withColumns({"ingestion_ts": F.timestamp_millis("ts_ms"), "source_table": qualified_table(), "source_properties": F.from_json(F.to_json("source"), "map<string,string>")})


def include_tables(events: DataFrame, patterns: list[str], table: Column | None = None) -> DataFrame:
    return events.filter(full_match(qualified_table() if table is None else table, patterns))


def include_schemas(events: DataFrame, schemas: list[str], schema: Column | None = None) -> DataFrame:
    return events.filter((F.col("source.schema") if schema is None else schema).isin(*schemas))


def split_valid(events: DataFrame, ops: tuple[str, ...] = OPS) -> tuple[DataFrame, DataFrame]:
    """Events with a known op, and the others: unknown ops, and broken envelopes, which decode to nulls."""
    known = F.coalesce(F.col("op").isin(*ops), F.lit(False))
    return events.filter(known), events.filter(~known)


def flatten(events: DataFrame, key: str = "id", keep: list[str] | None = None) -> DataFrame:
    """The key and the row after the change, beside the columns to ``keep``; a delete gives a null row."""
    return events.select(*(keep or []), event_key(key).alias(key), F.when(F.col("op") != "d", F.col("after")).alias("row"))


def split_moved(events: DataFrame, parent: str) -> DataFrame:
    """An update that moves a row to another parent, as a delete under the old one and a create under the new."""
    moved = F.coalesce((F.col("op") == "u") & (F.col(f"before.{parent}") != F.col(f"after.{parent}")), F.lit(False))
    gone = F.struct(F.lit("d").alias("op"), F.lit(0).alias("half"))
    come = F.struct(F.lit("c").alias("op"), F.lit(1).alias("half"))
    same = F.struct(F.col("op"), F.lit(0).alias("half"))
    out = events.withColumn("x", F.explode(F.when(moved, F.array(gone, come)).otherwise(F.array(same))))
    return out.withColumn("op", F.col("x.op")).withColumn("half", F.col("x.half")).drop("x")
