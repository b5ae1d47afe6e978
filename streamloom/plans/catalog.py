"""The library's queries by name, with their SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamloom.functions.expressions import day_text, epoch_date, json_field, later, lines_by_id, map_put, map_remove, money, tx_id, tx_lsn, tx_string, utf8
from streamloom.operators import backfill, changelog, envelope, reporting, transactions, txjoin
from streamloom.sources.connectors import ddl
from streamloom.plans.fixtures import load, with_sql

FLAGSHIP = "tx_order_agg"
CURRENT_LSN = "16/B374E000"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str, *names: str):
    """Registers a query over fixtures or tables, and its SQL."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*[load(spark, sf_dir, n) for n in names])
        defined = with_sql(*names)
        ORACLE_SQL[f.__name__] = (defined if defined != "WITH  " else "") + sql
        return f

    return add


S = "'__debezium_unavailable_value'"
KEYED = f"""SELECT pos, id, op, CASE WHEN op = 'u' AND biography = {S} THEN (last_value(CASE WHEN op IN ('r', 'c') OR (op = 'u' AND
 (biography IS NULL OR biography <> {S})) THEN {{'b': biography}} END IGNORE NULLS) OVER (PARTITION BY id, epoch ORDER BY pos ROWS
 BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)).b ELSE biography END AS biography FROM (SELECT *, count(CASE WHEN op = 'd' THEN 1 END)
 OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS epoch FROM fx1)"""


@query(f"SELECT pos, id, op, CASE WHEN biography = {S} AND op <> 'd' THEN CASE WHEN held.t >= ts - INTERVAL 30 DAYS THEN held.x END ELSE biography END AS biography FROM (SELECT *, last_value(CASE WHEN biography IS NOT NULL AND biography <> {S} THEN {{'t': ts, 'x': biography}} END IGNORE NULLS) OVER (PARTITION BY id ORDER BY ts, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held FROM fx1)", "fx1")
def backfill_over_30d(fx1):
    return backfill.backfill_over(fx1, "biography").select("pos", "id", "op", "biography")


@query(f"SELECT pos, id, op, CASE WHEN biography = {S} AND op <> 'd' THEN last_value(nullif(biography, {S}) IGNORE NULLS) OVER (PARTITION BY id ORDER BY ts, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) ELSE biography END AS biography FROM fx1", "fx1")
def backfill_over_unbounded(fx1):
    return backfill.backfill_over(fx1, "biography", days=None).select("pos", "id", "op", "biography")


@query(KEYED, "fx1")
def backfill_keyed_state(fx1):
    return backfill.backfill_keyed(fx1, ["biography"]).select("pos", "id", "op", "biography")


@query(f"SELECT pos, id, op, CASE WHEN biography = {S} THEN 'customer ' || c_name ELSE biography END AS biography FROM fx1 LEFT JOIN customer ON id = c_custkey", "fx1", "customer")
def backfill_reselect_lookup(fx1, customer):
    current = customer.select(F.col("c_custkey").alias("id"), F.concat(F.lit("customer "), "c_name").alias("biography"))
    return backfill.reselect(fx1, current, ["biography"]).select("pos", "id", "op", "biography")


def wired(fx1: DataFrame, schema=None) -> DataFrame:
    """fx1 as JSON envelopes: what a change topic holds."""
    schema = F.lit("inventory") if schema is None else schema
    row = F.struct("id", F.col("biography"))
    source = F.struct(F.lit("s1").alias("name"), F.lit("false").alias("snapshot"), schema.alias("schema"), F.when(F.col("id") % 2 == 0, "authors").otherwise("books_1").alias("table"), (F.col("pos") * 10).alias("txId"), (F.col("pos") * 100).alias("lsn"))
    value = F.to_json(F.struct(F.when(F.col("op") == "d", row).alias("before"), F.when(F.col("op") != "d", row).alias("after"), source.alias("source"), "op", (F.col("pos") * 1000).alias("ts_ms"), F.struct(F.concat_ws(":", F.col("pos") * 10, F.col("pos") * 100).alias("id")).alias("transaction")), {"ignoreNullFields": "false"})
    return fx1.select("pos", F.to_json(F.struct("id")).alias("key"), value.alias("value"))


ROW = "id bigint, biography string"


@query("SELECT pos, id, op, CASE WHEN op = 'd' THEN biography END AS before_biography, CASE WHEN op <> 'd' THEN biography END AS after_biography, pos * 1000 AS ts_ms, false AS is_snapshot FROM fx1", "fx1")
def envelope_append(fx1):
    e = envelope.decode(wired(fx1), ROW)
    return e.select("pos", envelope.event_key("id").alias("id"), "op", F.col("before.biography").alias("before_biography"), F.col("after.biography").alias("after_biography"), "ts_ms", "is_snapshot")


@query("SELECT pos, epoch_ms(make_timestamp(pos * 1000000)) AS ingestion_ms, CASE WHEN id % 2 = 0 THEN 'inventory.authors' ELSE 'inventory.books_1' END AS source_table, CAST(pos * 100 AS VARCHAR) AS lsn FROM fx1", "fx1")
def metadata_columns(fx1):
    m = envelope.metadata(envelope.decode(wired(fx1), ROW))
    return m.select("pos", F.unix_millis("ingestion_ts").alias("ingestion_ms"), "source_table", F.col("source_properties")["lsn"].alias("lsn"))


@query("SELECT pos, id FROM fx1 WHERE id % 2 = 0", "fx1")
def table_include_filter(fx1):
    return envelope.include_tables(envelope.decode(wired(fx1), ROW), ["inventory\\.authors", "inventory\\.book"]).select("pos", envelope.event_key("id").alias("id"))


@query("SELECT pos, pos * 10 AS tx_id, pos * 100 AS commit_lsn, CAST(pos * 10 AS VARCHAR) || ':' || CAST(pos * 100 AS VARCHAR) AS tx FROM fx1", "fx1")
def transaction_ids(fx1):
    e = envelope.decode(wired(fx1), ROW)
    t = F.col("transaction.id")
    return e.select("pos", tx_id(t).alias("tx_id"), tx_lsn(t).alias("commit_lsn"), tx_string(tx_id(t), tx_lsn(t)).alias("tx"))


IMAGES = "imaged AS (SELECT pos, id, op, CASE WHEN op <> 'c' THEN lag(biography) OVER (PARTITION BY id ORDER BY pos) END AS old, biography AS new FROM fx1)"
KINDS = f", {IMAGES} SELECT pos, id, CASE WHEN op = 'c' THEN '+I' ELSE '+U' END AS row_kind, new AS biography FROM imaged WHERE op <> 'd' UNION ALL SELECT pos, id, CASE WHEN op = 'u' THEN '-U' ELSE '-D' END, old FROM imaged WHERE op <> 'c' AND has"


def imaged(fx1: DataFrame) -> DataFrame:
    """fx1 with images before and after; the image before a key's first event is missing."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("id").orderBy("pos")
    row = F.struct("biography")
    return fx1.select("pos", "id", "op", F.when(F.col("op") != "c", F.lag(row).over(w)).alias("before"), F.when(F.col("op") != "d", row).alias("after"))


@query(KINDS.replace(" AND has", " AND (op = 'd' OR known)").replace("biography AS new FROM", "biography AS new, lag(1) OVER (PARTITION BY id ORDER BY pos) IS NOT NULL AS known FROM"), "fx1")
def rowkind_expand(fx1):
    return changelog.expand_row_kinds(imaged(fx1)).select("pos", "id", "row_kind", F.col("row.biography").alias("biography"))


@query("""SELECT pos, id, op, row_kind, biography FROM (SELECT pos, id, 'c' AS op, '+I' AS row_kind, biography FROM fx1 WHERE op = 'c'
 UNION ALL SELECT pos, id, 'c', '+U', biography FROM fx1 WHERE op = 'u' UNION ALL SELECT pos, id, 'd', '-D', old FROM (SELECT *, lag(biography) OVER (PARTITION BY id ORDER BY pos) AS old FROM fx1) WHERE op = 'd'
 UNION ALL SELECT pos, id, 'd', '-U', old FROM (SELECT *, lag(biography) OVER (PARTITION BY id ORDER BY pos) AS old, lag(1) OVER (PARTITION BY id ORDER BY pos) AS k FROM fx1) WHERE op = 'u' AND k IS NOT NULL)""", "fx1")
def changelog_envelope(fx1):
    e = changelog.to_envelope(changelog.expand_row_kinds(imaged(fx1)), "id")
    return e.select("pos", "id", "op", "row_kind", F.coalesce("after", "before")["biography"].alias("biography"))


NORMAL = """normal AS (SELECT pos, id, CASE WHEN op = 'd' THEN 'd' WHEN was THEN 'u' ELSE 'c' END AS op, CASE WHEN was THEN pb END AS before, CASE WHEN op <> 'd' THEN biography END AS after, was
 FROM (SELECT *, coalesce(lag(op) OVER w <> 'd', false) AS was, lag(biography) OVER w AS pb FROM fx1 WINDOW w AS (PARTITION BY id ORDER BY pos))
 WHERE (op <> 'd' AND NOT (was AND pb IS NOT DISTINCT FROM biography)) OR (op = 'd' AND was))"""


@query(f", {NORMAL} SELECT pos, id, op, before, after FROM normal", "fx1")
def normalize_changelog(fx1):
    n = changelog.normalize(fx1.withColumn("row", F.struct("biography")), "id", "row")
    return n.select("pos", "id", "op", F.col("before.biography").alias("before"), F.col("after.biography").alias("after"))


@query(f", {NORMAL} SELECT pos, id, op = 'd' AS tombstone, after AS biography FROM normal", "fx1")
def changelog_to_upsert(fx1):
    n = changelog.normalize(fx1.withColumn("row", F.struct("biography")), "id", "row")
    u = changelog.to_upsert(changelog.expand_row_kinds(n), "id")
    return u.select("pos", "id", F.col("value").isNull().alias("tombstone"), F.col("value.biography").alias("biography"))


def upserts(fx1: DataFrame) -> DataFrame:
    return fx1.select("id", "pos", F.when(F.col("op") != "d", F.struct("biography")).alias("value"))


@query(f""", {NORMAL} SELECT pos, id, CASE WHEN was THEN '+U' ELSE '+I' END AS row_kind, after AS biography FROM normal WHERE op <> 'd'
 UNION ALL SELECT pos, id, CASE WHEN op = 'd' THEN '-D' ELSE '-U' END, before FROM normal WHERE was""", "fx1")
def upsert_to_changelog(fx1):
    return changelog.upsert_to_changelog(upserts(fx1), "id").select("pos", "id", "row_kind", F.col("row.biography").alias("biography"))


LAST = "SELECT id, biography FROM fx1 QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos DESC) = 1 AND op <> 'd'"


@query(LAST, "fx1")
def upsert_materialize(fx1):
    return changelog.materialize(upserts(fx1), "id").select("id", F.col("value.biography").alias("biography"))


@query(LAST, "fx1")
def current_state(fx1):
    return changelog.current_state(fx1, "id", ["biography"])


def arrived_events(fo: DataFrame, arrived: DataFrame) -> DataFrame:
    one = lambda df, tbl: df.select(F.col("id").cast("long").alias("id"), (F.lit(5000000) - F.col("commit_lsn")).alias("tx_id"), "seq", F.lit(tbl).alias("tbl"))
    return one(fo, "orders").unionByName(one(arrived, "lines"))


EVENTS = ", ev AS (SELECT id, 5000000 - commit_lsn AS tx_id, seq, 'orders' AS tbl FROM fo UNION ALL SELECT id, 5000000 - commit_lsn, seq, 'lines' FROM arrived), stamped AS (SELECT ev.*, tx.commit_lsn FROM ev JOIN tx USING (tx_id))"
EXPECTED = ", expected AS (SELECT commit_lsn, 'orders' AS tbl, n_orders AS expected FROM tx UNION ALL SELECT commit_lsn, 'lines', n_lines FROM tx), counts AS (SELECT commit_lsn, tbl, count(*) AS n FROM stamped GROUP BY 1, 2), complete AS (SELECT commit_lsn, bool_and(coalesce(n, 0) = expected) AS complete FROM expected LEFT JOIN counts USING (commit_lsn, tbl) GROUP BY 1)"


def ends(tx: DataFrame) -> DataFrame:
    """tx as END events, with the table counts as the topic has them."""
    one = lambda tbl, n: F.struct(F.lit(tbl).alias("data_collection"), F.col(n).cast("int").alias("event_count"))
    return tx.select("tx_id", "commit_lsn", F.array(one("orders", "n_orders"), one("lines", "n_lines")).alias("data_collections"))


@query(EVENTS + " SELECT id, tbl, CAST(seq AS INTEGER) AS seq, tx_id, commit_lsn FROM stamped", "fo", "arrived", "tx")
def tx_commit_lsn_fix(fo, arrived, tx):
    return transactions.stamp_commit_lsn(arrived_events(fo, arrived), ends(tx)).select("id", "tbl", "seq", "tx_id", "commit_lsn")


@query(EVENTS + " SELECT commit_lsn, tbl, count(*) AS n FROM stamped GROUP BY 1, 2", "fo", "arrived", "tx")
def tx_event_counts(fo, arrived, tx):
    return transactions.event_counts(transactions.stamp_commit_lsn(arrived_events(fo, arrived), ends(tx)))


@query(EVENTS + EXPECTED + " SELECT * FROM complete", "fo", "arrived", "tx")
def tx_completeness(fo, arrived, tx):
    events = transactions.stamp_commit_lsn(arrived_events(fo, arrived), ends(tx))
    return transactions.completeness(events, transactions.expected_counts(ends(tx)))


@query(EVENTS + EXPECTED + " SELECT commit_lsn FROM (SELECT commit_lsn, bool_and(complete) OVER (ORDER BY commit_lsn) AS ok FROM complete) WHERE ok", "fo", "arrived", "tx")
def tx_frontier(fo, arrived, tx):
    events = transactions.stamp_commit_lsn(arrived_events(fo, arrived), ends(tx))
    return transactions.frontier(transactions.completeness(events, transactions.expected_counts(ends(tx))))


VERSIONS = """, ov AS (SELECT id, lsn, v, op, coalesce(lead(lsn) OVER (PARTITION BY id ORDER BY lsn), 9223372036854775807) AS nx FROM (SELECT id, commit_lsn AS lsn, v, op FROM fo QUALIFY row_number() OVER (PARTITION BY id, commit_lsn ORDER BY seq DESC) = 1)),
 lv AS (SELECT order_id, id, lsn, q, op, coalesce(lead(lsn) OVER (PARTITION BY order_id, id ORDER BY lsn), 9223372036854775807) AS nx FROM (SELECT order_id, id, commit_lsn AS lsn, q, op FROM fl QUALIFY row_number() OVER (PARTITION BY id, commit_lsn ORDER BY seq DESC) = 1)),
 touched AS (SELECT id AS order_id, commit_lsn FROM fo UNION SELECT order_id, commit_lsn FROM fl),
 oa AS (SELECT t.order_id, t.commit_lsn, ov.op = 'd' AS deleted, ov.v FROM touched t JOIN ov ON ov.id = t.order_id AND ov.lsn <= t.commit_lsn AND t.commit_lsn < ov.nx WHERE ov.op <> 'd' OR ov.lsn = t.commit_lsn),
 la AS (SELECT t.order_id, t.commit_lsn, lv.id AS line_id, lv.op AS line_op, lv.q AS line_q FROM touched t JOIN lv ON lv.order_id = t.order_id AND lv.lsn <= t.commit_lsn AND t.commit_lsn < lv.nx)"""
AGG = " SELECT order_id, commit_lsn, deleted, v, count(CASE WHEN line_op <> 'd' AND NOT deleted THEN 1 END) AS n_lines, coalesce(string_agg(CASE WHEN line_op <> 'd' AND NOT deleted THEN CAST(line_id AS VARCHAR) || '=' || CAST(CAST(line_q AS BIGINT) AS VARCHAR) END, ',' ORDER BY line_id), '') AS lines FROM oa {how} JOIN la USING (order_id, commit_lsn) GROUP BY 1, 2, 3, 4"


def flat_lines(df: DataFrame) -> DataFrame:
    item = lambda x: F.concat_ws("=", x["id"].cast("string"), x["q"].cast("long").cast("string"))
    return df.select("order_id", "commit_lsn", "deleted", "v", F.size("lines").cast("long").alias("n_lines"), F.concat_ws(",", F.transform("lines", item)).alias("lines"))


@query(VERSIONS + " SELECT * FROM oa", "fo", "fl")
def order_asof(fo, fl):
    return txjoin.order_asof(fo, fl, ["v"])


@query(VERSIONS + " SELECT * FROM la", "fo", "fl")
def lines_asof(fo, fl):
    return txjoin.lines_asof(fo, fl, ["q"]).withColumn("line_id", F.col("line_id").cast("long"))


@query(VERSIONS + " SELECT order_id, commit_lsn, deleted, v, line_id, line_op, line_q FROM oa JOIN la USING (order_id, commit_lsn)", "fo", "fl")
def tx_join_pairs(fo, fl):
    return txjoin.pairs(fo, fl, ["v"], ["q"]).withColumn("line_id", F.col("line_id").cast("long"))


@query(VERSIONS + AGG.format(how=""), "fo", "fl")
def tx_order_agg(fo, fl):
    return flat_lines(txjoin.nested(fo, fl, ["v"], ["q"]))


@query(VERSIONS + AGG.format(how="LEFT"), "fo", "fl")
def tx_order_agg_left(fo, fl):
    return flat_lines(txjoin.nested(fo, fl, ["v"], ["q"], how="left"))


@query(VERSIONS + " SELECT lpad(upper(to_hex(order_id)), 16, '0') AS key_hex, order_id, commit_lsn, deleted AS tombstone, CASE WHEN NOT deleted THEN CAST(to_json({'order_id': order_id, 'v': v, 'lines': coalesce(list({'id': line_id, 'q': line_q} ORDER BY line_id) FILTER (WHERE line_op <> 'd'), []), 'commit_lsn': commit_lsn}) AS VARCHAR) END AS value FROM oa JOIN la USING (order_id, commit_lsn) GROUP BY order_id, commit_lsn, deleted, v", "fo", "fl")
def tx_order_tombstones(fo, fl):
    t = txjoin.with_tombstones(txjoin.nested(fo, fl, ["v"], ["q"]), ["order_id", "v", "lines", "commit_lsn"])
    return t.select(F.hex("key").alias("key_hex"), "order_id", "commit_lsn", F.col("value").isNull().alias("tombstone"), "value")


@query(" SELECT o_orderkey, count(b.id) AS n_lines, coalesce(string_agg(CAST(b.id AS VARCHAR), ',' ORDER BY b.id), '') AS lines FROM orders LEFT JOIN base b ON b.order_id = o_orderkey GROUP BY 1", "orders", "base")
def order_nested_left_join(orders, base):
    n = txjoin.nested_left_join(orders, base, "o_orderkey", "order_id", ["id", "q"])
    return n.select("o_orderkey", F.size("lines").cast("long").alias("n_lines"), F.concat_ws(",", F.transform("lines", lambda x: x["id"].cast("string"))).alias("lines"))


@query(" SELECT slot_name, plugin, db, CASE WHEN invalidation_reason IS NOT NULL THEN 'invalid' WHEN active IS TRUE THEN 'active' ELSE 'inactive' END AS status FROM slots", "slots")
def slot_status(slots):
    return reporting.slot_status(slots).select("slot_name", "plugin", "db", "status")


@query(" SELECT * FROM (VALUES ('a', 1976, '1976 bytes', '50 GB'), ('b', 7659520, '7480 kB', '10239 kB'), ('c', 3010781185, '2871 MB', NULL), ('d', 4096, '4096 bytes', '10239 bytes')) AS t(slot_name, retained_bytes, retained_wal, safe_wal)".replace("retained_bytes, retained_wal, safe_wal)", "x, retained_wal, safe_wal)").replace("SELECT *", "SELECT slot_name, CAST(x AS BIGINT) AS retained_bytes, retained_wal, safe_wal"), "slots")
def slot_wal_lag(slots):
    return reporting.slot_lag(slots, CURRENT_LSN).select("slot_name", "retained_bytes", "retained_wal", "safe_wal")


LABELLED = """, labelled AS (SELECT event_id, ts, value, CASE event_id % 7 WHEN 0 THEN 'kafka_connect_worker_metrics_task-count' WHEN 1 THEN 'kafka_connect_metrics_request-rate'
  WHEN 2 THEN 'debezium_metrics_RowsScanned' WHEN 5 THEN 'debezium_metrics_MilliSecondsBehindSource' ELSE 'debezium_metrics_TotalNumberOfEventsSeen' END AS metric,
 CASE WHEN event_id % 7 IN (2, 3) THEN 'snapshot' WHEN event_id % 7 IN (4, 5) THEN 'streaming' ELSE '' END AS context,
 CASE WHEN event_id % 7 >= 2 THEN 's' || CAST(event_id % 3 AS VARCHAR) ELSE '' END AS name, CASE event_id % 7 WHEN 3 THEN '0' WHEN 4 THEN '1' ELSE '' END AS task,
 CASE WHEN event_id % 7 = 4 THEN 'mysql' WHEN event_id % 7 >= 2 THEN 'postgres' ELSE '' END AS plugin, CASE WHEN event_id % 7 = 3 THEN 'db1' ELSE '' END AS database,
 CASE WHEN event_id % 7 = 2 THEN 'inventory.authors' ELSE '' END AS tbl, CASE WHEN event_id % 7 = 1 THEN 'c' || CAST(event_id % 3 AS VARCHAR) ELSE '' END AS client FROM raw WHERE event_id % 7 < 6)"""


def labelled(raw: DataFrame) -> DataFrame:
    return reporting.relabel(raw, "raw")


@query(LABELLED + " SELECT event_id, metric, context, name, task, plugin, database, tbl, client FROM labelled", "raw")
def metric_relabel(raw):
    label = lambda k: F.coalesce(F.col("labels")[k], F.lit("")).alias(k)
    return labelled(raw).select("event_id", "metric", *[label(k) for k in ("context", "name", "task", "plugin", "database", "client")], label("table").alias("tbl"))


@query(LABELLED + " SELECT event_id, metric, value FROM labelled WHERE context = 'streaming'", "raw")
def metric_label_filter(raw):
    return reporting.where_label(labelled(raw), "context", "streaming").select("event_id", "metric", "value")


@query(LABELLED + " SELECT metric, epoch(date_trunc('minute', ts))::BIGINT AS bucket_s, min(value) AS value FROM labelled GROUP BY 1, 2", "raw")
def slot_activity_min_1m(raw):
    m = reporting.min_over_time(labelled(raw), ["metric"])
    return m.select("metric", F.unix_seconds(F.col("bucket").cast("timestamp")).alias("bucket_s"), "value")


@query(" SELECT event_id, CASE WHEN event_id % 2 = 1 THEN 'Active' ELSE 'Inactive' END AS activity FROM events", "events")
def value_mapping(events):
    return events.select("event_id", reporting.activity(F.col("event_id") % 2).alias("activity"))


@query(" SELECT o_orderkey, strftime(DATE '1970-01-01' + CAST(o_orderkey AS INTEGER), '%Y-%m-%d') AS day, md5(CAST(o_orderkey AS VARCHAR)) AS digest, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS padded FROM orders", "orders")
def scalar_functions(orders):
    k = F.col("o_orderkey")
    return orders.select("o_orderkey", day_text(epoch_date(k.cast("int"))).alias("day"), F.md5(k.cast("string").cast("binary")).alias("digest"), F.lpad(k.cast("string"), 12, "0").alias("padded"))


@query(" SELECT count(*) AS n FROM fl WHERE order_id % 3 = 0 OR order_id NOT IN (SELECT id FROM fo)", "fo", "fl")
def unmatched_lines(fo, fl):
    """Against a table that lacks every third order."""
    return txjoin.unmatched_lines(fo.filter("id % 3 <> 0"), fl)




@query(" SELECT pos, '{\"id\":' || CAST(id AS VARCHAR) || '}' AS key, CAST(to_json({'op': op, 'biography': biography}) AS VARCHAR) AS value FROM fx1", "fx1")
def append_json(fx1):
    """JSON key and value in and out; the key's id stands over the value's."""
    wire = fx1.select("pos", F.to_json(F.struct("id")).alias("key"), F.to_json(F.struct((F.col("id") + 1).alias("id"), "op", "biography")).alias("value"))
    rows = envelope.decode_flat(wire, "id bigint, op string, biography string", "id bigint")
    return rows.select("pos", *envelope.encode(["id"], ["op", "biography"]))


@query("""SELECT pos, row_kind, '{"id":' || CAST(id AS VARCHAR) || '}' AS key, CAST(to_json({'before': CASE WHEN op = 'd' THEN {'biography': biography} END, 'after': CASE WHEN op = 'c' THEN {'biography': biography} END, 'op': op}) AS VARCHAR) AS value FROM (
 SELECT pos, id, 'c' AS op, '+I' AS row_kind, biography FROM fx1 WHERE op = 'c'
 UNION ALL SELECT pos, id, 'c', '+U', biography FROM fx1 WHERE op = 'u' UNION ALL SELECT pos, id, 'd', '-D', old FROM (SELECT *, lag(biography) OVER (PARTITION BY id ORDER BY pos) AS old, lag(1) OVER (PARTITION BY id ORDER BY pos) AS k FROM fx1) WHERE op = 'd' AND k IS NOT NULL
 UNION ALL SELECT pos, id, 'd', '-U', old FROM (SELECT *, lag(biography) OVER (PARTITION BY id ORDER BY pos) AS old, lag(1) OVER (PARTITION BY id ORDER BY pos) AS k FROM fx1) WHERE op = 'u' AND k IS NOT NULL)""", "fx1")
def changelog_json(fx1):
    """Row kinds back to JSON envelopes, as a changelog sink writes them."""
    e = changelog.to_envelope(changelog.expand_row_kinds(imaged(fx1).filter("op != 'd' or before is not null")), "id")
    return e.select("pos", "row_kind", *envelope.encode(["id"], ["before", "after", "op"]))


def wired_transactions(tx: DataFrame) -> DataFrame:
    """tx as the JSON of a transaction topic, each with a BEGIN before its END, beside another topic's events."""
    one = lambda status, collections: F.to_json(F.struct(F.lit(status).alias("status"), F.concat_ws(":", "tx_id", "commit_lsn").alias("id"), collections.alias("data_collections")))
    table = lambda name, n: F.struct(F.lit(name).alias("data_collection"), F.col(n).alias("event_count"))
    none = F.lit(None).cast("array<struct<data_collection:string,event_count:bigint>>")
    end = F.array(table("orders", "n_orders"), table("lines", "n_lines"))
    values = F.explode(F.array(F.struct(F.lit("transaction").alias("topic"), one("BEGIN", none).alias("value")), F.struct(F.lit("transaction").alias("topic"), one("END", end).alias("value")), F.struct(F.lit("orders").alias("topic"), F.lit("{}").alias("value"))))
    return tx.select(values.alias("x")).select("x.*")


@query(" SELECT tx_id, commit_lsn, n_orders, n_lines FROM tx", "tx")
def tx_end_filter(tx):
    found = transactions.ends_of(envelope.decode_transactions(envelope.of_topic(wired_transactions(tx), "transaction")))
    n = lambda t: transactions.expected_of(F.col("data_collections"), t)
    return found.select("tx_id", "commit_lsn", n("orders").alias("n_orders"), n("lines").alias("n_lines"))


@query(EVENTS + EXPECTED + ", every_tx AS (SELECT * FROM complete UNION ALL SELECT 1, true UNION ALL SELECT 999999999, true) SELECT commit_lsn FROM (SELECT commit_lsn, bool_and(complete) OVER (ORDER BY commit_lsn) AS ok FROM every_tx) WHERE ok", "fo", "arrived", "tx")
def tx_heartbeat_frontier(fo, arrived, tx):
    """With heartbeats, transactions of no events, at both ends."""
    beats = tx.sparkSession.range(1).select(F.explode(F.array(F.lit(1).cast("long"), F.lit(999999999).cast("long"))).alias("commit_lsn")).withColumn("tx_id", -F.col("commit_lsn"))
    all_ends = ends(tx).unionByName(beats.withColumn("data_collections", F.array().cast("array<struct<data_collection:string,event_count:int>>")))
    events = transactions.stamp_commit_lsn(arrived_events(fo, arrived), all_ends)
    return transactions.frontier(transactions.completeness(events, transactions.expected_counts(all_ends)))


@query(EVENTS + EXPECTED + ", front AS (SELECT commit_lsn FROM (SELECT commit_lsn, bool_and(complete) OVER (ORDER BY commit_lsn) AS ok FROM complete) WHERE ok) SELECT least((SELECT max(commit_lsn) FROM front), (SELECT max(commit_lsn) FROM fo)) AS commit_lsn", "fo", "arrived", "tx")
def tx_joint_frontier(fo, arrived, tx):
    events = transactions.stamp_commit_lsn(arrived_events(fo, arrived), ends(tx))
    return transactions.combined(transactions.frontier(transactions.completeness(events, transactions.expected_counts(ends(tx)))), fo.select("commit_lsn"))


@query("SELECT pos, id FROM fx1 WHERE id % 5 <> 0", "fx1")
def schema_include_filter(fx1):
    e = envelope.decode(wired(fx1, F.when(F.col("id") % 5 == 0, "audit").otherwise("inventory")), ROW)
    return envelope.include_schemas(e, ["inventory", "shipment"]).select("pos", envelope.event_key("id").alias("id"))


@query("SELECT pos, id, op = 'd' AS tombstone, CASE WHEN op <> 'd' THEN biography END AS biography FROM fx1", "fx1")
def unwrap_flatten(fx1):
    flat = envelope.flatten(envelope.decode(wired(fx1), ROW), "id", ["pos"])
    return flat.select("pos", "id", F.col("row").isNull().alias("tombstone"), F.col("row.biography").alias("biography"))


@query("SELECT pos, pos % 11 <> 0 AND pos % 13 <> 0 AS valid FROM fx1", "fx1")
def validity_split(fx1):
    """Broken envelopes and unknown ops are set apart."""
    broken = F.when(F.col("pos") % 11 == 0, "{broken").when(F.col("pos") % 13 == 0, F.regexp_replace("value", '"op":"."', '"op":"x"')).otherwise(F.col("value"))
    good, bad = envelope.split_valid(envelope.decode(wired(fx1).withColumn("value", broken), ROW))
    return good.select("pos", F.lit(True).alias("valid")).unionByName(bad.select("pos", F.lit(False).alias("valid")))


@query(f"SELECT pos, id, op, CASE WHEN op <> 'd' THEN biography END AS biography, op = 'd' AS gone FROM ({KEYED})", "fx1")
def backfill_in_envelope(fx1):
    e = envelope.decode(wired(fx1), ROW)
    out = backfill.backfill_envelope(e, ["biography"])
    return out.select("pos", envelope.event_key("id").alias("id"), "op", F.col("after.biography").alias("biography"), F.col("after").isNull().alias("gone"))


@query("SELECT pos, op, CASE WHEN op <> 'd' THEN biography END AS biography, pos * 1000 AS ts_ms FROM fx1", "fx1")
def variant_decode(fx1):
    v = envelope.decode_any(wired(fx1))
    get = lambda path, kind: F.try_variant_get("value", path, kind)
    return v.select("pos", get("$.op", "string").alias("op"), get("$.after.biography", "string").alias("biography"), get("$.ts_ms", "bigint").alias("ts_ms"))


@query("SELECT pos, op, CAST(pos * 10 AS VARCHAR) || ':' || CAST(pos * 100 AS VARCHAR) AS tx, hex(encode(CAST(id AS VARCHAR) || '-é')) AS bytes FROM fx1", "fx1")
def json_path_and_bytes(fx1):
    w = wired(fx1).join(fx1.select("pos", "id"), "pos")
    return w.select("pos", json_field(F.col("value"), "op").alias("op"), json_field(F.col("value"), "transaction.id").alias("tx"), F.hex(utf8(F.concat(F.col("id").cast("string"), F.lit("-é")))).alias("bytes"))


PRICE = "CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' ELSE CAST(o_orderkey AS {text}) || '.' || lpad(CAST(o_orderkey % 100 AS {text}), 2, '0') END"


@query(" SELECT o_orderkey, try_cast(" + PRICE.format(text="VARCHAR") + " AS DECIMAL(10, 2)) AS price FROM orders", "orders")
def decimal_from_text(orders):
    return orders.select("o_orderkey", money(F.expr(PRICE.format(text="STRING"))).alias("price"))


@query(" SELECT fl.id, fl.seq, greatest(fo.commit_lsn, fl.commit_lsn) AS commit_lsn FROM fo JOIN fl ON fl.order_id = fo.id WHERE fo.op = 'u' AND fo.seq = 1", "fo", "fl")
def pair_positions(fo, fl):
    o = fo.filter("op = 'u' and seq = 1").select(F.col("id").alias("order_id"), F.col("commit_lsn").alias("o_lsn"))
    return fl.join(o, "order_id").select("id", "seq", later(F.col("o_lsn"), F.col("commit_lsn")).alias("commit_lsn"))


@query(" SELECT o_orderkey, count(b.id) + 1 AS n, CAST(coalesce(sum(b.q), 0) AS BIGINT) + 7 AS total FROM orders LEFT JOIN base b ON b.order_id = o_orderkey AND b.id <> o_orderkey * 1000 + 1 GROUP BY 1", "orders", "base")
def line_map(orders, base):
    """Lines as a map by id, with an entry put and one removed."""
    n = txjoin.nested_left_join(orders, base, "o_orderkey", "order_id", ["id", "q"])
    m = map_remove(map_put(F.transform_values(lines_by_id(F.col("lines")), lambda _, x: x["q"]), F.lit(-1).cast("long"), F.lit(7.0)), F.col("o_orderkey").cast("long") * 1000 + 1)
    return n.select("o_orderkey", F.size(m).cast("long").alias("n"), F.aggregate(F.map_values(m), F.lit(0.0), lambda a, x: a + x).cast("long").alias("total"))


MOVED = "CASE WHEN id % 4 = 0 THEN order_id + 1 ELSE order_id END"


@query(f" SELECT id, 'd' AS op, 0 AS half, order_id AS parent FROM base WHERE id % 4 = 0 UNION ALL SELECT id, 'c', 1, order_id + 1 FROM base WHERE id % 4 = 0 UNION ALL SELECT id, 'u', 0, order_id FROM base WHERE id % 4 <> 0", "base")
def moved_lines(base):
    """Lines moved to another order leave the old one and come to the new one."""
    row = lambda parent: F.struct("id", parent.alias("order_id"))
    events = base.select("id", F.lit("u").alias("op"), row(F.col("order_id")).alias("before"), row(F.expr(MOVED)).alias("after"))
    return envelope.split_moved(events, "order_id").select("id", "op", "half", envelope.event_key("order_id").alias("parent"))


@query("SELECT id, pos, op, biography FROM fx1 QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos DESC) = 1", "fx1")
def upsert_last_of_batch(fx1):
    return changelog.last_of_batch(fx1, "id", "pos").select("id", "pos", "op", "biography")


@query(LABELLED + """, samples AS (SELECT event_id, metric, context, value FROM labelled UNION ALL SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'pg_wal_size_bytes' WHEN 1 THEN 'pg_replication_slots_pg_wal_lsn_diff' ELSE 'pg_replication_slot_safe_wal_size_bytes' END, '', value FROM raw)
 SELECT event_id, metric, value FROM samples WHERE metric IN ('pg_wal_size_bytes', 'pg_replication_slots_pg_wal_lsn_diff', 'pg_replication_slot_safe_wal_size_bytes', 'debezium_metrics_MilliSecondsBehindSource') OR (metric = 'debezium_metrics_TotalNumberOfEventsSeen' AND context = 'streaming')""", "raw")
def dashboard_series(raw):
    """The dashboard's panels, but for the activity panel, which is a minimum over time."""
    direct = raw.select("event_id", F.element_at(F.array(*[F.lit(x) for x in ("pg_wal_size_bytes", "pg_replication_slots_pg_wal_lsn_diff", "pg_replication_slot_safe_wal_size_bytes")]), (F.col("event_id") % 3 + 1).cast("int")).alias("metric"), F.create_map().cast("map<string,string>").alias("labels"), "value")
    samples = labelled(raw).select("event_id", "metric", "labels", "value").unionByName(direct)
    panels = [reporting.series(samples, m) for m in ("pg_wal_size_bytes", "pg_replication_slots_pg_wal_lsn_diff", "pg_replication_slot_safe_wal_size_bytes", "debezium_metrics_MilliSecondsBehindSource")]
    panels.append(reporting.series(samples, "debezium_metrics_TotalNumberOfEventsSeen", "context", "streaming"))
    return reduce(DataFrame.unionByName, panels).select("event_id", "metric", "value")


@query("SELECT i AS id, printf('CREATE TABLE inventory.t_%s (id SERIAL PRIMARY KEY, value VARCHAR(255))', lpad(CAST(i AS VARCHAR), 3, '0')) AS statement FROM range(1, 41) t(i)", "region")
def generated_ddl(region):
    return ddl(region.sparkSession, 40)
