"""Change logs derived from the test tables, in SQL that both engines run; {table} marks the inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Times are cut to days, so that many events of a key have the same one.
FX1 = """SELECT event_id AS pos, user_id AS id, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS ts,
  CASE WHEN event_type = 'signup' THEN 'c' WHEN event_type = 'error' THEN 'd' ELSE 'u' END AS op,
  CASE WHEN event_type NOT IN ('signup', 'error') AND event_id % 3 = 1 THEN '__debezium_unavailable_value'
       WHEN event_id % 7 = 0 THEN NULL ELSE props END AS biography
FROM {events}"""
# Each row's events come from one pass over it; n numbers them.
ORDERS = """SELECT o_orderkey AS id, 100 + o_orderkey * 10 + CASE n WHEN 0 THEN 0 WHEN 3 THEN 7 ELSE 3 END AS commit_lsn, CASE n WHEN 2 THEN 2 ELSE 1 END AS seq,
  CASE n WHEN 0 THEN 'c' WHEN 3 THEN 'd' ELSE 'u' END AS op, o_totalprice + CASE n WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS v
FROM {orders} CROSS JOIN (VALUES (0), (1), (2), (3)) AS k(n)
WHERE n = 0 OR (n = 1 AND o_orderkey % 2 = 0) OR (n = 2 AND o_orderkey % 6 = 0) OR (n = 3 AND o_orderkey % 10 = 0)"""
BASE = """SELECT l_orderkey AS order_id, l_quantity AS q, CAST(l_orderkey AS BIGINT) * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
  l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS id FROM {lineitem}"""
LINES = """SELECT order_id, id, 100 + order_id * 10 + CASE n WHEN 0 THEN 0 WHEN 3 THEN 6 ELSE 5 END AS commit_lsn, CASE n WHEN 2 THEN 2 ELSE 1 END AS seq,
  CASE n WHEN 0 THEN 'c' WHEN 3 THEN 'd' ELSE 'u' END AS op, q + CASE n WHEN 1 THEN 100 WHEN 2 THEN 200 ELSE 0 END AS q
FROM {base} CROSS JOIN (VALUES (0), (1), (2), (3)) AS k(n)
WHERE n = 0 OR (n = 1 AND id % 3 = 0) OR (n = 2 AND id % 9 = 0) OR (n = 3 AND id % 5 = 0)"""
TX = """SELECT commit_lsn, 5000000 - commit_lsn AS tx_id, CAST(SUM(o) AS BIGINT) AS n_orders, CAST(SUM(l) AS BIGINT) AS n_lines
FROM (SELECT commit_lsn, 1 AS o, 0 AS l FROM {fo} UNION ALL SELECT commit_lsn, 0, 1 FROM {fl}) e GROUP BY commit_lsn"""
ARRIVED = "SELECT * FROM {fl} WHERE NOT (commit_lsn >= 8000 AND id % 97 = 0)"
SLOTS = """SELECT * FROM (VALUES ('a', 'pgoutput', 'inventory', '16/B374D848', CAST(NULL AS STRING), true, CAST(53687091200 AS BIGINT)),
 ('b', 'pgoutput', 'inventory', '16/B3000000', NULL, false, 10485247), ('c', 'pgoutput', 'shipment', '15/FFFFFFFF', 'wal_removed', false, NULL),
 ('d', 'pgoutput', 'shipment', '16/B374D000', NULL, CAST(NULL AS BOOLEAN), 10239)) AS t(slot_name, plugin, db, restart_lsn, invalidation_reason, active, safe_wal_size)"""
# A name for each of the six rules, and one that no rule takes.
RAW = """SELECT event_id, ts, value, CASE event_id % 7
 WHEN 0 THEN 'kafka.connect<type=connect-worker-metrics>task-count:'
 WHEN 1 THEN 'kafka.connect<type=connect-metrics, client-id=c' || CAST(event_id % 3 AS STRING) || '><>request-rate'
 WHEN 2 THEN 'debezium.postgres<type=connector-metrics, context=snapshot, server=s' || CAST(event_id % 3 AS STRING) || ', key=inventory.authors><>RowsScanned'
 WHEN 3 THEN 'debezium.postgres<type=connector-metrics, server=s' || CAST(event_id % 3 AS STRING) || ', task=0, context=snapshot, database=db1>TotalNumberOfEventsSeen'
 WHEN 4 THEN 'debezium.mysql<type=connector-metrics, server=s' || CAST(event_id % 3 AS STRING) || ', task=1, context=streaming>TotalNumberOfEventsSeen'
 WHEN 5 THEN 'debezium.postgres<type=connector-metrics, context=streaming, server=s' || CAST(event_id % 3 AS STRING) || '>MilliSecondsBehindSource'
 ELSE 'java.lang<type=Memory>used' END AS raw FROM {events}"""

PARTS = {"fx1": FX1, "fo": ORDERS, "base": BASE, "fl": LINES, "tx": TX, "arrived": ARRIVED, "slots": SLOTS, "raw": RAW}
NEEDS = {"fx1": ("events",), "fo": ("orders",), "base": ("lineitem",), "fl": ("base",), "tx": ("fo", "fl"), "arrived": ("fl",), "slots": (), "raw": ("events",)}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture, or a table of ``sf_dir``."""
    if name not in PARTS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(PARTS[name], **{n: load(spark, sf_dir, n) for n in NEEDS[name]}) if NEEDS[name] else spark.sql(PARTS[name])


def with_sql(*names: str) -> str:
    """The WITH clause that defines fixtures for the other engine."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in PARTS and name not in done:
            for n in NEEDS[name]:
                add(n)
            done[name] = PARTS[name].format(**{n: n for n in NEEDS[name]}).replace("AS STRING", "AS VARCHAR")

    for name in names:
        add(name)
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in done.items()) + " "
