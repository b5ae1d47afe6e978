"""Replication reporting: slots, metric names and metric series."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamloom.functions.expressions import full_match, lsn_number, size_pretty

#: Ordered rules (pattern, name, labels); $n is the n-th group, the first rule that matches counts.
RULES = (
    (r"kafka.connect<type=connect-worker-metrics>([^:]+):", "kafka_connect_worker_metrics_$1", {}),
    (r"kafka.connect<type=connect-metrics, client-id=([^:]+)><>([^:]+)", "kafka_connect_metrics_$2", {"client": "$1"}),
    (r"debezium.([^:]+)<type=connector-metrics, context=([^,]+), server=([^,]+), key=([^>]+)><>RowsScanned", "debezium_metrics_RowsScanned", {"plugin": "$1", "name": "$3", "context": "$2", "table": "$4"}),
    (r"debezium.([^:]+)<type=connector-metrics, server=([^,]+), task=([^,]+), context=([^,]+), database=([^>]+)>([^:]+)", "debezium_metrics_$6", {"plugin": "$1", "name": "$2", "task": "$3", "context": "$4", "database": "$5"}),
    (r"debezium.([^:]+)<type=connector-metrics, server=([^,]+), task=([^,]+), context=([^>]+)>([^:]+)", "debezium_metrics_$5", {"plugin": "$1", "name": "$2", "task": "$3", "context": "$4"}),
    (r"debezium.([^:]+)<type=connector-metrics, context=([^,]+), server=([^>]+)>([^:]+)", "debezium_metrics_$4", {"plugin": "$1", "name": "$3", "context": "$2"}),
)


def slot_status(slots: DataFrame) -> DataFrame:
    status = F.when(F.col("invalidation_reason").isNotNull(), "invalid").when(F.coalesce("active", F.lit(False)), "active").otherwise("inactive")
    return slots.withColumn("status", status)


def slot_lag(slots: DataFrame, current_lsn: str) -> DataFrame:
    """Retained log bytes of each slot up to ``current_lsn``, plain and with a unit, and the safe size with a unit."""
    lag = lsn_number(F.lit(current_lsn)) - lsn_number(F.col("restart_lsn"))
    return slots.withColumn("retained_bytes", lag).withColumn("retained_wal", size_pretty(F.col("retained_bytes"))).withColumn("safe_wal", size_pretty(F.col("safe_wal_size")))


def relabel(metrics: DataFrame, raw: str, rules: tuple = RULES) -> DataFrame:
    """metric and labels by the first rule that matches; names that no rule matches go.

    Names are few against samples: each distinct one is matched once, with all groups of its rule in one replacement.
    """
    mark = "\x01"

    def filled(template: str) -> Column:
        parts = re.split(r"\$(\d+)", template)
        return F.concat(*[F.element_at("_groups", int(p)) if i % 2 else F.lit(p) for i, p in enumerate(parts)])

    names = metrics.select(F.col(raw).alias("_raw")).distinct()
    rule = F.coalesce(*[F.when(F.col("_raw").rlike(pattern), F.lit(i)) for i, (pattern, _, _) in enumerate(rules)])
    names = names.withColumn("_rule", rule).filter("_rule is not null")
    groups, hits = F.lit(None), F.lit(None)
    for i, (pattern, name, labels) in reversed(list(enumerate(rules))):
        all_groups = mark.join(f"${k + 1}" for k in range(re.compile(pattern).groups))
        groups = F.when(F.col("_rule") == i, F.split(F.regexp_replace("_raw", f"(?s)^.*?{pattern}.*$", all_groups), mark)).otherwise(groups)
        entries = [x for k, v in labels.items() for x in (F.lit(k), filled(v))]
        made = F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")
        hits = F.when(F.col("_rule") == i, F.struct(filled(name).alias("metric"), made.alias("labels"))).otherwise(hits)
    # Generators keep the optimiser from copying the patterns into every use of the columns.
    names = names.select("_raw", "_rule", F.explode(F.array(groups)).alias("_groups"))
    names = names.select("_raw", F.explode(F.array(hits)).alias("_hit")).select("_raw", "_hit.metric", "_hit.labels")
    return metrics.join(names, F.col(raw) == F.col("_raw")).drop("_raw")


def where_label(samples: DataFrame, label: str, pattern: str) -> DataFrame:
    return samples.filter(full_match(F.coalesce(F.col("labels")[label], F.lit("")), [pattern]))


def min_over_time(samples: DataFrame, by: list[str], step: str = "1 minute") -> DataFrame:
    return samples.groupBy(*by, F.window("ts", step).alias("w")).agg(F.min("value").alias("value")).select(*by, F.col("w.start").alias("bucket"), "value")


def series(samples: DataFrame, metric: str, label: str | None = None, pattern: str | None = None) -> DataFrame:
    """A dashboard panel: the samples of one metric, where wanted those with a matching label."""
    own = samples.filter(F.col("metric") == metric)
    return own if label is None else where_label(own, label, pattern)


def activity(value: Column) -> Column:
    return F.when(value == 1, "Active").when(value == 0, "Inactive")
