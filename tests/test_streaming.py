"""Streams give what the batch operators give, however the input is split, and after a restart."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from streamloom.operators import backfill, changelog, transactions, txjoin
from streamloom.plans.fixtures import load
from streamloom.sources.connectors import ddl, files, generate, slots, to_callback, to_console, to_table
from streamloom.streaming.processors import backfill_batches, backfill_stream, configure, normalize_stream, order_stream, upsert_stream

SF = "/root/testdata/sf0.001"
ROW = "tx_id long, order_id long, id long, seq long, op string, v double"
END = "tx_id long, commit_lsn long, data_collections array<struct<data_collection:string,event_count:int>>"


def put(folder, parts, start=0):
    os.makedirs(folder, exist_ok=True)
    for i, rows in enumerate(parts, start):
        p = f"{folder}/{i:03d}.json"
        with open(p, "w") as f:
            f.writelines(json.dumps(r) + "\n" for r in rows)
        os.utime(p, (1_000_000 + i, 1_000_000 + i))


def run(df, tmp, out="out"):
    q = to_table(df, f"{tmp}/{out}", f"{tmp}/checkpoint-{out}")
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def order(tx, i, op, v, seq=0):
    return {"tx_id": tx, "order_id": i, "id": i, "seq": seq, "op": op, "v": v}


def line(tx, i, k, op, v, seq=1):
    return {"tx_id": tx, "order_id": i, "id": k, "seq": seq, "op": op, "v": v}


def end(tx, lsn, orders, lines):
    return {"tx_id": tx, "commit_lsn": lsn, "data_collections": [{"data_collection": "orders", "event_count": orders}, {"data_collection": "lines", "event_count": lines}]}


def split(rows, n, rng):
    """n parts in order, cut at random places."""
    cuts = [0, *sorted(rng.randrange(len(rows) + 1) for _ in range(n - 1)), len(rows)]
    return [rows[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def streamed(spark, tmp, orders, lines, ends, how="inner", again=False):
    """orders, lines, ends: parts, one a micro-batch. ``again``: stopped half way and started anew from its checkpoint."""
    one = lambda d, s: files(spark, f"{tmp}/{d}", s, per_batch=1)
    halves = [(0, len(orders) // 2), (len(orders) // 2, len(orders))] if again else [(0, len(orders))]
    for lo, hi in halves:
        for name, parts in (("o", orders), ("l", lines), ("e", ends)):
            put(f"{tmp}/{name}", parts[lo:hi], lo)
        run(order_stream(one("o", ROW), one("l", ROW), one("e", END), how), tmp)
    got = spark.read.parquet(f"{tmp}/out").select("order_id", "commit_lsn", "deleted", "v", "n_lines", "lines").collect()
    return sorted(tuple(r) for r in got)


def batched(spark, orders, lines, ends, how="inner"):
    """The same by the batch operators: position by END, completeness, frontier, nesting."""
    ends = spark.createDataFrame([(e["tx_id"], e["commit_lsn"], [tuple(c.values()) for c in e["data_collections"]]) for e in ends], END)
    o, n = (transactions.stamp_commit_lsn(spark.createDataFrame([tuple(r.values()) for r in rows], ROW), ends) for rows in (orders, lines))
    tracked = o.withColumn("tbl", F.lit("orders")).unionByName(n.withColumn("tbl", F.lit("lines"))).filter("commit_lsn > 0")
    released = transactions.frontier(transactions.completeness(tracked, transactions.expected_counts(ends)))
    allowed = released.unionByName(spark.range(1).select(F.lit(0).cast("long").alias("commit_lsn")))
    o, n = o.join(allowed, "commit_lsn", "left_semi"), n.join(allowed, "commit_lsn", "left_semi").withColumnRenamed("v", "q")
    got = txjoin.nested(o, n, ["v"], ["q"], how)
    flat = F.concat_ws(",", F.transform("lines", lambda x: F.concat_ws("=", x["id"], x["q"].cast("long"))))
    return sorted(tuple(r) for r in got.select("order_id", "commit_lsn", "deleted", "v", F.size("lines"), flat).collect())


def both(spark, tmp, orders, lines, ends, how="inner"):
    flat = lambda parts: [r for p in parts for r in p]
    got = streamed(spark, tmp, orders, lines, ends, how)
    assert got == batched(spark, flat(orders), flat(lines), flat(ends), how)
    return [(r[0], r[1], r[2], r[4], r[5]) for r in sorted(got, key=lambda r: r[1])]


@pytest.mark.parametrize("n", [1, 3])
def test_backfill_stream(spark, tmp_path, n):
    """Two columns, filled each for itself."""
    configure(spark)
    fx1 = load(spark, SF, "fx1").select("pos", "id", "op", "biography").filter("id < 20")
    fx1 = fx1.withColumn("motto", F.when((F.col("op") == "u") & (F.col("pos") % 2 == 0), backfill.UNAVAILABLE).otherwise(F.concat(F.lit("m"), "pos")))
    rows = sorted((r.asDict() for r in fx1.collect()), key=lambda r: r["pos"])
    put(f"{tmp_path}/in", [rows[i * len(rows) // n : (i + 1) * len(rows) // n] for i in range(n)])
    events = files(spark, f"{tmp_path}/in", "pos long, id long, op string, biography string, motto string", per_batch=1)
    run(backfill_stream(events, ["biography", "motto"]), tmp_path)
    got = spark.read.parquet(f"{tmp_path}/out").select(fx1.columns)
    want = backfill.backfill_keyed(fx1, ["biography", "motto"]).select(fx1.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count()


@pytest.mark.parametrize("upsert", [False, True])
def test_normalized_streams(spark, tmp_path, upsert):
    configure(spark)
    fx1 = load(spark, SF, "fx1").select("pos", "id", F.when(F.col("biography").isNull() & upsert, "d").when(F.lit(upsert), "u").otherwise(F.col("op")).alias("op"), "biography").filter("id < 20")
    rows = sorted((r.asDict() for r in fx1.collect()), key=lambda r: r["pos"])
    put(f"{tmp_path}/in", [rows[: len(rows) // 3], rows[len(rows) // 3 :]])
    events = files(spark, f"{tmp_path}/in", "pos long, id long, op string, biography string", per_batch=1)
    run(upsert_stream(events.drop("op"), "id", "biography") if upsert else normalize_stream(events, "id", "biography"), tmp_path)
    got = spark.read.parquet(f"{tmp_path}/out").select("id", "pos", "op", "before", "after")
    want = changelog.normalize(fx1, "id", "biography").select("id", "pos", "op", "before", "after")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count()


def test_window_backfill_of_batches(spark, tmp_path):
    rows = [{"pos": 1, "id": 1, "op": "c", "ts": "2024-01-01T00:00:00", "b": "x"}, {"pos": 2, "id": 1, "op": "u", "ts": "2024-01-02T00:00:00", "b": backfill.UNAVAILABLE}]
    put(f"{tmp_path}/in", [rows])
    q = backfill_batches(files(spark, f"{tmp_path}/in", "pos long, id long, op string, ts timestamp, b string"), f"{tmp_path}/out", f"{tmp_path}/c", "b")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert [r["b"] for r in spark.read.parquet(f"{tmp_path}/out").orderBy("pos").collect()] == ["x", "x"]


def test_window_backfill_on_ties(spark):
    """Of two events of one time, the first doesn't see the second; what is older than the interval doesn't count."""
    u = backfill.UNAVAILABLE
    rows = [(1, 1, "u", "2024-01-01", u), (2, 1, "u", "2024-01-01", "later"), (3, 1, "u", "2024-01-01", u), (4, 1, "u", "2024-01-31", u), (5, 1, "u", "2024-02-01", u), (6, 1, "d", "2024-02-01", u)]
    events = spark.createDataFrame(rows, "pos int, id int, op string, ts string, b string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = [r["b"] for r in backfill.backfill_over(events, "b").orderBy("pos").collect()]
    assert got == [None, "later", "later", "later", None, u]


def test_join(spark, tmp_path):
    """E1: an order with two lines; an update and a third line; the first two lines go."""
    got = both(spark, tmp_path, [[order(1, 1, "c", 10.0)], [order(2, 1, "u", 11.0)], []], [[line(1, 1, 11, "c", 1.0), line(1, 1, 12, "c", 2.0, 2)], [line(2, 1, 13, "c", 3.0)], [line(3, 1, 11, "d", 1.0), line(3, 1, 12, "d", 2.0, 2)]], [[end(1, 100, 1, 2)], [end(2, 110, 1, 1)], [end(3, 120, 0, 2)]])
    assert got == [(1, 100, False, 2, "11=1,12=2"), (1, 110, False, 3, "11=1,12=2,13=3"), (1, 120, False, 1, "13=3")]


def test_orders_interleaved_and_deleted(spark, tmp_path):
    """E2, E4: B commits first though A began first; a later transaction deletes A; nothing partial is ever seen."""
    got = both(spark, tmp_path, [[order(9, 1, "c", 10.0)], [order(8, 2, "c", 20.0)], [order(7, 1, "d", 10.0, 5)]], [[line(9, 1, 11, "c", 1.0)], [line(8, 2, 21, "c", 2.0), line(9, 1, 12, "c", 3.0)], [line(7, 1, 11, "d", 1.0), line(7, 1, 12, "d", 3.0, 2)]], [[], [end(8, 100, 1, 1), end(9, 110, 1, 2)], [end(7, 120, 1, 2)]])
    assert got == [(2, 100, False, 1, "21=2"), (1, 110, False, 2, "11=1,12=3"), (1, 120, True, 0, "")]


def test_accumulating_lines(spark, tmp_path):
    """E3: five transactions give five results: 3, 3, 8, 13 and 18 lines."""
    lines = [[line(t, 1, k, "c", 1.0, k) for k in range(a, b)] for t, a, b in ((1, 0, 3), (2, 3, 3), (3, 3, 8), (4, 8, 13), (5, 13, 18))]
    orders = [[order(1, 1, "c", 1.0)], [order(2, 1, "u", 2.0)], [], [], []]
    ends = [[end(t, 90 + 10 * t, len(orders[t - 1]), len(lines[t - 1]))] for t in range(1, 6)]
    assert [r[3] for r in both(spark, tmp_path, orders, lines, ends)] == [3, 3, 8, 13, 18]


def test_untracked_recreated_and_missing(spark, tmp_path):
    """Snapshot rows come at once; an order created anew has its lines; a repeated event of one table doesn't stand for a missing one of the other."""
    orders = [[order(None, 5, "r", 50.0), order(1, 1, "c", 10.0)], [order(2, 1, "d", 10.0), order(3, 1, "c", 12.0)], [order(4, 1, "u", 13.0), order(4, 1, "u", 13.0)]]
    lines = [[line(None, 5, 51, "r", 5.0), line(1, 1, 11, "c", 1.0)], [], []]
    ends = [[end(1, 100, 1, 1)], [end(2, 110, 1, 0), end(3, 120, 1, 0)], [end(4, 130, 1, 1)]]
    got = both(spark, tmp_path, orders, lines, ends)
    assert got == [(5, 0, False, 1, "51=5"), (1, 100, False, 1, "11=1"), (1, 110, True, 0, ""), (1, 120, False, 1, "11=1")]


def log(seed):
    """Transactions over a few orders, in commit order, with the events of each table."""
    rng = random.Random(seed)
    orders, lines, ends = [], [], []
    for t in range(1, 15):
        own_o, own_l, tx = [], [], 100 - t
        for seq in range(rng.randrange(0, 5)):
            i = rng.randrange(1, 4)
            if rng.random() < 0.4:
                own_o.append(order(tx, i, rng.choice("cuud"), float(rng.randrange(100)), seq))
            else:
                own_l.append(line(tx, i, 10 * i + rng.randrange(3), rng.choice("cuud"), float(rng.randrange(100)), seq))
        orders, lines = orders + own_o, lines + own_l
        ends.append(end(tx, 10 * t, len(own_o), len(own_l)))
    return rng, orders, lines, ends


@pytest.mark.parametrize("seed, how", [(1, "inner"), (2, "left")])
def test_random_arrival(spark, tmp_path, seed, how):
    """Any split into micro-batches and any order within a topic's transactions, with a restart half way."""
    rng, orders, lines, ends = log(seed)
    want = batched(spark, orders, lines, ends, how)
    rng.shuffle(orders)
    rng.shuffle(lines)
    got = streamed(spark, tmp_path, split(orders, 4, rng), split(lines, 4, rng), split(ends, 4, rng), how, again=True)
    assert got == want and want


def test_lines_moved_to_another_order(spark):
    events = spark.createDataFrame([("u", (1, 7), (1, 8)), ("u", (2, 7), (2, 7)), ("c", None, (3, 9)), ("d", (4, 9), None)], "op string, before struct<id:int,order_id:int>, after struct<id:int,order_id:int>")
    from streamloom.operators import envelope

    got = envelope.split_moved(events, "order_id").select(envelope.event_key("id").alias("id"), "op", envelope.event_key("order_id").alias("o")).collect()
    assert sorted(tuple(r) for r in got) == [(1, "c", 8), (1, "d", 7), (2, "u", 7), (3, "c", 9), (4, "d", 9)]


def test_unknown_lines_are_counted(spark):
    orders = spark.createDataFrame([(1,)], "id long")
    lines = spark.createDataFrame([(1, 1), (2, 2), (2, 3)], "order_id long, id long")
    assert txjoin.unmatched_lines(orders, lines).first()["n"] == 2


def test_sinks_and_sources(spark, tmp_path, capfd):
    put(f"{tmp_path}/in", [[{"id": 1}], [{"id": 2}]])
    seen = []
    for start in (lambda df: to_callback(df, lambda b, i: seen.append((i, b.count())), f"{tmp_path}/c1"), lambda df: to_console(df, f"{tmp_path}/c2")):
        q = start(files(spark, f"{tmp_path}/in", "id long", per_batch=1))
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    assert seen == [(0, 1), (1, 1)]
    to_console(spark.range(1))
    assert generate(spark, 3).filter("length(text) = 32").count() == 3 and ddl(spark, 2).count() == 2
    upserts = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (2, 3, "b")], "id int, pos int, value string")
    assert [tuple(r) for r in changelog.materialize(upserts, "id").collect()] == [(2, "b")]
    assert callable(slots)
