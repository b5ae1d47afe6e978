"""Cases from a review: each would have failed before the finding was settled."""

import numpy as np

from streamloom.llm import ann, decontaminate, lm_score, secret_scan, url_filter


def test_neighbours_beyond_the_probed_shards(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 50)  # 100 shards, of which a query visits PROBES
    n, rng = 5000, np.random.default_rng(5)
    v = rng.standard_normal((n, 64))
    got = ann.nearest(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>"), 100).collect()
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    true = {(q, int(i)) for q in range(0, n, 100) for i in np.argsort(-np.where(np.arange(n) == q, -9, v @ v[q]))[:5]}
    assert len({(r["query_id"], r["vec_id"]) for r in got} & true) >= 0.9 * len(true)


def test_tree_blocks_a_url_without_a_rule(spark):
    rules = tuple(("bets.example.com", f"/{p}/", "block") for p in "abc") + (("example.com", "/de/", "block"), ("good.org", "/", "allow"))
    urls = [f"http://bets.example.com/{p}/{i}" for p in "abc" for i in range(20)] + ["http://bets.example.com/d/1"]
    urls += [f"http://www.example.com/de/{i}" for i in range(30)] + [f"http://www.example.com/fr/{i}" for i in range(40)] + [f"http://good.org/{i}" for i in range(90)]
    got = {r["host"] + r["path"]: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    assert got["bets.example.com/d/1"]["rule"] is None and got["bets.example.com/d/1"]["verdict"] == "block"
    assert {got[f"www.example.com/fr/{i}"]["verdict"] for i in range(40)} == {"allow"}  # the rule for /de/ labels that path only


def test_keys_after_a_name_and_in_paths():
    for key, text in (("9f8A2kLmQ0zXc7VbN4tYpR6wEuJ1sHdG", "auth={}"), ("wJalrXUtnF3MIK7MDENGbPxRf1CYz8Q4hT2k", "AWS_SECRET_ACCESS_KEY={}"), ("9f8A2kLmQ0zXc7VbN4tYpR6wEuJ1sHdG", "/home/some-user/my_data/{}/x")):
        line = "a plain line of words before " + text.format(key) + " and after it"
        assert [(line[a:b], k) for a, b, k in secret_scan.scan(line)] == [(key, "random")]


def test_contexts_reach_over_white_space():
    a, b, alone = (lm_score.contexts_of(*lm_score.joined([t])) for t in (b"red apple ", b"sky apple ", b"apple "))
    names = list(lm_score.CONTEXTS)
    unit, pair, two = names.index("unit"), names.index("pair"), names.index(2)
    assert (a[unit][4:] == b[unit][4:]).all() and (a[unit][4:] == alone[unit]).all()
    assert (a[pair][4:-1] != b[pair][4:-1]).all() and (a[two][4:] != alone[two]).any()


def test_items_that_share_an_id(spark):
    a = "the slow river carried old wooden boats past quiet villages while children waved from every bridge"
    b = "seven bakers argued about flour and butter until somebody finally opened the heavy oven door again"
    bench = spark.createDataFrame([(1, a), (1, b), (None, a + " once more"), (None, b + " and left")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"before it {a} after"), (2, f"before it {b} after"), (3, "nothing of this kind is found in a text like the present one at all")], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["share"]) for r in decontaminate.contamination(docs, bench).collect()}
    assert {(1, 1, 1.0), (2, 1, 1.0)} <= got and {d for d, i, _ in got if i is None} == {1, 2} and not any(d == 3 for d, _, _ in got)
