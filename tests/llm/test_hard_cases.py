"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns; and against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from streamloom.llm import ann, decontaminate, language_id, lm_score, near_dedup, packing, quality, secret_scan, token_counts, url_filter
from streamloom.llm.common import release, shared_folder, written

KEY = "9f8A2kLmQ0zXc7VbN4tYpR6wEuJ1sHdG"
#: Columns named like those that the operators add or use.
EXTRA = "score string, lang_pred string, held_out string, train string, chunk string, row string, print string, words string, label string, host string, n_tokens string"


def texts():
    prose = "the old man walked slowly along the river and thought about the long winter"
    return [None, "", " ", prose, prose, prose.upper(), f"token: {KEY} {prose}", (prose + " ") * 4000, "x" * 70_000, "ž" * 50, "\x00\x1c 😀 é"]


@pytest.fixture(scope="module")
def docs(spark):
    n = len(texts())
    rows = [(i if i != n - 3 else None, t, "en" if i % 2 else None, *["z"] * 11) for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, *rows], f"doc_id long, text string, lang string, {EXTRA}").repartition(3)


OPERATORS = {
    "language": lambda d: language_id.identify(d, d.filter("lang is not null")),
    "secrets": lambda d: secret_scan.digest(d),
    "quality": lambda d: quality.quality(d.withColumn("held_out", F.lit(False)), 0.5),
    "lm": lambda d: lm_score.score(d, F.lit(True)),
    "near": lambda d: near_dedup.near_duplicates(d),
    "tokens": lambda d: token_counts.token_counts(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_result_a_row(docs, name):
    """Repeated rows get one result each, and the same."""
    got = OPERATORS[name](docs)
    rows = got.collect()
    assert Counter(r["doc_id"] for r in rows) == Counter({i: 2 for i in [*range(8), None, 9, 10]})
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], set()).add(str(r))
    assert all(len(x) == 1 for x in by.values())
    assert OPERATORS[name](docs.limit(0)).count() == 0


def test_packing_of_the_same_rows(docs):
    rows = packing.pack(docs).collect()
    want = docs.count()
    assert sum(r["start"] == 0 for r in rows) == want and packing.pack(docs.limit(0)).count() == 0
    assert {r["doc_tokens"] for r in rows if r["doc_id"] in (0, 1)} == {1}


def test_ties(spark):
    """Equal languages, nearest vectors, shares and sketches are told apart by name or id."""
    two = spark.createDataFrame([(1, "abc abc", "b"), (2, "abc abc", "a")], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language_id.identify(two, two).collect()} == {"a"}
    same = spark.createDataFrame([(i, [1.0, 0.0] if i else [1.0, 1.0]) for i in range(9)], "vec_id long, embedding array<double>")
    got = [(r["rank"], r["vec_id"]) for r in ann.nearest(same, 50).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)]
    assert [b for _, b in zip(range(3), packing.TierPacker(0, (4, 2)).sizes, strict=False)] == [4, 2]


def test_vectors_of_any_size(spark):
    """Very large and very small components neither overflow nor vanish; clashing columns do no harm."""
    rng = np.random.default_rng(2)
    v = rng.standard_normal((60, 8))
    scale = np.array([1e-200, 1e200, 1.0, 1e-310, 1e300])[np.arange(60) % 5]
    rows = [(i, (x * s).tolist(), "a", "b") for i, (x, s) in enumerate(zip(v, scale, strict=True))] + [(100, [0.0] * 8, "a", "b"), (150, None, "a", "b"), (200, [float("inf")] + [1.0] * 7, "a", "b")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node string, vec string")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in ann.nearest(table, 50).collect()}
    u = np.array([x for _, x, *_ in rows[:60]]) / scale[:, None]
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for q in (0, 50):
        s = u @ u[q]
        s[q] = -9
        for k, i in enumerate(np.argsort(-s)[:5], 1):
            assert got[(q, k)][0] == i and math.isclose(got[(q, k)][1], s[i], rel_tol=1e-9)
    assert len(got) == 10 and ann.nearest(table.limit(0), 50).count() == 0


def test_base_patterns_by_hand():
    """The three patterns, character by character, on random texts."""
    rng = random.Random(3)
    parts = ["password", "PassWD", "secret", "token", "api_key", "ApiKey", "api", "=", ":", " ", "'", '"', "abc123", "AKIA", "AKIA" + "Z9" * 8, "0af3" * 6, "x", "\n", "-", ".", "ſecret", "K", "é"]
    tail = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")

    def assigns(t):
        out, at = [], 0
        low = "".join(c.lower() if c.isascii() else "\x00" for c in t)
        while at < len(t):
            word = next((w for w in ("password", "passwd", "secret", "token", "api_key", "apikey") if low.startswith(w, at)), None)
            k = at + len(word) if word else at
            if word and k < len(t) and t[k] in "\"'":
                k += 1
            while word and k < len(t) and t[k] == " ":
                k += 1
            if not word or k >= len(t) or t[k] not in ":=":
                at += 1
                continue
            k += 1
            while k < len(t) and t[k] == " ":
                k += 1
            if k < len(t) and t[k] in "\"'":
                k += 1
            end = k
            while end < len(t) and t[end] in tail:
                end += 1
            if end == k:
                at += 1
                continue
            if end - k >= 6:
                out.append((at, end, "assign"))
            at = end
        return out

    def runs(t, kind, allowed, least, start=""):
        out, at = [], 0
        while at < len(t):
            if t.startswith(start, at) and (start or t[at] in allowed):
                end = at + len(start)
                while end < len(t) and t[end] in allowed:
                    end += 1
                if end > at + len(start):
                    out += [(at, end, kind)] if end - at >= least else []
                    at = end
                    continue
            at += 1
        return out

    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        want = assigns(t) + runs(t, "access", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 20, "AKIA") + runs(t, "hex", set("0123456789abcdef"), 24)
        want = sorted(want, key=lambda s: (s[0], secret_scan.KINDS.index(s[2])))
        got = [s for s in secret_scan.scan(t) if s[2] != "random"]
        assert got == want, t
        assert secret_scan.base_sha256(got) == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in want).encode()).hexdigest()


def test_keys_of_letters_and_in_paths():
    letters = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", k=40))
    for key, text in ((letters, "{}"), (KEY, "https://h.example/path/{}"), (KEY, "a/{}_b"), (KEY[:19], "PRIVATE_KEY={}")):
        line = "a plain line of words before " + text.format(key) + " and after it"
        assert (line.index(key), line.index(key) + len(key), "random") in secret_scan.scan(line)
    assert not secret_scan.scan("AbstractSingletonProxyFactoryBean rechtsschutzversicherungsgesellschaften internationalization")


def test_urls_of_all_depths(spark):
    """A rule below the fourth segment judges only what it fits; repeated, null and clashing rows stay."""
    rules = (("a.com", "/x/y/z/bad/", "block"),)
    urls = ["http://a.com/x/y/z/bad/1", "http://a.com/x/y/z/good/q", "http://b.a.com/x/y/z/q", None, "http://a.com/x/y/z/bad/1", "http://a.co.uk/" + "s/" * 300]
    pages = spark.createDataFrame([(i % 5, u, "h", "p", "t") for i, u in enumerate(urls)], "page_id long, url string, host string, path string, template string")
    got = url_filter.judge(pages, rules).collect()
    verdict = {r["path"]: r["verdict"] for r in got}
    assert len(got) == 6 and verdict["/x/y/z/bad/1"] == "block" and Counter(r["verdict"] for r in got) == {"block": 2, "allow": 4}
    assert url_filter.judge(pages.limit(0), rules).count() == 0 and {r["verdict"] for r in url_filter.judge(pages, ()[:0] or (("none", "/", "block"),)).collect()} == {"allow"}


def test_contamination_on_clashing_and_repeated_rows(spark):
    item = "we counted seven red boats and nine blue ones before the storm came over the old harbour"
    bench = spark.createDataFrame([(1, item, "a"), (1, item, "a"), (2, "", "a"), (3, None, "a")], "item_id long, text string, words string")
    docs = spark.createDataFrame([(1, "x " * 5000 + item, "r"), (1, "x " * 5000 + item, "r"), (None, item, "r"), (2, None, "r"), (3, "", "r")], "doc_id long, text string, row string")
    got = [(r["doc_id"], r["item_id"], r["share"]) for r in decontaminate.contamination(docs, bench).collect()]
    assert sorted(got, key=str) == [(1, 1, 1.0), (None, 1, 1.0)]


def test_quality_samples_whole_documents(spark, monkeypatch):
    """The sample's bound in passages leaves long documents out of training, never cuts them; repeated rows count once."""
    monkeypatch.setattr(quality, "MOST", 40)
    docs = spark.createDataFrame([(i, ("good words here " if i % 2 else "#!| %% 00 ") * (10 if i else 20_000)) for i in range(40)] * 2, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    model = quality.train(docs, labels)
    got = quality.quality(docs.withColumn("held_out", F.lit(False)), model)
    assert got.filter("predicted = doc_id % 2").count() >= 76


def test_tables_in_the_shared_folder(spark):
    out = written(spark.range(3))
    assert out.count() == 3 and re.search("table-", out.inputFiles()[0]) and shared_folder(spark)
    release(spark)
    release(spark)
