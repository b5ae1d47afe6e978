"""The operators against brute force, and on nulls, empty texts, repeats, empty tables and clashing columns."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from streamloom.llm import ann, decontaminate, language_id, lm_score, near_dedup, packing, quality, secret_scan, token_counts, url_filter
from streamloom.llm.common import FEW_PARTS, added_blocks, is_bucket

SF = "/root/testdata/sf0.001"
KEY = "9f8A2kLmQ0zXc7VbN4tYpR6wEuJ1sHdG"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, spans string"


@pytest.fixture(scope="module")
def docs(spark):
    """A part of the small table with the hard cases added."""
    own = spark.read.parquet(f"{SF}/documents.parquet").limit(60).withColumn("spans", F.lit("x"))
    hard = [(9001, None, "en", None, None, None), (9002, "", None, "s", 0, None), (None, "a b c d e f g", "en", "s", 13, None), (9003, " \n <|endoftext|> x\x1fy  z ", "en", "s", 1, None), (9004, "same same", "fr", "s", 9, None), (9004, "same same", "fr", "s", 9, None), (9005, "12 34 %%", "en", "s", 8, None)]
    return own.unionByName(spark.createDataFrame(hard, COLUMNS)).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


def rows_of(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def test_token_counts(docs, none):
    import public_tokenizers

    t = token_counts.tokenizer(public_tokenizers.path(token_counts.VOCABULARY))
    want = sorted((str(i), len(x.encode()), len(t.encode(x, add_special_tokens=False).ids)) for i, x in rows_of(docs))
    assert want == sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in token_counts.token_counts(docs).collect())
    assert token_counts.token_counts(none).count() == 0


def test_packing_round_trip(docs, none):
    import public_tokenizers

    t = packing.tokenizer(public_tokenizers.path(packing.VOCABULARY))
    want = Counter((i, zlib.crc32(np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4").tobytes())) for i, x in rows_of(docs))
    pieces = packing.pack(docs).collect()
    assert sum(r["length"] for r in pieces) == sum(len(t.encode(x, add_special_tokens=False).ids) + 1 for _, x in rows_of(docs))
    whole = Counter((r["doc_id"], r["ids_crc32"]) for r in pieces if r["length"] == r["doc_tokens"])
    assert not whole - want
    for _, own in itertools.groupby(sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        own = list(own)
        assert [r["offset"] for r in own] == [sum(r["length"] for r in own[:i]) for i in range(len(own))]
        assert sum(r["length"] for r in own) == own[0]["tier"] <= 1024 and own[0]["tier"] & (own[0]["tier"] - 1) == 0
    assert packing.pack(none).count() == 0


def test_language(docs, none):
    found = {r["doc_id"]: r for r in language_id.identify(docs.withColumn("score", F.lit(1)), docs.filter("lang is not null")).collect()}
    assert found[9001]["lang_pred"] == found[9002]["lang_pred"] == found[9005]["lang_pred"] == "und"
    own = [r for r in found.values() if r["doc_id"] is not None and r["doc_id"] < 9000]
    assert np.mean([r["lang_pred"] == r["lang"] for r in own]) > 0.95
    assert language_id.identify(none, docs).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(docs, none).collect()} == {"und"}


def test_secrets(spark, docs):
    text = f'x password: "{KEY}" and {KEY} AKIA{"A1B2" * 4} then {"0a1b2c3d" * 3} plain words only'
    spans = secret_scan.scan(text)
    assert [k for _, _, k in spans if k != "random"] == ["assign", "access", "hex"]
    assert any(text[a:b] == KEY and k == "random" for a, b, k in spans)
    assert secret_scan.scan("the quickbrownfoxjumpsoverthelazydog12 sat") == []
    assert secret_scan.scan("password=token=ab1") == [(0, 18, "assign")]
    got = secret_scan.digest(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r["n_assign"] >= 0
    by = {r["doc_id"]: r for r in got}
    for i, x in rows_of(docs):
        if i is not None:
            base = [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", x) if m.end() - m.start() >= 24]
            assert by[i]["n_hex"] == len(base) and by[i]["base_sha256"] == secret_scan.base_sha256(secret_scan.scan(x))


def test_quality(spark, docs, none):
    every = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = is_bucket("doc_id", 5, 0)
    model = quality.train(every.filter(~held), labels.filter(~held).select("doc_id", "quality"), sample=300)
    got = quality.quality(every.filter(held).select("doc_id", F.lit(True).alias("held_out"), "text"), model).join(labels, "doc_id")
    assert got.filter("predicted = quality").count() >= 0.95 * got.count()
    hard = quality.quality(docs.select("doc_id", F.lit(False).alias("held_out"), "text"), model)
    assert hard.filter("score between 0 and 1").count() == docs.count()
    assert quality.train(none, labels.limit(0)) == 0.5


def test_quality_gradients():
    rng = np.random.default_rng(1)
    x, counts, y = rng.standard_normal((7, 5)), np.array([3, 1, 3]), np.array([1.0, 0, 1])
    w = {"enc": rng.standard_normal((5, 4)), "enc0": np.zeros(4), "att": rng.standard_normal((4, 3)), "gate": rng.standard_normal((4, 3)), "pick": rng.standard_normal(3), "out": rng.standard_normal(4), "out0": np.array(0.1)}
    m = quality.Model(np.zeros(5), np.ones(5), w)
    loss = lambda: -np.mean(y * np.log(m.forward(x, counts)["p"]) + (1 - y) * np.log(1 - m.forward(x, counts)["p"]))
    g = m.gradients(x, counts, y)
    for k in ("enc", "att", "gate", "pick", "out"):
        at = (0,) * w[k].ndim
        w[k][at] += 1e-5
        up = loss()
        w[k][at] -= 2e-5
        assert abs((up - loss()) / 2e-5 - g[k][at]) < 1e-6
        w[k][at] += 1e-5


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((400, 16))
    v[100:200] = v[7]
    rows = [(int(i), x.tolist()) for i, x in enumerate(v)] + [(500, None), (550, [0.0] * 16), (600, [float("nan")] * 16), (None, [1.0] * 16), (650, [None] * 16)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 50).collect()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    hit = 0
    for i in range(0, 400, 50):
        s = np.round(u @ u[i], 12)
        s[i] = -9
        want = np.lexsort((np.arange(400), -s))[:5]
        hit += len({r["vec_id"] for r in got if r["query_id"] == i} & set(want.tolist()))
    assert hit >= 0.9 * 40 and len(got) == 40


def test_lm(docs, none):
    got = {r["doc_id"]: r for r in lm_score.score(docs, ~is_bucket("doc_id", 7, 2)).collect()}
    counts = Counter()
    for i, x in rows_of(docs):
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*x.encode().lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    for i, x in rows_of(docs):
        words = [*x.encode().lower().split(), None]
        assert got[i]["train_tokens"] == n and got[i]["n_tokens"] == len(words) and got[i]["n_known"] == sum(counts[w] > 0 for w in words)
        assert math.isclose(got[i]["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), rel_tol=1e-9)
        assert got[i]["score"] < 0 and math.isclose(got[i]["bits_per_byte"], -got[i]["score"] * math.log2(10) / max(1, len(x.encode())))
    assert lm_score.score(none, F.lit(True)).count() == 0


def lm_model(texts, seed=0):
    rng = np.random.default_rng(seed)
    sizes = [16] * len(lm_score.CONTEXTS)
    code = lm_score.Code(np.bincount(np.frombuffer(b"".join(t + lm_score.END for t in texts), np.uint8), minlength=256))
    counts = [np.zeros(2 << k, np.uint32) for k in sizes]
    lm_score.counts_into(counts, code, texts, sizes)
    weights = rng.normal(0.2, 0.1, (lm_score.GATES, lm_score.INPUTS)).astype(np.float32)
    return lm_score.Model(code, sizes, [lm_score.states_of(c) for c in counts], np.stack([lm_score.map_of_states(c) for c in counts]), weights), counts


def lm_slow(m, text, counted):
    """log10 of a text's probability and of its last byte's and its end byte's, bit by bit, in plain Python."""
    u32 = lambda x: x & 0xFFFFFFFF
    data, each = [*text, 255], []
    change, shift = [0.0] * lm_score.INPUTS, 0.0
    gradient, missed, weight, n = [0.0] * lm_score.INPUTS, 0.0, 0.0, 0
    contexts = lm_score.contexts_of(*lm_score.joined([text]))
    run, last_before = 0, None
    for j, byte in enumerate(data):
        last = next((k for k in range(j - 1, lm_score.REPEAT - 1, -1) if data[k - lm_score.REPEAT : k] == data[j - lm_score.REPEAT : j]), None) if j >= lm_score.REPEAT else None
        run = run + 1 if last is not None and last_before is not None and last == last_before + 1 else 0
        level, last_before, got = (0 if last is None else 1 + min(int(math.log2(run + 1)), 6)), last, 0.0
        for k in range(m.code.length[byte]):
            at = m.code.start[byte] + k
            node, y = int(m.code.node[at]), int(m.code.bit[at])
            s, seen = [], []
            for i, h in enumerate(contexts):
                state = int(m.states[i][u32(int(h[j]) + int(m.code.hash[at])) >> (32 - m.sizes[i])]) + (256 * (1 + y) if counted else 0)
                s.append(float(m.logit[i][state]))
                seen.append(int(m.level[state]))
            other = m.code.start[data[last]] + k if level and k < m.code.length[data[last]] else None
            agrees = other is not None and int(m.code.node[other]) == node
            s += [float(m.code.logit[at]), (2 * int(m.code.bit[other]) - 1) * level * 0.7 if agrees else 0.0, 1.0]
            gate = seen[-1] * 4 + seen[-2] + 16 * agrees
            x = sum((float(m.weights[gate, i]) + change[i] + float(m.weights[lm_score.SEEN + node, i])) * s[i] for i in range(lm_score.INPUTS))
            x = min(max(x, -11.99), 11.99)
            z = (x + float(m.refined[node, int((x + 12) * (lm_score.STEPS / 24))])) / 2 + shift
            p = 1 / (1 + math.exp(-z))
            got += math.log10(p if y else 1 - p)
            gradient = [g + (y - p) * v for g, v in zip(gradient, s, strict=True)]
            missed, weight, n = missed + y - p, weight + p * (1 - p), n + 1
        each.append(got)
        if (j + 1) % lm_score.STEP == 0:
            change = [c + lm_score.RATE * g / math.sqrt(n) for c, g in zip(change, gradient, strict=True)]
            shift += lm_score.MAP_RATE * missed / (weight + 8)
            gradient, missed, weight, n = [0.0] * lm_score.INPUTS, 0.0, 0.0, 0
    return sum(each), each


def test_lm_is_a_distribution():
    """The probabilities of all bytes at a place add up to one, before and after the weights have followed the text."""
    m, _ = lm_model([b"ab abc abd the abba abb", b"abz"])
    m.refined += np.random.default_rng(1).normal(0, 0.3, m.refined.shape).astype(np.float32)
    for start in (b"ab", b"ab " * 90 + b"ab"):
        total = 0.0
        for i in range(256):
            fast, (_, each) = m.log10([start + bytes([i])], [False])[0], lm_slow(m, start + bytes([i]), False)
            total += 10 ** (fast - sum(each[: len(start)]) - each[-1])
        assert abs(total - 1) < 2e-3


def test_lm_score_bit_by_bit():
    texts = [b"", b"the cat sat on the mat and the dog sat on the cat", b"x" * 300, ("die K\u00f6nigin \u00fcber alles, die K\u00f6nigin " * 8).encode(), b"one two one two three " * 20]
    m, _ = lm_model(texts[1:4])
    for counted in (False, True):
        got = m.log10(texts, [counted] * len(texts))
        assert np.allclose(got, [lm_slow(m, t, counted)[0] for t in texts], rtol=1e-3)
    a, b = m.log10([b"the cat sat on the mat ", b"mat the on sat cat the "], [False] * 2)
    assert a != b


def test_lm_counts():
    """Each occurrence of a bit in a context is one count; states of a slot less one occurrence are those of its counts."""
    texts = [b"abab", b"", b"aXab\xc3\xa9" * 3]
    m, counts = lm_model(texts)
    bits = sum(int(m.code.length[x]) for t in texts for x in [*t, 255])
    assert all(int(c.sum()) == bits for c in counts) and (m.events.sum(axis=(1, 2)) == bits).all()
    assert sum(2.0 ** -int(x) for x in m.code.length) == 1.0
    n = np.array([0, 0, 3, 1, 20, 1, 500, 400], np.uint32)
    states = lm_score.states_of(n).tolist()
    assert [lm_score.PAIRS[k] for k in states[:2]] == [(0, 0), (3, 1)] and len(lm_score.PAIRS) <= states[2] < states[3]
    assert lm_score.small(np.array([1000, 1, 0, 3], np.uint32), 255, np.uint8).tolist() == [255, 1, 0, 3]


def test_lm_fit_takes_every_bit():
    """Weights and map are fitted to all bits of all training texts, with the inputs and gates that the reader has."""
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefghijéß"), rng.integers(2, 9))) for _ in range(60)]
    texts = ["", "x", *(" ".join(rng.choice(words, n)) for n in (30, 300, 3000)), "again and " * 50]
    data = [t.encode() for t in texts]
    m, _ = lm_model(data)
    sums = np.frombuffer(next(lm_score.fitted(m, iter([pa.record_batch({"text": texts[:3]}), pa.record_batch({"text": texts[3:]})]))).column("counts")[0].as_py())
    k = lm_score.GATES * lm_score.INPUTS
    share, (ones, every) = sums[k : k + lm_score.GATES], sums[k + lm_score.GATES :].reshape(2, lm_score.PLACES, lm_score.STEPS)
    joint, lengths = lm_score.joined(data)
    _, gate, place, y, length = m.inputs(joint, lm_score.contexts_of(joint, lengths), *lm_score.repeats_of(joint, lengths), np.ones(len(joint), bool))
    assert len(gate) == length.sum() > 15_000
    assert share[: lm_score.SEEN].tolist() == np.bincount(gate, minlength=lm_score.SEEN).tolist()
    assert share[lm_score.SEEN :].tolist() == every.sum(axis=1).tolist() == np.bincount(place, minlength=lm_score.PLACES).tolist()
    assert ones.sum(axis=1).tolist() == np.bincount(place, y, lm_score.PLACES).tolist()
    fit = lm_score.refitted(m, sums)
    assert fit.log10(data, [True] * len(data)).sum() > m.log10(data, [True] * len(data)).sum()


def test_lm_one_worker_a_task(spark, monkeypatch):
    """No stage of the model's tables runs a second Python step, whose worker would stay in memory beside the first."""
    docs = spark.createDataFrame([(i, f"word {i} and more words {i % 7}") for i in range(50)], "doc_id long, text string")
    plans, collect = [], type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda self: plans.append(self._jdf.queryExecution().optimizedPlan().toString()) or collect(self))
    assert len(lm_score.score(docs, F.col("doc_id") >= 10).collect()) == 50
    stages = [stage for p in plans for stage in p.split("RepartitionByExpression")]
    assert sum("MapInArrow" in x for x in stages) >= 4 and max(x.count("MapInArrow") for x in stages) == 1


def test_lm_kernel_reads_as_defined(spark, monkeypatch):
    """The compiled reader gives the scores of the definition in Python."""
    texts = ["", "the cat sat on the mat and the dog sat on the cat", "x" * 300, "die K\u00f6nigin \u00fcber alles " * 8, "one two one two three " * 20]
    docs, models, kernel = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), [], lm_score.kernel
    monkeypatch.setattr(lm_score, "kernel", lambda *a: models.append(a[-1]) or kernel(*a))
    got = sorted(lm_score.score(docs, F.col("doc_id") >= 2).collect())
    want = models[-1].log10([t.encode() for t in texts], [i >= 2 for i in range(len(texts))])
    assert np.allclose([r["score"] for r in got], want, rtol=1e-3)


def test_added_blocks(spark):
    """Sums of blocks, whole or finished where they are added up, from few partitions and from many."""
    rows = [(i % 3, np.array([i, 1], np.uint32).tobytes()) for i in range(200)]
    want = {k: [sum(range(k, 200, 3)), len(range(k, 200, 3))] for k in range(3)}
    read = lambda raw: np.frombuffer(raw, np.uint32)
    for parts in (2, FEW_PARTS + 6):
        df = spark.createDataFrame(rows, "block int, counts binary").repartition(parts)
        assert {r["block"]: np.frombuffer(bytes(r["counts"]), np.uint64).tolist() for r in added_blocks(df, read, np.uint64).collect()} == want
        some = added_blocks(df, read, np.uint64, lambda x: {"first": x[:1].tobytes(), "last": x[-1:].tobytes()}, "block int, first binary, last binary")
        assert {r["block"]: [int(np.frombuffer(bytes(r[k]), np.uint64)[0]) for k in ("first", "last")] for r in some.collect()} == want


def test_lm_repeats_and_growth(spark):
    """A text that occurs twice scores better than one that occurs once; the tables follow the input."""
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(3, 9))) for _ in range(400)]
    texts = [" ".join(rng.choice(words, 120)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate([*texts, *texts[:10]])]
    got = {r["doc_id"]: r for r in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") >= 0).collect()}
    rate = lambda i: got[i]["bits_per_byte"]
    assert max(rate(i) for i in range(10)) < min(rate(i) for i in range(10, 60))
    assert lm_score.sizes_of(10) < lm_score.sizes_of(10**5) < lm_score.sizes_of(10**7)


def test_near_duplicates(docs, none):
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    texts = {i: x for i, x in rows_of(docs) if i is not None}
    root = {i: i for i in texts}
    for a, b in itertools.combinations(sorted(texts), 2):
        if near_dedup.overlap(texts[a], texts[b]) >= 0.8:
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = {k: new if r == old else r for k, r in root.items()}
    assert {r["doc_id"]: r["class_id"] for r in got} == root | {None: None}
    assert near_dedup.near_duplicates(none).count() == 0


def test_signatures_estimate_weighted_overlap():
    a, b = " ".join(f"w{i % 90}" for i in range(400)), " ".join(f"w{i % 90}" for i in range(300)) + " x y z"
    s = near_dedup.signatures([near_dedup.bag_of(a), near_dedup.bag_of(b)])
    assert abs((s[0] == s[1]).mean() - near_dedup.overlap(a, b)) < 0.2


def test_contamination(spark):
    item = "if anna buys 12 red apples for 30 dollars then how many apples of 12 kinds does she keep in the big basket"
    bench = spark.createDataFrame([(1, item), (2, None), (3, "too short")], "item_id long, text string")
    same = item.replace("12", "57").replace("30", "99")
    broken = item.replace("12 red", "57 red").replace("30", "99")
    docs = spark.createDataFrame([(1, f"some words before. {item} and after"), (2, f"x {same} y"), (3, f"x {broken} y"), (4, None), (5, "it is not too short at all"), (6, "nothing of the kind")], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contamination(docs, bench).collect()}
    assert got == {(1, 1), (2, 1), (5, 3)}
    assert decontaminate.contamination(docs, bench.limit(0)).count() == 0 and decontaminate.contamination(docs.limit(0), bench).count() == 0


def test_urls(spark):
    urls = ["http://a.example.net/en/1?q", "https://Example.NET/de", "http://b.example.com/de/x", "http://b.example.com/fr/x", "ftp://x.org/fr/", "http://x.net", None, "no scheme", "http://notexample.net.uk/en/"]
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [got[i]["rule"] for i in range(9)] == ["example.net/en/", "net/", "example.com/de/", None, "org/fr/", None, None, None, None]
    assert [got[i]["verdict"] for i in (0, 1, 2, 4, 6)] == ["allow", "block", "block", "allow", "allow"]
    assert got[0]["host"] == "a.example.net" and got[0]["path"] == "/en/1" and got[7]["host"] == ""


def test_pipeline(spark):
    import corpus_pipeline

    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        seen.append((name, docs.count()))
    assert [n for n, _ in seen] == ["language_id", "near_dedup", "decontamination", "secret_scan", "packing"]
    assert seen[0][1] >= seen[1][1] >= seen[2][1] == seen[3][1] > 0
    assert docs.agg(F.sum("length")).first()[0] == docs.select("doc_id", "doc_tokens").distinct().agg(F.sum("doc_tokens")).first()[0]


def test_bitmaps_bound_the_difference_of_multisets():
    rng = np.random.default_rng(3)
    for size in (5, 40, 900):
        words = [f"w{i}" for i in rng.integers(0, 30 if size == 40 else 500, size)]
        for edits in (0, 1, size // 20, size // 4):
            other = list(words)
            for i in rng.integers(0, size, edits):
                other[i] = "new"
            a, b = near_dedup.bag_of(" ".join(words)), near_dedup.bag_of(" ".join(other))
            _, i, j = np.intersect1d(a[0], b[0], return_indices=True)
            differ = int(a[1].sum() + b[1].sum()) - 2 * int(np.minimum(a[1][i], b[1][j]).sum())
            bits = sum(int(x).bit_count() for x in (near_dedup.parities(a) ^ near_dedup.parities(b)).view(np.uint64))
            assert bits <= differ and bits % 2 == differ % 2
    assert not near_dedup.parities(near_dedup.bag_of("")).any()


def test_components(spark):
    """A chain, random edges, loops and repeats against label propagation."""
    rng = np.random.default_rng(5)
    edges = [*map(tuple, rng.integers(0, 120, (90, 2)).tolist()), *((i, i + 1) for i in range(200, 240)), (7, 7), (200, 201)]
    root = {x: x for a, b in edges if a != b for x in (a, b)}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == root and len(got) == len(root)
    assert near_dedup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shingles_of_a_batch():
    texts = ["", "a", "a b c d", "a b c d e", "a b a b a b a b a b", "A  b\nc d e f", ""]
    for t, (x, n) in zip(texts, near_dedup.bags_of(texts), strict=True):
        alone, words = near_dedup.bag_of(t), t.lower().split()
        want = Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)) if words)
        assert (alone[0] == x).all() and sorted(n.tolist()) == sorted(want.values())
    assert near_dedup.bags_of([]) == []
