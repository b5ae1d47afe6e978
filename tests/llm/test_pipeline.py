"""The pipeline and its stages against plain Python on the smallest table, and on the hard cases."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from streamloom.llm import decontaminate, language_id, near_dedup, packing, secret_scan
from streamloom.llm.decontaminate import decontamination_stage
from streamloom.llm.language_id import language_stage
from streamloom.llm.near_dedup import dedup_stage
from streamloom.llm.packing import packing_stage
from streamloom.llm.secret_scan import secret_stage

SF = "/root/testdata/sf0.001"


def naive_bayes(rows):
    """doc_id -> posterior and language, gram by gram with a dictionary for counts; training outside of bucket 2."""
    letters = lambda t: re.sub(r"[\W\d_]+", " ", " " + t.lower() + " ")
    grams = lambda t: [x[i : i + n] for x in [letters(t)] for n in (1, 2, 3) for i in range(len(x) - n + 1)]
    counts, docs = {}, Counter()
    for i, t, lang in rows:
        if lang is not None and (i is None or zlib.crc32(str(i).encode()) % 4 != 2):
            counts.setdefault(lang, Counter()).update(grams(t))
            docs[lang] += 1
    out, total = {}, {k: c.total() + 0.5 * language_id.BINS for k, c in counts.items()}
    for i, t, _ in rows:
        own = Counter(grams(t))
        joint = {k: math.log(docs[k]) + sum(n * math.log((c[g] + 0.5) / total[k]) for g, n in own.items()) for k, c in counts.items()}
        top = max(joint.values())
        best = min(k for k in joint if joint[k] == top)
        out[i] = (best if letters(t).strip() else "und", 1 / sum(math.exp(v - top) for v in joint.values()))
    return out


MARKS = (decontaminate.NAME, decontaminate.NUMBER, decontaminate.UNIT)


def template_words(text):
    """The words of a text with its marks, by ``re``."""
    name, number, unit = MARKS
    text = re.sub(r"(?:(?<=[^\W_] )|(?<=[,;] ))[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ][^\W\d_]*", name, text)
    text = re.sub(r"\d+", number, text)
    units = "|".join(sorted(decontaminate.UNITS.split(), key=len, reverse=True))
    text = re.sub(rf"(?:(?<={number})|(?<={number} ))(?:{units})\b", unit, text)
    return [w for w in re.split(rf"(?:[^\w{name}{number}{unit}]|_)+", text.lower()) if w]


def plain_words(text):
    return [w for w in re.split(r"[^\w]+|_+", text.lower()) if w]


def contaminated(text, item):
    """Whether enough windows of the item stand in the text, in alignments that map each marked word to one."""
    marks = MARKS
    w, v = template_words(item), template_words(text)
    k = min(len(w), decontaminate.WINDOW)
    if not k:
        return False
    windows = [w[i : i + k] for i in range(len(w) - k + 1)]
    n_marks = [sum(any(m in x for m in marks) for x in y) for y in windows]
    allowed = [i for i, n in enumerate(n_marks) if n <= max(k - decontaminate.PLAIN, min(n_marks))]
    hits = [(i, j - i) for i in allowed for j in range(len(v) - k + 1) if v[j : j + k] == windows[i]]
    said_item, said_text, found = plain_words(item), plain_words(text), set()
    for shift in {s for _, s in hits}:
        own, seen = [i for i, s in hits if s == shift], {}
        places = {i + x for i in own if n_marks[i] for x in range(k)}
        for p in places:
            if any(m in v[p + shift] for m in marks):
                seen.setdefault((v[p + shift], said_item[p]), set()).add(said_text[p + shift])
        if all(len(x) == 1 for x in seen.values()):
            found |= set(own)
    return len(found) >= decontaminate.COVER * len(allowed)


def test_pipeline_by_brute_force(spark):
    rows = [(r["doc_id"], r["text"] or "", r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    bench = [r["text"] or "" for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = naive_bayes(rows)
    kept = {i: t for i, t, _ in rows if found[i][0] != "und" and found[i][1] >= 0.5}
    root = {i: i for i in kept}
    shingles = {i: Counter(tuple(t.lower().split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))) for i, t in kept.items()}
    for a, b in itertools.combinations(sorted(kept), 2):
        x, y = shingles[a], shingles[b]
        if root[a] != root[b] and 0.8 * max(x.total(), y.total()) <= min(x.total(), y.total()) and (x & y).total() >= 0.8 * (x | y).total():
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = {k: new if r == old else r for k, r in root.items()}
    kept = {i: t for i, t in kept.items() if root[i] == i and not any(contaminated(t, x) for x in bench)}
    import public_tokenizers

    t = packing.tokenizer(public_tokenizers.path(packing.VOCABULARY))
    want = {i: [*t.encode(secret_scan.redacted(x, secret_scan.scan(x)), add_special_tokens=False).ids, 0] for i, x in kept.items()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"]: r["doc_tokens"] for r in got} == {i: len(x) for i, x in want.items()}
    for r in got:
        ids = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sum(r["length"] for r in got) == sum(map(len, want.values()))


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls, empty and long texts, ties, repeats, ids with two texts, and columns named like those the stages make."""
    english = "the old man walked slowly along the river and thought about the long winter that was coming to the valley"
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, lang_pred string, kept_id int, bad_id int, spans string, root int, d string, k string"
    rest = ("a", "b", 1, 2, "c", 3, "e", "f")
    rows = [(1, english, "en"), (1, english, "en"), (1, "quite another text stands here under the very same number as the first one does", "en"), (2, english + " now", "en"), (3, None, "en"), (3, None, None), (4, "", "en"), (5, " \n\t", None), (None, english, "en"), (6, (english + " ") * 3000, "en"), (7, "password=abcdef123456 is " + english[::-1], None)]
    return spark.createDataFrame([(i, t, lang, None, None if t is None else len(t), *rest) for i, t, lang in rows], schema)


def test_stages_on_hard_cases(spark, hard):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, hard, SF)
        assert out.columns == hard.columns and out.schema.simpleString() == hard.schema.simpleString()
        assert {(r["score"], r["lang_pred"], r["kept_id"], r["bad_id"], r["spans"]) for r in out.collect()} <= {("a", "b", 1, 2, "c")}
        assert stage(spark, hard.limit(0), SF).count() == 0
    ids = lambda df: sorted((r["doc_id"] or 0, len(r["text"] or "")) for r in df.collect())
    every = ids(hard)
    assert {i for i, _ in ids(language_stage(spark, hard, SF))} == {0, 1, 2, 6, 7}
    kept = dedup_stage(spark, hard, SF)
    assert ids(kept) == sorted([x for x in every if x[0] in (0, 3, 4, 5, 6, 7)] + sorted({x for x in every if x[0] == 1}))
    assert ids(decontamination_stage(spark, hard, SF)) == every
    out = {r["doc_id"]: r for r in secret_stage(spark, hard, SF).collect()}
    assert out[7]["text"].startswith("<SECRET> is ") and out[7]["n_chars"] == len(out[7]["text"]) and out[3]["text"] is None
    pieces = packing_stage(spark, hard, SF)
    assert pieces.filter("doc_id = 3").count() == 2 and pieces.filter("doc_id is null").count() >= 1
    assert packing_stage(spark, hard.limit(0), SF).count() == 0


def test_an_item_with_several_slots(spark):
    """The operator and the plain version agree on whole, edited and re-parameterised passages, short items and long texts."""
    items = ["if anna buys 12 red apples for 30 dollars then how many apples of 12 kinds does she keep in the big basket", "a short one", "we know that Peter walked 5 km in 2 hours, then Maria walked 5 km more along the quiet road to the lake"]
    texts = []
    for x in items:
        w = x.split()
        texts += [x, "before it " + x + " after it", " ".join(w[: len(w) // 2]), x.replace("12", "7").replace("30", "9").replace("5", "8"), x.replace("12 red", "7 red"), " ".join([*w[:9], "changed", *w[10:]]), x.replace("Peter", "Paul").replace("Maria", "Eva"), (x + " filler words between them ") * 40, x.upper()]
    texts += ["", None, "nothing here"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contamination(docs, bench).collect()}
    assert got == {(i, j) for i, t in enumerate(texts) for j, x in enumerate(items) if contaminated(t or "", x)}


def test_two_texts_of_one_id(spark):
    """Each text keeps its own links."""
    x, y = ("one two three four five six seven eight nine ten eleven twelve " + w for w in ("alpha beta gamma delta", "rho sigma tau ypsilon"))
    y = " ".join(reversed(y.split()))
    rows = [(1, x), (1, y), (2, x), (3, y), (4, "x y z"), (5, None), (None, x)]
    got = sorted(((r["doc_id"] or 0), r["copy_of"], r["class_id"]) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, None, None), (1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 4, 4), (5, 5, 5)]
    kept = dedup_stage(spark, spark.createDataFrame(rows[:4], "doc_id long, text string"), SF).collect()
    assert sorted(r["text"] for r in kept) == sorted([x, y])


def test_large_buckets_are_dealt_in_shares(spark, monkeypatch):
    """As with one share, all links within a bucket are found."""
    monkeypatch.setattr(near_dedup, "SHARE", 2)
    monkeypatch.setattr(near_dedup, "PAIRS", 2)
    monkeypatch.setattr(near_dedup, "FEW", 0)  # and names go to the salted join
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join([*base[:k], f"new{k}", *base[k + 1 :]]) for k in range(0, 60, 5)]
    got = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    root = {i: i for i in range(len(texts))}
    for a, b in itertools.combinations(root, 2):
        if near_dedup.overlap(texts[a], texts[b]) >= 0.8:
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = {k: new if r == old else r for k, r in root.items()}
    assert {r["doc_id"]: r["class_id"] for r in got} == root


def test_packing_by_tiers(spark):
    """Pieces go to windows of their tier's size; step groups have one size and equal ids."""
    docs = spark.createDataFrame([(i, "word " * (10 + i * 7 % 900)) for i in range(400)], "doc_id long, text string").coalesce(1)
    rows = packing.pack(docs).collect()
    sizes = {r["sequence_id"]: (r["tier"], r["step_group"]) for r in rows}
    used = Counter(t for t, _ in sizes.values())
    assert set(used) >= {1024, 512, 128} and all(t & (t - 1) == 0 for t in used)
    groups = {}
    for tier, group in sizes.values():
        groups.setdefault(group, []).append(tier)
    assert all(len(set(x)) == 1 and sum(x) <= packing.STEP * 1024 for x in groups.values())
    short = Counter(x[0] for x in groups.values() if sum(x) < packing.STEP * 1024)
    assert max(short.values()) == 1


def test_letters_are_counted(spark):
    assert language_id.bins_of(4) == 1 << 16 and language_id.bins_of(5000) * 5000 <= language_id.MOST
    many = spark.createDataFrame([(i, f"text {chr(97 + i % 26)}{chr(97 + i // 26 % 26)} " * 3, f"l{i}") for i in range(600)], "doc_id long, text string, lang string")
    assert language_id.identify(many.limit(5), many).filter("score > 0").count() == 5
    assert F is not None
