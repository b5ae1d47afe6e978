"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE characters (the whole text, the last passage shorter). A passage is described
by the shares of classes of characters and of pairs of neighbouring classes, its word shape, and how well it compresses.
An encoder maps that to a hidden vector; gated attention gives each passage a weight; the weighted sum of the hidden
vectors is scored. Encoder, attention and output are learned together, from document labels only, by gradient descent
on the driver over a bounded sample of labelled documents: SAMPLE of them, and of these, in the same order, as many whole
ones as have MOST passages together. The model is a few thousand numbers and is broadcast.

Null and empty texts have one empty passage and so a score. Rows without a label aren't learned from; of an id with
several labels, or texts, the smallest counts. Null ids are scored but not learned from. Repeated rows are scored each. With labels
of one kind only, or none, every score is that kind's share (0.5 without labels). Extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import functools
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamloom.llm.common import is_bucket, slices, small_batches, table, texts_of, written

PASSAGE = 1024
#: Documents of the training sample (those with the smallest id hashes), epochs, documents in a step, hidden sizes.
SAMPLE, EPOCHS, STEP, HIDDEN, GATE = 3000, 30, 64, 16, 8
#: Passages of the training sample, some 550 bytes each on their way to the driver.
MOST = 60_000
THRESHOLD = 0.3
CLASSES = 16


@functools.cache
def class_table() -> np.ndarray:
    """The class of each code point of the basic plane; others count as letters of no case."""
    singles = {" ": 4, "\n": 5, ".": 6, ",": 7, "!": 8, "?": 8, "|": 9, "#": 10, "%": 11, "&": 12, "$": 13, "*": 14}
    general = {"Ll": 0, "Lu": 1, "Lt": 1, "Lm": 2, "Lo": 2, "Mn": 2, "Mc": 2, "Me": 2, "Nd": 3, "Nl": 3, "No": 3, "Zs": 4, "Cc": 5, "Zl": 5, "Zp": 5}
    return np.array([singles.get(chr(i), general.get(unicodedata.category(chr(i)), 15)) for i in range(0x10000)], np.int64)


def passages_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and how many each text has."""
    counts = np.array([max(1, -(-len(t) // PASSAGE)) for t in texts])
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = class_table()[np.minimum(code, 0xFFFF)]
    lengths = np.array([len(t) for t in texts])
    within = np.arange(len(code)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    passage = np.repeat(np.cumsum(counts) - counts, lengths) + within // PASSAGE
    n = int(counts.sum())
    ones = np.bincount(passage * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES)
    same = passage[1:] == passage[:-1]
    pairs = np.bincount((passage[1:] * CLASSES * CLASSES + kind[:-1] * CLASSES + kind[1:])[same], minlength=n * CLASSES * CLASSES).reshape(n, CLASSES * CLASSES)
    size = np.maximum(ones.sum(axis=1), 1)[:, None]
    bits = [t[i : i + PASSAGE].encode("utf-8", "surrogatepass") for t in texts for i in range(0, max(1, len(t)), PASSAGE)]
    packed = np.array([len(zlib.compress(b, 1)) / (len(b) + 20) for b in bits])[:, None]
    words = (ones[:, 4] + ones[:, 5] + 1)[:, None]
    more = np.hstack([packed, np.log(size) / 7, np.minimum(size / words, 30) / 30, ones.sum(axis=1, keepdims=True) == 0])
    return np.hstack([np.sqrt(ones / size), np.sqrt(pairs / size), more]).astype(np.float32), counts


class Model:
    """Weights of encoder, gated attention and output, over standardised features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: dict[str, np.ndarray]):
        self.mean, self.scale, self.w = mean, scale, weights

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        """x: standardised passages of all documents, in order; counts: passages of each document."""
        w = self.w
        h = np.tanh(x @ w["enc"] + w["enc0"])
        a, g = np.tanh(h @ w["att"]), 1 / (1 + np.exp(-(h @ w["gate"])))
        e = (a * g) @ w["pick"]
        starts = np.cumsum(counts) - counts
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), counts))
        e = e / np.repeat(np.add.reduceat(e, starts), counts)
        z = np.add.reduceat(h * e[:, None], starts, axis=0)
        logit = z @ w["out"] + w["out0"]
        return {"h": h, "a": a, "g": g, "e": e, "z": z, "p": 1 / (1 + np.exp(-np.clip(logit, -30, 30)))}

    def gradients(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, f = self.w, self.forward(x, counts)
        d = (f["p"] - y) / len(y)
        dz = np.repeat(d[:, None] * w["out"], counts, axis=0)
        starts = np.cumsum(counts) - counts
        de = (dz * f["h"]).sum(axis=1)
        de = f["e"] * (de - np.repeat(np.add.reduceat(f["e"] * de, starts), counts))
        dag = de[:, None] * w["pick"]
        da, dg = dag * f["g"] * (1 - f["a"] ** 2), dag * f["a"] * f["g"] * (1 - f["g"])
        dh = (dz * f["e"][:, None] + da @ w["att"].T + dg @ w["gate"].T) * (1 - f["h"] ** 2)
        return {"enc": x.T @ dh, "enc0": dh.sum(axis=0), "att": f["h"].T @ da, "gate": f["h"].T @ dg, "pick": ((f["a"] * f["g"]) * de[:, None]).sum(axis=0), "out": f["z"].T @ d, "out0": np.array(d.sum())}

    def score(self, texts: list[str]) -> np.ndarray:
        x, counts = passages_of(texts)
        return self.forward((x - self.mean) / self.scale, counts)["p"]


def fit(bags: list[np.ndarray], labels: np.ndarray, seed: int = 0, decay: float = 1e-3) -> Model:
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags)
    mean, scale = every.mean(axis=0), every.std(axis=0) + 0.02
    bags = [(b - mean) / scale for b in bags]
    n = every.shape[1]
    init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float64)
    share = np.clip(labels.mean(), 0.01, 0.99)
    w = {"enc": init(n, HIDDEN), "enc0": np.zeros(HIDDEN), "att": init(HIDDEN, GATE), "gate": init(HIDDEN, GATE), "pick": init(GATE), "out": init(HIDDEN), "out0": np.array(np.log(share / (1 - share)))}
    model = Model(mean, scale, w)
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    turn = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        for lo in range(0, len(bags), STEP):
            own = order[lo : lo + STEP]
            x, counts = np.concatenate([bags[i] for i in own]), np.array([len(bags[i]) for i in own])
            turn += 1
            for k, g in model.gradients(x, counts, labels[own]).items():
                g = g + decay * w[k] * (k in ("enc", "out"))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] -= 0.01 * (1 - epoch / EPOCHS) * (m[k] / (1 - 0.9**turn)) / (np.sqrt(v[k] / (1 - 0.999**turn)) + 1e-8)
    return model


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | float:
    """A model from at most ``sample`` documents, of MOST passages, of labels(doc_id, quality); without two kinds of labels their share."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, y = texts_of(b), b.column("quality").to_pylist()
            for lo, hi in slices(texts):
                x, counts = passages_of(texts[lo:hi])
                parts = np.split(x, np.cumsum(counts)[:-1])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(y[lo:hi], pa.int32()), pa.array([p.astype(np.float16).tobytes() for p in parts], pa.binary())], names=["doc_id", "quality", "bag"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))), "doc_id")
    held = written(rows.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min(F.coalesce("text", F.lit(""))).alias("text")))
    sizes = held.select("doc_id", F.greatest(F.ceil(F.length("text") / PASSAGE), F.lit(1)).alias("n"), F.xxhash64("doc_id").alias("h")).collect()  # ``sample`` rows at most
    own, total = [], 0
    for r in sorted(sizes, key=lambda r: (r["h"], r["doc_id"])):
        if total + r["n"] <= MOST:
            own.append(r["doc_id"])
            total += r["n"]
    if len(own) < len(sizes):
        held = held.filter(F.col("doc_id").isin(own))
    found = sorted(held.select("doc_id", "quality", "text").mapInArrow(features, "doc_id long, quality int, bag binary").collect())
    y = np.array([r["quality"] for r in found], float)
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    width = CLASSES + CLASSES * CLASSES + 4
    return fit([np.frombuffer(bytes(r["bag"]), np.float16).reshape(-1, width).astype(np.float64) for r in found], y)


def quality(documents: DataFrame, model: Model | float) -> DataFrame:
    """doc_id, held_out, score, predicted for rows (doc_id, held_out, text)."""
    small_batches(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(model)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            texts, out = texts_of(b), []
            for lo, hi in slices(texts):
                out += [m] * (hi - lo) if isinstance(m, float) else m.score(texts[lo:hi]).tolist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(out, pa.float64())], names=["doc_id", "held_out", "score"])

    scored = documents.select("doc_id", "held_out", "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = is_bucket("doc_id", 5, 0)
    model = train(docs.filter(~held_out), labels.filter(~held_out).select("doc_id", "quality"))
    return quality(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
