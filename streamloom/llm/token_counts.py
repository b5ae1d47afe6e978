"""Token counts by a map-side two-tier lookup.

Tier one is a compact table of the lengths, in tokens, of frequent pre-tokens, which every task gets by broadcast.
Tier two is a cache in each Python worker: a pre-token that misses the table is encoded, and kept if it comes again, as
most occur once. Texts and their
pre-tokens are never shuffled; the pass that finds the frequent ones sends one bounded sketch per task, and these are
added up as they stream in, in two steps where there are many.

The vocabulary splits a text at white space first, so a text's count is the sum of its pieces' counts. Texts for
which that isn't certain (special strings, separators on which libraries disagree) are encoded whole.

Null texts count as empty: 0 bytes, 0 tokens. Null ids, repeated rows and other columns are kept as they are:
one result row for each input row. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import os
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamloom.llm.common import FEW_PARTS, slices, small_batches, table, texts_of

VOCABULARY = "word_bpe_49k.json"
#: Entries of the broadcast table, entries of each task's sketch, entries of a worker's cache, and places of hashes met.
FREQUENT, SKETCH, CACHE, MET = 16_384, 8_192, 400_000, 1 << 23
#: Characters that only some libraries take as white space, and the openings of special strings.
ODD = re.compile("[\x1c-\x1f]|<\\|")


@functools.cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
    os.environ["RAYON_NUM_THREADS"] = "1"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def encoded_lengths(path: str, pieces: list[str]) -> list[int]:
    return [len(e.ids) for e in tokenizer(path).encode_batch_fast(pieces, add_special_tokens=False)]


def _top(counts: Counter, n: int) -> list[tuple[str, int]]:
    return sorted(counts.most_common(n), key=lambda x: (-x[1], x[0]))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for t in texts_of(batch):
            counts.update(t.split())
        if len(counts) > 16 * SKETCH:  # keep the heavy ones; what is lost has a small count
            counts = Counter(dict(counts.most_common(4 * SKETCH)))
    top = [(w, n) for w, n in _top(counts, SKETCH) if n > 1 and not ODD.search(w)]
    if top:
        yield pa.RecordBatch.from_arrays([pa.array(["\n".join(w for w, _ in top)]), pa.array([np.array([n for _, n in top], np.int64).tobytes()], pa.binary())], names=["words", "counts"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sketch of all sketches of a task, which it adds up as they come."""
    total: Counter = Counter()
    for batch in batches:
        for w, c in zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            for k, v in zip(w.split("\n"), np.frombuffer(c, np.int64).tolist(), strict=True):
                total[k] += v
            if len(total) > 8 * FREQUENT:
                total = Counter(dict(_top(total, 4 * FREQUENT)))
    top = _top(total, FREQUENT)
    if top:
        yield pa.RecordBatch.from_arrays([pa.array(["\n".join(w for w, _ in top)]), pa.array([np.array([n for _, n in top], np.int64).tobytes()], pa.binary())], names=["words", "counts"])


def frequent_lengths(texts: DataFrame, path: str) -> tuple[str, bytes]:
    """The broadcast table, compactly: the frequent pre-tokens joined by newlines and their lengths as 16-bit integers."""
    schema = "words string, counts binary"
    sketches = texts.mapInArrow(_sketches, schema)
    tasks = sketches._jdf.queryExecution().toRdd().getNumPartitions()
    if tasks > FEW_PARTS:
        sketches = sketches.repartition(int(tasks**0.5)).mapInArrow(_merged, schema)
    rows = sketches.repartition(1).mapInArrow(_merged, schema).collect()  # one row
    words = rows[0]["words"].split("\n") if rows else []
    lengths = np.array(encoded_lengths(path, words), np.int64) if words else np.zeros(0, np.int64)
    kept = [i for i in range(len(words)) if lengths[i] < 65_536]
    return "\n".join(words[i] for i in kept), lengths[kept].astype(np.uint16).tobytes()


class Worker:
    """A worker's tables: the frequent lengths, and with them those of other pieces that more than one slice of texts had."""

    def __init__(self, path: str, words: str, lengths: bytes):
        self.path = path
        self.first = dict(zip(words.split("\n") if words else [], np.frombuffer(lengths, np.uint16).tolist(), strict=True))
        self.known, self.met = dict(self.first), bytearray(MET)

    def counts(self, texts: list[str]) -> list[int]:
        """The tokens of each text."""
        odd = [i for i, t in enumerate(texts) if ODD.search(t)]
        whole = dict(zip(odd, encoded_lengths(self.path, [texts[i] for i in odd]), strict=True))
        flat: list[str] = []
        ends = []
        for i, t in enumerate(texts):
            if i not in whole:
                flat += t.split()
            ends.append(len(flat))
        found = list(map(self.known.get, flat))
        unknown = [i for i, x in enumerate(found) if x is None] if None in found else []
        if unknown:
            missed = list(dict.fromkeys(map(flat.__getitem__, unknown)))
            fresh = dict(zip(missed, encoded_lengths(self.path, missed), strict=True))
            for i in unknown:
                found[i] = fresh[flat[i]]
            if len(self.known) > CACHE:
                self.known = dict(self.first)
            places = [hash(w) % MET for w in missed]
            self.known.update((w, fresh[w]) for w, k in zip(missed, places, strict=True) if self.met[k])
            for k in places:
                self.met[k] = 1
        return [whole[i] if i in whole else sum(found[a:b]) for i, (a, b) in enumerate(zip([0, *ends], ends, strict=False))]


#: The tables of the latest broadcast.
_workers: dict[str, Worker] = {}


def token_counts(documents: DataFrame, limit: int = 2048, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether the count exceeds ``limit``, for each row of documents(doc_id, text)."""
    spark = documents.sparkSession
    small_batches(spark)
    path = path or public_tokenizers.path(VOCABULARY)
    docs = documents.select("doc_id", "text")
    frequent = spark.sparkContext.broadcast(frequent_lengths(docs.select("text"), path))
    made = uuid.uuid4().hex

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if made not in _workers:
            _workers.clear()
            _workers[made] = Worker(path, *frequent.value)
        worker = _workers[made]
        for batch in batches:
            texts = texts_of(batch)
            n_tokens = [n for a, b in slices(texts) for n in worker.counts(texts[a:b])]
            n_bytes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > F.lit(limit))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
