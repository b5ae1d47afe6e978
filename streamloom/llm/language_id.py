"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training adds up, per language, counts of hashed 1- to 3-grams of letters over every training document, as dense
blocks summed on the executors. The smoothed log-probability matrix has a fixed size and is broadcast. Scoring hashes
all n-grams of a batch of whole texts at once and adds the matrix rows of each document's grams in numpy.

Text is lower-cased; runs of other characters than letters read as one space. Null texts and texts without letters
get ``und`` with score 0. Rows with a null language aren't learned from. Null ids count as training rows (not held
out). Repeated rows count as often as they occur and each gets its result. Ties go to the language first in order of
name. With no training rows every text is ``und``. Extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from streamloom.llm.common import is_bucket, slices, small_batches, summed_blocks, table, texts_of, without

#: Rows of the matrix (one more is for grams that cross documents), gram lengths, and added to each count.
BINS, ORDERS, ALPHA = 1 << 16, (1, 2, 3), 0.5
#: Numbers of the matrix at most: with more than 128 languages each has fewer rows, 256 at least.
MOST = 1 << 23
UND = "und"


def bins_of(languages: int) -> int:
    """Rows of the matrix, a power of two."""
    bins = BINS
    while bins * languages > MOST and bins > 256:
        bins //= 2
    return bins


@functools.cache
def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def hashed_grams(texts: list[str], bins: int = BINS) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The rows of all grams, one array for each order, where each document starts in them, and its count of letters."""
    joined = "".join(" " + t.lower() + " " for t in texts)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.cumsum([0, *(len(t.lower()) + 2 for t in texts)])[:-1]
    is_letter = letters()[code]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    keep[starts] = True
    place = np.cumsum(keep) - 1
    starts = place[starts]
    code = np.where(is_letter, code, np.uint32(32))[keep]
    ends = np.append(starts[1:], len(code))
    rows = []
    h = code * np.uint32(0x9E3779B1)
    for n in ORDERS:
        if n > 1:
            h = h[:-1] * np.uint32(0x85EBCA6B) + code[n - 1 :] * np.uint32(0xC2B2AE35) + np.uint32(n)
        x = h ^ (h >> np.uint32(15))
        row = np.full(len(code), bins, np.int32)
        row[: len(h)] = (x * np.uint32(0x27D4EB2F)) >> np.uint32(33 - bins.bit_length())
        for k in range(1, n):  # grams that reach into the next document
            row[np.maximum(ends - k, starts)] = bins
        rows.append(row)
    return rows, starts, np.add.reduceat(code != 32, starts)


def counts_of(batches: Iterator[pa.RecordBatch], languages: list[str]) -> Iterator[pa.RecordBatch]:
    place, bins = {x: i for i, x in enumerate(languages)}, bins_of(len(languages))
    total = np.zeros((len(languages), bins + 1), np.int64)
    for batch in batches:
        texts, lang = texts_of(batch), batch.column("lang").to_pylist()
        for k in sorted({x for x in lang if x in place}):
            own = [t for t, x in zip(texts, lang, strict=True) if x == k]
            for a, b in slices(own):
                for row in hashed_grams(own[a:b], bins)[0]:
                    total[place[k]] += np.bincount(row, minlength=bins + 1)
    for i in range(len(languages)):
        if total[i].any():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([total[i, :bins].tobytes()], pa.binary())], names=["block", "counts"])


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log-probability matrix (rows + 1, languages) and log priors from rows (text, lang)."""
    found = labelled.filter(F.col("lang").isNotNull()).groupBy("lang").count().collect()  # one row a language
    languages = sorted(r["lang"] for r in found)
    n = {r["lang"]: r["count"] for r in found}
    if not languages:
        return [], np.zeros((BINS + 1, 0), np.float32), np.zeros(0)
    bins = bins_of(len(languages))
    sums = summed_blocks(labelled.select("text", "lang").mapInArrow(lambda it: counts_of(it, languages), "block int, counts binary"))
    counts = np.stack([sums.get(i, np.zeros(bins, np.int64)) for i in range(len(languages))], axis=1) + ALPHA
    matrix = np.vstack([np.log(counts / counts.sum(axis=0)), np.zeros((1, len(languages)))]).astype(np.float32)
    prior = np.log(np.array([n[x] for x in languages], float))
    return languages, matrix, prior - prior.max()


def scores(texts: list[str], matrix: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log joint probabilities (texts, languages), and whether a text has letters."""
    rows, starts, n_letters = hashed_grams(texts, len(matrix) - 1)
    out = np.tile(prior, (len(texts), 1))
    for k in range(len(prior)):
        column = np.ascontiguousarray(matrix[:, k])
        for row in rows:
            out[:, k] += np.add.reduceat(column[row], starts, dtype=np.float64)
    return out, n_letters > 0


def identify(documents: DataFrame, training: DataFrame, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """documents(doc_id, text, ...) with lang_pred and score (the posterior) for each row; training has text and lang. Columns that have these ``names`` are replaced."""
    spark = documents.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(train(training))
    documents = without(documents, *names)
    kept = documents.columns
    schema = StructType([*documents.schema, StructField(names[0], StringType()), StructField(names[1], DoubleType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, matrix, prior = model.value
        for batch in batches:
            texts, pred, score = texts_of(batch), [], []
            for a, b in slices(texts):
                if not languages:
                    pred += [UND] * (b - a)
                    score += [0.0] * (b - a)
                    continue
                joint, known = scores(texts[a:b], matrix, prior)
                best = joint.argmax(axis=1)
                p = 1 / np.exp(joint - joint.max(axis=1, keepdims=True)).sum(axis=1)
                pred += [languages[i] if k else UND for i, k in zip(best.tolist(), known.tolist(), strict=True)]
                score += np.where(known, p, 0.0).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*kept, *names])

    return documents.mapInArrow(predict, schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = is_bucket("doc_id", 4, 2)
    found = identify(docs.select("doc_id", "text", held_out.alias("held_out")), docs.filter(~held_out).select("text", "lang"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.5) -> DataFrame:
    """Pipeline stage: documents without an identified language, or with a posterior under ``least``, go.

    It learns from the rows that it gets (those with a language, outside of the held-out bucket). Null and empty texts go;
    ties go to the language first in order of name; repeated rows stay as often as they occur; an empty table gives an
    empty result. The columns stay those of the input, whatever their names.
    """
    training = docs.filter(~is_bucket("doc_id", 4, 2)).select("text", "lang")
    new = max(docs.columns, key=len) + "_"
    found = identify(docs, training, (f"{new}language", f"{new}score"))
    kept = (F.col(f"`{new}language`") != UND) & (F.col(f"`{new}score`") >= least)
    return found.filter(kept).select(*[F.col(f"`{c}`") for c in docs.columns])
