"""Secret scanning: fixed patterns, and a battery of randomness tests on every other long run of key characters.

A run is a maximal stretch of base-64 characters. Its encoding (hex, base 32, base 36, letters, base 62, base 64) is
inferred from the characters that it has. A run that fits no alphabet, fails the battery, or touches a pattern's span is
split at inner ``=`` (a name and its key), and a part for which that holds again at ``/``, ``-`` and ``_`` (paths). A
run that passes is split too where its parts bear more evidence than the whole. The battery tests it as a random string
over that alphabet: chi-squared uniformity of the characters, a Wald-Wolfowitz runs test about the middle of the
alphabet, and lag-one serial correlation; Fisher's method combines the three. A run that passes is weighed against the
hypothesis that it is ordinary text of its document, by the likelihood ratio of the uniform alphabet to the document's
other characters (in runs of letters only: to its letters whatever their case, and to changes of case being rare). Its
reciprocal would be a valid p-value if the alphabet were not chosen by the run; as it is, it is a score near one. The
Benjamini-Hochberg procedure over the document's runs, with weights by length (a longer run can bear evidence, a short
one can't), keeps the share of false discoveries low.

Null texts read as empty and have no spans. Null ids and repeated rows are kept, one result for each row; extra
columns are ignored; an empty table gives an empty result. Ties in p are all taken or all left.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from streamloom.llm.common import small_batches, table, texts_of, without

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
KEYWORD = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Characters of a run or part at least, and of one of letters only.
LEAST, LETTERS_LEAST = 16, 24
#: The parts of a run, in turn: at inner ``=`` (padding stays), then at every separator.
SPLITS = (re.compile(r"[^=]+(?:=+$)?"), re.compile(r"[^=/_-]+"))
KINDS = ("assign", "access", "hex", "random")
#: Rate of false discoveries, level of the battery, and length at which a run has half of the full weight.
RATE, LEVEL, HALF_LENGTH = 0.01, 1e-3, 24

DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = (
    ("hex", frozenset(DIGITS + "abcdef"), DIGITS + "abcdef"),
    ("HEX", frozenset(DIGITS + "ABCDEF"), DIGITS + "ABCDEF"),
    ("base32", frozenset("234567" + LOWER.upper()), LOWER.upper() + "234567"),
    ("base36", frozenset(DIGITS + LOWER), DIGITS + LOWER),
    ("BASE36", frozenset(DIGITS + LOWER.upper()), DIGITS + LOWER.upper()),
    ("lower", frozenset(LOWER), LOWER),
    ("upper", frozenset(LOWER.upper()), LOWER.upper()),
    ("letters", frozenset(LOWER + LOWER.upper()), LOWER.upper() + LOWER),
    ("base62", frozenset(DIGITS + LOWER + LOWER.upper()), LOWER.upper() + LOWER + DIGITS),
    ("base64", frozenset(DIGITS + LOWER + LOWER.upper() + "+/"), LOWER.upper() + LOWER + DIGITS + "+/"),
    ("base64url", frozenset(DIGITS + LOWER + LOWER.upper() + "-_"), LOWER.upper() + LOWER + DIGITS + "-_"),
)


#: Shares of letters in any text, roughly: what is frequent in most languages with these letters.
LETTERS = {c: x / 100 for c, x in zip(LOWER, (8, 1.5, 2.8, 4, 13, 2, 2, 4, 7, 0.2, 0.8, 4, 2.4, 7, 7.5, 1.9, 0.1, 6, 6.5, 9, 3, 1, 1.5, 0.2, 1.5, 0.3), strict=True)}


def encoding_of(run: str) -> tuple[str, str] | None:
    """The smallest alphabet that has all of the run's characters, if the run has letters; among letters only, base 32 and hex don't count."""
    own = set(run.rstrip("="))
    if not any(c.isalpha() for c in own):
        return None
    if not any(c.isdigit() for c in own):
        return None if len(run) < LETTERS_LEAST else next(((name, order) for name, chars, order in ALPHABETS if not chars & set(DIGITS) and own <= chars), None)
    return next(((name, order) for name, chars, order in ALPHABETS if own <= chars), None)


def normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi2_tail(x: float, k: int) -> float:
    """Upper tail of chi-squared with k degrees of freedom (Wilson-Hilferty)."""
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(run: str, order: str) -> float:
    """Combined p-value of the hypothesis that the run is random over the alphabet."""
    place = {c: i for i, c in enumerate(order)}
    x = [place[c] for c in run]
    n, k = len(x), len(order)
    uniform = chi2_tail(sum((v - n / k) ** 2 for v in Counter(x).values()) * k / n + (k - len(set(x))) * n / k, k - 1)
    high = [v >= k / 2 for v in x]
    a = sum(high)
    b = n - a
    if a and b:
        mean = 2 * a * b / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        runs = normal_tail((1 + sum(p != q for p, q in zip(high, high[1:], strict=False)) - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        runs = 2.0 ** (1 - n)
    mid = (k - 1) / 2
    serial = normal_tail(sum((p - mid) * (q - mid) for p, q in zip(x, x[1:], strict=False)) / ((k * k - 1) / 12 * math.sqrt(n - 1)))
    stat = -sum(math.log(max(p, 1e-300)) for p in (uniform, runs, serial))
    return math.exp(-stat) * (1 + stat + stat * stat / 2)  # Fisher, 6 degrees of freedom


def evidence(run: str, k: int) -> float:
    """The same by what characters are in any text: a logarithm, larger for what is less like text."""
    return sum(math.log(1 / (k * (0.8 / 26 if c.islower() else 0.1 / 26 if c.isupper() else 0.008 if c.isdigit() else 0.005))) for c in run)


def text_p(run: str, k: int, common: Counter, n: int) -> float:
    """How likely the run is as ordinary text with the document's characters against a random string: 1 at most."""
    ratio = 0.0
    if k in (26, 52):
        last = ""
        for c in run:
            lower, upper = c.lower(), c.upper()
            case = 1.0 if k == 26 else 0.5 if not last else 0.9 if last.isupper() == c.isupper() else 0.1
            ratio += math.log((n + 50) / (k * case * (common[lower] + common[upper] + 50 * LETTERS[lower])))
            last = c
        return math.exp(-max(0.0, ratio))
    for c in run:
        prior = 0.8 / 26 if c.islower() else 0.1 / 26 if c.isupper() else 0.008 if c.isdigit() else 0.005
        ratio += math.log((n + 50) / (k * (common[c] + 50 * prior)))
    return math.exp(-max(0.0, ratio))


def discoveries(tests: list[tuple[float, int]], rate: float = RATE) -> list[bool]:
    """Weighted Benjamini-Hochberg: tests are p-values with lengths; the weights have mean 1."""
    if not tests:
        return []
    raw = [n / (n + HALF_LENGTH) for _, n in tests]
    scaled = [p * sum(raw) / len(raw) / w for (p, _), w in zip(tests, raw, strict=True)]
    order, limit = sorted(scaled), 0.0
    for i, p in enumerate(order, 1):
        if p <= rate * i / len(order):
            limit = p
    return [p <= limit and p <= rate for p in scaled]


def keys_of(run: str, start: int, taken: list[tuple[int, int]], level: int = 0) -> list[tuple[int, int, str | None]]:
    """The run or its parts to be weighed: start, end, and the alphabet, or none if the battery refuses it."""
    end = start + len(run)
    if len(run) < LEAST:
        return []
    code = encoding_of(run) if all(b <= start or a >= end for a, b in taken) else None
    random = code is not None and battery(run.rstrip("="), code[1]) >= LEVEL
    parts = [k for m in SPLITS[level].finditer(run) for k in keys_of(m[0], start + m.start(), taken, level + 1)] if level < len(SPLITS) else []
    if random:
        own = evidence(run, len(code[1]))
        if not any(order and (a, b) != (start, end) and evidence(run[a - start : b - start], len(order)) > own for a, b, order in parts):
            return [(start, end, code[1])]
    return parts or ([(start, end, None)] if code else [])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of sorted spans."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan(text: str) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind), by start, then kind in the order of KINDS."""
    spans: list[tuple[int, int, str]] = []
    if KEYWORD.search(text):
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    runs = list(RUN.finditer(text))
    if runs:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
        spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= 24]
        taken = sorted((a, b) for a, b, _ in spans)
        found, i = [], 0
        for m in runs:
            while i < len(taken) and taken[i][1] <= m.start():
                i += 1
            j = i
            while j < len(taken) and taken[j][0] < m.end():
                j += 1
            found += keys_of(m[0], m.start(), taken[i:j])
        if found:
            common = Counter(text)
            for a, b in [(a, b) for a, b, _ in found] + merged(taken):
                common.subtract(text[a:b])
            n = sum(common.values())
            tests = [(text_p(text[a:b].rstrip("="), len(order), common, n) if order else 1.0, b - a) for a, b, order in found]
            spans += [(a, b, "random") for (a, b, _), new in zip(found, discoveries(tests), strict=True) if new]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def scan_documents(documents: DataFrame) -> DataFrame:
    """Every row with its spans: an array of (start, end, kind) in code points, the end exclusive."""
    small_batches(documents.sparkSession)
    documents = without(documents, "spans")
    item = StructType().add("start", "long").add("end", "long").add("kind", "string")
    schema = StructType([*documents.schema, StructField("spans", ArrayType(item))])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"start": a, "end": b, "kind": k} for a, b, k in scan(t)] for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind)], names=[*batch.schema.names, "spans"])

    return documents.mapInArrow(run, schema)


def digest(documents: DataFrame) -> DataFrame:
    """Counts and checksums of the spans, for each row."""
    found = scan_documents(documents.select("doc_id", "text"))
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"] != "random")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.concat_ws(",", F.transform(spans, one))
    return found.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), n("random").alias("n_random"))


def redacted(text: str, spans: list[tuple[int, int, str]], mark: str = "<SECRET>") -> str:
    """The text with the union of the spans replaced by a mark."""
    out, at = [], 0
    for a, b, _ in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def base_sha256(spans: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans if k != "random").encode()).hexdigest()


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every row stays, with the secrets of its text replaced by a mark, and n_chars, if there is one, counted anew where they were.

    Null and empty texts stay as they are, as do all other columns, whatever their names; repeated rows stay as often as
    they occur; an empty table gives an empty result.
    """
    small_batches(spark)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(names, batch.columns, strict=True))
            texts = columns["text"].to_pylist()
            n = columns["n_chars"].to_pylist() if "n_chars" in columns else [None] * len(texts)
            for i, t in enumerate(texts):
                if t and (spans := scan(t)):
                    texts[i] = redacted(t, spans)
                    n[i] = len(texts[i])
            columns["text"] = pa.array(texts, columns["text"].type)
            if "n_chars" in columns:
                columns["n_chars"] = pa.array(n, columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    return docs.mapInArrow(run, docs.schema)
