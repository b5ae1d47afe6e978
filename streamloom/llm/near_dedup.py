"""Near-duplicate detection by BagMinHash over multisets of five-word shingles.

A shingle that occurs w times in a text has weight w. For each shingle, independent Poisson processes run over the
dyadic weight intervals [0,1), [1,2), [2,4), [4,8) and so on, at a rate equal to the interval's length. Each point has a
time, a signature component and a place in its interval, all from a hash of the shingle, so they are the same in every
text; a point counts if its place, discretised to whole weights, lies below the text's weight. A component's value is
its earliest point, and two texts share it with a probability equal to their weighted Jaccard similarity. All processes
of a batch advance together, and a process stops once its time exceeds the largest component of its text.

Texts with equal multisets are one class. Signatures of classes are banded; in every bucket each class is compared with
the bucket's hub, the class with the most bucket mates overall, which links a group of any size by about as many pairs
as it has members. After the components of these links are known, what shares a bucket but not a component is compared
too, less the pairs that a parity bitmap of the two multisets rules out: the bits that differ are at most as many as
the elements that do, so this bound loses nothing. It prunes texts of up to some thousand shingles; longer ones are left
to the verification. Every candidate pair is verified by the exact similarity of the two multisets. Groups are the connected components of the verified links, found by alternating
large-star and small-star steps.

Words are lower-cased and split at white space. A text of one to four words is one shingle. Texts without words (null,
empty, blank) are no one's duplicate: each is its own class and group. Rows with a null id take no part and get null
classes. Rows that share an id are compared each for itself, by its own text. Every class and group is named by its
smallest id, so two groups that have the same smallest id, which different texts share, have the same name. Repeated rows get
one result each. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamloom.llm.common import cut, mix64, slices, small_batches, table, texts_of

SHINGLE, THRESHOLD = 5, 0.8
#: 24 bands of 4: a pair of similarity 0.8 shares none with probability 3e-6.
BANDS, ROWS = 24, 4
SIZE = BANDS * ROWS
#: Shared components below which a pair isn't verified: at 0.8, five standard deviations below the mean.
LEAST = 0.6
#: Bits of the parity bitmap.
BITS = 1024
CACHE = 250_000
#: Members of a bucket that one task compares with the rest of it, and pairs of a hub that one task verifies.
SHARE, PAIRS = 1024, 512
#: Shares of a group's rows in joins by group.
SALTS = 16
#: Ids of 8 bytes that may be broadcast.
FEW = 100_000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def golden(k: int) -> np.uint64:
    return np.uint64(k * int(GOLDEN) & 0xFFFFFFFFFFFFFFFF)


class Words(dict):
    """A worker's cache of word hashes."""

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_words = Words()


def bags_of(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its shingles, sorted, and how often each occurs; all texts are hashed together."""
    words = [t.lower().split() for t in texts]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    h = np.fromiter(map(_words.__getitem__, chain.from_iterable(words)), np.uint64, int(lengths.sum()))
    h = np.concatenate([h, np.zeros(SHINGLE, np.uint64)])
    width, counts = np.minimum(lengths, SHINGLE), np.where(lengths > 0, np.maximum(lengths - SHINGLE + 1, 1), 0)
    ends = np.cumsum(counts)
    at = np.arange(int(counts.sum())) + np.repeat(np.cumsum(lengths) - lengths - ends + counts, counts)
    width = np.repeat(width, counts)
    x = width.astype(np.uint64)
    for k in range(SHINGLE):
        y = mix64(x + GOLDEN) + h[at + k]
        x = np.where(width > k, y, x) if len(width) and width.min() <= k else y
    x = mix64(x)
    new = np.ones(len(x), bool)
    for lo, hi in zip((ends - counts).tolist(), ends.tolist(), strict=True):
        x[lo:hi].sort()
    new[1:] = x[1:] != x[:-1]
    new[(ends - counts)[counts > 0]] = True
    first = np.flatnonzero(new)
    n, x = np.diff(np.append(first, len(x))), x[first]
    split = np.searchsorted(first, ends).tolist()
    return [(x[lo:hi], n[lo:hi]) for lo, hi in zip([0, *split], split, strict=False)]


def bag_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    return bags_of([text])[0]


def alike(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The exact similarity of two multisets: the sum of minima over the sum of maxima."""
    (x, n), (y, m) = a, b
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], m[j]).sum())
    total = int(n.sum() + m.sum()) - both
    return both / total if total else 0.0


def overlap(a: str, b: str) -> float:
    return alike(bag_of(a), bag_of(b))


def print_of(bag: tuple[np.ndarray, np.ndarray]) -> str | None:
    """128 bits of a multiset; null for an empty one."""
    return xxhash.xxh3_128_hexdigest(bag[0].tobytes() + bag[1].tobytes()) if len(bag[0]) else None


def signatures(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """(texts, SIZE) components as unsigned 32-bit integers; a text without shingles has zeros."""
    out = np.full((len(bags), SIZE), np.inf)
    seeds, weights, docs = (np.concatenate(x) if bags else np.zeros(0) for x in ([b[0] for b in bags], [b[1] for b in bags], [np.full(len(b[0]), i, np.int64) for i, b in enumerate(bags)]))
    seed, low, length, weight, doc = [], [], [], [], []
    level, lo, size = 0, 0, 1
    at = np.arange(len(seeds))
    while len(at):  # one process for each shingle and interval that its weight reaches
        seed.append(mix64(seeds[at] + golden(level + 1)))
        low.append(np.full(len(at), float(lo)))
        length.append(np.full(len(at), float(size)))
        weight.append(weights[at].astype(float))
        doc.append(docs[at])
        lo, size, level = (1, 1, 1) if level == 0 else (lo * 2, size * 2, level + 1)
        at = at[weights[at] > lo]
    if not seed:
        return np.zeros((len(bags), SIZE), np.uint32)
    seed, low, length, weight, doc = map(np.concatenate, (seed, low, length, weight, doc))
    time, flat, turn = np.zeros(len(seed)), out.reshape(-1), 0
    most = np.full(len(bags), np.inf)
    while len(seed):
        turn += 1
        r = mix64(seed + golden(turn))
        time = time - np.log1p(-((r >> np.uint64(11)).astype(float) * 2.0**-53)) / length
        r = mix64(r + GOLDEN)
        place = (r & np.uint64(0xFFFFFFFF)).astype(float) * 2.0**-32
        component = ((r >> np.uint64(32)) * np.uint64(SIZE)) >> np.uint64(32)
        counts = np.floor(low + place * length) < weight
        np.minimum.at(flat, doc[counts] * SIZE + component[counts].astype(np.int64), time[counts])
        if turn < 8 or turn % 8 == 0:
            most = out.max(axis=1)
        go = time < most[doc]
        seed, low, length, weight, doc, time = (x[go] for x in (seed, low, length, weight, doc, time))
    out[np.isinf(out)] = 0
    return (mix64(out.view(np.uint64)) >> np.uint64(32)).astype(np.uint32)


def band_hashes(sig: np.ndarray) -> np.ndarray:
    """(texts, BANDS) 64-bit bucket keys."""
    x = np.zeros((len(sig), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    cols = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    for k in range(ROWS):
        x = mix64(x * GOLDEN + cols[:, :, k])
    return x.view(np.int64)


def parities_of(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """(texts, BITS / 64) 64-bit integers: each bit tells if an odd number of the multiset's elements falls on it."""
    x, n = (np.concatenate([b[i] for b in bags]) for i in (0, 1))
    occurrence = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = mix64(np.repeat(x, n) + GOLDEN * (occurrence + 1).astype(np.uint64)) % np.uint64(BITS)
    doc = np.repeat(np.arange(len(bags)), [int(b[1].sum()) for b in bags])
    odd = np.bincount(doc * BITS + at.astype(np.int64), minlength=len(bags) * BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(len(bags), BITS // 64)


def parities(bag: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return parities_of([bag])[0]


def sketched(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, print (of the multiset; null without words), n (shingles), sig, bands, bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, texts = batch.column("doc_id"), batch.column("text_hash"), texts_of(batch)
            for a, b in slices(texts):
                bags = bags_of(texts[a:b])
                sig = signatures(bags)
                prints = [print_of(bag) for bag in bags]
                n = [int(m.sum()) for _, m in bags]
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(bags) * BANDS + 1, BANDS, dtype=np.int32)), pa.array(band_hashes(sig).ravel()))
                bits = pa.ListArray.from_arrays(pa.array(np.arange(0, len(bags) * BITS // 64 + 1, BITS // 64, dtype=np.int32)), pa.array(parities_of(bags).ravel()))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), hashes.slice(a, b - a), pa.array(prints, pa.string()), pa.array(n, pa.int64()), pa.array([s.tobytes() for s in sig], pa.binary()), bands, bits], names=["doc_id", "text_hash", "print", "n", "sig", "bands", "bits"])
        _words.clear()  # a worker lives longer than its task

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, print string, n long, sig binary, bands array<long>, bits array<long>")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component), for each node of edges(a, b)."""
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    while not stars_only(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        e = cut(small.filter("u != v").distinct())
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def stars_only(edges: DataFrame) -> bool:
    """Whether the distinct edges (u, v), u > v, are stars around their smallest node: then each u has one edge and is no v."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e")).select("e.*")
    tangled = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up > 0 and down > 0)")
    return tangled.isEmpty()


def texts_of_classes(wanted: DataFrame, documents: DataFrame) -> DataFrame:
    """node, text for wanted(node, first, print): one text that has the print, from the rows with the id ``first``."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            for a, b in slices(texts):
                same = [print_of(bag) == p for bag, p in zip(bags_of(texts[a:b]), batch.column("print").slice(a, b - a).to_pylist(), strict=True)]
                yield batch.slice(a, b - a).select(["node", "text"]).filter(pa.array(same, pa.bool_()))
        _words.clear()

    # Few ids go to the texts, as their number has been counted; otherwise the texts are dealt to the ids.
    sent = F.broadcast(wanted) if wanted.count() <= FEW else wanted
    rows = documents.select(F.col("doc_id").cast("long").alias("first"), "text").join(sent, "first").select("node", "print", "text")
    return rows.mapInArrow(own, "node long, text string").groupBy("node").agg(F.min("text").alias("text"))


def verified(pairs: DataFrame, classes: DataFrame, documents: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose multisets overlap enough: first by signatures, then exactly by texts."""
    x = classes.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"))
    y = classes.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"))

    def likely_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, q = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, SIZE) for c in ("sig_a", "sig_b"))
            keep = pa.array((p == q).mean(axis=1) >= LEAST)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(keep)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = texts_of(batch, "text_a"), texts_of(batch, "text_b")
            keep: list[bool] = []
            for a, b in slices(left):
                own = list(dict.fromkeys(left[a:b] + right[a:b]))  # a hub's text comes many times
                bags = dict(zip(own, bags_of(own), strict=True))
                keep += [alike(bags[p], bags[q]) >= THRESHOLD for p, q in zip(left[a:b], right[a:b], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
        _words.clear()

    likely = cut(pairs.join(x, "a").join(y, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(likely_of, "a long, b long"))
    ends = likely.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    held = texts_of_classes(cut(ends.join(classes.select("node", "first", "print"), "node")), documents)
    # A hub is in as many pairs as its group has members: these are dealt in shares, each with the hub's text.
    hubs = cut(likely.groupBy("b").agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("shares")).filter("shares > 1"))
    hubs = F.broadcast(hubs) if hubs.count() <= FEW else hubs
    one = F.coalesce("shares", F.lit(1))
    left = likely.join(hubs, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), one).cast("int").alias("share"))
    right = held.select(F.col("node").alias("b"), F.col("text").alias("text_b")).join(hubs, "b", "left").select("b", "text_b", F.explode(F.sequence(F.lit(0), one - 1)).alias("share"))
    full = left.join(held.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(right, ["b", "share"])
    return full.select("a", "b", "text_a", "text_b").mapInArrow(exact, "a long, b long").distinct()


def may_link(p: str, q: str) -> Column:
    """Whether the sizes and bitmaps of rows ``p`` and ``q`` allow a similarity of THRESHOLD."""
    n, m = F.col(f"{p}.n"), F.col(f"{q}.n")
    differ = sum((F.bit_count(F.col(f"{p}.bits")[i].bitwiseXOR(F.col(f"{q}.bits")[i])) for i in range(BITS // 64)), F.lit(0))
    fits = F.least(n, m) >= F.lit(THRESHOLD) * F.greatest(n, m)
    return fits & (differ <= (n + m) * F.lit((1 - THRESHOLD) / (1 + THRESHOLD) + 1e-9))


def grouped(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, first (smallest id of the rows with an equal multiset) and root (a number of the group) for each row; null where it takes no part."""
    small_batches(documents.sparkSession)
    rows = cut(sketched(documents))
    full = rows.filter("print is not null and doc_id is not null")
    # A class has a number of its own, fixed by the checkpoint: ids only name it.
    classes = full.groupBy("print").agg(F.min("doc_id").alias("first"), *[F.first(c).alias(c) for c in ("n", "sig", "bands", "bits")])
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    # Buckets that hold one class only are dropped first: most are.
    buckets = classes.select(F.explode(F.array_distinct("bands")).alias("key"), "node", "n")
    sizes = buckets.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    shared = cut(buckets.join(sizes, "key"))
    degrees = shared.groupBy("node").agg(F.sum("size").alias("degree"))
    hubs = shared.join(degrees, "node").groupBy("key").agg(F.max(F.struct("degree", "node", "n")).alias("hub"))
    stars = shared.join(hubs, "key").select(F.col("node").alias("a"), F.col("hub.node").alias("b"), "n", F.col("hub.n").alias("m"))
    stars = stars.filter((F.col("a") != F.col("b")) & (F.least("n", "m") >= F.lit(THRESHOLD) * F.greatest("n", "m"))).select("a", "b").distinct()
    links = cut(verified(stars, classes, documents))
    roots = cut(components(links))
    # Across components that share a bucket: the join itself applies the bitmaps, so only pairs that may link are made.
    placed = shared.join(roots, "node", "left").select("key", "size", "node", "n", F.coalesce("root", "node").alias("root"))
    apart = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("key")
    placed = cut(placed.join(apart, "key", "left_semi").join(classes.select("node", "bits"), "node").withColumn("shares", F.ceil(F.col("size") / SHARE).cast("int")))
    # A large bucket is dealt in shares, each compared with the whole of it.
    p = placed.withColumn("share", F.pmod(F.xxhash64("node"), F.col("shares")).cast("int")).alias("p")
    q = placed.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).alias("q")
    near = (F.col("p.key") == F.col("q.key")) & (F.col("p.share") == F.col("q.share")) & (F.col("p.root") < F.col("q.root")) & may_link("p", "q")
    rest = p.join(q, near).select(F.greatest("p.node", "q.node").alias("a"), F.least("p.node", "q.node").alias("b")).distinct()
    more = cut(verified(rest, classes, documents))
    # The new links join whole components, so only the components' roots are joined anew.
    at = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
    across = more.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    top = cut(components(across)).select(F.col("node").alias("root"), F.col("root").alias("top"))
    merged = roots.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    alone = top.select(F.col("root").alias("node"), F.col("top").alias("root")).join(roots.select("node"), "node", "left_anti")
    roots = merged.unionByName(alone)
    named = classes.select("print", "node", "first").join(roots, "node", "left").select("print", "first", F.coalesce("root", "node").alias("root"))
    return rows.select("doc_id", "text_hash", "print").join(named, "print", "left").select("doc_id", "text_hash", F.when(F.col("doc_id").isNotNull(), F.col("first")).alias("first"), F.when(F.col("doc_id").isNotNull(), F.col("root")).alias("root"))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, copy_of (smallest id with an equal multiset) and class_id (smallest id of the group), for each row."""
    found = cut(grouped(documents))
    names = found.filter("root is not null").groupBy("root").agg(F.min("first").alias("class_id"), F.max("first").alias("last"))
    names = cut(names.filter("class_id != last").select("root", "class_id"))  # a group of one class has its name
    if names.count() <= FEW:
        out = found.join(F.broadcast(names), "root", "left")
    else:  # a group may hold a third of all rows
        salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SALTS)))
        out = salted.join(names.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["root", "salt"], "left")
    return out.select("doc_id", F.coalesce("first", "doc_id").alias("copy_of"), F.coalesce("class_id", "first", "doc_id").alias("class_id"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group the row with the smallest id stays (of its texts, if it has several in the group, that with the smallest hash), once.

    Texts without words aren't copies of each other: all of them stay, as do rows without an id. Columns stay as they are,
    whatever their names. An empty table gives an empty result.
    """
    found = cut(grouped(docs))
    best = found.filter("root is not null").groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("r")).select("r.doc_id", "r.text_hash")
    # How often the row that stays occurs: only repeated ones have to be brought together.
    times = found.filter("root is not null").groupBy("doc_id", "text_hash").agg(F.count("*").alias("times"))
    wordless = found.filter("root is null and doc_id is not null").select("doc_id", "text_hash").distinct().withColumn("times", F.lit(1).cast("long"))
    kept = cut(best.join(times, ["doc_id", "text_hash"]).unionByName(wordless).select(F.struct("doc_id", "text_hash").alias("r"), "times"))
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), key.alias("k"), F.col("doc_id").isNull().alias("free"))
    taken, same = rows.filter("not free"), F.col("k") == F.col("r")
    once = taken.join(kept.filter("times = 1"), same, "left_semi")
    repeated = taken.join(kept.filter("times > 1"), same, "left_semi").dropDuplicates(["k"])
    return once.unionByName(repeated).unionByName(rows.filter("free")).select("d.*")


#: The same in SQL, for another engine: all pairs of texts that share a shingle, exactly. White space is Python's.
SQL = f"""WITH RECURSIVE texts AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x09-\\x0D\\x1C-\\x20\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+'), lambda w: w <> '') AS words FROM documents),
 prints AS (SELECT doc_id, CASE WHEN doc_id IS NULL OR len(words) = 0 THEN NULL WHEN len(words) <= {SHINGLE} THEN [words] ELSE list_sort(list_transform(range(1, len(words) - {SHINGLE - 2}), lambda i: words[i : i + {SHINGLE - 1}])) END AS print FROM texts),
 classes AS (SELECT row_number() OVER () AS node, print, min(doc_id) AS first FROM prints WHERE print IS NOT NULL GROUP BY print),
 bags AS (SELECT node, x, count(*) AS n FROM (SELECT node, unnest(print) AS x FROM classes) GROUP BY 1, 2),
 shared AS (SELECT a.node AS a, b.node AS b, sum(least(a.n, b.n)) AS n FROM bags a JOIN bags b ON a.x = b.x AND a.node <> b.node GROUP BY 1, 2),
 links AS (SELECT a, b FROM shared JOIN classes p ON p.node = a JOIN classes q ON q.node = b WHERE n::DOUBLE / (len(p.print) + len(q.print) - n) >= {THRESHOLD}::DOUBLE),
 reached AS (SELECT node, node AS other FROM classes UNION SELECT r.node, l.b FROM reached r JOIN links l ON l.a = r.other),
 named AS (SELECT r.node, min(c.first) AS class_id FROM reached r JOIN classes c ON c.node = r.other GROUP BY 1)
 SELECT p.doc_id, coalesce(c.first, p.doc_id) AS copy_of, coalesce(n.class_id, p.doc_id) AS class_id FROM prints p LEFT JOIN classes c ON c.print = p.print LEFT JOIN named n ON n.node = c.node"""
