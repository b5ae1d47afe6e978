"""Hierarchical packing of documents into training windows of several lengths.

A document's ids are cut into whole windows of the longest size; what is left is routed to the tier of the smallest
context size that holds it. Each buffer of pieces is then packed tier by tier from the longest down, into windows of the
tier's own size: a window opens with the tier's longest piece, and its gap is filled by the best-fitting pieces of the
shorter tiers, the last one cut to fit. All sizes are powers of two, and so are the windows into which the remainder at
the end of a partition is split, so none needs padding. A step group holds windows of one size, as many as make up STEP
of the longest: all groups but a partition's last of each size have the same number of ids and one shape.

The job is one narrow stage: each task encodes and packs its own rows within a bounded buffer, so nothing is shuffled
and a lost task is redone alone, with the same ids. Ids come from a cache of pre-token encodings in each worker.

Null texts read as empty: such a document has one id, the end mark. Null ids and repeated rows are packed like any
other row (each row is a document of its own). Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import json
import re
import sys
import zlib
from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from streamloom.llm.common import slices, small_batches, table, texts_of
from streamloom.llm.token_counts import tokenizer

VOCABULARY, SPECIAL = "byte_bpe_50k.json", "<|endoftext|>"
WINDOW, CACHE, MET = 1024, 400_000, 1 << 23
#: Ids that a buffer gathers before it is packed, and windows of the longest size whose ids a step group has.
BUFFER, STEP = 256 * WINDOW, 8
#: Pieces that are encoded as one text.
JOINED = 128
#: Marks that are a pre-token of their own after letters, if nothing follows.
MARKS = frozenset(".,;:!?")
#: A space before white space or the end; elsewhere every space starts a pre-token.
LOOSE = re.compile(r" (?:\s|\Z)")
BOUNDARY = re.compile(r"(?<=\S)(?= \S)")
SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"

#: A worker's cache, by path: the little-endian 32-bit ids of pieces of text, and which places of hashes were met. A piece is
#: kept from the second slice of texts on that has it: most occur once.
_caches: dict[str, tuple[dict[str, bytes], bytearray]] = {}


def pieces_of(text: str) -> list[str]:
    """The text cut where a pre-token must start, so that the encodings of the pieces join to that of the text.

    A piece that starts with its only space is given without it, any other one with a space put before it.
    """
    if LOOSE.search(text):
        return [" " + x for x in BOUNDARY.split(text)]
    out = text.split(" ")
    if out[0]:
        out[0] = " " + out[0]
        return out
    return out[1:]


@functools.cache
def opens(path: str) -> np.ndarray:
    """For each id of the vocabulary, whether it starts with a space."""
    vocabulary = tokenizer(path).get_vocab()
    out = np.zeros(max(vocabulary.values()) + 1, bool)
    out[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True
    return out


@functools.cache
def single_piece(path: str):
    """A faster encoder of the bytes of one pre-token, or none.

    Where the vocabulary's merges are numbered in their order, merging by rank, as the other library does, gives the
    same ids: a token's parts are merged before any other pair that would make it.
    """
    model = json.loads(tokenizer(path).to_str())
    merges = [m if isinstance(m, str) else "".join(m) for m in model["model"].get("merges", [])]
    vocabulary = model["model"].get("vocab", {})
    pattern = (model.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not model.get("normalizer")
    if not pattern or [vocabulary.get(m.replace(" ", "")) for m in merges] != list(range(256, 256 + len(merges))):
        return None
    import tiktoken

    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    ranks = {bytes(byte[c] for c in t): i for t, i in vocabulary.items() if t != SPECIAL}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


def encode_words(words: list[str], path: str) -> list[bytes]:
    """The ids of each word with a space before it. Words of letters only are one pre-token, with one of MARKS after them two."""
    single = single_piece(path)
    if single is None:
        return encode_joined(words, path)
    out: list[bytes | None] = []
    for w in words:
        if w.isalpha():
            out.append(as_bytes(single((" " + w).encode())))
        elif w[-1] in MARKS and w[:-1].isalpha():
            out.append(as_bytes(single((" " + w[:-1]).encode()) + single(w[-1].encode())))
        else:
            out.append(None)
    rest = iter(encode_joined([w for w, x in zip(words, out, strict=True) if x is None], path))
    return [next(rest) if x is None else x for x in out]


def encode_joined(words: list[str], path: str) -> list[bytes]:
    """The ids of each word with a space before it. Many are encoded as one text, which is cut where an id starts with a space."""
    encode, out = tokenizer(path).encode_batch_fast, []
    for lo in range(0, len(words), JOINED):
        part = words[lo : lo + JOINED]
        ids = np.array(encode([" " + " ".join(part)], add_special_tokens=False)[0].ids, "<u4")
        starts = np.flatnonzero(opens(path).take(ids)) * 4
        if len(starts) != len(part) or starts[0]:
            out += [as_bytes(e.ids) for e in encode([" " + w for w in part], add_special_tokens=False)]
        else:
            raw, starts = ids.tobytes(), starts.tolist()
            out += map(raw.__getitem__, map(slice, starts, [*starts[1:], len(raw)]))
    return out


def as_bytes(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def encode_all(texts: list[str], path: str) -> list[bytes]:
    """The ids of each text, as little-endian unsigned 32-bit integers."""
    cache, met = _caches.setdefault(path, ({}, bytearray(MET)))
    odd, flat, ends = [], [], []
    for i, t in enumerate(texts):
        if SPECIAL in t:
            odd.append(i)
        else:
            flat += pieces_of(t)
        ends.append(len(flat))
    found = list(map(cache.get, flat))
    unknown = [i for i, x in enumerate(found) if x is None] if None in found else []
    if unknown:
        missed = list(dict.fromkeys(map(flat.__getitem__, unknown)))
        words, others = [w for w in missed if w[0] != " "], [w[1:] for w in missed if w[0] == " "]
        fresh = dict(zip(words, encode_words(words, path), strict=True))
        for w, e in zip(others, tokenizer(path).encode_batch_fast(others, add_special_tokens=False), strict=True):
            fresh[" " + w] = as_bytes(e.ids)
        for i in unknown:
            found[i] = fresh[flat[i]]
        if len(cache) > CACHE:
            cache.clear()
        places = [hash(w) % MET for w in missed]
        cache.update((w, fresh[w]) for w, k in zip(missed, places, strict=True) if met[k])
        for k in places:
            met[k] = 1
    out = [b"".join(found[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
    if odd:
        for i, e in zip(odd, tokenizer(path).encode_batch_fast([texts[i] for i in odd], add_special_tokens=False), strict=True):
            out[i] = as_bytes(e.ids)
    return out


class TierPacker:
    """Packs the pieces of one task. ``sizes``: the tiers' context sizes, powers of two, longest first."""

    def __init__(self, base: int, sizes: tuple[int, ...] = (1024, 512, 256, 128, 64)):
        self.sizes, self.window = sizes, sizes[0]
        self.tiers: dict[int, list[tuple]] = {s: [] for s in sizes}
        self.base, self.next, self.held = base, 0, 0
        self.steps, self.open = 0, {}
        self.out: list[tuple] = []

    def route(self, piece: tuple) -> None:
        """piece: length, order of arrival, row, start, crc's bytes, ids of the document."""
        insort(self.tiers[min(s for s in self.sizes if s >= piece[0])], piece)

    def emit(self, pieces: list[tuple], size: int) -> None:
        """One window, in the open step group of its size."""
        if size not in self.open:
            self.open[size], self.steps = (self.steps, 0), self.steps + 1
        step, offset = self.open[size][0], 0
        for length, _, row, start, ids, n in pieces:
            self.out.append((row, start, length, zlib.crc32(ids), n, self.base + self.next, offset, size, self.base + step))
            offset += length
        self.next += 1
        held = self.open[size][1] + size
        if held >= STEP * self.window:
            del self.open[size]
        else:
            self.open[size] = (step, held)

    def add(self, row: object, ids: bytes, arrival: int) -> None:
        n, w = len(ids) // 4, self.window
        whole = n - n % w
        for s in range(0, whole, w):
            self.emit([(w, arrival, row, s, ids[4 * s : 4 * (s + w)], n)], w)
        if n > whole:
            self.route((n - whole, arrival, row, whole, ids[4 * whole :], n))
            self.held += n - whole
        if self.held >= BUFFER:
            self.pack()

    def longest(self, most: int) -> tuple | None:
        """Takes the longest piece of at most ``most`` ids, from the longest tier that has one."""
        for s in self.sizes:
            tier = self.tiers[s]
            if tier and (i := bisect_right(tier, (most, float("inf")))):
                return tier.pop(i - 1)
        return None

    def fill(self, size: int) -> list[tuple]:
        """A window of exactly ``size`` ids, or of all that is left."""
        window, gap = [], size
        while gap:
            piece = self.longest(gap)
            if piece is None:  # none fits whole: the shortest is cut
                tier = next((self.tiers[s] for s in reversed(self.sizes) if self.tiers[s]), None)
                if tier is None:
                    break
                length, arrival, row, start, ids, n = tier.pop(0)
                piece = (gap, arrival, row, start, ids[: 4 * gap], n)
                self.route((length - gap, arrival, row, start + gap, ids[4 * gap :], n))
            window.append(piece)
            gap -= piece[0]
        self.held -= size - gap
        return window

    def pack(self) -> None:
        for size in self.sizes:
            while self.tiers[size] and self.held >= size:
                self.emit(self.fill(size), size)

    def finish(self) -> None:
        self.pack()
        while self.held:
            size = 1 << (self.held.bit_length() - 1)
            self.emit(self.fill(size), size)


def pack(documents: DataFrame, path: str | None = None) -> DataFrame:
    """One row for each piece: its document, place there, checksum and place in a sequence.

    ``tier`` is the length of the sequence, 1024, 512 and so on to 64, or less at a partition's end, always a power of two,
    so no sequence needs padding. ``step_group`` numbers groups of sequences of one length and equal id counts.
    """
    small_batches(documents.sparkSession)
    path = path or public_tokenizers.path(VOCABULARY)
    kind = documents.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = TierPacker(TaskContext.get().partitionId() << 36)
        arrival, id_type = 0, None

        def drained() -> pa.RecordBatch:
            rows, packer.out = packer.out, []
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            types = [id_type, *[pa.int64()] * 6, pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            id_type = batch.column("doc_id").type
            rows, texts = batch.column("doc_id").to_pylist(), texts_of(batch)
            for a, b in slices(texts):
                for row, ids in zip(rows[a:b], encode_all(texts[a:b], path), strict=True):
                    packer.add(row, ids + b"\0\0\0\0", arrival)
                    arrival += 1
                if packer.out:
                    yield drained()
        packer.finish()
        if packer.out:
            yield drained()

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {SCHEMA}")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the kept documents as pieces of training sequences."""
    return pack(docs)
