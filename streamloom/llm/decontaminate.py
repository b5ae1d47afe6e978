"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

A text's template replaces each number by a number mark, each unit of measurement after a number by a unit mark, and
each capitalised word inside a sentence by a name mark; words are then lower-cased and cut at other characters than
letters and digits. Windows of template words are hashed and equi-joined to those of the benchmark. Matches are
grouped into alignments (document, item, shift). In an alignment the words behind the marks are compared: a
re-parameterised copy maps each number, unit or name of the item to one value throughout, so an alignment in which one
value maps to two is inconsistent and doesn't count. A document is contaminated by an item if the consistent
alignments cover enough of the item's windows.

Windows have eight words, of which four at least must be plain (an item that has no such window keeps all of its
windows); an item shorter than that is one window of all its words, looked up among windows of that length.

Null texts read as empty. Empty documents and empty items match nothing. Rows with a null id take part, and their
matches carry the null. Rows with the same id, of documents or of the benchmark, are compared each for itself and
reported once, by the best match. Every match that reaches
the threshold is returned, so ties need no rule. Extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamloom.llm.common import cut, table

#: Words of a window, plain words in it, and the share of an item's windows that must be found.
WINDOW, PLAIN, COVER = 8, 4, 0.6
#: Benchmark windows up to which they are broadcast (about 30 bytes each); more are joined by a shuffle.
BROADCAST = 1_000_000
UNITS = "mm cm m km mg g kg ml l s ms min h hr hours minutes seconds days miles feet inches dollars euros percent usd eur"
#: Marks from the private-use area, which count as letters here.
NAME, NUMBER, UNIT = "\ue000", "\ue001", "\ue002"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), rf"[^\p{{L}}\p{{M}}\p{{N}}{NAME}{NUMBER}{UNIT}]+"), "")


def template(text: Column) -> Column:
    """The words with marks: as many words, at the same places, as the text itself has."""
    named = F.regexp_replace(text, r"(?<=[\p{L}\p{N},;] )\p{Lu}\p{Ll}[\p{L}\p{M}]*", NAME)
    numbered = F.regexp_replace(named, r"\p{N}+", NUMBER)
    return words(F.regexp_replace(numbered, rf"(?<={NUMBER} ?)(?:{'|'.join(sorted(UNITS.split(), key=len, reverse=True))})\b", UNIT))


def windows(rows: DataFrame, sizes: list[int], *keys: str) -> DataFrame:
    """keys, ``size``, ``at`` and ``hash`` of every window of each of the sizes in the words of the array column ``words``, in one pass."""
    hashes = lambda k: F.transform(F.sequence(F.lit(1), F.size("words") - (k - 1)), lambda i: F.xxhash64(F.slice("words", i, k)))
    rows = rows.filter(F.size("words") >= min(sizes))
    if len(sizes) == 1:
        return rows.select(*keys, F.lit(sizes[0]).alias("size"), F.posexplode(hashes(sizes[0])).alias("at", "hash"))
    named = lambda k: F.transform(hashes(k), lambda h, i: F.struct(F.lit(k).alias("size"), i.alias("at"), h.alias("hash")))
    each = [F.when(F.size("words") >= k, named(k)) for k in sizes]
    none = F.array().cast("array<struct<size:int,at:int,hash:bigint>>")
    return rows.select(*keys, F.explode(F.concat(*[F.coalesce(x, none) for x in each])).alias("w")).select(*keys, "w.*")


def few(df: DataFrame) -> DataFrame:
    """``df``, for a join: counted, and broadcast only if it is small."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= BROADCAST else df


def inconsistent(hits: DataFrame, rows: DataFrame, items: DataFrame) -> DataFrame:
    """The alignments (row, item_id, shift) in which a value behind a mark of the item maps to two in the document."""
    slotted = hits.filter("slots").select("row", "item_id", "shift", "item_at", "size").distinct()
    wanted = slotted.select("row").distinct()
    said = rows.join(wanted, "row", "left_semi").select("row", words(F.col("text")).alias("said"), template(F.col("text")).alias("kinds")).dropDuplicates(["row"])
    place = F.explode(F.sequence(F.lit(0), F.col("size") - 1))
    at = slotted.select("row", "item_id", "shift", "item_at", place.alias("i")).select("row", "item_id", "shift", (F.col("item_at") + F.col("i")).alias("place")).distinct()
    both = at.join(said, "row").select("row", "item_id", "shift", "place", F.try_element_at("said", (F.col("place") + F.col("shift") + 1).cast("int")).alias("word"), F.try_element_at("kinds", (F.col("place") + F.col("shift") + 1).cast("int")).alias("kind"))
    both = both.filter(F.col("kind").rlike(f"[{NAME}{NUMBER}{UNIT}]"))
    own = items.select(F.col("item_id").alias("i_id"), F.posexplode("said").alias("i_place", "item_word"))
    both = both.join(few(own), (F.col("item_id") == F.col("i_id")) & (F.col("place") == F.col("i_place")))
    found = both.groupBy("row", "item_id", "shift", "kind", "item_word").agg(F.min("word").alias("lo"), F.max("word").alias("hi"))
    return found.filter("lo != hi").select(F.col("row").alias("b_row"), F.col("item_id").alias("b_item"), F.col("shift").alias("b_shift")).distinct()


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, cover: float = COVER) -> DataFrame:
    """doc_id, item_id, windows found, windows of the item, and their ratio, for each contaminated document."""
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct().withColumn("key", F.xxhash64("item_id", "text"))
    names = items.select(F.col("key").alias("n_key"), F.col("item_id").alias("name"))
    items = items.select(F.col("key").alias("item_id"), template(F.col("text")).alias("words"), words(F.col("text")).alias("said")).withColumn("size", F.least(F.size("words"), F.lit(window))).filter("size > 0")
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect()) or [window]  # ``window`` values at most
    # Rows are told apart by 128 bits of their ids and texts.
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.struct(F.xxhash64("doc_id", "text").alias("a"), F.xxhash64("text", "doc_id").alias("b")))
    docs = rows.select("doc_id", "row", template(F.col("text")).alias("words"))
    marked = lambda w: w.rlike(f"[{NAME}{NUMBER}{UNIT}]")
    mine = items.select("item_id", "size", "words", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1), lambda i: F.xxhash64(F.slice("words", i, F.col("size"))))).alias("item_at", "hash"))
    mine = mine.select("item_id", "size", "item_at", "hash", F.size(F.filter(F.slice("words", F.col("item_at") + 1, F.col("size")), marked)).alias("marks"))
    most = mine.groupBy("item_id").agg(F.min("marks").alias("least"))
    mine = mine.join(most, "item_id").filter(F.col("marks") <= F.greatest(F.col("size") - PLAIN, "least"))
    mine = few(mine.select("item_id", "size", "item_at", "hash", (F.col("marks") > 0).alias("slots")))
    hits = windows(docs, sizes, "doc_id", "row").join(mine, ["size", "hash"])
    found = cut(hits.select("doc_id", "row", "item_id", (F.col("at") - F.col("item_at")).alias("shift"), "item_at", "slots", "size"))
    broken = inconsistent(found, rows, items)
    same = (F.col("row") == F.col("b_row")) & (F.col("item_id") == F.col("b_item")) & (F.col("shift") == F.col("b_shift"))
    counts = found.join(broken, same, "left_anti").groupBy("doc_id", "row", "item_id").agg(F.countDistinct("item_at").alias("found"))
    total = few(mine.groupBy("item_id").agg(F.count("*").alias("windows")))
    out = counts.join(total, "item_id").filter(F.col("found") >= F.lit(cover) * F.col("windows"))
    out = out.join(few(names), F.col("item_id") == F.col("n_key")).groupBy("doc_id", F.col("name").alias("item_id"))
    out = out.agg(F.max(F.struct((F.col("found") / F.col("windows")).alias("share"), "found", "windows")).alias("top")).select("doc_id", "item_id", "top.found", "top.windows")
    return out.withColumn("share", F.round(F.col("found") / F.col("windows"), 6))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows whose id has a text that holds a benchmark item go; null and empty texts hold none.

    The other rows stay as they are, repeated ones as often as they occur, with all columns, whatever their names. An
    empty table gives an empty result.
    """
    bad = contamination(docs, table(spark, sf_dir, "benchmark")).select(F.struct("doc_id").alias("bad")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))
    return rows.join(bad, F.col("d.doc_id").eqNullSafe(F.col("bad.doc_id")), "left_anti").select("d.*")


_class = rf"\p{{L}}\p{{M}}\p{{N}}{NAME}{NUMBER}{UNIT}"
_units = "|".join(sorted(UNITS.split(), key=len, reverse=True))
_words = lambda text: f"list_filter(string_split_regex(lower({text}), '[^{_class}]+'), lambda w: w <> '')"
# Without look-behind a name that follows another one is found by a second pass.
_named = lambda text, extra: f"regexp_replace({text}, '([\\p{{L}}\\p{{N}},;{extra}] )\\p{{Lu}}\\p{{Ll}}[\\p{{L}}\\p{{M}}]*', '\\1{NAME}', 'g')"
_marked = f"regexp_replace(regexp_replace({_named(_named('text', ''), NAME)}, '\\p{{N}}+', '{NUMBER}', 'g'), '({NUMBER} ?)(?:{_units})\\b', '\\1{UNIT}', 'g')"
#: The same in SQL, for another engine; windows are compared word by word.
SQL = f"""WITH items AS (SELECT row_number() OVER () AS item, item_id, {_words(_marked)} AS words, {_words('text')} AS said FROM (SELECT DISTINCT item_id, coalesce(text, '') AS text FROM benchmark)),
 sized AS (SELECT *, least(len(words), {WINDOW}) AS size FROM items WHERE len(words) > 0),
 parts AS (SELECT item, size, words, unnest(range(len(words) - size + 1)) AS item_at FROM sized),
 counted AS (SELECT item, size, item_at, words[item_at + 1 : item_at + size] AS win, len(list_filter(words[item_at + 1 : item_at + size], lambda w: regexp_matches(w, '[{NAME}{NUMBER}{UNIT}]'))) AS marks FROM parts),
 mine AS (SELECT *, marks > 0 AS slots FROM (SELECT *, min(marks) OVER (PARTITION BY item) AS least_marks FROM counted) WHERE marks <= greatest(size - {PLAIN}, least_marks)),
 docs AS (SELECT row_number() OVER () AS doc_row, doc_id, {_words(_marked)} AS words, {_words('text')} AS said FROM (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents)),
 places AS (SELECT doc_row, doc_id, words, s.size, unnest(range(len(words) - s.size + 1)) AS pos FROM docs, (SELECT DISTINCT size FROM mine) s WHERE len(words) >= s.size),
 hits AS (SELECT p.doc_row, p.doc_id, m.item, p.pos - m.item_at AS shift, m.item_at, m.size, m.slots FROM (SELECT doc_row, doc_id, size, pos, words[pos + 1 : pos + size] AS win FROM places) p JOIN mine m ON m.size = p.size AND m.win = p.win),
 slotted AS (SELECT DISTINCT doc_row, item, shift, unnest(range(item_at, item_at + size)) AS place FROM hits WHERE slots),
 said AS (SELECT s.doc_row, s.item, s.shift, d.words[s.place + s.shift + 1] AS kind, i.said[s.place + 1] AS item_word, d.said[s.place + s.shift + 1] AS word FROM slotted s JOIN docs d ON d.doc_row = s.doc_row JOIN items i ON i.item = s.item),
 broken AS (SELECT DISTINCT doc_row, item, shift FROM (SELECT doc_row, item, shift FROM said WHERE regexp_matches(kind, '[{NAME}{NUMBER}{UNIT}]') AND item_word IS NOT NULL GROUP BY doc_row, item, shift, kind, item_word HAVING min(word) <> max(word))),
 kept AS (SELECT h.doc_id, h.doc_row, h.item, count(DISTINCT h.item_at) AS found FROM hits h LEFT JOIN broken b ON b.doc_row = h.doc_row AND b.item = h.item AND b.shift = h.shift WHERE b.doc_row IS NULL GROUP BY 1, 2, 3),
 total AS (SELECT item, count(*) AS windows FROM mine GROUP BY 1)
 SELECT doc_id, i.item_id, found, windows, round(found::DOUBLE / windows, 6) AS share FROM kept JOIN total USING (item) JOIN items i USING (item) WHERE found >= {COVER} * windows
 QUALIFY row_number() OVER (PARTITION BY doc_id, i.item_id ORDER BY found::DOUBLE / windows DESC, found DESC, windows DESC) = 1"""
