"""Column expressions for change events: transaction ids, log positions, keys, sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tx_id(transaction: Column) -> Column:
    """The number before the colon of ``txId:lsn``; -1 without a transaction."""
    return F.coalesce(F.split_part(transaction, F.lit(":"), F.lit(1)).cast("long"), F.lit(-1).cast("long"))


def tx_lsn(transaction: Column) -> Column:
    return F.coalesce(F.split_part(transaction, F.lit(":"), F.lit(2)).cast("long"), F.lit(-1).cast("long"))


def tx_string(tx: Column, lsn: Column) -> Column:
    return F.concat_ws(":", tx.cast("string"), lsn.cast("string"))


def lsn_number(text: Column) -> Column:
    """A log position ``X/Y`` (two hexadecimal halves) as a number."""
    half = lambda i: F.conv(F.split_part(text, F.lit("/"), F.lit(i)), 16, 10).cast("decimal(20,0)")
    return (half(1) * F.lit(1 << 32).cast("decimal(20,0)") + half(2)).cast("long")


def size_pretty(size: Column) -> Column:
    """A byte count with a unit: below 10 of the next unit's thousands the smaller unit is used, rounded half up."""
    out = F.concat(size.cast("string"), F.lit(" bytes"))
    for power, unit in ((1, "kB"), (2, "MB"), (3, "GB"), (4, "TB"), (5, "PB")):
        whole = 1 << (10 * power)
        rounded = F.sign(size).cast("long") * F.floor((F.abs(size) + whole // 2) / whole)
        out = F.when(F.abs(size) >= F.lit(10 * (whole >> 10) * 1024 - (0 if power == 1 else (whole >> 11))), F.concat(rounded.cast("string"), F.lit(" " + unit))).otherwise(out)
    return out


def long_key(key: Column) -> Column:
    """A number as eight bytes, the highest first."""
    return F.unhex(F.lpad(F.hex(key), 16, "0"))


def full_match(text: Column, patterns: list[str]) -> Column:
    """Whether the whole text matches one of the patterns."""
    return text.rlike("^(?:" + "|".join(patterns) + ")$")


def epoch_date(days: Column) -> Column:
    return F.date_from_unix_date(days)


def day_text(date: Column) -> Column:
    """A date as year-month-day for any year: four digits at least from year 0 on, more without a sign; years before as they are."""
    year = F.year(date)
    digits = F.when(year.between(0, 999), F.lpad(year.cast("string"), 4, "0")).otherwise(year.cast("string"))
    return F.concat(digits, F.substring(date.cast("string"), -6, 6))


def lines_by_id(lines: Column) -> Column:
    return F.map_from_entries(F.transform(lines, lambda x: F.struct(x["id"], x)))


def map_put(m: Column, key: Column, value: Column) -> Column:
    """The map with an entry added or replaced."""
    return F.map_concat(F.map_filter(m, lambda k, _: k != key), F.create_map(key, value))


def map_remove(m: Column, key: Column) -> Column:
    return F.map_filter(m, lambda k, _: k != key)


def money(text: Column) -> Column:
    """Text as decimal(10,2); null where it isn't a number of that size."""
    return text.try_cast("decimal(10,2)")


def later(a: Column, b: Column) -> Column:
    """The greater of two log positions; a missing one doesn't count."""
    return F.greatest(a, b)


def utf8(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def json_field(text: Column, path: str) -> Column:
    """One field of a JSON text as text."""
    return F.get_json_object(text, f"$.{path}")
