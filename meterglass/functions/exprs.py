"""Column expressions for gateway fields. All are built-ins, so they stay inside generated code."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

DECIMAL = "decimal(38,0)"
BAD = -1
SHORT, PLACES = "decimal(18,9)", 12  # of values that are summed as decimals, and of their means


def hex_to_decimal(h: Column) -> Column:
    """Hex digits as DECIMAL(38,0); null and '' give null; junk and values beyond 38 digits give -1."""
    digits = F.regexp_replace(h, "^0+(?=.)", "")
    padded = F.lpad(digits, 45, "0")
    part = lambda i: F.conv(F.substring(padded, 1 + 15 * i, 15), 16, 10).cast(DECIMAL)
    scaled = lambda i, power: F.try_multiply(part(i), F.lit(Decimal(16**power)))
    value = F.try_add(F.try_add(scaled(0, 30), scaled(1, 15)), part(2)).cast(DECIMAL)
    bad = F.lit(BAD).cast(DECIMAL)
    return F.when(h.isNull() | (h == ""), F.lit(None).cast(DECIMAL)).when(~h.rlike("^[0-9A-Fa-f]+$") | (F.length(digits) > 32), bad).otherwise(F.coalesce(value, bad))


def fraction_to_double(s: Column, bad: str = "sentinel") -> Column:
    """'4/5' as 0.8. Null stays null; what is no fraction, or has a zero below, gives -1.0 (bad="null": null)."""
    fits = s.rlike(r"^\s*[+-]?\d+\s*/\s*[+-]?\d+\s*$")
    part = lambda i: F.trim(F.split(s, "/").getItem(i)).try_cast("int").cast("double")
    wrong = F.lit(None).cast("double") if bad == "null" else F.lit(float(BAD))
    return F.when(s.isNull(), F.lit(None).cast("double")).when(fits, F.coalesce(F.try_divide(part(0), part(1)), wrong)).otherwise(wrong)


def reverse_octets(h: Column) -> Column:
    """Hex octets in reverse order; an odd last digit is an octet of its own."""
    return F.array_join(F.reverse(F.regexp_extract_all(h, F.lit("(.{1,2})"), 1)), "")


def data_rate(s: Column) -> tuple[Column, Column]:
    """Spreading factor and bandwidth of 'SF7BW125' as longs; -1 where the text does not match."""
    group = lambda i: F.regexp_extract(s, r"SF(\d+)BW(\d+)", i)
    one = lambda i: F.when(F.length(group(i)) > 0, group(i).try_cast("long")).when(s.isNotNull(), F.lit(BAD).cast("long"))
    return one(1), one(2)


def json_tail(s: Column) -> Column:
    """The JSON object that follows a datagram's binary header; '' if there is none."""
    return F.regexp_extract(s, r'(\{"(?:rxpk|stat)".*)', 1)


def cflist_split(c: Column) -> tuple[Column, Column]:
    """(list without its last octet, that octet); null and '' give nulls."""
    some = c.isNotNull() & (c != "")
    return F.when(some, F.substring(c, F.lit(1), F.length(c) - 2)), F.when(some, F.right(c, F.lit(2)))


def exact_mean(x: Column) -> Column:
    """An aggregate: the mean of doubles where it and each of them is a short decimal, whatever the order they come in, else null.

    A mean may equal a value, the edge of a bin or a tie of its rounding. It does so to the last bit only if nothing was rounded on the way."""
    short = x.try_cast(SHORT)
    mean = F.try_divide(F.sum(short), F.count(x).cast("decimal(10,0)"))
    exact = F.bool_and(F.coalesce(short.cast("double") == x, x.isNull())) & (F.round(mean, PLACES) == mean)
    return F.when(exact, mean.cast("double"))


def base64_to_hex(s: Column) -> Column:
    return F.hex(F.unbase64(s))


def distinct_values(own: Column, others: Column) -> Column:
    """Own value, then the others: distinct, without nulls and NaNs."""
    merged = F.array_union(F.array(own), F.coalesce(others, F.array()))
    return F.filter(merged, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")))


def pick(values: Column, i: int) -> Column:
    """Element i (from 0) or null."""
    return F.when(F.size(values) > i, F.get(values, F.lit(i)))


def known(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def duration_text(seconds: float) -> str:
    """Seconds as '500 ms', '1 min 1 s' or '1 h 1 min 1 s'."""
    if seconds < 1:
        ms = round(seconds * 1000)
        return f"{ms} ms" if ms < 1000 else "1 s"
    whole = round(seconds)
    hours, minutes, rest = whole // 3600, whole % 3600 // 60, whole % 60
    return " ".join(f"{n} {unit}" for n, unit in ((hours, "h"), (minutes, "min"), (rest, "s")) if n) or "0 s"


def duration(seconds: Column) -> Column:
    """duration_text of a column."""
    ms, whole = F.bround(seconds * 1000, 0).cast("long"), F.bround(seconds, 0).cast("long")
    part = lambda n, unit: F.when(n != 0, F.concat(n.cast("string"), F.lit(f" {unit}")))
    long = F.concat_ws(" ", part(F.floor(whole / 3600), "h"), part(F.floor(whole % 3600 / 60), "min"), part(whole % 60, "s"))
    return F.when(seconds < 1, F.when(ms < 1000, F.concat(ms.cast("string"), F.lit(" ms"))).otherwise("1 s")).otherwise(F.when(long == "", "0 s").otherwise(long))
