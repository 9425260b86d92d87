"""Columns for amounts, rates and codes: integer minor units, basis points and thousandths, never floats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean


def pence(text: Column) -> Column:
    """A signed sterling figure as integer pence; null for any other shape or more than two decimals."""
    return pence_of(F.translate(clean(text), ",£ ", ""))


def pence_of(bare: Column) -> Column:
    """``pence`` of a figure without blanks, commas and signs of currency."""
    return F.when(bare.rlike(r"^[+-]?[0-9]+(?:\.[0-9]{1,2})?$"), (bare.try_cast("decimal(21,2)") * 100).try_cast("bigint"))


def grouped(digits: Column) -> Column:
    """The last three digits, then groups of two."""
    head = F.reverse(F.regexp_replace(F.reverse(F.substring(digits, 1, 1000)), r"^([0-9]{3})(?=[0-9])", "$1,"))
    first, last = F.substring_index(head, ",", 1), F.substring_index(head, ",", -1)
    pairs = F.reverse(F.regexp_replace(F.reverse(first), r"([0-9]{2})(?=[0-9])", "$1,"))
    return F.when(F.length(digits) > 3, F.concat(pairs, F.lit(","), last)).otherwise(digits)


def over(a: Column, b: Column) -> Column:
    """a div b in integers, towards zero; null for b = 0."""
    return F.call_function("div", a, F.nullif(b, F.lit(0)))


def formatted(paise: Column) -> Column:
    """``₹-4,200.50``: the sign inside the symbol, always two decimals."""
    size = F.abs(paise)
    return F.concat(F.lit("₹"), F.when(paise < 0, "-").otherwise(""), grouped(over(size, F.lit(100)).cast("string")), F.lit("."), F.lpad((size % 100).cast("string"), 2, "0"))


def scaled_rate(n: Column, d: Column, scale: int) -> Column:
    """n of d, times ``scale``, rounded half up in integers; null if d is 0. Products are decimals, so none overflows."""
    n, d = n.cast("decimal(19,0)"), d.cast("decimal(19,0)")
    return F.when(d > 0, over(F.lit(2 * scale) * n + d, F.lit(2) * d).cast("bigint"))


def tax_inside(amount: Column, basis_points: Column) -> Column:
    """The tax that an inclusive amount holds, rounded down (towards minus infinity for refunds)."""
    top, below = amount.cast("decimal(19,0)") * basis_points.cast("decimal(10,0)"), basis_points.cast("decimal(10,0)") + F.lit(10000)
    return over(top - F.pmod(top, below), below).cast("bigint")


def basis_points(text: Column) -> Column:
    """``18%`` as 1800; null if it isn't exact."""
    value = F.regexp_extract(F.trim(text), r"^([0-9]+(?:\.[0-9]+)?)\s*%$", 1).try_cast("decimal(20,6)") * 100
    return F.when(value % 1 == 0, value.cast("bigint"))


def thousandths(text: Column) -> Column:
    """``2.5`` as 2500; null if it isn't exact."""
    value = F.regexp_extract(F.trim(text), r"^([0-9]+(?:\.[0-9]+)?)$", 1).try_cast("decimal(20,6)") * 1000
    return F.when(value % 1 == 0, value.cast("bigint"))


def tax_id(text: Column) -> Column:
    """A well-formed 15-character tax id; else null. Its first two digits are the state's."""
    up = F.upper(F.trim(text))
    return F.when(up.rlike(r"^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9A-Z]Z[0-9A-Z]$"), up)


def goods_code(text: Column) -> Column:
    """struct(code, kind) of a 4, 6 or 8 digit code: chapter 99 is a service, the rest goods; null for any other."""
    bare = F.trim(text)
    return F.when(bare.rlike(r"^[0-9]{4}([0-9]{2}){0,2}$"), F.struct(bare.alias("code"), F.when(bare.startswith("99"), "SAC").otherwise("HSN").alias("kind")))


def crore(paise: Column) -> Column:
    """Paise as crores with two decimals, exact; null if hundredths of a crore don't divide it."""
    hundredths = over(paise, F.lit(10_000_000))
    return F.when(paise % 10_000_000 == 0, F.format_string("%s%d.%02d", F.when(paise < 0, "-").otherwise(""), over(F.abs(hundredths), F.lit(100)), F.abs(hundredths) % 100))


def spend_date(text: Column) -> Column:
    """``03/11/2025`` or ``04-Nov-25``, whatever the machine's locale; null for any other shape and for days that don't exist."""
    return date_of(clean(text))


def date_of(bare: Column) -> Column:
    """``spend_date`` of a cleaned text."""
    slash, named = r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$", r"^([0-9]{1,2})-([A-Za-z]{3})-([0-9]{2})$"
    months = F.array(*map(F.lit, "jan feb mar apr may jun jul aug sep oct nov dec".split()))
    part = lambda k: F.regexp_extract(bare, named, k)
    number = F.array_position(months, F.lower(part(2)))
    a = F.regexp_replace(bare, slash, "$3-$2-$1")
    b = F.concat_ws("-", F.concat(F.lit("20"), part(3)), F.lpad(number.cast("string"), 2, "0"), F.lpad(part(1), 2, "0"))
    return F.when(bare.rlike(slash), a.try_cast("date")).when(bare.rlike(named) & (number > 0), b.try_cast("date"))
