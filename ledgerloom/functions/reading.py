"""Columns that read dates, amounts and names out of printed text, and say why they don't.

What can be read in two ways is not read: the result names the doubt. Everything is a Column, so a reader runs over a table of lines.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a line, without empty ones."""
    return F.array_remove(F.split(text, r"\s+"), "")


# Dates

MONTHS = "January February March April May June July August September October November December".split()
#: Fixed value: two-digit years up to this one are of this century.
PIVOT = 68
DAY_FIRST, NO_ORDER, EITHER = "day first", "no order", "either order"
#: The three shapes of a printed date.
_ISO = r"(?<![0-9])([0-9]{4})([-/])([0-9]{1,2})\2([0-9]{1,2})(?![0-9])"
_SPELT = r"(?<![0-9])([0-9]{1,2})[ -]+([A-Za-z]{3,9})\.?[ -]+([0-9]{4})(?![0-9])"
_FIGURES = r"(?<![0-9])([0-9]{1,2})([-/.])([0-9]{1,2})\2([0-9]{4}|[0-9]{2})(?![0-9])"
_DAYS = "array<struct<value:date,ambiguous:boolean,candidates:array<date>,why:string>>"


def _day(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")).try_cast("date")


def _reading(value: Column, ambiguous: Column, candidates: Column, why: Column) -> Column:
    return F.struct(value.alias("value"), ambiguous.alias("ambiguous"), candidates.alias("candidates"), why.alias("why"))


def _certain(value: Column) -> Column:
    return let(value, lambda v: _reading(v, F.lit(False), F.array_compact(F.array(v)), F.when(v.isNull(), "no such day").otherwise("")))


def _every(text: Column, shape: str, groups: tuple[int, ...], use: Callable[[Column], Column]) -> Column:
    found = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(shape), F.lit(g)).alias(f"g{g}") for g in groups])
    return F.transform(found, use)


def _in_order(first: Column, second: Column, year: Column, order: str) -> Column:
    day_first, month_first = _day(year, second, first), _day(year, first, second)
    if order == DAY_FIRST:
        return _certain(day_first)
    nothing = F.lit(None).cast("date")

    def told(days: Column) -> Column:
        two = F.size(days) > 1
        if order == NO_ORDER:
            return _reading(nothing, two, days, F.when(F.size(days) == 0, "no such day").otherwise("no order is assumed"))
        return _reading(F.when(~two, F.get(days, F.lit(0))), two, days, F.when(F.size(days) == 0, "no such day").when(two, "day and month can change places").otherwise(""))

    return let(F.array_distinct(F.array_compact(F.array(day_first, month_first))), told)


def date(text: Column, order: str) -> Column:
    """struct(value, ambiguous, candidates, why) of the one date that a text states.

    A date that begins with its year or names its month says its own order. Of plain figures ``order`` decides: day first; no order (never read); either
    order, if only one is a real day. Dotted figures need a four-digit year, or they are a clause or version. The same date twice
    is one date, two different ones are none. A null text has no date.
    """
    spelt = {m.upper()[:3]: k for k, m in enumerate(MONTHS, 1)} | {m.upper(): k for k, m in enumerate(MONTHS, 1)} | {"SEPT": 9}
    number = F.create_map(*[F.lit(x) for kv in spelt.items() for x in kv])
    text = F.coalesce(text, F.lit(""))
    iso = _every(text, _ISO, (1, 3, 4), lambda m: _certain(_day(m["g1"], m["g3"], m["g4"])))
    named = F.filter(_every(text, _SPELT, (1, 2, 3), lambda m: F.struct(m["g1"].alias("d"), number[F.upper(m["g2"])].alias("m"), m["g3"].alias("y"))), lambda m: m["m"].isNotNull())
    named = F.transform(named, lambda m: _certain(_day(m["y"], m["m"], m["d"])))
    century = lambda y: F.when(F.length(y) == 4, y.cast("int")).when(y.cast("int") <= PIVOT, y.cast("int") + 2000).otherwise(y.cast("int") + 1900)
    plain = F.filter(F.arrays_zip(*[F.regexp_extract_all(text, F.lit(_FIGURES), F.lit(g)).alias(f"g{g}") for g in (1, 2, 3, 4)]), lambda m: ~((m["g2"] == ".") & (F.length(m["g4"]) == 2)))
    plain = F.transform(plain, lambda m: let(century(m["g4"]), lambda y: _in_order(m["g1"], m["g3"], y, order)))
    nothing = F.lit(None).cast("date")

    def one(found: Column) -> Column:
        some = F.array_sort(F.array_distinct(F.flatten(F.transform(found, lambda r: r["candidates"]))))
        several = _reading(nothing, F.lit(False), some, F.lit("several dates"))
        none = _reading(nothing, F.lit(False), F.array().cast("array<date>"), F.lit("no date"))
        same = F.size(F.array_distinct(F.transform(found, lambda r: F.struct(r["value"], r["ambiguous"], r["candidates"])))) == 1
        return F.when(F.size(found) == 0, none).when(same, F.get(found, F.lit(0))).otherwise(several)

    return let(F.concat(iso, named, plain).cast(_DAYS), one)


# Amounts

#: Spellings of currencies; what a shared sign may stand for; minor digits; the character that each currency's home uses as decimal mark.
CURRENCIES = {
    "INR": "INR", "INR.": "INR", "RS": "INR", "RS.": "INR", "₹": "INR", "USD": "USD", "US$": "USD", "EUR": "EUR", "€": "EUR", "GBP": "GBP", "£": "GBP",
    "IDR": "IDR", "RP": "IDR", "RP.": "IDR", "JPY": "JPY", "AED": "AED", "$": "UNKNOWN", "¥": "UNKNOWN",
}
SHARED_SIGNS = {"$": "USD", "¥": "JPY"}
MINOR_DIGITS = {"INR": 2, "USD": 2, "EUR": 2, "GBP": 2, "AED": 2, "IDR": 0, "JPY": 0}
DECIMAL_MARKS = {"INR": ".", "USD": ".", "GBP": ".", "AED": ".", "JPY": ".", "EUR": ",", "IDR": ","}
UNKNOWN = "UNKNOWN"
_AMOUNT = r"((?<![0-9.,])[-−]?[0-9](?:[0-9.,]*[0-9])?(?![0-9]))(\s*%)?"


def _spellings() -> str:
    out = []
    for word in sorted(CURRENCIES, key=lambda w: -len(w)):
        left, right = "(?<![A-Za-z])" if word[0].isalpha() else "", "(?![A-Za-z])" if word[-1].isalpha() else ""
        out.append(left + "".join(f"\\{c}" if c in "$." else c for c in word) + right)
    return "|".join(out)


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def money(text: Column) -> Column:
    """struct(minor, code, symbol, ambiguous, why) of the one amount that a text states, in minor units of its currency.

    The sign or code beside the figure names the currency; if there is none, or one that several currencies share, the only one named anywhere in the
    text does (a shared sign: only what it may stand for). Rates (18 %) are no amounts. Grouping and decimal marks are told apart by their
    number, order and last group; one mark before three digits goes by the currency. More decimals than the currency has, an unknown currency
    without exactly two decimals, or different amounts in one text are not read. A null text has no amount.
    """
    alias = f"(?i)({_spellings()})"
    codes = _map(CURRENCIES)

    def located(m: Column) -> Column:
        at = F.array_position(m["rates"], "").cast("int") - 1
        before, after = F.get(m["pieces"], at), F.get(m["pieces"], at + 1)
        lead = F.regexp_extract(before, alias + r"\s*$", 1)
        symbol = F.when(lead != "", lead).otherwise(F.regexp_extract(after, r"^\s*" + alias, 1))
        return F.struct(F.get(m["figures"], at).alias("figure"), symbol.alias("symbol"))

    def denominated(a: Column) -> Column:
        direct = codes[F.upper(a["symbol"])]
        stated = F.filter(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(alias), F.lit(0)), lambda s: codes[F.upper(s)])), lambda c: c != UNKNOWN)
        allowed = F.filter(stated, lambda c: (a["symbol"] == "") | (c == _map(SHARED_SIGNS)[a["symbol"]]))
        code = F.when(direct != UNKNOWN, direct).otherwise(let(allowed, lambda s: F.when(F.size(s) == 1, F.get(s, F.lit(0))).otherwise(UNKNOWN)))
        return F.struct(a["figure"].rlike("^[-−]").alias("negative"), F.regexp_replace(a["figure"], "^[-−]", "").alias("body"), a["symbol"].alias("symbol"), F.coalesce(code, F.lit(UNKNOWN)).alias("code"))

    def split(a: Column) -> Column:
        body, marks = a["body"], F.regexp_replace(a["body"], "[0-9]", "")
        last = F.length(F.regexp_extract(body, r"[.,]([0-9]*)$", 1))
        both = F.contains(marks, F.lit(".")) & F.contains(marks, F.lit(","))
        decimal = F.when(marks == "", False).when(both, True).when(F.length(marks) > 1, False).when(last != 3, True).when(body.startswith("0"), True).otherwise(marks == _map(DECIMAL_MARKS)[a["code"]])
        doubt = F.when((marks == "") | both, "").when(F.length(marks) > 1, F.when(last != 3, "marks that can be neither").otherwise("")).when((last == 3) & ~body.startswith("0") & (a["code"] == UNKNOWN), "one mark that can be either").otherwise("")
        whole = F.when(decimal, F.regexp_extract(body, r"^(.*)[.,][0-9]*$", 1)).otherwise(body)
        return F.struct(a["negative"].alias("negative"), a["symbol"].alias("symbol"), a["code"].alias("code"), F.regexp_replace(whole, "[.,]", "").alias("whole"), F.when(decimal, F.regexp_extract(body, r"[.,]([0-9]*)$", 1)).otherwise("").alias("fraction"), doubt.alias("doubt"))

    def scaled(a: Column) -> Column:
        size = F.length(a["fraction"])
        digits = F.when(a["code"] != UNKNOWN, _map(MINOR_DIGITS)[a["code"]]).when(size == 2, 2)
        value = F.concat(a["whole"], a["fraction"], F.repeat(F.lit("0"), F.greatest(F.lit(0), digits - size))).try_cast("bigint")
        why = F.when(a["doubt"] != "", a["doubt"]).when(digits.isNull(), "minor digits are unknown").when(size > digits, "finer than the minor unit").when(value.isNull(), "too large")
        unpinned = F.when(a["code"] == UNKNOWN, "currency is not stated").otherwise("")
        signed = F.when(a["negative"], -value).otherwise(value)
        return _amount(F.when(why.isNull(), signed), a["code"], a["symbol"], why.isNotNull() | (unpinned != ""), F.coalesce(why, unpinned))

    def one(m: Column) -> Column:
        distinct = F.size(F.array_distinct(F.transform(F.filter(F.arrays_zip(m["figures"].alias("f"), m["rates"].alias("r")), lambda x: x["r"] == ""), lambda x: x["f"])))
        nothing = F.lit(None).cast("bigint")
        none = _amount(nothing, F.lit(UNKNOWN), F.lit(""), F.lit(False), F.lit("no amount"))
        several = _amount(nothing, F.lit(UNKNOWN), F.lit(""), F.lit(True), F.lit("several amounts"))
        return F.when(distinct == 0, none).when(distinct > 1, several).otherwise(let(let(let(located(m), denominated), split), scaled))

    text = F.coalesce(text, F.lit(""))
    found = F.struct(F.regexp_extract_all(text, F.lit(_AMOUNT), F.lit(1)).alias("figures"), F.regexp_extract_all(text, F.lit(_AMOUNT), F.lit(2)).alias("rates"), F.split(text, _AMOUNT, -1).alias("pieces"))
    return let(found, one)


def _amount(minor: Column, code: Column, symbol: Column, ambiguous: Column, why: Column) -> Column:
    return F.struct(minor.alias("minor"), code.alias("code"), symbol.alias("symbol"), ambiguous.alias("ambiguous"), why.alias("why"))


#: What a printed amount is decorated with.
DECORATIONS = ("RS.", "RS", "INR", "GBP", "₹", "£", "$", " ", ",", " ")


def paise(text: Column) -> Column:
    """A decorated printed amount as integer paise; null for any other shape and for parts of a paisa."""
    shown = F.trim(text)
    bare = F.regexp_replace(F.upper(shown), r"RS\.|RS|INR|GBP|[₹£$\x{A0}, ]", "")
    exact = F.regexp_extract(bare, r"^-?[0-9]+(?:\.[0-9]+)?$", 0).try_cast("decimal(38,10)") * 100
    # what most amounts look like is told by its shape alone, as a decimal is dear and a cast that fails dearer
    plain = lambda v: F.when(v.rlike(r"^-?[0-9]{1,15}\.[0-9]{2}\z"), F.replace(v, F.lit("."), F.lit("")).try_cast("bigint")).when(v.rlike(r"^-?[0-9]{1,15}\z"), v.try_cast("bigint") * 100)
    return F.coalesce(plain(shown), F.when(bare.rlike(r"^-?[0-9]+(?:\.[0-9]+)?$"), F.coalesce(plain(bare), F.when(exact % 1 == 0, exact.try_cast("bigint")))))


# Misreadings

#: Characters that frame a page; fewest letters of a name; letters from which a name needs a vowel.
FURNITURE, FEW_LETTERS, WANTS_VOWEL = "|¦_=~^`*<>{}[]", 3, 8


def artifacts(text: Column) -> Column:
    """What tells that a name was misread: array of furniture, mixed (letters and digits in a word), case (flips inside a word), short, no vowel. Blank text: none."""
    text = F.trim(text)
    words, letters = words_of(text), F.regexp_replace(text, r"[^\p{L}]", "")
    framed = F.length(F.translate(text, FURNITURE, "")) < F.length(text)
    mixed = F.exists(words, lambda w: w.rlike(r"^[A-Za-z0-9]{4,}$") & w.rlike("[A-Za-z]") & w.rlike("[0-9]"))
    flips = F.exists(words, lambda w: w.rlike(r"[A-Z][a-z][A-Z]") | w.rlike(r"[a-z][A-Z].*[a-z][A-Z]"))
    voiceless = (F.length(letters) >= WANTS_VOWEL) & ~letters.rlike("[AEIOUaeiou]")
    said = F.array_compact(F.array(F.when(framed, "furniture"), F.when(mixed, "mixed"), F.when(flips, "case"), F.when(F.length(letters) < FEW_LETTERS, "short"), F.when(voiceless, "no vowel")))
    return F.when(text != "", said).otherwise(F.array().cast("array<string>"))


#: Words beside a figure that say what it is; how a currency may decorate it.
COUNTED = ("QUANTITY", "QTY", "NOS", "PCS", "PIECES", "UNITS")
CLASSED = ("HSN", "SAC")
DIALLED = ("PHONE", "TEL", "TELEPHONE", "MOB", "MOBILE", "CONTACT", "FAX", "HELPLINE")
REFERRED = ("INVOICE", "BILL", "REF", "ORDER", "CHALLAN", "GSTIN", "PAN")
CURRENCY = r"(?:RS\.?|INR|GBP|₹|£)"


def beside(context: Column) -> Column:
    """What the words around a figure can say of it, as bits: a rate, counted, classed, dialled, referred to. That of two texts with a blank between is both bits together."""
    up = F.upper(context)
    named = lambda words: F.when(reduce(Column.__or__, [F.contains(up, F.lit(w)) for w in words]), up.rlike(r"\b(?:" + "|".join(words) + r")\b"))
    said = (context.contains("%"), named(COUNTED), named(CLASSED), named(DIALLED), named(REFERRED))
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(c, 1 << k).otherwise(0) for k, c in enumerate(said)])


def not_money(value: Column, context: Column) -> Column:
    """Why a figure isn't an amount, by its shape and the words around it; empty if nothing speaks against it. The first of eight reasons counts."""
    return not_money_beside(value, beside(context))


def not_money_beside(value: Column, bits: Column) -> Column:
    """``not_money`` of a figure with ``beside`` of its context. A short plain amount with nothing beside it is told by its shape alone."""
    plain = (bits == 0) & value.rlike(r"^[0-9]{1,5}(?:\z|[0-9]{0,2}\.[0-9]{2}\z)")
    return F.when(plain, "").otherwise(let(F.struct(value.alias("v"), bits.alias("b")), lambda x: _not_money(x["v"], x["b"])))


def _not_money(value: Column, bits: Column) -> Column:
    v = F.trim(value)
    rated, counted, classed, dialled, referred = (bits.bitwiseAND(1 << k) != 0 for k in range(5))
    shape = r"^([0-9]{1,4})([/.-])([0-9]{1,2})\2([0-9]{1,4})$"
    number = lambda x: F.nullif(x, F.lit("")).try_cast("int")  # noqa: E731  a cast that fails is dear
    a, m, b = (number(F.regexp_extract(v, shape, k)) for k in (1, 3, 4))
    day = lambda x: x.between(1, 31)
    year = lambda x: x.between(1900, 2199)
    dated = v.rlike(r"^[0-9]{1,2}[\s/.-]*[A-Za-z]{3,9}[\s/.-]*[0-9]{2,4}$") | F.when(v.rlike(shape), F.coalesce(m.between(1, 12) & (day(a) & ((b <= 99) | year(b)) | year(a) & day(b)), F.lit(False))).otherwise(False)
    small = number(F.regexp_extract(v, r"^([0-9]{1,3})(?:\.[0-9]{1,2})?$", 1))
    rate = value.contains("%") | rated & F.coalesce(small <= 100, F.lit(False))
    dial = F.regexp_replace(value, "[^0-9+]", "")
    phone = dial.rlike(r"^\+|^(?:91)?[6-9][0-9]{9}$|^0[0-9]{10}$") | dialled & v.rlike(r"^[0-9 +()-]+$") & (F.length(dial) >= 6)
    bare = F.trim(F.regexp_replace(v, f"(?i)^{CURRENCY}|{CURRENCY}$", ""))
    numbered = value.contains("#") | bare.rlike("[A-Za-z]") & bare.rlike("[0-9]") | referred & v.rlike("^[0-9]{7,}$")
    reasons = (
        (dated, "a date"), (rate, "a percentage"), (counted & v.rlike(r"^[0-9]{1,6}(?:\.[0-9]{1,3})?$"), "a quantity"), (classed & v.rlike("^(?:[0-9]{4}|[0-9]{6}|[0-9]{8})$"), "a classification code"),
        (phone, "a phone number"), (v.rlike("^[0-9]{6}$"), "a postal code"), (numbered, "a document number"), (paise(value).isNull(), "a malformed amount"),
    )
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), name) for c, name in reasons], F.lit(""))
