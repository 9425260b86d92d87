"""Reading fields from the lines of documents: values under labels, figures near them, parties, tables, and the wide row of a document.

Lines are rows (doc_id, line_no from 0, text). What a rule asks of one line is a Column over it; what it asks of neighbours is an equi-join on document and
line; what it asks of a page is an aggregate by document. Two printings that disagree are never chosen from.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import money as M
from ..functions import reading as R

#: Labels of each field.
LABELS = {
    "total": ("GRAND TOTAL", "TOTAL DUE", "AMOUNT PAYABLE", "AMOUNT DUE", "TOTAL", "NET PAYABLE", "TOTAL PAYABLE", "BALANCE DUE", "SUM TOTAL", "FINAL AMOUNT", "AMOUNT"),
    "tax": ("OUTPUT TAX", "INPUT TAX", "IGST", "GST", "TAX", "GST AMOUNT", "TAX AMOUNT"),
    "net": ("TOTAL BEFORE TAX", "SUBTOTAL", "NET AMOUNT", "NET", "TAXABLE VALUE", "PRE-TAX"),
    "cgst": ("CGST",),
    "sgst": ("SGST",),
    "utgst": ("UTGST",),
    "party": ("SUPPLIER", "VENDOR", "BILLED BY", "SOLD BY"),
    "number": ("TAX INVOICE NO", "INVOICE NUMBER", "INVOICE NO", "DOCUMENT NO", "INVOICE #", "INV NO"),
    "date": ("DATE", "INVOICE DATE", "BILL DATE", "DATED", "SUPPLY DATE"),
    "po": ("PURCHASE ORDER NO", "PURCHASE ORDER", "ORDER NUMBER", "PO NUMBER", "ORDER NO", "PO NO"),
    "place": ("PLACE OF SUPPLY",),
    "igst": ("IGST",),
    "cess": ("COMPENSATION CESS", "CESS"),
    "round_off": ("ROUNDING OFF", "ROUND OFF", "ROUND-OFF", "ROUNDED OFF", "ROUNDING", "R/OFF"),
    "irn": ("INVOICE REFERENCE NUMBER", "IRN"),
    "eway": ("E-WAY BILL NUMBER", "EWAY BILL NUMBER", "E-WAY BILL NO", "EWAY BILL NO", "E-WAY BILL", "EWB NO"),
    "address": ("ADDRESS",),
    "words": ("AMOUNT CHARGEABLE IN WORDS", "TOTAL IN WORDS", "AMOUNT IN WORDS", "RUPEES IN WORDS", "IN WORDS"),
}
MONEY_FIELDS, TEXT_FIELDS = ("total", "tax", "net", "cgst", "sgst", "utgst"), ("party", "number", "date", "po", "place")
#: Headings of the two parties; a word before a label that makes it another; score of what was found by place; lines of a page's head.
SECTIONS = {"supplier": ("SUPPLIER", "BILLED BY", "SOLD BY", "SELLER", "VENDOR", "FROM"), "buyer": ("BILLED TO", "CONSIGNEE", "CUSTOMER", "BILL TO", "SHIP TO", "SOLD TO", "BUYER")}
MODIFIER, BY_PLACE, HEAD = "SUB", 0.5, 10
#: How a candidate was found, best first.
METHODS = ("same_line", "next_line", "previous_line")
#: Names of table columns and what they hold, and how many of them make a header.
COLUMNS = (
    ("DESCRIPTION OF GOODS", "description"), ("PARTICULARS", "description"), ("DESCRIPTION", "description"), ("ITEM", "description"), ("HSN/SAC", "hsn_sac"), ("HSN CODE", "hsn_sac"), ("SAC", "hsn_sac"), ("HSN", "hsn_sac"),
    ("QUANTITY", "quantity"), ("QTY", "quantity"), ("UOM", "unit"), ("UNIT", "unit"), ("UNIT PRICE", "rate"), ("RATE", "rate"), ("DISCOUNT", "discount"), ("DISC", "discount"), ("TAXABLE VALUE", "taxable"), ("TAXABLE", "taxable"),
    ("GST RATE", "gst_rate"), ("TAX RATE", "gst_rate"), ("CGST", "cgst"), ("SGST", "sgst"), ("UTGST", "sgst"), ("IGST", "igst"), ("CESS", "cess"), ("LINE TOTAL", "line_total"), ("AMOUNT", "line_total"), ("TOTAL", "line_total"),
)
ENOUGH_NAMES = 3


def _loose(label: str) -> str:
    """A label's characters with white space anywhere between them."""
    return r"\s*".join(re.sub(r"([^A-Za-z0-9 ])", r"\\\1", c) for c in label)


def _closed(text: Column) -> Column:
    """A line in upper case without white space: wherever a label is printed, however loosely, its characters stand here side by side."""
    return reduce(lambda c, blank: F.replace(c, F.lit(blank), F.lit("")), " \t\n\x0b\f\r", F.upper(text))


def _begins(closed: Column, fields: tuple[str, ...]) -> Column:
    """Whether a line, ``_closed``, begins with a label of the fields."""
    return reduce(Column.__or__, [closed.startswith(x) for x in sorted({x.replace(" ", "") for f in fields for x in LABELS[f]})])


def _may_name(text: Column, fields: tuple[str, ...]) -> Column:
    """Whether a line can hold a label of the fields, however its words are set; never false for one that does."""
    bare = {re.sub("[^A-Z0-9]", "", label) for f in fields for label in LABELS[f]}
    least = sorted(x for x in bare if not any(y in x for y in bare if y != x))  # a label within another stands for it
    return F.upper(text).rlike("|".join("[^A-Z0-9]*".join(x) for x in least)) | text.rlike(r"[^\x00-\x7F]")


_FOUND = "array<struct<field:string,label_no:int,value:string>>"


def _opened(rows: DataFrame, found: Column, *columns: str) -> DataFrame:
    """The columns and the fields of each struct of an array, which is worked out once; a row with an empty one stays, with nulls (what would drop it first would work the array out for that too)."""
    return rows.select(*columns, found.alias("found")).select(*columns, F.inline_outer("found"))


def _said(field: str, label_no: int | None, value: Column, worth: Column) -> Column:
    """An array of (field, label_no, value); empty if the value isn't worth it."""
    return F.when(worth, F.array(F.struct(F.lit(field).alias("field"), F.lit(label_no).cast("int").alias("label_no"), value.alias("value"))).cast(_FOUND))


def _all(found: list[Column]) -> Column:
    """The structs of all arrays, null ones left out; compiled as a whole, other than functions with lambdas."""
    none = F.array().cast(_FOUND)
    return F.concat(*[F.coalesce(x, none) for x in found])


def _told(text: Column, closed: Column, fields: tuple[str, ...]) -> Column:
    """What a line (also given ``_closed``) prints behind each label: array of (field, label_no, value)."""
    said = lambda f, k: lambda v: _said(f, k, v, v != "")
    found = []
    for f in fields:
        for k, label in enumerate(LABELS[f]):
            shape = rf"(?i)(?:^|\s){_loose(label)}\s*:\s*(.*)$"
            value = F.trim(F.regexp_replace(F.regexp_extract(text, shape, 1), r"\s{2,}[A-Z][A-Z0-9 /]*:.*$", ""))
            found.append(F.when(closed.contains(label.replace(" ", "") + ":"), R.let(value, said(f, k))))
    return F.when(closed.contains(":"), _all(found))


def label_values(lines: DataFrame, fields: tuple[str, ...] = TEXT_FIELDS) -> DataFrame:
    """doc_id, field, label_no, line_no, value: what is printed behind a label and a colon, up to the next label on the line; blank values don't count."""
    rows = lines.filter(F.col("text").contains(":")).select("doc_id", "line_no", "text", _closed(F.col("text")).alias("closed"))
    rows = _opened(rows, _told(F.col("text"), F.col("closed"), fields), "doc_id", "line_no").filter("field IS NOT NULL")
    return rows.select("doc_id", "field", "label_no", "line_no", "value")


def _stated(text: Column, closed: Column, fields: tuple[str, ...]) -> Column:
    """The amount that a line (also given ``_closed``) states for each field: array of (field, null, paise as text)."""
    said = lambda f: lambda p: _said(f, None, p.cast("string"), p.isNotNull())
    found = []
    for f in fields:
        some = "|".join(_loose(x) for x in sorted(LABELS[f], key=lambda x: (-len(x), x)))
        shape = rf"(?i)^\s*(?:{some})\b(?:\s*@?\s*[0-9]{{1,2}}(?:\.[0-9]+)?\s*%)?[\s:|]*{R.CURRENCY}?\s*(-?[0-9,]+(?:\.[0-9]+)?)\s*{R.CURRENCY}?\s*(?:/-)?\s*\|?\s*$"
        found.append(F.when(_begins(closed, (f,)), R.let(R.paise(F.regexp_extract(text, shape, 1)), said(f))))
    return _all(found)


def label_amounts(lines: DataFrame, fields: tuple[str, ...] = MONEY_FIELDS) -> DataFrame:
    """doc_id, field, line_no, paise: a line that is a label, perhaps a rate, and an amount and nothing else; the longest label of a field counts."""
    rows = lines.select("doc_id", "line_no", "text", _closed(F.col("text")).alias("closed")).filter(_begins(F.col("closed"), fields))
    rows = _opened(rows, _stated(F.col("text"), F.col("closed"), fields), "doc_id", "line_no").filter("field IS NOT NULL")
    return rows.select("doc_id", "field", "line_no", F.col("value").cast("bigint").alias("paise"))


def agreed(found: DataFrame, value: str) -> DataFrame:
    """doc_id, field, printed (how many different values), the value if all printings agree, and the first line of it."""
    per = found.groupBy("doc_id", "field").agg(F.count_distinct(value).alias("printed"), F.min(value).alias("__one"), F.min("line_no").alias("line_no"))
    return per.select("doc_id", "field", "printed", F.when(F.col("printed") == 1, F.col("__one")).alias(value), "line_no")


# Figures near a label


def _bare(said: Column) -> Column:
    """The words of a line (words with one blank between), in upper case without what stands before their first or behind their last letter or figure."""
    return F.split(F.upper(F.regexp_replace(said, r"(?<!\S)[^0-9A-Za-z\s]+|[^0-9A-Za-z\s]+(?!\S)", "")), " ")


def _spans(words: Column) -> Column:
    """Figures of a line: array of (first, last, value); a currency mark before one belongs to it."""
    mark = lambda w: w.rlike(f"(?i)^{R.CURRENCY}$")
    figure = lambda w: w.rlike(rf"(?i)^{R.CURRENCY}?[0-9.,+\-/#%]*[0-9][0-9.,+\-/#%]*{R.CURRENCY}?$")

    def span(w: Column, i: Column) -> Column:
        before = F.get(words, i - 1)
        alone = F.struct(i.alias("first"), i.alias("last"), w.alias("value"))
        led = F.struct((i - 1).alias("first"), i.alias("last"), F.concat(before, F.lit(" "), w).alias("value"))
        return F.when(figure(w), F.when((i > 0) & mark(before), led).otherwise(alone))

    return F.filter(F.transform(words, span), lambda x: x.isNotNull())


def _sites(words: Column, bare: Column, labels: tuple[str, ...]) -> Column:
    """Labels of a line (its words, and the same ``_bare``): array of (first, last, label), the longest run of words at each place, none overlapping; those that a modifier makes others are left out."""
    longest, begun = max(len(x.split()) for x in labels), {x[: k + 1] for x in labels for k in range(len(x))}

    def run(i: Column) -> Column:
        tries = []
        for n in range(longest, 0, -1):
            own = [F.get(bare, i + k) for k in range(n)]  # null beyond the last
            spaced = own[:1] + [x for w in own[1:] for x in (F.lit(" "), w)]
            tries.append(F.when(F.concat(*spaced).isin(*labels) | F.concat(*own).isin(*labels), n))
        return F.coalesce(*tries, F.lit(0))

    def go(state: Column, hit: Column) -> Column:
        taken = (hit["n"] > 0) & (hit["i"] >= state["free"])
        modified = (hit["i"] > 0) & (F.get(bare, hit["i"] - 1) == MODIFIER)
        site = F.struct(hit["i"].alias("first"), (hit["i"] + hit["n"] - 1).alias("last"), F.array_join(F.slice(words, hit["i"] + 1, hit["n"]), " ").alias("label"))
        return F.struct(F.when(taken, hit["i"] + hit["n"]).otherwise(state["free"]).alias("free"), F.when(taken & ~F.coalesce(modified, F.lit(False)), F.concat(state["sites"], F.array(site))).otherwise(state["sites"]).alias("sites"))

    empty = F.struct(F.lit(0).alias("free"), F.array().cast("array<struct<first:int,last:int,label:string>>").alias("sites"))
    hits = F.transform(bare, lambda w, i: F.when(w.isin(*sorted(begun)), F.struct(i.alias("i"), run(i).alias("n"))))
    return F.aggregate(F.filter(hits, lambda h: h["n"] > 0), empty, go, lambda s: s["sites"])


def nearby(lines: DataFrame, fields: tuple[str, ...] = ("total", "tax", "net"), methods: tuple[str, ...] = METHODS, unread: bool = False) -> DataFrame:
    """doc_id, field, label, label_line, value, line_no, first, method, distance, rejected, rank: figures behind a label, or on the line below or above it.

    A line is seen with its two neighbours, in one pass over a document in order (a line's number is there once); only lines that may hold a label are looked into. A figure
    counts once for a field, by its best site; ``rejected`` says why it is no amount (empty: accepted). Ranked: accepted ones first, then by method, distance and value.
    Sites of other than the given methods don't count; with ``unread`` only fields are looked for that no line of the document states (``label_amounts``).
    """
    text, in_order = F.col("text"), W.partitionBy("doc_id").orderBy("line_no")
    page = in_order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    beside = lambda step: F.when(F.lag("line_no", step).over(in_order) == F.col("line_no") - step, F.lag("text", step).over(in_order))
    own = lines.select("doc_id", "line_no", "text", *[_closed(text).alias("closed")] * unread)
    if unread:
        own = own.withColumns({f"states_{f}": F.size(_stated(text, F.col("closed"), (f,))) > 0 for f in fields}).drop("closed")
    seen = {c: beside(k) for k, c, m in ((1, "above", METHODS[2]), (-1, "below", METHODS[1])) if m in methods}
    own = own.withColumns(seen | ({f"wants_{f}": ~F.coalesce(F.max(f"states_{f}").over(page), F.lit(False)) for f in fields} if unread else {}))
    may = {f: F.when(F.col(f"wants_{f}"), _may_name(text, (f,))).otherwise(False) if unread else _may_name(text, (f,)) for f in fields}
    own = own.filter(reduce(Column.__or__, may.values()) if unread else _may_name(text, fields)).withColumn("words", R.words_of(text)).withColumn("label_said", F.array_join("words", " "))
    own = own.select("*", _bare(F.col("label_said")).alias("bare"), R.beside(F.col("label_said")).alias("label_bits"))
    named = lambda f: lambda s: F.struct(F.lit(f).alias("field"), s["last"].alias("label_last"), s["label"].alias("label"), s["first"].alias("label_first"))
    none = F.array().cast("array<struct<field:string,label_last:int,label:string,label_first:int>>")
    every = F.concat(*[F.coalesce(F.when(may[f], F.transform(_sites(F.col("words"), F.col("bare"), LABELS[f]), named(f))), none) for f in fields])
    three = F.array(*[F.struct((F.col("line_no") + k).alias("line_no"), F.col(c).alias("near")) for k, c, m in ((-1, "above", METHODS[2]), (0, "text", METHODS[0]), (1, "below", METHODS[1])) if m in methods])
    # as in ``_opened``, what drops a row comes after its array is worked out, or it would be worked out twice
    label, site = ("doc_id", "label_line", "label_bits"), ("field", "label_last", "label", "label_first")
    sites = own.select("doc_id", F.col("line_no").alias("label_line"), "label_bits", three.alias("three"), every.alias("sites"))
    sites = sites.select(*label, "three", F.inline_outer("sites")).filter("field IS NOT NULL")
    near = sites.select(*label, *site, F.inline("three")).filter(F.col("near").rlike("[0-9]")).withColumn("words", R.words_of(F.col("near")))
    bits = F.when(F.col("line_no") == F.col("label_line"), F.col("label_bits")).otherwise(F.col("label_bits").bitwiseOR(R.beside(F.array_join("words", " "))))
    near = near.select("doc_id", "label_line", *site, "line_no", bits.alias("bits"), _spans(F.col("words")).alias("spans"))
    pairs = near.select("doc_id", "label_line", *site, "line_no", "bits", F.inline_outer("spans")).filter("value IS NOT NULL")
    pairs = pairs.filter((F.col("line_no") != F.col("label_line")) | (F.col("first") > F.col("label_last")))
    method = F.when(F.col("line_no") == F.col("label_line"), 0).when(F.col("line_no") > F.col("label_line"), 1).otherwise(2)
    pairs = pairs.withColumn("how", method).withColumn("rejected", R.not_money_beside(F.col("value"), F.col("bits")))
    order = F.struct((F.col("rejected") != "").alias("bad"), "how", "value", "label_line", "label_first", "label", "rejected")
    best = pairs.groupBy("doc_id", "field", "line_no", "first").agg(F.min(order).alias("o"))
    best = best.select("doc_id", "field", F.col("o.label").alias("label"), F.col("o.label_line").alias("label_line"), F.col("o.value").alias("value"), "line_no", "first", F.col("o.how").alias("how"), F.col("o.rejected").alias("rejected"))
    rank = F.row_number().over(W.partitionBy("doc_id", "field").orderBy(F.col("rejected") != "", "how", "value", "line_no", "first"))
    return best.withColumn("rank", rank).withColumn("method", F.element_at(F.array(*map(F.lit, METHODS)), F.col("how") + 1)).withColumn("distance", (F.col("how") > 0).cast("int")).drop("how")


def review(candidates: DataFrame) -> DataFrame:
    """doc_id, field, accepted, value, review: the first accepted figure, and whether a person has to say which.

    No review is needed for fewer than two accepted figures, for accepted ones that are all equal, or if the first was found by a better method or nearer.
    """
    own = candidates.filter("rejected = ''").select("doc_id", "field", "value", "rank", F.array_position(F.array(*map(F.lit, METHODS)), F.col("method")).alias("how"), "distance")
    per = own.groupBy("doc_id", "field").agg(F.count("*").alias("accepted"), F.count_distinct("value").alias("values"), F.slice(F.array_sort(F.collect_list(F.struct("rank", "how", "distance", "value"))), 1, 2).alias("two"))
    a, b = F.get("two", F.lit(0)), F.get("two", F.lit(1))
    clear = (a["how"] < b["how"]) | (a["distance"] < b["distance"])
    return per.select("doc_id", "field", "accepted", a["value"].alias("value"), ((F.col("values") > 1) & ~clear).alias("review"))


# Whole pages


def is_label(text: Column) -> Column:
    """Whether a text begins with any known label of a figure, party or date."""
    known = sorted({x for f in ("total", "net", "tax", "cgst", "sgst", "utgst", "party", "date") for x in LABELS[f]})
    return F.upper(F.trim(text)).rlike("^(?:" + "|".join(known).replace("-", r"\-") + ")")


#: What looks like a date in the head of a page.
_DAYS = (r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b", r"\b[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4}\b", r"(?i)\b[0-9]{1,2}[\s.-]*(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[\s.,-]*[0-9]{2,4}\b")


#: Fixed value: what each of them holds, to be looked for first.
_DAY_LIKE = r"(?i)[0-9](?:[/.-][0-9]{1,2}[/.-][0-9]|[\s.-]*(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec))"


def _dated(text: Column) -> Column:
    """The first run that looks like a date."""
    first = lambda p: R.let(F.regexp_extract(text, p, 0), lambda x: F.nullif(x, F.lit("")))
    return F.when(text.rlike(_DAY_LIKE), F.coalesce(*[first(p) for p in _DAYS]))


def head_dates(lines: DataFrame, head: int = HEAD) -> DataFrame:
    """doc_id, line_no, printed: the first run in the head of a page that looks like a date."""
    return lines.filter(F.col("line_no") < head).withColumn("printed", _dated(F.col("text"))).filter("printed IS NOT NULL").groupBy("doc_id").agg(F.min_by("printed", "line_no").alias("printed"), F.min("line_no").alias("line_no"))


def page_fields(lines: DataFrame) -> DataFrame:
    """doc_id, field, value, confidence: total, tax, net, party, number and date of each page, a row for each that was read.

    Money: the amount on a label's own line (agreed over the page); if there is none, the one accepted figure on the line below a label, if it stands on its line alone,
    belongs to no other field's label and is no label itself, at confidence 0.5. Date: under its label, else the first in the head at 0.5. A party comes from its label
    only, at 0 if it looks misread.
    """
    text, closed, money, words = F.col("text"), F.col("closed"), ("total", "tax", "net"), ("party", "number", "date")
    head = F.when((F.col("line_no") < HEAD) & text.rlike(_DAY_LIKE), R.let(_dated(text), lambda d: _said("head", None, d, d.isNotNull())))
    alone = _said("alone", None, F.trim(text), text.rlike("[0-9]") & F.trim(text).rlike(r"^\S+(?:\s\S+)?$"))  # as a figure is, with or without a currency
    found = _all([_stated(text, closed, money), _told(text, closed, words), head, alone])
    found = _opened(lines.select("doc_id", "line_no", "text", _closed(text).alias("closed")), found, "doc_id", "line_no").filter("field IS NOT NULL")
    of = lambda field: F.when(F.col("field") == field, F.col("value"))
    ends = [c for f in (*money, *words) for c in (F.min(of(f)).alias(f), F.max(of(f)).alias(f"{f}_most"))]
    per = found.groupBy("doc_id").agg(*ends, F.min_by(of("head"), F.when(F.col("field") == "head", F.col("line_no"))).alias("head"), F.collect_list(of("alone")).alias("alone"))
    standing = nearby(lines, money, METHODS[:2], unread=True).filter((F.col("rejected") == "") & (F.col("method") == "next_line")).filter(~is_label(F.col("value")))
    other = (F.col("field") == "total") & F.upper(F.trim("label")).rlike("^(?:" + "|".join(LABELS["net"]) + ")")
    standing = standing.filter(~other).groupBy("doc_id").agg(*[c for f in money for c in (F.count(of(f)).alias(f"{f}_n"), F.min(of(f)).alias(f"{f}_below"))])
    per = per.join(standing, "doc_id", "left")
    one = lambda f: F.when(F.col(f) == F.col(f"{f}_most"), F.col(f))
    row = lambda f, value, sure: F.struct(F.lit(f).alias("field"), value.alias("value"), sure.alias("confidence"))
    rows = []
    for f in money:
        below = F.col(f"{f}_below")
        alone = F.size(F.array_remove("alone", below)) == F.size("alone") - 1
        rows.append(F.when(one(f).isNotNull(), row(f, one(f), F.lit(1.0))).when(F.col(f).isNull() & (F.col(f"{f}_n") == 1) & alone, row(f, R.paise(below).cast("string"), F.lit(BY_PLACE))))
    rows.append(F.when(one("party").isNotNull(), row("party", one("party"), F.when(F.size(R.artifacts(one("party"))) > 0, 0.0).otherwise(1.0))))
    rows.append(F.when(one("number").isNotNull(), row("number", one("number"), F.lit(1.0))))
    printed = F.when(F.col("date").isNull(), F.col("head")).otherwise(one("date"))
    day = R.let(R.date(printed, R.DAY_FIRST)["value"].cast("string"), lambda d: F.when(d.isNotNull(), row("date", d, F.when(F.col("date").isNull(), BY_PLACE).otherwise(1.0))))
    return per.select("doc_id", F.inline(F.array_compact(F.array(*rows, day))))


def split_tax(lines: DataFrame) -> DataFrame:
    """doc_id, tax: the parts' sum, each part agreed with its repeats first; the whole figure if there are no parts; null if a part or the whole disagrees, or both are printed."""
    found = agreed(label_amounts(lines, ("tax", "cgst", "sgst", "utgst")), "paise")
    part = F.col("field") != "tax"
    per = found.groupBy("doc_id").agg(F.count_if(part).alias("parts"), F.count_if(part & F.col("paise").isNull()).alias("odd"), F.sum(F.when(part, F.col("paise"))).alias("sum"), F.count_if(~part).alias("whole"), F.max(F.when(~part, F.col("paise"))).alias("one"))
    tax = F.when((F.col("parts") > 0) & (F.col("whole") > 0), None).when((F.col("parts") > 0) & (F.col("odd") > 0), None).when(F.col("parts") > 0, F.col("sum")).otherwise(F.col("one"))
    return per.select("doc_id", tax.cast("bigint").alias("tax"))


def below_heading(lines: DataFrame, side: str) -> DataFrame:
    """doc_id, value: the first usable line below a page's first heading of a side: not blank, no tax id; none if another heading comes first."""
    up = F.upper("text")
    heads = lambda names: up.rlike("|".join(names))
    rows = lines.withColumn("own", heads(SECTIONS[side])).withColumn("any", heads(SECTIONS["supplier"] + SECTIONS["buyer"]))
    first = rows.filter("own").groupBy("doc_id").agg(F.min("line_no").alias("at"))
    below = rows.join(first, "doc_id").filter("line_no > at AND trim(text) <> ''")
    kind = F.when(F.col("any"), "stop").when(M.tax_id(F.col("text")).isNotNull(), None).otherwise("use")
    one = below.withColumn("kind", kind).filter("kind IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("line_no", "kind", F.trim("text").alias("value"))).alias("one"))
    return one.filter("one.kind = 'use'").select("doc_id", "one.value")


#: Fixed value: a tax id within a line.
_TAX_ID = r"\b([0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9A-Z]Z[0-9A-Z])\b"


def tax_ids(lines: DataFrame) -> DataFrame:
    """doc_id, side, tax_id, state: the one tax id of each side of a page, by the last heading above it (null before the first); one seen again doesn't count again; two of a side are none."""
    up = F.upper("text")
    side = F.when(up.rlike("|".join(SECTIONS["supplier"])), "supplier").when(up.rlike("|".join(SECTIONS["buyer"])), "buyer")
    rows = lines.withColumn("side", F.last(side, ignorenulls=True).over(W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)))
    found = rows.select("doc_id", "line_no", "side", F.explode(F.regexp_extract_all(F.upper("text"), F.lit(_TAX_ID), F.lit(1))).alias("tax_id"))
    first = found.groupBy("doc_id", "tax_id").agg(F.min_by("side", "line_no").alias("side"))
    per = first.groupBy("doc_id", "side").agg(F.count("*").alias("n"), F.min("tax_id").alias("tax_id")).filter("n = 1")
    return per.select("doc_id", "side", "tax_id", F.substring("tax_id", 1, 2).alias("state"))


DOC_FIELDS = (
    "number", "date", "po", "irn", "eway", "place", "supplier_name", "supplier_tax_id", "supplier_state", "supplier_address", "buyer_name", "buyer_tax_id", "buyer_state", "buyer_address",
    "net", "cgst", "sgst", "igst", "cess", "tax", "round_off", "total", "words",
)
#: Shapes without which a reference isn't one.
SHAPES = {"irn": "^[0-9a-fA-F]{64}$", "eway": "^[0-9]{12}$"}


def doc_fields(lines: DataFrame) -> DataFrame:
    """One wide row per document that has any field: identity, both parties, totals (paise, as text), and which mandatory fields it lacks.

    A field is read if all printings under its labels agree; references only in their shape. A party's name is that under its label, else the first usable line below its
    heading; an address is only read under its label, which doesn't say whose it is. ``sgst`` is the state's or union territory's part. ``tax_stated`` tells
    a printed total tax from one worked out of its parts (integrated tax counts as printed). A page is read in one pass over its lines in order: each line is looked into once, and only those that
    say something are gathered.
    """
    own, text = lines.select("doc_id", "line_no", "text", F.upper("text").alias("up")), F.col("text")
    heads = lambda names: F.exists(F.array(*map(F.lit, names)), lambda x: F.contains("up", x))
    own = own.withColumns({f"is_{s}": heads(names) for s, names in SECTIONS.items()})
    heading = F.col("is_supplier") | F.col("is_buyer")
    taxed = (F.length(F.trim("up")) == 15) & M.tax_id(text).isNotNull()
    own = own.withColumn("ends", (F.trim("text") != "") & (heading | ~taxed))  # of lines below a heading, the first of these tells the name, or that there is none
    in_order = W.partitionBy("doc_id").orderBy("line_no")
    upto = in_order.rowsBetween(W.unboundedPreceding, 0)
    own = own.withColumns(
        {f"from_{s}": F.min(F.when(F.col(f"is_{s}"), F.col("line_no"))).over(upto) for s in SECTIONS}
        | {"side": F.last(F.when(F.col("is_supplier"), "supplier").when(F.col("is_buyer"), "buyer"), ignorenulls=True).over(upto), "before": F.lag(F.when(F.col("ends"), F.col("line_no"))).over(in_order)}
    )
    # a line right after one that ends the search isn't the first
    first = {s: F.col("ends") & (F.col("line_no") > F.col(f"from_{s}")) & ~F.coalesce(F.col("before") > F.col(f"from_{s}"), F.lit(False)) for s in SECTIONS}
    own = own.select("doc_id", "line_no", "side", "text", "up", _closed(text).alias("closed"), F.when(~heading, F.trim("text")).alias("name"), *[c.alias(f"first_{s}") for s, c in first.items()])
    words, amounts = ("number", "date", "po", "place", "party", *SHAPES, "address", "words"), ("total", "net", "cgst", "sgst", "tax", "igst", "cess", "round_off")
    ids = F.transform(F.regexp_extract_all("up", F.lit(_TAX_ID), F.lit(1)), lambda x: F.struct(F.lit("tax_id"), F.lit(None).cast("int"), x)).cast(_FOUND)
    found = _all([_told(text, F.col("closed"), words), _stated(text, F.col("closed"), (*amounts, "utgst")), F.when(F.col("up").contains("Z"), ids), *[_said(f"{s}_below", None, F.col("name"), F.col(f"first_{s}")) for s in SECTIONS]])
    own = _opened(own, found, "doc_id", "line_no", "side").filter("field IS NOT NULL").withColumn("field", F.when(F.col("field") == "utgst", "sgst").otherwise(F.col("field")))
    # per field and tax id (whose side is that of its first place), then per page
    own = own.withColumn("tax_id", F.when(F.col("field") == "tax_id", F.col("value")))
    per = own.groupBy("doc_id", "field", "tax_id").agg(F.min("value").alias("least"), F.max("value").alias("most"), F.min(F.struct("line_no", "side", "value")).alias("first"))
    below = [f"{s}_below" for s in SECTIONS]
    value = F.when(F.col("field").isin(below), F.col("first.value")).when(F.col("least") == F.col("most"), F.col("least"))
    per = per.select("doc_id", F.when(F.col("field") == "tax_id", F.concat("first.side", F.lit("_tax_id"))).otherwise(F.col("field")).alias("field"), value.alias("value"))
    of = lambda field: F.when(F.col("field") == field, F.col("value"))
    ids = [f"{s}_tax_id" for s in SECTIONS]
    wide = per.groupBy("doc_id").agg(*[F.min(of(f)).alias(f) for f in (*words, *amounts, *below, *ids)], *[F.max(of(f)).alias(f"{f}_most") for f in ids])
    wide = wide.withColumns({f: F.when(F.col(f) == F.col(f"{f}_most"), F.col(f)) for f in ids} | {f: F.when(F.col(f).rlike(shape), F.col(f)) for f, shape in SHAPES.items()})
    wide = wide.withColumns({"date": R.date(F.col("date"), R.DAY_FIRST)["value"].cast("string")} | {f"{s}_state": F.substring(f"{s}_tax_id", 1, 2) for s in SECTIONS})
    wide = wide.filter(F.coalesce(*[f for f in words if f != "date"], *amounts, *below, *ids, "date").isNotNull())  # the date last: to ask for it is to read it again
    wide = wide.withColumn("supplier_name", F.coalesce("party", "supplier_below")).withColumn("buyer_name", F.col("buyer_below")).withColumn("tax_stated", F.col("tax").isNotNull())
    wide = wide.withColumns({f"{s}_address": F.col("address") for s in SECTIONS})
    parts = reduce(Column.__add__, [F.coalesce(F.col(f).cast("bigint"), F.lit(0)) for f in ("cgst", "sgst", "cess")])
    worked = F.when(F.coalesce("cgst", "sgst", "cess").isNotNull(), parts.cast("string"))
    wide = wide.withColumn("tax", F.coalesce("tax", worked))
    mandatory = ("number", "date", "supplier_name", "total")
    return wide.select("doc_id", *DOC_FIELDS, "tax_stated", F.array_compact(F.array(*[F.when(F.col(m).isNull(), m) for m in mandatory])).alias("missing"))


def confidence(fields: DataFrame) -> DataFrame:
    """doc_id, average, lowest, fields: over the fields that were read (confidence above 0); 0.0 and none for a document without any."""
    read = F.col("confidence") > 0
    per = fields.groupBy("doc_id").agg(F.avg(F.when(read, F.col("confidence"))).alias("average"), F.min(F.when(read, F.col("confidence"))).alias("lowest"), F.array_sort(F.collect_set(F.when(read, F.col("field")))).alias("fields"))
    return per.fillna(0.0, ["average", "lowest"])


def merged(exact: DataFrame, picture: DataFrame) -> DataFrame:
    """doc_id, field, value, source, confidence: two readings of the same documents; the exact one wins every field it read, with its source and confidence."""
    a = exact.filter("value IS NOT NULL").select("doc_id", "field", F.struct("value", "source", "confidence").alias("a"))
    b = picture.filter("value IS NOT NULL").select("doc_id", "field", F.struct("value", "source", "confidence").alias("b"))
    return a.join(b, ["doc_id", "field"], "full").select("doc_id", "field", F.coalesce("a", "b").alias("one")).select("doc_id", "field", "one.*")


# Tables


def _named(text: Column) -> Column:
    """Columns that a header line names, in order of place: names are tried in order, and one that overlaps an earlier one doesn't count."""
    up = F.upper(text)

    def step(state: Column, entry: Column) -> Column:
        at = F.instr(up, entry["name"])
        end = at + F.length(entry["name"])
        free = (at > 0) & ~F.exists(state, lambda s: (s["at"] < end) & (at < s["end"]))
        return F.when(free, F.concat(state, F.array(F.struct(at.alias("at"), end.alias("end"), entry["column"].alias("column"))))).otherwise(state)

    table = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(c).alias("column")) for n, c in COLUMNS])
    found = F.aggregate(table, F.array().cast("array<struct<at:int,end:int,column:string>>"), step)
    return F.transform(F.array_sort(F.transform(found, lambda s: F.struct(s["at"], s["column"]))), lambda s: s["column"])


def table_rows(lines: DataFrame) -> DataFrame:
    """doc_id, line_no, cells: the rows below a page's first header (three known column names), split from the right, up to the first line that is no row.

    ``cells`` lists (column, printed) in the header's order; the description takes what is left of the others. A header without a description has no rows.
    A page is read in one pass over its lines in order.
    """
    up, in_order = F.upper("text"), W.partitionBy("doc_id").orderBy("line_no")
    several = reduce(Column.__add__, [F.contains(up, F.lit(n)).cast("int") for n, _ in COLUMNS]) >= ENOUGH_NAMES  # some may be within others
    own = lines.select("doc_id", "line_no", "text", F.when(several, _named(F.col("text"))).alias("named"))
    heads = F.when(F.size("named") >= ENOUGH_NAMES, F.col("named"))
    columns = F.first(heads, ignorenulls=True).over(in_order.rowsBetween(W.unboundedPreceding, -1))
    rows = own.select("doc_id", "line_no", "text", columns.alias("columns")).filter(F.array_contains("columns", "description"))
    rows = rows.withColumn("tokens", R.words_of(F.col("text"))).withColumn("others", F.size("columns") - 1)
    stop = F.min(F.when(F.size("tokens") <= F.col("others"), F.col("line_no"))).over(in_order.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("stop", stop).filter("stop IS NULL")
    left = F.greatest(F.lit(0), F.size("tokens") - F.col("others"))
    wide = F.concat(F.array(F.array_join(F.slice("tokens", F.lit(1), left), " ")), F.slice("tokens", left + 1, F.col("others")))
    return rows.select("doc_id", "line_no", F.arrays_zip(F.col("columns").alias("column"), wide.alias("printed")).alias("cells"))


def cell_value(column: Column, printed: Column) -> Column:
    """A cell's value as text: paise, thousandths, basis points or a code, by its column; null if it can't be read as such."""
    return (
        F.when(column.isin("description", "unit"), F.nullif(F.trim(printed), F.lit("")))
        .when(column == "hsn_sac", M.goods_code(printed)["code"])
        .when(column == "quantity", M.thousandths(printed).cast("string"))
        .when(column == "gst_rate", M.basis_points(printed).cast("string"))
        .otherwise(R.paise(printed).cast("string"))
    )
