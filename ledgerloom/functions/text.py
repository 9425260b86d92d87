"""Columns for names, phrases and markers."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes of a supplier's name, and trailing legal forms (longest first).
PREFIXES = (("m", "s"), ("ms",), ("messrs",))
FORMS = (
    (("private", "limited"), "pvt_ltd"), (("private", "ltd"), "pvt_ltd"), (("pvt", "limited"), "pvt_ltd"), (("pvt", "ltd"), "pvt_ltd"), (("and", "co"), "and_co"), (("and", "company"), "and_co"),
    (("ltd",), "ltd"), (("limited",), "ltd"), (("llp",), "llp"), (("inc",), "inc"), (("incorporated",), "inc"), (("corp",), "corp"), (("corporation",), "corp"), (("co",), "and_co"), (("company",), "and_co"),
)
STRONG_FORMS = ("ltd", "pvt_ltd", "llp", "inc", "corp")
#: The tag that a posted narration carries is [MARKER:operation].
MARKER = "LEDGERLOOM"


def clean(text: Column) -> Column:
    """No-break spaces as spaces, runs of white space as one, trimmed."""
    return F.trim(F.regexp_replace(F.replace(text, F.lit(" "), F.lit(" ")), r"\s+", " "))


def header(text: Column) -> Column:
    return F.lower(clean(text))


#: Built from the Unicode tables: base and combining mark to the one character that they make; characters that fold to others than their lower case.
_COMPOSED = {
    "".join(chr(int(x, 16)) for x in parts): chr(c)
    for c in range(0xC0, 0x3000)
    if len(parts := unicodedata.decomposition(chr(c)).split()) == 2 and unicodedata.combining(chr(int(parts[1], 16))) and unicodedata.normalize("NFC", chr(c)) == chr(c)
}
_FOLDED = {chr(c): chr(c).casefold() for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000 and chr(c).casefold() != chr(c).lower()}
_MARKS = r"[\x{300}-\x{36F}]"


def _table(values: dict[str, str]) -> Column:
    return F.map_from_arrays(F.split(F.lit("|".join(values)), r"\|"), F.split(F.lit("|".join(values.values())), r"\|"))


def composed(text: Column) -> Column:
    """Base characters and the marks behind them as one character where there is one (NFC of marked letters). Text without marks is left alone."""
    known = _table(_COMPOSED)
    join = lambda a, m: F.coalesce(F.try_element_at(known, F.concat(a, m)), F.concat(a, m))
    cluster = lambda c: F.aggregate(F.split(F.substr(c, F.lit(2)), ""), F.left(c, F.lit(1)), join)
    parts = F.regexp_extract_all(text, F.lit(rf"(?s).{_MARKS}*"), F.lit(0))
    return F.when(text.rlike(_MARKS), F.array_join(F.transform(parts, cluster), "")).otherwise(text)


def folded_case(text: Column) -> Column:
    """Composed and case-folded; plain lower case for text that is all ASCII."""
    known = _table(_FOLDED)
    special = "[" + "".join(_FOLDED) + "]"
    whole = F.lower(composed(text))
    full = F.when(whole.rlike(special), F.array_join(F.transform(F.split(whole, ""), lambda c: F.coalesce(F.try_element_at(known, c), c)), "")).otherwise(whole)
    return F.when(text.rlike(r"[^\x00-\x7F]"), full).otherwise(F.lower(text))


def folded(text: Column) -> Column:
    """Case, punctuation and spacing folded; no word is lost. Composed and decomposed spellings are one."""
    return F.trim(F.regexp_replace(folded_case(text), r"[^\p{L}\p{N}]+", " "))


_PREFIX = "^(?:" + "|".join(" ".join(p) for p in PREFIXES) + ") (?=.)"
_TAIL = "(?:^| )(" + "|".join(" ".join(t) for t, _ in FORMS) + ")$"


def supplier_name(name: Column) -> Column:
    """struct(stem, form): the words between a naming prefix and the longest trailing legal form."""
    bare = F.regexp_replace(folded(name), _PREFIX, "")
    forms = F.create_map(*[F.lit(x) for t, canonical in FORMS for x in (" ".join(t), canonical)])
    return F.struct(F.regexp_replace(bare, _TAIL, "").alias("stem"), F.coalesce(forms[F.regexp_extract(bare, _TAIL, 1)], F.lit("")).alias("form"))


def joined_key(stem: Column, form: Column) -> Column:
    """Words and form joined by underscores; empty if neither is left."""
    stem = F.translate(stem, " ", "_")
    return F.concat_ws("_", F.when(stem != "", stem), F.when(form != "", form))


def vendor_key(name: Column) -> Column:
    n = supplier_name(name)
    return joined_key(n["stem"], n["form"])


def operation_in(narration: Column) -> Column:
    """The operation that a narration's marker names; null without one."""
    found = F.regexp_extract(narration, rf"\[{MARKER}:([A-Za-z0-9_\-]+)\]", 1)
    return F.when(found != "", found)


def stamped(narration: Column, operation: Column) -> Column:
    """The narration with its marker; unchanged if it has the same, null if it has another."""
    own = operation_in(narration)
    fresh = F.trim(F.concat(narration, F.lit(f" [{MARKER}:"), operation, F.lit("]")))
    return F.when(own.isNull(), fresh).when(own == operation, narration)


def phrase_key(narration: Column) -> Column:
    """The narration without our marker, numbers and punctuation (``&`` stays), words joined by underscores."""
    bare = F.regexp_replace(narration, rf"\[{MARKER}:[A-Za-z0-9_\-]+\]", " ")
    bare = F.regexp_replace(F.regexp_replace(F.lower(bare), r"\p{Nd}+", " "), r"[^\p{L}\p{N}_\s&]", " ")
    return F.regexp_replace(F.trim(bare), r"\s+", "_")


def same_company(a: Column, b: Column) -> Column:
    """Whether two names are one in composed form; case and punctuation tell names apart."""
    return composed(F.trim(a)) == composed(F.trim(b))


def company_key(name: Column) -> Column:
    """Words of the composed, case-folded name, joined by underscores."""
    return F.regexp_replace(F.trim(F.regexp_replace(folded_case(name), r"[^\p{L}\p{N}_\s]", " ")), r"\s+", "_")


def same_supplier(stem_a: Column, form_a: Column, stem_b: Column, form_b: Column) -> Column:
    """same, different or ambiguous. Strong forms exclude each other; a missing name or form leaves it open."""
    blank = F.coalesce(stem_a == "", F.lit(True)) | F.coalesce(stem_b == "", F.lit(True))
    strong = form_a.isin(*STRONG_FORMS) & form_b.isin(*STRONG_FORMS)
    return F.when(blank, "ambiguous").when(stem_a != stem_b, "different").when(form_a == form_b, "same").when(strong, "different").otherwise("ambiguous")


def legible(text: Column) -> Column:
    """Share of letters and digits among the characters that aren't blank; null if all are."""
    ink = F.length(F.regexp_replace(text, r"\s", ""))
    return F.when(ink > 0, F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")) / ink)
