"""How far an entry may go by itself: BLOCK, ASK or POST, with every reason in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decide import QUESTIONS

#: Confidence below which an entry is blocked, and asked about; tiers of reading that are exact; kinds that have a date.
BLOCK_BELOW, ASK_BELOW, EXACT, DATED = 0.70, 0.95, ("pdf_text_layer", "typed_text"), ("invoice", "credit_note")


def confidence(words: Column, valid: Column) -> Column:
    """The least confidence of the words over 100; 0 without words or for a value of the wrong form; null if one is outside 0 to 100."""
    odd = F.exists(words, lambda w: (w < 0) | (w > 100))
    return F.when(odd, F.lit(None)).when(~F.coalesce(valid, F.lit(False)) | (F.size(words) < 1), 0.0).otherwise(F.array_min(words) / 100)


def decided(rows: DataFrame) -> DataFrame:
    """``band`` and ``reasons``. Columns: laws (verdicts), checked_paise, written_paise, asked, has_tax (null: unknown), tax_read, period_open,
    party_known, debit_account, credit_account, amount_confidence, party_confidence, tax_confidence, date_confidence, kind, repaired, tiers,
    needs_person, ambiguous.

    Tax counts unless has_tax is false; the date counts for dated kinds only. Unknown facts block.
    """
    c = F.col
    no = lambda x: ~F.coalesce(x, F.lit(False))
    lowest = F.least(c("amount_confidence"), c("party_confidence"), F.when(no(c("has_tax") == False), c("tax_confidence")), F.when(c("kind").isin(*DATED), c("date_confidence")))  # noqa: E712
    lowest = F.coalesce(lowest, F.lit(0.0))
    block = F.array_compact(F.array(
        F.when(F.exists("laws", lambda v: v == "INDETERMINATE"), "a law can't be told"), F.when(F.exists("laws", lambda v: v == "FAIL"), "a law fails"),
        F.when(~c("checked_paise").eqNullSafe(c("written_paise")), "the amount checked isn't the amount written"), F.when(F.coalesce("asked", F.lit(0)) >= QUESTIONS, "too many questions"),
        F.when(no(c("has_tax") == False), "tax isn't ruled out"), F.when((c("has_tax") == False) & F.coalesce("tax_read", F.lit(False)), "tax was read where there is none"),  # noqa: E712
        F.when(no(c("period_open")), "the period isn't open"), F.when(no(c("party_known")), "the party isn't known"),
        F.when((c("debit_account") != "") & (c("debit_account") == c("credit_account")), "both legs are one account"), F.when(lowest < BLOCK_BELOW, "a field is too uncertain"),
    ))
    ask = F.array_compact(F.array(
        F.when(F.coalesce("repaired", F.lit(False)), "the file was repaired"), F.when((F.size("tiers") < 1) | F.exists("tiers", lambda t: ~t.isin(*EXACT)), "a field was read inexactly"),
        F.when(F.coalesce("needs_person", F.lit(False)), "the kind needs a person"), F.when(F.coalesce("ambiguous", F.lit(0)) > 0, "a field is ambiguous"),
        F.when(lowest < ASK_BELOW, "a field is uncertain"), F.when((F.coalesce("debit_account", F.lit("")) == "") | (F.coalesce("credit_account", F.lit("")) == ""), "a leg is missing"),
    ))
    band = F.when(F.size(block) > 0, "BLOCK").when(F.size(ask) > 0, "ASK").otherwise("POST")
    return rows.withColumn("band", band).withColumn("reasons", F.concat(block, ask))
