"""Where a missing ledger belongs, what kind of document a draft is, whether it has to be read again, and the facts that a band is decided on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fields import LABELS

#: Groups of a chart of accounts.
MONEY_GROUPS = ("Bank Accounts", "Cash-in-Hand")
INCOME_GROUPS = ("Sales Accounts", "Direct Incomes", "Indirect Incomes")
TRADE_GROUPS = ("Purchase Accounts", "Direct Expenses", "Indirect Expenses", "Fixed Assets", *INCOME_GROUPS)
CREDITORS, DEBTORS = "Sundry Creditors", "Sundry Debtors"
#: Kind of a document by the tier that its total came from; characters of a real text layer.
KINDS, UNSUPPORTED = {"typed_text": "typed_expense_note", "stub": "invoice"}, "unsupported"
SHORTEST = 20


def ledger_groups(legs: DataFrame, chart: DataFrame) -> DataFrame:
    """company_key, id, side, account, found, refused: the group of every leg's ledger; one that the chart lacks is placed by what the chart and the voucher say, or refused.

    A party goes by its side and the other leg: money settles, trade bills. A credit leg that is no party goes to the one money group, if the company has no income ledgers.
    A debit leg that is no party is a person's decision. A twin that differs in case only, and a group that isn't in use, refuse. legs: company_key, id, party,
    debit_account, credit_account. chart: company_key, account, parent.
    """
    sides = F.array(F.struct(F.lit("debit").alias("side"), F.col("debit_account").alias("account"), F.col("credit_account").alias("counter")), F.struct(F.lit("credit").alias("side"), F.col("credit_account").alias("account"), F.col("debit_account").alias("counter")))
    rows = legs.select("company_key", "id", "party", F.inline(sides)).withColumn("account", F.coalesce("account", F.lit("")))
    known = chart.select("company_key", "account", F.trim("parent").alias("parent")).distinct()
    per = known.filter("parent <> ''").groupBy("company_key").agg(F.collect_set("parent").alias("groups"))  # groups of a company: a few dozen
    twins = known.select("company_key", F.lower("account").alias("__low")).distinct().withColumn("twin", F.lit(True))
    rows = rows.join(known, ["company_key", "account"], "left").join(known.select("company_key", F.col("account").alias("counter"), F.col("parent").alias("beside")), ["company_key", "counter"], "left")
    rows = rows.withColumn("__low", F.lower("account")).join(twins, ["company_key", "__low"], "left").join(per, "company_key", "left")
    groups = F.coalesce("groups", F.array().cast("array<string>"))
    party = (F.col("account") == F.col("party")) & ~F.coalesce(F.col("counter") == F.col("party"), F.lit(False))
    settles = F.col("beside").isin(*MONEY_GROUPS)
    wanted = F.when((F.col("side") == "credit") == settles, DEBTORS).otherwise(CREDITORS)
    money = F.array_intersect(groups, F.array(*map(F.lit, MONEY_GROUPS)))
    refused = (
        F.when(F.trim("account") == "", "no name").when(F.col("parent").isNotNull(), None).when(F.coalesce("twin", F.lit(False)), "differs in case only").when(F.size(groups) == 0, "no groups in use")
        .when(party & ~F.coalesce(F.col("beside").isin(*MONEY_GROUPS, *TRADE_GROUPS), F.lit(False)), "the other leg doesn't tell").when(party & ~F.array_contains(groups, wanted), "group isn't in use").when(party, None)
        .when((F.col("side") == "credit") & F.arrays_overlap(groups, F.array(*map(F.lit, INCOME_GROUPS))), "may be income").when((F.col("side") == "credit") & (F.size(money) != 1), "no single money group").when(F.col("side") == "credit", None).otherwise("a person's decision")
    )
    group = F.coalesce("parent", F.when(party, wanted).otherwise(F.get(money, F.lit(0))))
    return rows.select("company_key", "id", "side", "account", F.when(refused.isNull(), group).alias("found"), refused.alias("refused"))


def kind_of(provenance: Column) -> Column:
    """The document's kind from the provenance of its total; anything else is unsupported."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[F.try_element_at(provenance, F.lit("total_paise"))], F.lit(UNSUPPORTED))


def looks_scanned(outcome: Column, text: Column) -> Column:
    """Whether a document has to be read again as a picture: no text layer, too short a one, or one without any label of a bill. Documents that couldn't be opened haven't."""
    some = sorted({x for f in ("date", "total", "tax", "cgst", "sgst", "utgst") for x in LABELS[f]})
    poor = (F.length(F.trim(text)) < SHORTEST) | ~F.upper(text).rlike("|".join(some))
    return F.when(outcome == "no_text_layer", True).when(outcome != "read", False).otherwise(F.coalesce(poor, F.lit(True)))


def situation(drafts: DataFrame) -> DataFrame:
    """Drafts with kind, tiers, lines_total, has_tax and tax_read, as a band's decision wants them.

    drafts: provenance (map of field to tier), net_paise, tax_paise, gross_paise, tax_claimed. The lines add up to the net if that was read; to the gross only where the tax
    was read as zero; else to nothing known: never to the gross less the tax.
    """
    tiers = F.array_sort(F.array_distinct(F.filter(F.map_values("provenance"), lambda t: t.isNotNull())))
    lines = F.when(F.col("net_paise").isNotNull(), F.col("net_paise")).when(F.col("tax_paise") == 0, F.col("gross_paise"))
    return drafts.withColumns({"kind": kind_of(F.col("provenance")), "tiers": tiers, "lines_total": lines, "has_tax": F.when(F.col("tax_paise").isNotNull(), F.col("tax_paise") != 0).otherwise(F.col("tax_claimed")), "tax_read": F.col("tax_paise").isNotNull()})
