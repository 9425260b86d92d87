"""Published spend files: headers by alias, encodings by file, every row loaded or set aside with every reason."""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import money as M
from ..functions import text as X
from ..functions.reading import let
from ..shared import kept

#: Published headers, folded, that supply each field; and why a row isn't loaded.
ALIASES = {
    "narration": ("narrative", "description", "item text", "publication description", "invoice cost centre description", "po catergory description"),
    "account": ("expense type", "invoice account description"),
    "party": ("supplier", "supplier name"),
    "date": ("date of payment", "invoice paid date", "date"),
    "amount": ("amount in sterling", "transparency invoice amount", "amount", "£"),
}
SHORT_ROW = "row has fewer columns than the header"
NOT_IN_SOURCE, NOT_FOUND = "not in source", "not found"


def resolve(header: Sequence[str]) -> dict[str, int]:
    """Field to column number; a header that gives a field twice, or not at all, or repeats, is refused."""
    folded = [" ".join(h.replace(" ", " ").split()).casefold() for h in header]
    found = {}
    for field, names in ALIASES.items():
        at = [i for i, h in enumerate(folded) if h in names]
        if len(at) != 1:
            raise ValueError(f"{field}: {'no' if not at else 'more than one'} column among {folded}")
        found[field] = at[0]
    return found


#: Ends a record while it is parsed, so that its cells can be counted; no published cell is this.
_END = "\x01end\x01"
#: The characters that cp1252 has where ISO-8859-1 has controls.
_OVER = {chr(b): bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def _inside(line: Column, inside: int) -> Column:
    """1 if a quoted cell is open at the line's end, 0 if not, for a line that begins ``inside`` one or outside.

    The pieces between quotes are folded: a quote opens a cell only where one begins, two in a row inside a cell are a quote of its text, and
    others are text. The state is 0 outside, 1 inside, 2 behind a quote that closes unless the next sign is another; -1 at the line's start.
    """

    def step(state: Column, piece: Column) -> Column:
        opens = (state == -1) & (piece == "") | piece.endswith(",")
        return F.when(state == 1, 2).when((state == 2) & (piece == ""), 1).otherwise(F.when(opens, 1).otherwise(0))

    pieces = F.split(line, '"', -1)
    folded = F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), F.lit(1 if inside else -1), step)
    return F.when(line.contains('"'), (folded == 1).cast("int")).otherwise(inside)


def _outside(line: Column) -> Column:
    """``_inside`` of a line that begins outside: it ends so if no quote is left once the cells that are quoted as they should be are."""
    left = F.regexp_replace(line, '(?:^|,)"[^"]*"(?=,|$)', "")
    return F.when(line.contains('"') & left.contains('"'), _inside(line, 0)).otherwise(0)


def _states(rows: DataFrame, group: list[str], order: list[str], known: bool) -> DataFrame:
    """``rows`` (with to_0 and to_1, the state behind a row that was entered in 0 or 1) and the state before each row: at_0 and at_1, for a group entered in 0 or 1.

    A row whose two states are equal forgets what was before; of the others only how many switch the state matters. So the state before a row is that behind the last
    forgetting row, and the switches since: running sums, no loop. ``known``: groups are entered in 0, and only at_0 is made.
    """
    before = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("__turn", (F.col("to_0") > F.col("to_1")).cast("int"))
    rows = rows.withColumn("__turns", F.coalesce(F.sum("__turn").over(before), F.lit(0)))
    rows = rows.withColumn("__set", F.last(F.when(F.col("to_0") == F.col("to_1"), F.col("to_0") + F.col("__turns")), ignorenulls=True).over(before))
    at = lambda s: (F.coalesce(F.col("__set"), F.lit(s)) + F.col("__turns")) % 2
    return rows.withColumns({f"at_{s}": at(s).cast("int") for s in ((0,) if known else (0, 1))}).drop("__turn", "__turns", "__set")


def records(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """path, number (0: the header), record (text, with its quotes): CSV files of any size, split into byte ranges.

    A quoted cell may hold line ends, so whether a line begins a record hangs on all quotes before it. Every range of a file works out what it does to
    either state at its start, and how many records begin in it then; the few ranges of a file are put together, and only then lines get their record's number. A file none of
    whose lines ends inside a cell that it began outside is told first: its lines are its records, numbered by where they stand, and stay where they are. In other files, a
    record of one line stays where it is; others are joined from their lines (line ends become ``\\n``). Files that are valid UTF-8 throughout (a mark at the start is left out) are read
    so, others as cp1252.
    """
    lines = spark.read.text(list(paths) if not isinstance(paths, str) else paths)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"), F.col("value").alias("line"))
    lines = lines.withColumn("line", F.when((F.col("block") == 0) & F.col("line").startswith("\ufeff"), F.substring("line", 2, 1 << 30)).otherwise(F.col("line")))
    lines = lines.withColumns({"valid": F.is_valid_utf8("line"), "to_0": _outside(F.col("line"))})
    lines = kept(lines.withColumn("line", F.col("line").cast("binary")))  # written once: read for the ranges, then for the records
    own = W.partitionBy("path")
    ranges = lines.groupBy("path", "block").agg(F.min("nth").alias("__first"), F.count("*").alias("n"), F.max("to_0").alias("open"), F.bool_and("valid").alias("valid"))
    ranges = ranges.withColumns({"__before": F.sum("n").over(own.orderBy("block")) - F.col("n"), "open": F.max("open").over(own), "__valid": F.min("valid").over(own)})
    ranges = kept(ranges.select(F.col("path").alias("__path"), F.col("block").alias("__block"), "__first", "__before", "open", "__valid"))
    plain = _of_range(lines, ranges.filter("open = 0"))
    plain = plain.select("path", (F.col("__before") + F.col("nth") - F.col("__first")).alias("number"), _read("line").alias("record"))
    cells = ranges.filter("open = 1")
    return plain if cells.isEmpty() else plain.unionByName(_over_lines(_of_range(lines, cells).select(*lines.columns)))


def _of_range(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    return lines.join(ranges, (F.col("path") == F.col("__path")) & (F.col("block") == F.col("__block")))


def _read(line: str) -> Column:
    """A line's bytes as text, by what its whole file is."""
    latin = F.translate(F.decode(line, "ISO-8859-1"), "".join(_OVER), "".join(_OVER.values()))
    return F.when(F.col("__valid"), F.decode(line, "UTF-8")).otherwise(latin)


def _over_lines(lines: DataFrame) -> DataFrame:
    """``records`` of files in which a cell may go over a line's end."""
    lines = lines.withColumn("to_1", _inside(F.col("line").cast("string"), 1))
    rows = _states(lines, ["path", "block"], ["nth"], known=False)
    upto = W.partitionBy("path", "block").orderBy("nth").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({f"n_{s}": F.sum(1 - F.col(f"at_{s}")).over(upto) for s in (0, 1)})
    rows = kept(rows)
    after = lambda s: F.when(F.col(f"at_{s}") == 0, F.col("to_0")).otherwise(F.col("to_1"))
    ranges = rows.groupBy("path", "block").agg(*[F.max_by(after(s), "nth").alias(f"to_{s}") for s in (0, 1)], *[F.max(f"n_{s}").alias(f"c_{s}") for s in (0, 1)], F.bool_and("valid").alias("valid"))
    ranges = _states(ranges, ["path"], ["block"], known=True)
    own = W.partitionBy("path")
    begun = F.when(F.col("at_0") == 0, F.col("c_0")).otherwise(F.col("c_1"))
    ranges = kept(ranges.select(F.col("path").alias("__path"), F.col("block").alias("__block"), F.col("at_0").alias("__at"), (F.sum(begun).over(own.orderBy("block")) - begun).alias("__before"), F.min("valid").over(own).alias("__valid")))
    rows = _of_range(rows, ranges)
    of = lambda name: F.when(F.col("__at") == 0, F.col(f"{name}_0")).otherwise(F.col(f"{name}_1"))
    rows = rows.withColumns({"at": of("at"), "number": F.col("__before") + of("n") - 1})
    rows = rows.withColumn("to", F.when(F.col("at") == 0, F.col("to_0")).otherwise(F.col("to_1")))
    rows = rows.select("path", "number", "block", "nth", "at", "to", _read("line").alias("line"))
    one = (F.col("at") == 0) & (F.col("to") == 0)
    long = rows.filter(~one).groupBy("path", "number").agg(F.array_sort(F.collect_list(F.struct("block", "nth", "line"))).alias("parts"), F.max_by("to", F.struct("block", "nth")).alias("open"))
    text = F.concat(F.array_join(F.transform("parts", lambda p: p["line"]), "\n"), F.when(F.col("open") == 1, '"').otherwise(""))  # a file may end inside a cell
    return rows.filter(one).select("path", "number", F.col("line").alias("record")).unionByName(long.select("path", "number", text.alias("record")))


def cells(record: Column, width: int) -> Column:
    """The cells of a record, of ``width`` at most; none in an empty one. A cell that isn't quoted as it should be keeps its quotes."""
    schema = ", ".join(f"c{k} string" for k in range(width + 1))
    options = {"quote": '"', "escape": '"', "nullValue": "\x02", "emptyValue": "", "maxCharsPerColumn": "-1", "mode": "PERMISSIVE"}
    row = F.from_csv(F.concat(record, F.lit(f",{_END}")), schema, options)
    every = let(row, lambda r: F.array(*[F.coalesce(r[f"c{k}"], F.lit("")) for k in range(width + 1)]))  # the record is parsed once
    counted = lambda x: F.slice(x, F.lit(1), F.when(F.array_contains(x, _END), F.array_position(x, F.lit(_END)).cast("int") - 1).otherwise(width))
    return F.when(record == "", F.array().cast("array<string>")).otherwise(let(every, counted))


def read_files(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """path, number (from 1), cells, columns: the rows of CSV files of any size, however they are split; see ``records``.

    ``columns`` are the places of the five fields in that file. Each distinct header is resolved once; one that can't be fails the read and names its file.
    """
    every = kept(records(spark, paths))
    headers = every.filter("number = 0").groupBy("record").agg(F.min("path").alias("path")).collect()  # a row per distinct header
    known, width = [], 1
    for r in headers:
        names = next(csv.reader(io.StringIO(r["record"], newline="")), [])
        try:
            found = resolve(names)
        except ValueError as e:
            raise ValueError(f"{r['path']}: {e}") from None
        width = max(width, len(names))
        known.append((r["record"], [found[f] for f in ALIASES]))
    places = spark.createDataFrame(known, "record string, columns array<int>")
    of = every.filter("number = 0").join(places, "record").select("path", "columns")
    named = F.broadcast(of) if of.limit(ONE_BY_ONE + 1).count() <= ONE_BY_ONE else of
    rows = every.filter("number > 0").join(named, "path")
    return rows.select("path", F.col("number").cast("int").alias("number"), F.explode(F.array(cells(F.col("record"), width))).alias("cells"), "columns")  # a record is parsed once: no filter goes below


#: Files whose places are broadcast, at most.
ONE_BY_ONE = 10_000


def load(rows: DataFrame) -> DataFrame:
    """path, number, date, party, narration, account, amount, reasons: one row per published row; no reasons: it is loaded."""
    cell = lambda f: F.coalesce(F.get("cells", F.get("columns", F.lit(list(ALIASES).index(f)))), F.lit(""))
    short = F.size("cells") <= F.array_max("columns")
    typed = F.struct(
        short.alias("short"), let(X.clean(cell("date")), M.date_of).alias("date"), X.clean(cell("party")).alias("party"), X.clean(cell("narration")).alias("narration"),
        X.clean(cell("account")).alias("account"), let(F.translate(X.clean(cell("amount")), ",£ ", ""), M.pence_of).alias("amount"),
    )
    typed = rows.select("path", "number", F.inline(F.array(typed)))  # and a row is read once
    reasons = F.array_compact(F.array(
        F.when(F.col("narration") == "", "narration is empty"), F.when(F.col("account") == "", "account is empty"), F.when(F.col("party") == "", "party is empty"),
        F.when(F.col("date").isNull(), "date is unreadable"), F.when(F.col("amount").isNull(), "amount is unreadable"),
    ))
    return typed.withColumn("reasons", F.when(F.col("short"), F.array(F.lit(SHORT_ROW))).otherwise(reasons)).drop("short")


def report(rows: DataFrame) -> DataFrame:
    """Per file: rows = loaded + rejected, refunds, and each reason's count (a row may have several)."""
    ok = F.size("reasons") == 0
    per = rows.groupBy("path").agg(F.count("*").alias("rows"), F.count_if(ok).alias("loaded"), F.count_if(~ok).alias("rejected"), F.count_if(ok & (F.col("amount") < 0)).alias("refunds"))
    why = rows.select("path", F.explode("reasons").alias("reason")).groupBy("path", "reason").agg(F.count("*").alias("n"))
    why = why.groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("by_reason"))
    return per.join(why, "path", "left")


def as_vouchers(rows: DataFrame, code: str, url: str) -> DataFrame:
    """Loaded rows as vouchers named CODE-00001; what isn't published says so."""
    found = F.create_map(*[F.lit(x) for c in ("date", "party", "narration", "debit_account") for x in (c, url)], F.lit("amount_paise"), F.lit(f"{url} (pence)"), F.lit("credit_account"), F.lit(NOT_FOUND), F.lit("gst_paise"), F.lit(NOT_FOUND))
    return rows.filter(F.size("reasons") == 0).select(
        F.concat(F.lit(f"{code}-"), F.lpad(F.col("number").cast("string"), 5, "0")).alias("id"), "date", "party", "narration", F.col("account").alias("debit_account"), F.lit(NOT_IN_SOURCE).alias("credit_account"),
        F.col("amount").alias("amount_paise"), F.lit(None).cast("bigint").alias("gst_paise"), found.alias("provenance"),
    )


def chart(vouchers: DataFrame) -> DataFrame:
    return vouchers.select(F.col("debit_account").alias("account")).union(vouchers.select("credit_account")).distinct()
