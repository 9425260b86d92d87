"""CSV files split into byte ranges, against a reader of whole files."""

import csv
import io
import random

import pytest

from ledgerloom.sources import spend

HEAD = "Date,Supplier,Expense type,Description,Amount\n"


def rows_of(content):
    try:
        text = content.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = content.decode("cp1252")
    return {n: r for n, r in enumerate(csv.reader(io.StringIO(text, newline="")))}


def made(rng, n):
    cells = lambda: rng.choice(["plain", "", "5 inch\" pipe", '"quoted, with comma"', '"two\nlines"', '"a ""word"" in it"', '"\n\n"', "é—x", '""', '" lead', "1,2", '"x"', '","', '"""all"""', "ends\""])
    out = []
    for _ in range(n):
        row = ",".join(cells() for _ in range(rng.randint(1, 7)))
        if row.count('"') % 2 == 0 or rng.random() < 0.1:
            out.append(row)
    return out




@pytest.mark.parametrize("size", [40, 300, 1 << 20])
def test_records_of_split_files_are_those_of_whole_ones(spark, tmp_path, size):
    rng = random.Random(size)
    want = {}
    for k in range(6):
        text = HEAD + "\n".join(made(rng, 120)) + rng.choice(["", "\n"])
        content = text.encode("utf-8-sig") if k % 3 == 0 else text.encode("utf-8") if k % 3 == 1 else text.replace("é—x", "caf\xe9 \x80").encode("latin-1")
        (tmp_path / f"f{k}.csv").write_bytes(content)
        want |= {(f"f{k}.csv", n): r for n, r in rows_of(content).items()}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        rows = spend.records(spark, str(tmp_path))
        got = {(r["path"].split("/")[-1], r["number"]): r["record"] for r in rows.collect()}
        parsed = {(r["path"].split("/")[-1], r["number"]): r["cells"] for r in rows.select("path", "number", spend.cells(rows["record"], 12).alias("cells")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert got.keys() == want.keys()
    assert {k: next(csv.reader(io.StringIO(v, newline="")), []) for k, v in got.items()} == want
    odd = {k for k in want if parsed[k] != want[k]}
    assert all(any('"' in c.strip('"') or c.startswith('"') for c in parsed[k]) for k in odd) and len(odd) < len(want) // 2  # only cells that are quoted in part


def test_a_header_over_lines_and_files_without_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Date,Supplier,"Expense\n type",Description,Amount,"un,used"\n03/11/2025,A,Rent,x,£5,\n\n03/11/2025,B,"Rent\n\n2",y,£6,z,more,still\n')
    (tmp_path / "b.csv").write_text("")
    (tmp_path / "c.csv").write_text(HEAD)
    (tmp_path / "d.csv").write_text(HEAD + '03/11/2025,C,Rent,z,"£7')
    got = {(r["path"][-5:], r["number"]): r["cells"] for r in spend.read_files(spark, str(tmp_path)).collect()}
    assert got == {("a.csv", 1): ["03/11/2025", "A", "Rent", "x", "£5", ""], ("a.csv", 2): [], ("a.csv", 3): ["03/11/2025", "B", "Rent\n\n2", "y", "£6", "z"], ("d.csv", 1): ["03/11/2025", "C", "Rent", "z", "£7"]}
    rows = {(r["path"][-5:], r["number"]): (r["amount"], r["reasons"]) for r in spend.load(spend.read_files(spark, str(tmp_path))).collect()}
    assert rows["a.csv", 2] == (None, [spend.SHORT_ROW]) and rows["d.csv", 1] == (700, [])
    (tmp_path / "e.csv").write_text("Date,Amount\n1,2\n")
    with pytest.raises(ValueError, match=r"e\.csv: narration"):
        spend.read_files(spark, str(tmp_path))
