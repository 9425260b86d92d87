"""Keyed tables, windows with late rows, the state machine as a stream, commits by manifest, guarded reading."""

import datetime
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import extraction as X
from ledgerloom.operators import reversal as R
from ledgerloom.sources import books
from ledgerloom.sources.manifest import Manifest
from ledgerloom.streaming import proposals as P
from ledgerloom.streaming import windows as N
from ledgerloom.streaming.table import Table


def counts(spark, folder, fan=3):
    return Table(spark, folder, "k string, n long, first struct<version:long,seq:long>", ["k"], [F.sum("n").alias("n"), F.min("first").alias("first")], ("k", "n", F.col("first.version").alias("version")), fan=fan)


def rows_of(spark, keys):
    return lambda version: spark.createDataFrame([(k, 1) for k in keys], "k string, n long").withColumn("first", F.struct(F.lit(version).cast("long").alias("version"), F.lit(0).cast("long").alias("seq")))


def test_table_takes_a_batch_once_and_merges_runs(spark, tmp_path):
    table, want = counts(spark, f"file://{tmp_path}/t"), Counter()
    for batch in range(11):
        keys = [f"k{(batch * 3 + i) % 10}" for i in range(4)]
        table.add(rows_of(spark, keys), batch, "w")
        table.add(rows_of(spark, keys), batch, "w")  # the same batch again, as after a failure
        want.update(keys)
        runs = table.manifest.newest()[1]["runs"]
        assert len(runs) <= 3 and {r["k"]: r["n"] for r in table.read().collect()} == dict(want)
    assert {r["k"]: r["version"] for r in table.read().collect()}["k0"] == 1  # who was first stays first through merges
    table.add(rows_of(spark, ["k0"]), 0, "another")  # a writer with numbers of its own
    assert {r["k"]: r["n"] for r in table.read().collect()}["k0"] == want["k0"] + 1
    alive = {r["path"] for n in table.manifest.numbers() for r in table.manifest.at(n)["runs"]}
    assert {f"runs/{p.name}" for p in (tmp_path / "t/runs").iterdir() if p.is_dir()} == alive and len(table.manifest.numbers()) == 2
    assert counts(spark, f"file://{tmp_path}/none").read().count() == 0


def test_table_starts_again_after_a_failure_before_the_commit(spark, tmp_path, monkeypatch):
    table = counts(spark, f"file://{tmp_path}/t")
    table.add(rows_of(spark, "ab"), 0, "w")
    with monkeypatch.context() as m:
        m.setattr(Manifest, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            table.add(rows_of(spark, "ac"), 1, "w")
    assert {r["k"] for r in table.read().collect()} == set("ab")
    table.add(rows_of(spark, "ac"), 1, "w")
    assert {r["k"]: r["n"] for r in table.read().collect()} == {"a": 2, "b": 1, "c": 1}


def test_table_of_two_writers_loses_nothing(spark, tmp_path, monkeypatch):
    table, other = counts(spark, f"file://{tmp_path}/t"), counts(spark, f"file://{tmp_path}/t")
    once, real = [], Manifest.commit

    def commit(self, number, content):
        if not once:
            once.append(1)
            other.add(rows_of(spark, "b"), 0, "other")  # commits the number that this one is about to
        return real(self, number, content)

    monkeypatch.setattr(Manifest, "commit", commit)
    table.add(rows_of(spark, "a"), 0, "w")
    assert {r["k"]: r["version"] for r in table.read().collect()} == {"b": 1, "a": 2}


def test_manifests_are_whole_and_numbered(spark, tmp_path):
    m = Manifest(spark, f"file://{tmp_path}/m")
    assert m.newest() == (0, {}) and m.commit(1, {"a": "é"}) and not m.commit(1, {"a": 2}) and m.newest() == (1, {"a": "é"})
    assert [p.name for p in (tmp_path / "m/manifest").iterdir() if not p.name.endswith(".crc")] == ["000000000001.json"]


def test_companies_are_replaced_at_once(spark, tmp_path):
    schema = "company_key string, vendor_key string, times long"
    index = spark.createDataFrame([("c", "k", 1), ("d/é=", "k", 2), ("e", "k", 3)], schema)
    own = books.Companies(spark, f"file://{tmp_path}/index", schema)
    assert own.read().count() == 0
    own.write(index)
    before = own.read()
    own.replace(index.filter("company_key = 'c'").withColumn("times", F.lit(9).cast("long")), "c")
    assert {(r["company_key"], r["times"]) for r in own.read().collect()} == {("c", 9), ("d/é=", 2), ("e", 3)}
    assert {(r["company_key"], r["times"]) for r in before.collect()} == {("c", 1), ("d/é=", 2), ("e", 3)}  # begun before, read to the end
    own.forget("d/é=")
    own.forget("nobody")
    assert {r["company_key"] for r in own.read().collect()} == {"c", "e"} and {r["company_key"] for r in own.read(["e", "x"]).collect()} == {"e"}
    gone = {p for p in (tmp_path / "index/data").glob("*/folder=*")}
    assert len(gone) == 1  # forgotten and replaced rows are gone from the disk
    own.replace(index.limit(0), "c")
    assert {r["company_key"] for r in own.read().collect()} == {"e"}
    with pytest.raises(ValueError, match="another company"):
        own.replace(index, "c")


def _log(spark, rows):
    t = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(c, o, t + datetime.timedelta(minutes=m), "write_attempted" if m % 2 else "decided", "unknown" if m % 3 == 0 else "valid") for c, o, m in rows], "company_key string, operation_id string, ts timestamp, action string, outcome string")


def test_windows_close_once_and_late_rows_are_kept(spark, tmp_path):
    w = N.metrics(spark, f"file://{tmp_path}/w", late="10 minutes", size="1 hour")
    w.add(_log(spark, [("c", "o", 5), ("c", "o", 50), ("d", "o", 65)]), 0)
    assert w.rows("closed").count() == 0 and w.rows("late").count() == 0  # the first hour ends at 60, the watermark stands at 55
    w.add(_log(spark, [("c", "o", 30), ("c", "o", 75)]), 1)  # before the watermark, in a window that is open: counted
    assert {(r["company_key"], r["rows"]) for r in w.rows("closed").collect()} == {("c", 3)} and w.rows("open").count() == 2
    w.add(_log(spark, [("c", "o", 59), ("e", "o", 1), ("c", "o", 70)]), 2)
    w.add(_log(spark, [("c", "o", 59), ("e", "o", 1), ("c", "o", 70)]), 2)  # the same batch again
    late = w.rows("late").collect()
    assert sorted(r["company_key"] for r in late) == ["c", "e"] and {r["batch"] for r in late} == {2}
    w.add(_log(spark, []), 3)
    again = N.metrics(spark, f"file://{tmp_path}/w", late="10 minutes", size="1 hour")  # another process goes on
    again.add(_log(spark, [("z", "o", 500)]), 4)
    assert {(r["company_key"], r["start"].hour, r["rows"]) for r in again.rows("closed").collect()} == {("c", 0, 3), ("c", 1, 2), ("d", 1, 1)}
    assert again.rows("open").count() == 1 and len(list((tmp_path / "w/open").iterdir())) <= 2


def test_sessions_in_batches_are_those_of_all_rows(spark, tmp_path):
    rng = random.Random(2)
    rows = [("c", f"o{rng.randrange(6)}", m) for m in sorted(rng.randrange(2000) for _ in range(300))]
    w = N.sessions(spark, f"file://{tmp_path}/w", gap="30 minutes", late="60 minutes")
    parts = [rows[i * 75 : (i + 1) * 75] for i in range(4)]
    for k, part in enumerate(parts):
        rng.shuffle(part)
        w.add(_log(spark, part), k)
    want, by = Counter(), defaultdict(list)
    for _, o, m in rows:
        by[o].append(m)
    for o, ms in by.items():
        n = 1
        for a, b in zip(sorted(ms), sorted(ms)[1:]):
            if b - a < 30:
                n += 1
            else:
                want[o, n] += 1
                n = 1
        want[o, n] += 1
    got = w.rows("closed").unionByName(w.rows("open")).collect()
    assert w.rows("late").count() == 0 and Counter((r["operation_id"], r["lines"]) for r in got) == want and w.rows("closed").count() > 10


def _events(spark, n=400, seed=3):
    rng = random.Random(seed)
    names = sorted({e for e, *_ in R.EDGES})
    return [(f"p{rng.randrange(25)}", k, rng.choice(names), rng.choice(["why", None, " "]), rng.choice(["op", "op", None]), rng.choice(["me", None])) for k in range(n)]


SCHEMA = "proposal string, seq long, event string, reason string, operation_id string, actor string"


def test_state_machine_as_a_stream_is_the_fold(spark, tmp_path):
    rows = _events(spark)
    rng = random.Random(5)
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for part in (rows[:150], rows[150:160], rows[160:]):  # three batches, the query starts anew for each
        rng.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        P.follow(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    want = {r["proposal"]: (r["state"], r["illegal"]) for r in R.folded(spark.createDataFrame(rows, SCHEMA), ["proposal"]).collect()}
    assert {r["proposal"]: (r["state"], r["illegal"]) for r in P.states(spark, f"{tmp_path}/out").collect()} == want
    assert len({s for s, _ in want.values()}) > 2
    last = max(k for p, k, *_ in rows if p == "p1")
    spark.createDataFrame([("p1", last, "answered", "x", "op", "me"), ("p1", 0, "answered", "x", "op", "me"), ("p99", 1, "conservation_passed", None, None, None)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    P.follow(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    refused = Counter(r["verdict"] for r in P.told(spark, f"{tmp_path}/out", True).collect())
    assert refused == {P.ILLEGAL: sum(n for _, n in want.values()), P.REPLAY: 1, P.LATE: 1}
    assert {r["proposal"]: (r["state"], r["illegal"]) for r in P.states(spark, f"{tmp_path}/out").collect()} == want | {"p99": ("observed", 0)}
    assert {r["verdict"] for r in P.told(spark, f"{tmp_path}/out", False).collect()} == {P.LEGAL}


def _docs(spark, rows):
    return spark.createDataFrame([(n, k, bytearray(d) if d is not None else None, "m") for k, (n, d) in enumerate(rows)], "name string, seq long, data binary, mime string")


OUTAGES = [
    (TimeoutError("no answer in 5 s"), "TimeoutError: no answer in 5 s"), (ConnectionError("refused"), "ConnectionError: refused"), (ValueError(""), "ValueError: no message"), (KeyError("total"), "KeyError: 'total'"), (RecursionError("too deep"), "RecursionError: too deep"),
    (UnicodeDecodeError("utf-8", b"\xff", 0, 1, "bad"), "UnicodeDecodeError: 'utf-8' codec can't decode byte 0xff in position 0: bad"), (MemoryError("full"), "MemoryError: full"), (None, "TypeError: the reader answered with a NoneType instead of fields"),
    ("text", "TypeError: the reader answered with a str instead of fields"), ([1], "TypeError: the reader answered with a list instead of fields"),
]


def test_no_outage_of_a_document_loses_a_row_or_a_reason(spark):
    def read(data, mime):
        text = data.decode()
        if text.startswith("bad "):
            answer = OUTAGES[int(text.split()[1])][0]
            if isinstance(answer, Exception):
                raise answer
            return answer
        return {"party": text, "total": None if "hollow" in text else 5, "date": " " if "hollow" in text else "d", "extra": "e"}

    rows = [(f"bad{k}", f"bad {k}".encode()) for k in range(len(OUTAGES))] + [("good", b"Acme"), ("hollow", b"hollow"), ("again", b"Acme"), ("bad again", b"bad 3"), ("null", None), ("null too", None)]
    out = X.guarded(_docs(spark, rows), X.by_row(read), ("party", "total", "date"), "ladder")
    broken = {r["name"]: r for r in out.broken.collect()}
    fields = {r["name"]: r for r in out.read.collect()}
    assert {r["name"]: r["first_seen_as"] for r in out.repeats.collect()} == {"again": "good", "bad again": "bad3"}
    assert {f"bad{k}": says for k, (_, says) in enumerate(OUTAGES)} == {n: r["failure"] for n, r in broken.items() if n.startswith("bad")}
    assert all(r["sources"] == dict.fromkeys(("party", "total", "date"), f"not found: {r['failure']}") for r in broken.values())
    assert broken["null"]["failure"].startswith("AttributeError") and "null too" in broken
    assert fields["good"]["fields"] == {"party": "Acme", "total": "5", "date": "d", "extra": "e"} and fields["good"]["complete"] and set(fields["good"]["sources"].values()) == {"ladder"}
    hollow = fields["hollow"]
    assert hollow["fields"] == {"party": "hollow", "extra": "e"} and not hollow["complete"] and hollow["sources"]["total"] == hollow["sources"]["date"] == "not found: ladder gave no value for it"
    assert {r["output"]: r["n"] for r in X.counted(out).collect()} == {"read": 2, "broken": len(OUTAGES) + 2, "repeats": 2}


def test_whatever_a_reader_does_the_outputs_add_up(spark):
    docs = _docs(spark, [("a", b"1"), ("b", b"2"), ("c", b"3"), ("d", b"4"), ("e", b"5"), ("f", b"1")])
    answer = lambda d, f: d.select("name", F.create_map(F.lit("x"), F.lit("y")).alias("fields"), F.lit(f).cast("string").alias("failure"))

    def careless(d):
        none = answer(d.filter("name = 'd'"), None).withColumn("fields", F.lit(None).cast("map<string,string>"))
        return answer(d.filter("name IN ('a', 'c')"), None).union(answer(d.filter("name = 'c'"), None)).union(none).union(answer(d.filter("name = 'e'"), " ")).union(answer(d.filter("name = 'a'").withColumn("name", F.lit("unasked")), None))

    out = X.guarded(docs, careless, ("x",), "r")
    assert {r["name"]: r["failure"].split(":")[0] for r in out.broken.collect()} == {"b": "MissingAnswer", "c": "ManyAnswers", "d": "MalformedAnswer", "e": "Unexplained"}
    assert [r["name"] for r in out.read.collect()] == ["a"] and [r["name"] for r in out.repeats.collect()] == ["f"]
    down = X.guarded(docs, X.unavailable("ConnectionError: down"), ("x",), "r")
    assert down.read.count() == 0 and down.broken.count() == 5 and {r["sources"]["x"] for r in down.broken.collect()} == {"not found: ConnectionError: down"}
    nothing = X.guarded(docs.limit(0), careless, ("x",), "r")
    assert {r["output"]: r["n"] for r in X.counted(nothing).collect()} == {"read": 0, "broken": 0, "repeats": 0}


def test_an_interrupt_is_no_broken_document(spark):
    def read(data, mime):
        raise SystemExit("stop")

    with pytest.raises(Exception, match="stop|SystemExit|exit|crashed|Job aborted"):
        X.guarded(_docs(spark, [("a", b"1")]), X.by_row(read), ("x",)).broken.collect()


def test_same_bills_are_those_of_documents_that_were_read(spark):
    read = lambda data, mime: (lambda p: {"supplier": p[0], "number": p[1]} if p[0] != "bad" else 1 / 0)(data.decode().split("|"))
    rows = [("a", b"bad|7|x"), ("b", b"Acme|7|x"), ("c", b" ACME |7|y"), ("d", b"Acme|8|"), ("e", b"||1"), ("f", b"||2"), ("g", b"acme|7|z")]
    out = X.guarded(_docs(spark, rows), X.by_row(read), ("supplier", "number"))
    assert {r["name"]: r["same_as"] for r in X.same_bills(out.read).collect()} == {"b": None, "c": "b", "d": None, "e": None, "f": None, "g": "b"}
