"""Small tables with every odd case, held against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("ledgerloom.llm")
from pyspark.sql import functions as F  # noqa: E402

from ledgerloom.llm import ctw, extract, hnsw, leaks, licences, mixing, near, secrets, toxicity, warc  # noqa: E402
from ledgerloom.llm.common import shared_folder  # noqa: E402

WORDS = [f"{a}{b}" for a in "an be co du el fi ga ho".split() for b in "ra se ti no pu lé".split()]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def documents():
    """(doc_id, text, source): nulls, empty, short, long, exact and near copies, repeated rows."""
    base = prose(1, 120)
    rows = [(1, None, "a"), (2, "", "a"), (3, "  \n ", "b"), (4, "One two", "b"), (5, "one TWO", None), (None, "lonely text without an id at all", "c"), (None, None, None)]
    rows += [(10 + i, base if i < 3 else base.replace(" ", "\n", i), "hot") for i in range(6)]
    for i in range(6):
        words = base.split()
        words[20 * i] = f"changed{i}"
        rows.append((20 + i, " ".join(words), "hot"))
    rows += [(40 + i, prose(100 + i, 30 + 40 * i), "hot" if i % 2 else "d") for i in range(8)]
    rows += [(60, prose(7, 6000), "long"), (61, prose(8, 50), "e"), (61, prose(8, 50), "e")]
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, "doc_id long, text string, source string").withColumn("score", F.lit("clash")).withColumn("key", F.lit(7))


def words(text, pattern=r"[^\x20\x09-\x0D]+"):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(pattern, low)


PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain_queue(rows, weight_of):
    """Words taken from each (source, key), one copy after the other in order of finish time."""
    sizes, units = defaultdict(int), defaultdict(list)
    for d, t, s in rows:
        n = len(words(t))
        text = "" if t is None else hashlib.md5(t.encode()).hexdigest()
        sizes[s] += n
        units[s, hashlib.md5(f"{'' if d is None else d}:{text}".encode()).hexdigest()].append(n)
    copies, at = [], defaultdict(int)
    for s, k in sorted(units, key=lambda u: (u[0] is None, u[0] or "", u[1])):
        n = sum(units[s, k])
        at[s] += n
        copies += [((r * sizes[s] + at[s]) / weight_of[s], s is None, s or "", k, r, n) for r in range(3) if n]
    left, taken = sum(sizes.values()), defaultdict(int)
    for _, none, s, k, _, n in sorted(copies):
        taken[None if none else s, k] += min(n, left)
        left -= min(n, left)
    return {u: taken[u] // len(own) for u, own in units.items()}


def test_mixing_is_the_queue(spark):
    """Against a plain queue, with a source that holds a third of all words and is used up three times over."""
    rows = documents() + [(1000 + i, prose(i, 1 + i % 40), "hot" if i % 3 else f"s{i % 7}") for i in range(150)] + [(2000, prose(5, 30), "tiny")]
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows) and {"key", "score", "text"} <= set(got[0].asDict())
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    sizes = {s: sum(len(words(t)) for _, t, x in rows if x == s) for s in names}
    want = plain_queue(rows, weight)
    by, longest = defaultdict(int), defaultdict(int)
    for r in got:
        text = "" if r["text"] is None else hashlib.md5(r["text"].encode()).hexdigest()
        key = hashlib.md5(f"{'' if r['doc_id'] is None else r['doc_id']}:{text}".encode()).hexdigest()
        assert r["taken"] == want[r["source"], key] and r["size"] == len(words(r["text"])) and r["taken"] <= 3 * r["size"]
        assert r["source_size"] == sizes[r["source"]] and r["target"] <= 3 * r["source_size"] + 1e-6
        by[r["source"], r["target"]] += r["taken"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    assert all(abs(taken - target) <= 2 * max(longest.values()) for (_, target), taken in by.items())
    assert abs(sum(t for _, t in by) - sum(sizes.values())) < 1e-6
    assert sum(sizes.values()) - sum(by.values()) <= 1  # only the rounding of rows that share
    again = mixing.mix(frame(spark, rows).repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(frame(spark, [])).count() == 0


def test_mixing_replaces_clashing_names_and_keeps_to_a_budget(spark):
    rows = [(i, prose(i, 10), "ab"[i % 2]) for i in range(40)]
    clash = frame(spark, rows).selectExpr("*", "1 AS size", "2 AS target", "3 AS before", "4 AS taken", "5 AS round", "6 AS weight")
    got = mixing.mix(clash, budget=105).collect()
    assert len(got) == 40 and sum(r["taken"] for r in got) == 105 and {r["size"] for r in got} == {10} and {r["round"] for r in got} == {5}
    assert sum(1 for r in got if r["taken"] % 10) == 1  # the copy that the budget's end cuts, alone


@pytest.mark.parametrize("sizes", [[10, 1000, 5], [1, 1, 1, 1, 500], [7], [0, 0], [100, 0, 3]])
def test_targets_by_water_filling(spark, sizes):
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")).collect()}
    weight = {f"s{i}": (5, 2, 1)[i % 3] for i in range(len(sizes))}
    want, left, free = {}, float(sum(sizes)), dict(enumerate(sizes))
    while free:
        total = sum(weight[f"s{i}"] for i in free)
        over = [i for i, n in free.items() if left * weight[f"s{i}"] / total >= 3 * n]
        if not over:
            want |= {f"s{i}": left * weight[f"s{i}"] / total for i in free}
            break
        for i in over:
            want[f"s{i}"] = 3.0 * free.pop(i)
        left = sum(sizes) - sum(want.values())
    assert got == pytest.approx(want)


def test_near_copies_against_brute_force(spark):
    def sets(text):
        w = words(text)
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    rows = documents()
    own = [sets(t) for _, t, _ in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(own[i] & own[j])
            if both and 100 * both >= 75 * len(own[i] | own[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = defaultdict(list)
    for (d, _, _), g in zip(rows, group, strict=True):
        if d is not None:
            least[g].append(d)
    want = sorted(str((d, len(s), min(least[g]) if s and least[g] else d)) for (d, _, _), s, g in zip(rows, own, group, strict=True))
    found = near.classes(frame(spark))
    assert sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in found.collect()) == want
    stay = near.one_of_each(frame(spark))
    assert stay.columns == frame(spark).columns
    classes = {g for g, s in zip(group, own, strict=True) if s}
    assert stay.count() == len(classes) + sum(not s for s in own)
    assert near.classes(frame(spark, [])).count() == 0


def test_near_links_chains_and_blocks(spark):
    """A chain whose ends are far apart is one class; a block size of 1 changes nothing."""
    words_ = prose(5, 300).split()
    rows = []
    for i in range(12):
        rows.append((i, " ".join(words_[5 * i : 5 * i + 120]), "x"))
    found = near.classes(frame(spark, rows)).collect()
    assert {r["component_id"] for r in found} == {0}


def test_agreement_is_corrected_for_chance(spark):
    a = [prose(i, 200) for i in range(40)]
    nodes = near.signed(frame(spark, [(i, t, "x") for i, t in enumerate(a)])).withColumnRenamed("n", "m")
    x, y = nodes.filter("doc_id < 20").alias("x"), nodes.filter("doc_id >= 20").alias("y")
    share = x.crossJoin(y).select(F.avg(near.agreement("x", "y"))).head()[0] / near.MINIMA
    assert abs(share - 2.0**-near.BITS) < 0.02


def test_leaks_against_brute_force(spark):
    items = [(1, prose(40, 25)), (2, "Just six words stand in here"), (3, None), (4, ""), (None, prose(41, 12)), (5, prose(40, 25))]
    rows = [(1, "before " + items[0][1].upper().replace(" ", " - ") + " after", "a"), (2, "so just six WORDS, stand in-here now", "a"), (3, None, "a"), (None, " ".join(items[4][1].split()[:10]), "b"), (5, " ".join(items[0][1].split()[:9]), "b")] + documents()
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    want = []
    seen = Counter(w for _, text, _ in rows for w in words(text, PLAIN))
    for d, text, _ in rows:
        own, hit, names, close = words(text, PLAIN), set(), set(), set()
        at = defaultdict(list)
        for p, w in enumerate(own):
            at[w].append(p)
        for item, t in items:
            w = words(t, PLAIN)
            k = min(10, len(w))
            for s in range(len(w) - k + 1 if w else 0):
                for p in range(len(own) - k + 1):
                    if own[p : p + k] == w[s : s + k]:
                        hit |= set(range(p, p + k))
                        names.add("" if item is None else str(item))
                rare = sorted(range(s, s + k), key=lambda i: (seen[w[i]], i))[:3]
                first, *rest = (x for _, x in sorted({(seen[w[i]], w[i].encode()) for i in rare}))
                if any(all(any(abs(b - a) <= k + 10 for b in at[x.decode()]) for x in rest) for a in at[first.decode()]):
                    close.add("" if item is None else str(item))
        digest = lambda x: hashlib.sha256(",".join(sorted(x)).encode()).hexdigest()
        want.append(str((d, len(own), len(hit), len(names), digest(names), bool(hit), len(close), digest(close))))
    got = leaks.digests(leaks.search(frame(spark, rows), bench)).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(want)
    assert sum(r["n_hit"] > 0 for r in got) >= 3 and sum(r["n_near"] > 0 for r in got) > 3
    clean = leaks.clean(frame(spark, rows), bench)
    assert clean.columns == frame(spark).columns and clean.count() == sum(r["n_hit"] == 0 for r in got)
    assert leaks.search(frame(spark, []), bench).count() == 0
    assert leaks.search(frame(spark), bench.limit(0)).filter("n_hit > 0").count() == 0


def test_leaks_blocks_of_items_and_proximity(spark, monkeypatch):
    item = prose(40, 14)
    swapped = item.split()
    swapped[3], swapped[9] = swapped[9], swapped[3]
    rows = [(1, "x " + item, "a"), (2, " ".join(swapped), "a"), (3, prose(99, 10), "a")]
    bench = spark.createDataFrame([(7, item), (8, prose(50, 20))], "item_id long, text string")
    found = {r["doc_id"]: r for r in leaks.search(frame(spark, rows), bench).collect()}
    assert found[1]["items"] == ["7"] and found[2]["items"] == [] and found[2]["near"] == ["7"] and found[3]["near"] == []
    monkeypatch.setattr(leaks, "ITEM_WORDS", 30)
    again = {r["doc_id"]: r for r in leaks.search(frame(spark, rows), bench).collect()}
    assert all(found[k]["n_hit"] == again[k]["n_hit"] and found[k]["items"] == again[k]["items"] for k in found)


def test_leaks_blocks_tell_rows_of_equal_ids_apart(spark, monkeypatch):
    rng = random.Random(41)
    items = [" ".join(rng.choices(WORDS, k=12)) + f" item{i}" for i in range(30)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = [(i, x, "a") for i in (None, 7) for x in items] + [(7, items[0], "a"), (7, None, "a"), (8, f"{items[1]} {items[2]} {items[3]}", "a")]
    look = lambda: sorted((repr(r) for r in leaks.search(frame(spark, rows), bench).collect()))
    whole = look()
    monkeypatch.setattr(leaks, "ITEM_WORDS", 100)
    assert look() == whole and sum("n_hit=0" in r for r in whole) == 1


def test_leaks_take_a_repeated_item_once(spark, monkeypatch):
    taken, items = [], leaks.Items
    monkeypatch.setattr(leaks, "Items", lambda own: taken.append(len(own)) or items(own))
    bench = spark.createDataFrame([(1, prose(40, 14))] * 50 + [(2, prose(41, 14))], "item_id long, text string")
    assert leaks.search(frame(spark, [(1, prose(40, 14), "a")]), bench).collect()[0]["items"] == ["1"]
    assert taken == [2]


def test_secrets_against_regular_expressions(spark):
    key = "AKIA" + "ABCD1234EFGH"
    rows = [(1, None, "a"), (2, "", "a"), (3, f"é password = \"abcdefgh\" and {key} end", "a"), (4, "token=token=abcdefghij", "b"), (5, "password: secret: abcdefghi", "b"), (6, "0123456789abcdef" * 2 + " x " + "0123456789abcdef", "c")]
    rows += [(7, f"user: alice at https://db.example.net/x {'z' * 10} Passwd=hunter2hunter2", "c"), (8, "user: bob and https://nowhere.example.org only", "d"), (9, "zZ9" * 9 + " alone " + "word " * 100 + f" {key} far", "d"), (None, "API_KEY:'" + "q" * 50 + "'", None), (11, ("apikey=12345678 " + "filler " * 50) * 40, "long")]
    kinds = [("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 8), ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32)]
    want = []
    for d, t, _ in rows:
        spans, n = [], Counter()
        for i, (k, p, ok) in enumerate(kinds):
            for m in re.finditer(p, t or ""):
                if ok(m):
                    spans.append((m.start(), i, f"{k}:{m.start()}:{m.end()}"))
                    n[k] += 1
        want.append(str((d, n["assign"], n["access"], n["hex"], hashlib.sha256(",".join(s[2] for s in sorted(spans)).encode()).hexdigest())))
    got = secrets.digests(secrets.scan(frame(spark, rows))).collect()
    assert sorted(str(tuple(r)[:5]) for r in got) == sorted(want)
    spans = {r["doc_id"]: r["spans"] for r in got}
    assert "ident:" in spans[7] and "endpoint:" in spans[7] and spans[8] == "" and "opaque" not in spans[9]
    out = {r["doc_id"]: r["text"] for r in secrets.redacted(frame(spark, rows)).collect()}
    assert out[1] is None and out[2] == "" and "hunter2" not in out[7] and key not in out[3] and out[8] == rows[7][1] and out[3].startswith("é [redacted]") and out[11].count("[redacted]") == 40
    assert secrets.scan(frame(spark, [])).count() == 0


def test_licences_against_plain_counts(spark):
    rows = [(801, None, "a"), (802, "CC-BY cc by cc  by", "a"), (803, "GNU General\nPublic, License! all rights RESERVED", "b"), (804, "Permission is hereby granted, free of charge,\nto any person obtaining a copy of this software\nand associated documentation files", "b"), (805, "permission granted", "c"), (806, "é all rights reserved é", None)] + documents()
    got = {(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]): r for r in licences.digests(licences.scan(frame(spark, rows))).collect()}
    for d, t, _ in rows:
        w = words(t, PLAIN)
        places, labels = [], set()
        for p, label in licences.PHRASES.items():
            p = p.split()
            own = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            places += own
            labels |= {label} if own else set()
        assert (d, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))) in got
    labels = {k[0]: r["labels"] for k, r in got.items()}
    assert "mit-notice" in labels[804] and labels[805] == ""
    assert licences.scan(frame(spark, [])).count() == 0


def test_licence_join_is_exact():
    """Every filter is safe: the join finds what counting all words finds."""
    rng = random.Random(3)
    vocabulary = [w.encode() for w in WORDS[:20]]
    templates = {f"t{i}": " ".join(w.decode() for w in rng.sample(vocabulary, rng.randint(1, 8))) for i in range(30)}
    index = licences.Templates(templates, {w: rng.randint(0, 5) for w in vocabulary}, 0.7)
    for _ in range(300):
        block = set(rng.sample(vocabulary, rng.randint(0, 12)))
        want = {k: len(s) for k, t in templates.items() if len((s := {x.encode() for x in t.split()}) & block) >= max(1, math.ceil(0.7 * len(s) - 1e-9))}
        assert set(dict(index.met(block))) == set(want)


def test_licences_wrapped_over_any_lines(spark):
    rows, labels = [], sorted(licences.TEMPLATES)
    for k, label in enumerate(labels):
        w = licences.TEMPLATES[label].split()
        rows += [(1000 + k, "intro\n * " + "\n * ".join(w) + "\nend", "a"), (2000 + k, "\n\n".join(" ".join(w[i : i + 4]) for i in range(0, len(w), 4)), "a")]
    w = licences.TEMPLATES["gpl-notice"].split()
    rows += [(3000, "\n".join(" ".join([x, *["other"] * 9]) for x in w), "far apart")]
    got = {r["doc_id"]: r["blocks"] for r in licences.scan(frame(spark, rows)).collect()}
    for k, label in enumerate(labels):
        assert all(label in {b["label"] for b in got[base + k]} for base in (1000, 2000)), label
    own = [b for b in got[1000 + labels.index("gpl-notice")] if b["label"] == "gpl-notice"]
    assert max(b["share"] for b in own) == 1.0 and all(b["lines"] > 3 for b in own)
    assert not any(b["label"] == "gpl-notice" for b in got[3000])


def test_warc_round_trip(spark):
    big = "<p>" + "é" * 600 + "</p>"
    pages = [(1, "http://a/ b?x=é", big), (2, None, big), (5, "u", big), (3, "u", None), (4, "u", ""), (6, "u", "short"), (7, "u", "short"), (None, "u", big), (8, "u", prose(3, 9000)), (8, "u", prose(3, 9000))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    folder = shared_folder(spark)
    index = warc.write(df, folder)
    rows = warc.read(index, folder).collect()
    assert len(rows) == len(pages)
    want = []
    for p, u, h in pages:
        data = (h or "").encode()
        twin = max((q for q, _, g in pages if g == h and q is not None), default=None)
        revisit = len(data) >= 1000 and twin is not None and p != twin
        want.append(str((p, u, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", twin if revisit else None, None if revisit else data)))
    assert sorted(str(tuple(r)[:6] + ((None if r["payload"] is None else bytes(r["payload"])),)) for r in rows) == sorted(want)
    full = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read(index.filter("page_id IN (1, 2, 6)"), folder, whole=index).collect()}
    assert full == {1: big, 2: big, 6: "short"}  # a revisit's payload is that of its response, which wasn't selected
    some = warc.read(index.filter("page_id = 6"), folder).collect()
    assert [bytes(r["payload"]) for r in some] == [b"short"]
    assert warc.write(df.limit(0), shared_folder(spark)).count() == 0


def test_ctw_sums_to_one_and_codes_well(spark):
    docs = frame(spark)
    tree = ctw.fit(docs)
    assert np.abs((10.0 ** tree.log10.astype(float)).sum(axis=1) - 1).max() < 1e-5
    rows = ctw.score(docs).collect()
    assert len(rows) == len(documents())
    counts = Counter()
    for d, t, _ in documents():
        if d is None or zlib.crc32(str(d).encode()) % 7 != 2:
            counts.update([*words(t), None])
    n, v = sum(counts.values()), len(counts)
    want = []
    for d, t, _ in documents():
        own = [*words(t), None]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)
        want.append((str(d), d is not None and zlib.crc32(str(d).encode()) % 7 == 2, len(own), sum(counts[w] > 0 for w in own), n, round(base, 6)))
    assert sorted(want) == sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows)
    long = next(r for r in rows if r["doc_id"] == 60)
    assert -long["score"] / math.log10(2) / len(documents()[-3][1].encode()) < 4
    assert ctw.score(frame(spark, [])).count() == 0


def test_ctw_weights_are_those_of_the_recursion(spark):
    """The root's weighted probability, by the definition, on a text of two letters."""
    text = b"abaababa"
    levels = [defaultdict(lambda: np.zeros(256, np.int64)) for _ in range(3)]
    data = bytes([255] * 5) + text + b"\xff"
    for i in range(5, len(data)):
        for d in range(3):
            context = int.from_bytes(data[i - d : i], "big") if d else 0
            levels[d][context][data[i]] += 1
    tree = ctw.Tree([dict(x) for x in levels])
    kt = lambda z, o: math.exp(math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi))

    def weighted(d, c):
        n = levels[d][c]
        own = kt(n[:128].sum(), n[128:].sum())
        if d == 2:
            return own
        below = 1.0
        for x in levels[d + 1]:
            if x & ((1 << 8 * d) - 1) == c:
                below *= weighted(d + 1, x)
        return 0.5 * own + 0.5 * below

    def predicted(d, c, path):
        n = levels[d][c]
        own = (n[128:].sum() + 0.5) / (n.sum() + 1)
        if d == 2:
            return own
        stop = 0.5 * kt(n[:128].sum(), n[128:].sum()) / weighted(d, c)
        longer = c | path[d] << 8 * d
        return stop * own + (1 - stop) * predicted(d + 1, longer, path)

    node = tree.child[tree.child[0, ord("a")], ord("b")]
    first_bit = (10.0 ** tree.log10[node, 128:].astype(float)).sum()
    assert first_bit == pytest.approx(predicted(0, 0, b"ab"), rel=1e-4)


def test_ctw_has_a_node_for_every_context(spark):
    """Scores are those of the whole tree, to whose deepest contexts every training text comes; nodes grow with the corpus."""
    rng = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz é"
    rows = [*documents(), *[(100 + i, "".join(rng.choice(letters) for _ in range(400)), "r") for i in range(60)]]
    docs = frame(spark, rows)
    tree = ctw.fit(docs.filter(~ctw.held_out(F.col("doc_id"))))
    assert len(tree.child) > 6 * 4096
    got = defaultdict(list)
    for r in ctw.score(docs).collect():
        got[r["doc_id"]].append(r["score"])
    want = defaultdict(list)
    for (d, _, _), s in zip(rows, tree.scores([(t or "").encode() for _, t, _ in rows]), strict=True):
        want[d].append(s)
    assert all(sorted(got[d]) == pytest.approx(sorted(want[d]), rel=1e-5) for d in want) and len(got) == len(want)
    assert any(zlib.crc32(str(d).encode()) % 7 == 2 for d in want if d is not None)
    untrained = frame(spark, [(d, t, s) for d, t, s in rows if d is not None and zlib.crc32(str(d).encode()) % 7 == 2])
    sizes = {d: len((t or "").encode()) + 1 for d, t, _ in rows}
    assert all(r["score"] == pytest.approx(-8 * sizes[r["doc_id"]] * math.log10(2)) for r in ctw.score(untrained).collect())


def test_toxicity_learns_words_and_pairs(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(900):
        w = [rng.choice(WORDS) for _ in range(rng.randint(5, 60))]
        toxic = i % 3 == 0
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(["vilest", "scumbag"]))
        rows.append((i, " ".join(w), "s"))
        labels.append((i, 1, int(toxic)))
    labels += [(None, 1, 1), (5000, 1, 1), (3, 1, None)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = frame(spark, rows + [(None, None, None), (9001, "", "x")])
    machine = toxicity.fit(docs, known)
    got = toxicity.score(docs, machine, ["doc_id"]).collect()
    assert len(got) == len(rows) + 2 and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 900 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert sum((r["score"] >= 0.5) == (r["doc_id"] % 3 == 0) for r in held) >= 0.97 * len(held)
    again = toxicity.score(docs.repartition(3), toxicity.fit(docs.repartition(5), known), ["doc_id"]).collect()
    assert {(r["doc_id"], round(r["score"], 9)) for r in got} == {(r["doc_id"], round(r["score"], 9)) for r in again}
    nothing = toxicity.fit(docs, known.limit(0))
    assert {r["score"] for r in toxicity.score(docs, nothing, ["doc_id"]).collect()} == {0.0}


def test_toxicity_learns_an_interaction_from_documents(spark):
    """Two words that count only together: neither tells the labels apart, and fit() has to let both in."""
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        w = [rng.choice(WORDS) for _ in range(30)] + ["grumpf"] * a + ["zorbs"] * b
        rng.shuffle(w)
        rows.append((i, " ".join(w), "s"))
        labels.append((i, 1, int(a != b)))
    docs, known = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    machine = toxicity.fit(docs, known)
    assert not machine.alone.all()
    held = {i for i in range(3000) if zlib.crc32(str(i).encode()) % 5 == 0}
    got = {r["doc_id"]: r["score"] >= 0.5 for r in toxicity.score(docs, machine, ["doc_id"]).collect() if r["doc_id"] in held}
    assert np.mean([got[i] == bool(labels[i][2]) for i in held]) > 0.95


def test_toxicity_counts_a_document_once_and_reads_long_texts(spark):
    rows = [(i, f"filler {'vilest' if i % 2 else 'kindest'} words {i}", "s") for i in range(200)]
    known = spark.createDataFrame([(i, 1, i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    once = toxicity.fit(frame(spark, rows), known)
    often = toxicity.fit(frame(spark, rows + [rows[1]] * 400 + [(2, None, "s")] * 50), known)
    assert often.wanted == once.wanted and often.bias == once.bias and np.array_equal(often.w, once.w)
    long = frame(spark, [(1, "plain words " * 200_000 + "vilest", "s"), (3, None, None), (3, None, None)])
    got = toxicity.score(long, once, ["doc_id"]).collect()
    assert len(got) == 3 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(long.limit(0), once, ["doc_id"]).count() == 0


def test_hnsw_recall_and_exact_scores(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    x[1:1500:3] = x[1]  # a third of all rows are one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(9100, None), (9200, [0.0] * 24), (9300, [float("nan")] + [1.0] * 23), (9400, [None] + [1.0] * 23), (None, [1.0] * 24), (100, x[100].tolist()), (9500, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    monkeypatch.setattr(hnsw, "SHARD", 400)
    got = defaultdict(list)
    for r in hnsw.nearest(df).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 1500, 100))
    hit = 0
    for q, found in got.items():
        far = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        best = sorted((d, i) for i, d in enumerate(far.tolist()) if i != q)[:10]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11)) and all(s == pytest.approx(far[v], rel=1e-12) for _, v, s in found)
        hit += len({v for _, v, _ in found} & {i for _, i in best})
    assert hit >= 0.9 * 10 * len(got)
    assert hnsw.nearest(df.limit(0)).count() == 0


def test_extract_pages(spark):
    page = """<!doctype html><html><head><title>T</title><script>var a="</p>";</script></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href=1>Menu</a></ul></nav>
    <div class=ad>Buy, buy, buy, and buy more and more and more things now.</div><article><h1>A &amp; B</h1><p>First, <b>bold</b>ly  written&nbsp;paragraph, with commas.<br>New line<p>Second paragraph, unclosed, also long enough to count.
    <aside>Aside, aside, aside, aside, aside, aside, aside.</aside><form><p>Your mail, please, now, at once, for news?</p></form></article><section id="comments"><p>Great, great, great, great, great post, really it was.</p></section><footer>&copy; me</footer></body>"""
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "plain words, no markup"), (5, "u", "<div><p>Only &lt;one&gt; paragraph, here, that is long enough.</p></div>"), (1, "u", page), (None, "u", "<article>" + "<p>Long, long text of a page.</p>" * 500)]
    got = extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    texts = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert texts[1] == "A & B First, boldly written paragraph, with commas. New line Second paragraph, unclosed, also long enough to count."
    assert texts[2] == texts[3] == "" and texts[4] == "plain words, no markup" and texts[5] == "Only <one> paragraph, here, that is long enough." and len(texts[None]) == 500 * 27 - 1
    assert extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def made_page(rng):
    """A page of random make, and the text of its article as it was put together."""
    said, kept_ = lambda n: " ".join(rng.choice(WORDS) for _ in range(n)) + ", " + rng.choice(WORDS) + ".", []

    def paragraph():
        text = said(rng.randint(12, 40))
        kept_.append(text)
        w = text.split(" ")
        k = rng.randrange(len(w))
        w[k] = rng.choice(["<b>{}</b>", "<em class=x>{}</em>", "<span>{}</span>", "<!-- no, no -->{}"]).format(w[k])
        return f"<p>{rng.choice([' ', chr(10)]).join(w)}" + rng.choice(["</p>", ""])

    def part(depth):
        own = "".join(paragraph() if depth == 0 or rng.random() < 0.7 else part(depth - 1) for _ in range(rng.randint(2, 4)))
        return f"<div class='c{rng.randint(1, 9)}'>{own}</div>"

    title = said(4)
    kept_.append(title)
    whole = "".join(part(rng.randint(0, 2)) for _ in range(2))
    links = "".join(f"<li><a href=/{k}>{said(3)}</a>" for k in range(6))
    before = ["<header><p>" + said(20) + "</header>", f"<nav><ul>{links}</ul></nav>", "<div class='cookie-notice'><p>" + said(20) + "</div>", "<script>var a = '<p>" + said(9) + "';</script>", "<style>p > a {}</style>"]
    after = ["<aside><p>" + said(30) + "</p></aside>", "<form><p>" + said(15) + "<input name=a></form>", "<section id='comments'>" + "<p>" + said(30) + "</p></section>", "<footer>" + said(12) + "</footer>", f"<div><ul>{links}</ul></div>"]
    rng.shuffle(before), rng.shuffle(after)
    body = rng.choice(["<article><h1>{}</h1>{}</article>", "<main><article><h2>{}</h2>{}</article></main>", "<div id='content'><div class='post'><h1>{}</h1>{}</div></div>"]).format(title, whole)
    return f"<!doctype html><html><head><title>t</title></head><body>{''.join(before)}{body}{''.join(after)}", " ".join(kept_)


def test_extract_finds_the_article_of_made_pages(spark):
    rng = random.Random(11)
    pages = [made_page(rng) for _ in range(80)]
    df = spark.createDataFrame([(k, "u", h) for k, (h, _) in enumerate(pages)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r["text"] for r in extract.extract(df).collect()}
    assert [got[k] for k in range(80)] == [t for _, t in pages]


def test_extract_is_linear_in_long_and_deep_pages():
    import time

    text = "many words, of one long text"
    hostile = {"deep": "<div>" * 150_000 + text, "open": "<a " * 300_000, "inline": "<b>" * 100_000 + f"<li>{text}" * 10_000, "quotes": '<p title="' * 100_000, "paragraphs": f"<p>{text}<b>" * 30_000, "comments": "<!--" * 200_000, "tables": "<table><tr><td>" * 30_000 + text, "plain": "a < b " * 150_000}
    for name, page in hostile.items():
        began = time.process_time()
        found = extract.main_text(page)
        assert time.process_time() - began < 6, name
        assert (text in found) == (name in ("deep", "inline", "paragraphs", "tables")), name
    assert extract.main_text("<p>a < b &amp;&lt; c</p>") == "a < b &< c" and extract.main_text(None) == "" and extract.main_text("<script>x") == ""


def test_pipeline_against_its_parts(spark, tmp_path):
    """Stage by stage, what goes and what stays is what the plain versions above say."""
    import corpus_pipeline

    rows = documents() + [(200, prose(200, 50) + " token=abcdef123456 end", "z"), (201, "see " + prose(300, 30), "z"), (202, prose(202, 40) + " vilest scumbag", "z")]
    rows += [(300 + i, prose(1000 + i, 40) + (" vilest scumbag" if i % 3 == 0 else ""), "t") for i in range(150)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.lit("en")).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0))).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(300 + i, 1, int(i % 3 == 0)) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(300, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names, sets = docs.columns, [{r["doc_id"] for r in docs.collect()}]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        assert i == len(corpus_pipeline.STAGES) - 1 or docs.columns == names
        path = f"{tmp_path}/stage{i}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        sets.append({r["doc_id"] for r in docs.collect()})
    assert sets[0] - sets[1] == {202} | {300 + i for i in range(0, 150, 3)}
    assert {11, 12, 13, 14, 15, 20, 21, 22, 23, 24, 25}.isdisjoint(sets[2]) and {10, 60, 61, 1, 2, 3, None} <= sets[2]
    assert sets[2] - sets[3] == {201}
    assert sets[3] == sets[4]
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tmp_path}/stage3").collect()}
    assert "[redacted]" in text[200] and "abcdef123456" not in text[200]
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, docs.collect()))


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"doc_id", "text", "taken"} <= set(out.columns)


def test_long_texts_of_the_models(spark):
    """A text of a million words in the language model's and the toxicity machine's way costs no more memory than its words."""
    rows = [(1, "one word " * 400_000, "a"), (2, "other text here", "a"), (9, "x" * 300_000, "b")]
    got = {r["doc_id"]: r for r in ctw.score(frame(spark, rows)).collect()}
    assert set(got) == {1, 2, 9} and got[1]["score"] < got[2]["score"] < 0


def test_licences_in_long_texts_cost_no_more_than_their_words(spark):
    import time

    index = licences.Templates(licences.TEMPLATES, dict.fromkeys({w for t in licences.TEMPLATES.values() for w in licences.plain(t.encode())}, 1), 0.8)
    notice = licences.TEMPLATES["mit-notice"].replace(" ", "\n")
    for text, most in ((b"cc by " * 60_000, 60_000), ((notice + "\n") .encode() * 3_000, 0)):
        began = time.process_time()
        batch = licences.pa.RecordBatch.from_arrays([licences.pa.array([1]), licences.pa.array([text.decode()])], ["doc_id", "text"])
        (got,) = licences._scan(iter([batch]), index, {p.encode(): x for p, x in licences.PHRASES.items()})
        assert time.process_time() - began < 10
        row = got.to_pylist()[0]
        assert row["n_base"] == most and (most or len([b for b in row["blocks"] if b["label"] == "mit-notice"]) >= 3_000)
    assert licences.scan(frame(spark, [])).count() == 0
