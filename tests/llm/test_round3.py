"""Vector codes, token files, resampling; and cases that earlier operators once got wrong."""

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

from ledgerloom.llm import codes, leaks, mixing, near, resample, secrets, tokens, toxicity, warc  # noqa: E402
from ledgerloom.llm.common import shared_folder  # noqa: E402

WORDS = [f"{a}{b}" for a in "an be co du el fi ga ho".split() for b in "ra se ti no pu lé".split()]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def plain(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("row", F.lit(7)).withColumn("n_words", F.lit(1))


# -- vector codes


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """(vec_id, label, vector) to (codes, error) of each kept row and the books, by comparing all with all."""
    kept = sorted(([i is None, i or 0, [math.floor(4096 * x) for x in v]], label) for i, label, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v))
    x = np.array([k[2] for k, _ in kept], np.int64)
    width = x.shape[1] // parts
    books = [x[:entries, p * width : (p + 1) * width].copy() for p in range(parts)]

    def assigned():
        d = [((x[:, None, p * width : (p + 1) * width] - books[p][None]) ** 2).sum(axis=2) for p in range(parts)]
        return np.stack([e.argmin(axis=1) for e in d], 1), sum(e.min(axis=1) for e in d)

    for _ in range(rounds):
        at, _ = assigned()
        for p in range(parts):
            for e in range(len(books[p])):
                own = x[at[:, p] == e, p * width : (p + 1) * width]
                if len(own):
                    books[p][e] = own.sum(axis=0) // len(own)
    at, far = assigned()
    return [(None if k[0] else k[1], label, "".join(f"{c:02x}" for c in row), int(f)) for (k, label), row, f in zip(kept, at, far, strict=True)], books


def test_codes_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 16)).round(1)  # many ties
    x[::3] = x[0]
    rows = [(i, None if i % 5 == 0 else i % 4, v.tolist()) for i, v in enumerate(x)]
    rows += [(9, 1, x[5].tolist()), (None, 2, x[7].tolist()), (500, 1, None), (501, 1, [float("nan")] * 16), (502, 1, [None] + [0.0] * 15), (503, 1, [float("inf")] + [0.0] * 15)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("code", F.lit("clash"))
    own = codes.kept(codes.integers(df, ["vec_id", "label"]))
    books = codes.fit(own)
    coded = codes.encode(own, books)
    want, plain_books = plain_codes(rows)
    got = codes.by_label(coded).selectExpr("vec_id", "label", "lower(hex(code)) AS code", "error", "label_error").collect()
    assert sorted(map(str, ((r["vec_id"], r["label"], r["code"], r["error"]) for r in got))) == sorted(map(str, want))
    assert all((b.entries == p).all() for b, p in zip(books, plain_books, strict=True))
    assert codes.digest(books) == hashlib.sha256(",".join(str(v) for b in plain_books for v in b.ravel().tolist()).encode()).hexdigest()
    sums = defaultdict(int)
    for _, label, _, e in want:
        sums[label] += e
    assert all(r["label_error"] == sums[r["label"]] for r in got)
    back = {r["vec_id"]: r["vector"] for r in codes.decode(coded.select("vec_id", "code"), books).collect()}
    assert back[4] == [v / 4096 for b, c in zip(books, bytes.fromhex(next(c for i, _, c, _ in want if i == 4)), strict=True) for v in b.entries[c]]


def test_codes_of_few_odd_and_no_rows(spark):
    few = spark.createDataFrame([(2, 1, [1.0] * 10), (1, 1, [0.5] * 10), (3, 2, [1.0, 2.0])], "vec_id long, label int, embedding array<float>")
    own = codes.kept(codes.integers(few, ["vec_id", "label"]))
    books = codes.fit(own)  # two entries; the first two parts have two components; a vector of another length has no code
    assert [b.entries.shape for b in books] == [(2, 2), (2, 2)] + [(2, 1)] * 6
    got = {r["vec_id"]: (None if r["code"] is None else bytes(r["code"]), r["error"]) for r in codes.encode(own, books).collect()}
    assert got == {1: (bytes(8), 0), 2: (bytes([1] * 8), 0), 3: (None, None)}
    none = codes.integers(few.limit(0), ["vec_id", "label"])
    assert codes.fit(none) == [] and codes.encode(none, []).count() == 0
    with pytest.raises(ValueError, match="63 bits"):
        codes.fit(codes.integers(spark.createDataFrame([(1, 1, [1e9] * 8)], "vec_id long, label int, embedding array<double>"), ["vec_id", "label"]))


def test_equal_average_search_is_exact_and_looks_at_few():
    rng = np.random.default_rng(6)
    for trial in range(30):
        dim, k = int(rng.integers(1, 9)), int(rng.integers(1, 40))
        spread = int(rng.choice([2, 50, 5000]))
        book = codes.Codebook(rng.integers(-spread, spread, (k, dim)))
        x = rng.integers(-spread, spread, (500, dim))
        at, far, looked = book.nearest(x)
        d = ((x[:, None] - book.entries[None]) ** 2).sum(axis=2)
        assert (at == d.argmin(axis=1)).all() and (far == d.min(axis=1)).all() and looked <= d.size, trial
    book = codes.Codebook(np.arange(256).reshape(-1, 1) * 10)
    assert book.nearest(rng.integers(0, 2560, (1000, 1)))[2] < 3.1 * 1000


# -- token files


@pytest.fixture(scope="module")
def vocabulary():
    P = pytest.importorskip("public_tokenizers")
    return str(P.path("byte_bpe_50k.json"))


ODD = [
    None, "", " ", "\n\n a", "a  b", "don't can't 'tis it's' 's", "x<|endoftext|>y <|endoftext|>", "a  b  c", "中文 字, and中 a", "tab\t\tand\r\n lines \n", "\x1c \x1d!", "é̂ à la 3x4 12,5%%% $$$word(x)", "é" * 50,
    "ПРИВЕТ мир!", "a᠎ b", "emoji 😀😀 ok", "…! —?", "١٢٣ abc٣", "'''quoted''' ''ll", "Áb c", "   ", "trailing  ",
]


def test_pieces_are_encoded_as_the_whole_text_is(vocabulary):
    from tokenizers import Tokenizer

    whole, own = Tokenizer.from_file(vocabulary), tokens.Encoder(vocabulary)
    assert own.cuts
    rng = random.Random(3)
    letters = list("ab é'sdl3!.,$ \n\t中 \x1c١") + ["<|endoftext|>", "'ll", "  "]
    texts = [t or "" for t in ODD] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    for _ in range(2):  # the second time from memory
        for text, ids in zip(texts, own.ids(texts), strict=True):
            assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_long_texts_are_cut_at_sure_places(vocabulary, monkeypatch):
    from tokenizers import Tokenizer

    whole, own = Tokenizer.from_file(vocabulary), tokens.Encoder(vocabulary)
    monkeypatch.setattr(tokens, "RUN", 40)
    monkeypatch.setattr(tokens, "REMEMBERED", 20)
    for text in [prose(2, 500), "x" * 500, " ".join(t or "" for t in ODD), "a   b " * 30]:
        parts = list(own.sections(text))
        assert "".join(parts) == text
        ids = [i for s in parts for i in own.ids([s])[0].tolist()]
        assert ids == whole.encode(text, add_special_tokens=False).ids


def test_token_files_round_trip(spark, vocabulary, monkeypatch):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary)
    monkeypatch.setattr(tokens, "FILE", 3000)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 - i, prose(i, 5 * i)) for i in range(60)] + [(7, "again"), (None, "no id"), (None, None), (50, prose(9, 5000))]
    df = frame(spark, rows).withColumn("at", F.lit(1)).repartition(5)
    folder = shared_folder(spark)
    index = tokens.write(df, folder, vocabulary, length=16, rows=4)
    got = sorted(tokens.read(index, folder).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((d for d, _ in rows if d is not None)) + [None, None]
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids"][-1] == 2
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    want = Counter((d, tuple([*whole.encode(t or "", add_special_tokens=False).ids, 2])) for d, t in rows)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want
    every = [i for r in got for i in r["ids"]]
    files = sorted(tokens.files(index).collect(), key=lambda f: f["base"])
    assert len(files) > 2 and sum(f["n"] for f in files) == at
    seqs = defaultdict(list)
    for r in tokens.sequences(index, folder).collect():
        seqs[r["file"]].append((r["row"], r["ids"], r["mask"], r["first"]))
    for f in files:
        held = [r for r in sorted(seqs[f["file"]])]
        ids, mask, first = ([v for r in held for v in r[k]] for k in (1, 2, 3))
        assert len(held) == f["rows"] and all(len(r[1]) == len(r[2]) == 16 for r in held)
        assert ids[: f["n"]] == every[f["base"] : f["base"] + f["n"]] and not any(ids[f["n"] :]) and mask == [k < f["n"] for k in range(len(ids))]
        starts = {r["start"] - f["base"] for r in got if f["base"] <= r["start"] < f["base"] + f["n"]}
        assert first == [k in starts for k in range(len(ids))]
        own = tokens.Sequences(f"{folder}/{f['file']}".removeprefix("file://"))  # mapped: rows are views
        assert len(own) == f["rows"] and own.head == f["head"] and own.stride == f["stride"]
        row = random.Random(1).randrange(len(own))
        assert [x.tolist() for x in own[row]] == list(held[row][1:]) and not own[row][0].flags.owndata and not own[row][0].flags.writeable
    none = tokens.write(df.limit(0), shared_folder(spark), vocabulary)
    assert none.count() == 0 and tokens.read(none, folder).count() == 0


# -- resampling


@pytest.mark.parametrize("grams", [1, 3])
def test_resampling_against_plain_counts(spark, monkeypatch, grams):
    monkeypatch.setattr(resample, "JOINED", 150)
    monkeypatch.setattr(resample, "REMEMBERED", 30)
    rows = [(i, prose(i, 3 * i)) for i in range(70)] + [(100, None), (101, ""), (102, "\x00 a\x00b "), (None, prose(3, 40)), (None, prose(3, 40)), (5, prose(5, 900)), (5, prose(5, 900)), (103, "one two")]
    items = [(1, prose(5, 50)), (2, None), (3, prose(60, 9))]

    def features(text):
        w = plain(text)
        return [" ".join(w[i : i + n]) for n in range(1, grams + 1) for i in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % 997
    s, t = (Counter(bucket(f) for _, x in own for f in features(x)) for own in (rows, items))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 997) / ((s[b] + 1) * (t.total() + 997))))
    want = []
    for d, x in rows:
        f = features(x)
        weight = sum(gain(bucket(y)) for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        want.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(plain(x)) >= 20))
    can = sorted((w for w in want if w[4]), key=lambda w: (-w[3], w[0] is None, w[0]))
    most = 10 * len(can) // 100
    docs, target = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    g = resample.gains(docs, target, grams, 997)
    out = resample.drawn(resample.scored(docs, g, grams)).collect()
    assert sorted(map(str, ((r["row"]["doc_id"], r["n_features"], r["weight"], r["score"]) for r in out))) == sorted(str(w[:4]) for w in want)
    got = sorted((r["rank"], r["row"]["doc_id"]) for r in out if r["rank"] is not None)
    assert got == [(k + 1, w[0]) for k, w in enumerate(can[:most])] and most > 3
    drawn = resample.resampled(docs, target, grams=grams, buckets=997)
    assert drawn.columns == ["doc_id", "text", "row", "n_words", "n_features", "weight", "score", "rank"] and {r["row"] for r in drawn.collect()} == {7}
    assert resample.resampled(docs.limit(0), target).count() == 0 and resample.resampled(docs, target.limit(0)).count() == most


def test_resampling_draws_one_by_one_of_a_hot_document(spark):
    rows = [(1, prose(1, 30))] * 300 + [(k, prose(k, 30)) for k in range(2, 302)]
    out = resample.resampled(frame(spark, rows), spark.createDataFrame([(1, prose(1, 30))], "item_id long, text string"), share=20)
    ranks = [r["rank"] for r in out.collect()]
    assert sorted(ranks) == list(range(1, 121))


# -- cases that were wrong


def test_leaks_count_words_of_all_rows_on_both_paths(spark, monkeypatch):
    """Thirty copies of one text make its words frequent; which words are rare must not hang on the number of item blocks."""
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    near_by = "alpha xx beta xx gamma and more"
    rows = [(0, near_by)] + [(k, "alpha beta gamma") for k in range(1, 31)] + [(40 + k, f"delta {k} epsilon zeta {k} eta theta iota kappa " * 2) for k in range(10)]
    rows += [(60, "delta zeta epsilon"), (61, None), (62, ""), (63, "eta theta iota, of all"), (64, item)]
    items = spark.createDataFrame([(1, item), (2, prose(1, 30)), (3, prose(2, 12)), (4, "alpha beta gamma rho sigma")], "item_id long, text string")
    docs = frame(spark, rows).withColumn("copies", F.lit("clash"))
    one = {r["doc_id"]: (r["n_words"], r["n_hit"], tuple(map(tuple, r["spans"])), tuple(r["items"]), tuple(r["near"])) for r in leaks.search(docs, items).collect()}
    monkeypatch.setattr(leaks, "ITEM_WORDS", 20)
    two = {r["doc_id"]: (r["n_words"], r["n_hit"], tuple(map(tuple, r["spans"])), tuple(r["items"]), tuple(r["near"])) for r in leaks.search(docs, items).collect()}
    assert one == two and len(one) == len(rows) and any(x[4] for x in one.values())


def test_leaks_in_very_long_texts(spark):
    item = prose(77, 14)
    rows = [(1, "filler words " * 300_000 + item + " filler" * 1000), (2, "filler words")]
    got = {r["doc_id"]: r for r in leaks.search(frame(spark, rows), spark.createDataFrame([(5, item)], "item_id long, text string")).collect()}
    assert got[1]["spans"] == [(600_000, 600_014)] and got[1]["items"] == ["5"] and got[2]["n_hit"] == 0


def test_warc_urls_come_back_to_the_letter(spark):
    urls = ["http://a/%20b?q=%C3%A9", "http://a/ b?x=é", "100%", "%", "", "http://a/%zz", "x\ny: z", "#frag?&=+%2B", None]
    df = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)], "page_id long, url string, html string")
    folder = shared_folder(spark)
    got = {r["page_id"]: r["url"] for r in warc.read(warc.write(df, folder), folder).collect()}
    assert got == dict(enumerate(urls))


def clashing(df):
    names = ["__score", "__text", "__own", "__hash", "__spans", "__key", "__doc", "__md5", "__id", "__one", "__nth", "__leaked", "__unit", "__source", "__range", "row", "key", "changed", "start", "end", "copies"]
    return df.withColumns({n: F.lit(f"own {n}") for n in names}), names


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, prose(i, 40) + (" token=abcdef123456" if i == 5 else ""), "ab"[i % 2], "en", 1) for i in range(30)] + [(40, prose(1, 40), "a", "en", 1), (41, prose(300, 30), "a", "en", 1), (42, None, None, None, None), (43, "", "", "", 0)]
    docs, names = clashing(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(30)], "doc_id long, quality int, toxic int").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(300, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns[: len(docs.columns)] == docs.columns, name
        got = out.collect()
        assert all(r[n] == f"own {n}" for r in got for n in names), name
        kept.append({r["doc_id"] for r in got})
        docs = codes.kept(out)
    every = {r[0] for r in rows}
    assert kept == [every, every - {40}, every - {40, 41}, every - {40, 41}, kept[4]]  # without labels none is called toxic
    assert kept[4] and kept[4] <= every - {40, 41, 42, 43}
    assert next(r["text"] for r in docs.collect() if r["doc_id"] == 5).endswith("[redacted]")


def test_no_labels_call_nothing_toxic(spark):
    docs = frame(spark, [(i, prose(i, 30)) for i in range(20)])
    for labels in ([], [(None, 1, 1)], [(999, 1, 1)], [(1, 1, None), (2, 1, 7)]):
        known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, known), ["doc_id"]).collect()} == {0.0}


def test_mixing_and_secrets_in_very_long_texts(spark):
    long = "word " * 400_000
    rows = [(1, long + "token=abcdef123456 " + long, "a"), (2, "short text here", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in mixing.mix(df).collect()}
    assert got[1]["size"] == 800_001 and got[2]["taken"] == 9
    spans = {r["doc_id"]: r["base"] for r in secrets.scan(df).collect()}
    assert [(s["start"], s["end"]) for s in spans[1]] == [(2_000_000, 2_000_018)] and spans[2] == []
    assert {r["doc_id"] for r in near.one_of_each(df).collect()} == {1, 2}


# -- articles behind names that speak against them

WRAPPERS = [
    "div class='sidebar-layout'", "div class='page sidebar-right'", "div class='modal-open'", "div class='comments-enabled'", "div class='layout widget-area'", "div class='search-results'", "article class='post related-topic'", "article title='the hidden truth of x'",
    'div data-x="class=ad id=nav hidden" title="style=display:none"', "section role='dialog'", "div class=overlay id='newsletter'", "div class='social promo banner'",
]


@pytest.mark.parametrize("wrapper", WRAPPERS)
@pytest.mark.parametrize("outer", ["", "div class='page'", "div class='menu-open sidebar-left'"])
def test_articles_in_suspect_wrappers_stay_whole(wrapper, outer):
    from ledgerloom.llm.extract import main_text

    tag, rng = wrapper.split()[0], random.Random(len(wrapper))
    texts = [prose(rng.random(), 20) + ", " + prose(rng.random(), 6) + "." for _ in range(rng.randint(3, 9))]
    title, reader = "A title of the page", prose(99, 25) + ", really."
    aside = f"<div class='sidebar'><p>{prose(5, 30)}, and more.</p></div><div class='cookie-notice'><p>{prose(6, 25)}, accept, all.</p></div>"
    comments = f"<div id='comments'><p>{reader}</p><p>{reader}</p></div>"
    body = f"<h1>{title}</h1><div>" + "".join(f"<p>{t}</p>" for t in texts) + "</div>"
    page = f"<body><nav><a href=/>menu</a></nav>{f'<{outer}>' if outer else ''}{aside}<{wrapper}>{body}{comments}</{tag}>{'</div>' if outer else ''}<footer>me</footer></body>"
    assert main_text(page) == " ".join([title, *texts])


def test_suspect_parts_beside_an_article_go_however_long():
    from ledgerloom.llm.extract import main_text

    own, other = prose(1, 40) + ", so it was, in the end.", prose(2, 60) + ", yes, no, maybe, really."
    comments = "".join(f"<p>{other}</p>" for _ in range(12))
    for before in ("<article><h1>T</h1><p>{}</p><p>{}</p></article>", "<main><p>{}</p><p>{}</p></main>"):
        assert main_text(f"<body>{before.format(own, own)}<section class=comments>{comments}</section>").endswith(f"{own} {own}")
    assert main_text(f"<body><div class=notice><p>{prose(3, 10)}, so, there.</p></div>") == ""  # a notice alone is no article
    assert main_text(f"<p hidden>{own}</p><p title='a hidden b'>{own}</p><p class='x' HIDDEN>{own}</p>") == own


# -- notices in long lines, and whole texts as templates


def test_words_far_apart_in_a_long_line_are_no_notice(spark):
    from ledgerloom.llm import licences

    filler = prose(4, 400)
    apart = f"{filler} ".join(["", "released ", "under ", "the ", "mit ", "license "]) + filler
    near = f"{filler} Released, under the (MIT) License {filler}"
    text = frame(spark, [(1, apart), (2, near), (3, near.replace(" ", "\n")), (4, f"{filler} released under\nthe MIT {filler}\nlicense {filler}"), (5, (filler + " ") * 400 + "released under the mit license"), (6, None)])
    got = {r["doc_id"]: [(b["label"], b["share"]) for b in r["blocks"]] for r in licences.scan(text).collect()}
    assert got[1] == [] and got[2] == [("mit", 1.0)] and set(got[3]) == {("mit", 1.0)} and [x[0] for x in got[4]] == ["mit"] and got[4][0][1] == 0.8 and got[5] == [("mit", 1.0)] and got[6] == []


def test_whole_licence_texts_as_templates(spark):
    from ledgerloom.llm import licences

    rng = random.Random(8)
    whole = " ".join(f"{rng.choice(WORDS)}{rng.randrange(200)}" for _ in range(900))
    other = " ".join(f"{rng.choice(WORDS)}{rng.randrange(200)}" for _ in range(400))
    words = whole.split()
    wrapped = "\n".join(" ".join(words[i : i + 11]) for i in range(0, 900, 11))
    edited = "\n".join(" ".join(w if rng.random() > 0.08 else "edited" for w in words[i : i + 11]) for i in range(0, 900, 11))
    half = "\n".join(" ".join(words[i : i + 11]) for i in range(0, 450, 11))
    text = frame(spark, [(1, "intro\n" + wrapped + "\n" + prose(1, 500)), (2, edited), (3, half), (4, prose(2, 900)), (5, whole), (6, other + "\n" + wrapped)])
    got = {r["doc_id"]: {b["label"] for b in r["blocks"]} for r in licences.scan(text, {"own": whole, "other": other}).collect()}
    assert got == {1: {"own"}, 2: {"own"}, 3: set(), 4: set(), 5: {"own"}, 6: {"own", "other"}}


def test_hnsw_in_many_blocks_and_shards_is_the_same(spark, monkeypatch):
    from ledgerloom.llm import hnsw

    rng = np.random.default_rng(7)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(600, 12)))] + [(700 + i, v.tolist()) for i, v in enumerate(rng.normal(size=(40, 5)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    one = sorted(map(tuple, hnsw.nearest(df, k=5, every=5).collect()))
    for shard, block, blocks in ((150, 7, 3), (60, 1000, 16)):
        monkeypatch.setattr(hnsw, "SHARD", shard), monkeypatch.setattr(hnsw, "BLOCK", block), monkeypatch.setattr(hnsw, "BLOCKS", blocks)
        got = sorted(map(tuple, hnsw.nearest(df, k=5, every=5).collect()))
        assert len(got) == len(one) == (120 + 8) * 5 and len(set(got) & set(one)) > 0.97 * len(one)


def test_near_copies_in_large_families_of_one_bucket(spark, monkeypatch):
    """Two families that share much and don't link, one that links to both, many exact copies: held against all pairs."""
    monkeypatch.setattr(near, "BLOCK", 8)
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(120)]
    other = [*base[:90], *(f"o{k}" for k in range(30))]  # 86 of 146 shingles in common

    def edited(words):
        words = list(words)
        words[int(rng.integers(len(words)))] = f"e{rng.integers(10**6)}"
        return " ".join(words)

    texts = [edited(base) for _ in range(30)] + [edited(other) for _ in range(30)] + [" ".join(base)] * 40 + [None, "", "one two"]
    rows = [*enumerate(texts), (None, " ".join(base))]
    words = [(t or "").split() for _, t in rows]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    label = list(range(len(rows)))
    for _ in rows:
        before = list(label)
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                if x & y and 100 * len(x & y) >= 75 * len(x | y):
                    label[i] = label[j] = min(label[i], label[j])
        if label == before:
            break
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.classes(frame(spark, rows)).collect() if r["doc_id"] is not None}
    assert found == {i: (len(sets[i]), label[i]) for i in range(len(texts))}
