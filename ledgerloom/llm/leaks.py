"""Benchmark decontamination on a distributed positional inverted index.

Documents are cut into chunks of about CHUNK words; a chunk's documents stand one after the other in one stream of
positions, with a gap between them that no match can bridge. The index is a table, written once: for each chunk and each of its words
(by 64-bit hash), the sorted positions of that word. The words of the test items are joined to it, which gives their occurrences over the whole
corpus and, per chunk, their lists. Searching starts each window of an item from its rarest word, whose positions, less the word's place in the
item, are the possible alignments; these are intersected with the offset-adjusted lists of the other words. The same lists
give proximity matches: the rarest words of a window, in any order, close together. Items are taken in blocks of
ITEM_WORDS words, so what a task holds of them is bounded; blocks read the index, never the texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, table
from .texts import WordHashes, plain, raw

WINDOW = 10
#: Rarest words of a window that a proximity match needs, and the words beyond the window that they may be apart.
RAREST, SLOP = 3, 10
CHUNK, ITEM_WORDS = 1_500_000, 1_000_000
_DOC = pa.struct([("doc_id", pa.string()), ("start", pa.int64()), ("n", pa.int64())])
_INDEX = "chunk string, term long, n long, total long, positions binary, docs array<struct<doc_id:string,start:long,n:long>>"
_FOUND = "doc_id string, n_words long, n_hit long, spans array<struct<start:long,end:long>>, items array<string>, near array<string>"


def _chunk(rows: list[dict], hashes: list[np.ndarray], copies: list[int]) -> pa.RecordBatch:
    """Rows of one chunk: its documents first (no term), then a row per word with its positions, and its places in all copies of the texts."""
    words = np.concatenate(hashes).view(np.int64)
    place = np.concatenate([np.arange(r["start"], r["start"] + r["n"], dtype=np.uint32) for r in rows])
    many = np.repeat(np.array(copies, np.int64), [len(h) for h in hashes])
    order = np.argsort(words, kind="stable")
    words, place, many = words[order], place[order], many[order]
    cuts = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]])) if len(words) else np.zeros(0, np.int64)
    ends = np.append(cuts, len(words))
    lists = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer((ends * 4).astype(np.int32).tobytes()), pa.py_buffer(place.tobytes())])
    n, total = len(cuts), rows[-1]["start"] + rows[-1]["n"]
    columns = [
        pa.array([uuid.uuid4().hex] * (n + 1)), pa.concat_arrays([pa.array([None], pa.int64()), pa.array(words[cuts])]), pa.concat_arrays([pa.array([total], pa.int64()), pa.array(np.diff(ends).astype(np.int64))]), pa.concat_arrays([pa.array([None], pa.int64()), pa.array(np.add.reduceat(many, cuts) if len(cuts) else many)]),
        pa.concat_arrays([pa.array([None], pa.binary()), lists]), pa.array([rows, *[None] * n], pa.list_(_DOC)),
    ]
    return pa.RecordBatch.from_arrays(columns, ["chunk", "term", "n", "total", "positions", "docs"])


def _indexed(docs: Iterator[pa.RecordBatch], gap: int) -> Iterator[pa.RecordBatch]:
    hashes, rows, copies, at, known = [], [], [], 0, WordHashes()
    for batch in docs:
        for doc, text, many in zip(batch.column("doc_id").to_pylist(), raw(batch, "text"), batch.column("copies").to_pylist(), strict=True):
            own = known.of(plain(text))
            rows.append({"doc_id": doc, "start": at, "n": len(own)})
            hashes.append(own)
            copies.append(many)
            at += len(own) + gap
            if at >= CHUNK:
                yield _chunk(rows, hashes, copies)
                hashes, rows, copies, at = [], [], [], 0
    if rows:
        yield _chunk(rows, hashes, copies)


def index(docs: DataFrame, slop: int = SLOP) -> DataFrame:
    """The written index of all words of ``docs`` (doc_id, text): chunk, term, n, positions; and a row per chunk with its documents.

    If there is a column ``copies``, a text stands for so many rows, and ``total`` counts a word's places in all of them.
    """
    copies = docs["copies"].cast("long") if "copies" in docs.columns else F.lit(1).cast("long")
    slim = docs.select(docs["doc_id"].cast("string").alias("doc_id"), docs["text"].cast("string").alias("text"), copies.alias("copies"))
    return kept(slim.mapInArrow(partial(_indexed, gap=WINDOW + max(slop, 0) + 1), _INDEX))


class Items:
    """A block of test items as word hashes, with each window's rarest places."""

    def __init__(self, items: list[tuple[str, list[bytes]]]):
        known = WordHashes()
        self.items = [(name, known.of(words).view(np.int64).tolist(), words) for name, words in items if words]
        self.terms = sorted({t for _, own, _ in self.items for t in own})

    def ranked(self, counts: dict[int, int]) -> Items:
        """With the windows' rarest places and words; ties go by place, then by the word's bytes."""
        self.anchors, self.triples = [], []
        for _, own, words in self.items:
            size = min(WINDOW, len(words))
            first, three = set(), set()
            for w in range(len(words) - size + 1):
                rare = sorted(range(w, w + size), key=lambda i: (counts.get(own[i], 0), i))
                first.add(rare[0])
                three.add(tuple(t for _, _, t in sorted({(counts.get(own[i], 0), words[i], own[i]) for i in rare[:RAREST]})))
            self.anchors.append(sorted(first))
            self.triples.append(sorted(three))
        self.items = [(name, own) for name, own, _ in self.items]
        return self


def _has(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(values):
        return np.zeros(len(wanted), bool)
    at = np.searchsorted(values, wanted)
    at[at == len(values)] = 0
    return values[at] == wanted


def _near(values: np.ndarray, wanted: np.ndarray, within: int) -> np.ndarray:
    return np.searchsorted(values, wanted + within, "right") > np.searchsorted(values, wanted - within)


def _search(group: Iterator[pa.RecordBatch], items: Items, slop: int) -> Iterator[pa.RecordBatch]:
    t = pa.Table.from_batches(list(group))
    if not t.num_rows:
        return
    lists, docs, total = {}, [], 0
    for term, n, positions, rows in zip(t["term"].to_pylist(), t["n"].to_pylist(), t["positions"].to_pylist(), t["docs"].to_pylist(), strict=True):
        if term is None:
            docs, total = rows, n
        else:
            lists[term] = np.frombuffer(positions, np.uint32).astype(np.int64)
    none = np.zeros(0, np.int64)
    starts = np.array([d["start"] for d in docs], np.int64)
    cover = np.zeros(total + 1, np.int32)
    exact: list[set[str]] = [set() for _ in docs]
    near: list[set[str]] = [set() for _ in docs]
    for (name, words), anchors, triples in zip(items.items, items.anchors, items.triples, strict=True):
        size = min(WINDOW, len(words))
        maybe = [lists[words[o]] - o for o in anchors if words[o] in lists]
        if maybe:
            base = np.unique(np.concatenate(maybe))
            run = np.zeros(len(base), np.int64)  # words that match up to here, one after the other
            for j, w in enumerate(words):
                run = np.where(_has(lists.get(w, none), base + j), run + 1, 0)
                ends = base[run >= size] + j + 1
                if len(ends):
                    np.add.at(cover, ends - size, 1)
                    np.add.at(cover, ends, -1)
                    for d in np.unique(np.searchsorted(starts, ends - 1, "right") - 1):
                        exact[d].add(name)
        for terms in triples if slop >= 0 else ():
            if all(x in lists for x in terms):
                at = lists[terms[0]]
                for x in terms[1:]:
                    at = at[_near(lists[x], at, size + slop)]
                for d in np.unique(np.searchsorted(starts, at, "right") - 1):
                    near[d].add(name)
    hit = np.cumsum(cover[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))).reshape(-1, 2)
    of = np.searchsorted(starts, edges[:, 0], "right") - 1
    spans: list[list[dict]] = [[] for _ in docs]
    for d, (a, b) in zip(of, edges, strict=True):
        spans[d].append({"start": int(a - starts[d]), "end": int(b - starts[d])})
    columns = [[d["doc_id"] for d in docs], [d["n"] for d in docs], [sum(x["end"] - x["start"] for x in s) for s in spans], spans, [sorted(x) for x in exact], [sorted(x) for x in near]]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = [pa.string(), pa.int64(), pa.int64(), span, pa.list_(pa.string()), pa.list_(pa.string())]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_words", "n_hit", "spans", "items", "near"])


def search(docs: DataFrame, benchmark: DataFrame, slop: int = SLOP) -> DataFrame:
    """doc_id, n_words, n_hit, spans of hit words, items (exact), near (proximity): one row per row of ``docs``.

    Windows are WINDOW consecutive words of an item; a shorter item is one window, one without words none. Items
    are named by item_id (null: an empty name); items of one name count once. A slop below 0 leaves proximity
    out. Null texts have no words and no hits. Repeated rows are found one by one. Extra columns don't matter.
    """
    tests = benchmark.select(F.coalesce(benchmark["item_id"].cast("string"), F.lit("")).alias("item"), benchmark["text"].cast("string").alias("text")).distinct()  # a repeated item counts once anyhow
    words = tests.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) / 2)).head()[0] or 0
    blocks = int(words // ITEM_WORDS) + 1
    own = docs.select(docs["doc_id"].cast("string").alias("doc_id"), docs["text"].cast("string").alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    if blocks == 1:
        return _found(index(own, slop), tests, slop).withColumn("doc_id", F.col("doc_id").cast(kind))
    texts = own.groupBy(F.md5(F.coalesce("text", F.lit(""))).alias("doc_id")).agg(F.any_value("text").alias("text"), F.count("*").alias("copies"))
    held = index(texts, slop)  # each text once; how rare a word is hangs on all rows, as with one block
    merged = _merged([kept(_found(held, tests.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k), slop)) for k in range(blocks)])
    return own.select(F.col("doc_id").cast(kind).alias("doc_id"), F.md5(F.coalesce("text", F.lit(""))).alias("key")).join(merged, "key").drop("key")


def _found(held: DataFrame, tests: DataFrame, slop: int) -> DataFrame:
    """The search for one block of items (item, text), of ITEM_WORDS words or so: its terms, at most that many longs, are broadcast to the index."""
    items = Items([(r["item"], plain((r["text"] or "").encode())) for r in tests.collect()])
    terms = F.broadcast(held.sparkSession.createDataFrame(pa.table({"__term": pa.array(items.terms, pa.int64())})))
    own = held.join(terms, F.col("term") == F.col("__term")).drop("__term")
    counts = {r["term"]: r["n"] for r in own.groupBy("term").agg(F.sum("total").alias("n")).collect()}
    return _grouped(own.unionByName(held.filter("term IS NULL")), partial(_search, items=items.ranked(counts), slop=slop))


def _grouped(own: DataFrame, work: partial) -> DataFrame:
    def one(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return work(group)

    return own.groupBy("chunk").applyInArrow(one, _FOUND)


def _merged(found: list[DataFrame]) -> DataFrame:
    """One row per text hash from the rows that each block of items has for it; spans that overlap or touch become one."""
    rows = found[0]
    for x in found[1:]:
        rows = rows.union(x)
    every = lambda c: F.flatten(F.collect_list(c))
    rows = rows.groupBy(F.col("doc_id").alias("key")).agg(F.max("n_words").alias("n_words"), F.array_sort(every("spans")).alias("spans"), F.array_sort(F.array_distinct(every("items"))).alias("items"), F.array_sort(F.array_distinct(every("near"))).alias("near"))
    joined = "concat(slice(a, 1, size(a) - 1), array(named_struct('start', a[size(a) - 1].start, 'end', greatest(a[size(a) - 1].end, s.end))))"
    spans = F.expr(f"aggregate(spans, slice(spans, 1, 0), (a, s) -> CASE WHEN size(a) > 0 AND a[greatest(size(a) - 1, 0)].end >= s.start THEN {joined} ELSE concat(a, array(s)) END)")
    rows = rows.withColumn("spans", spans)
    return rows.select("key", "n_words", F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)").alias("n_hit"), "spans", "items", "near")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with their columns, without any hit. Hits hang on the text alone and are found by it."""
    own = docs.select(F.struct("*").alias("row"), F.md5(F.coalesce(docs["text"], F.lit(""))).alias("key"))
    found = search(own.select(F.col("key").alias("doc_id"), F.col("row")["text"].alias("text")), benchmark, slop=-1)
    leaked = kept(found.filter("n_hit > 0").select(F.col("doc_id").alias("key")).distinct())
    return own.join(leaked, "key", "left_anti").select("row.*")


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.size("near").cast("long").alias("n_near"), F.sha2(F.array_join("near", ","), 256).alias("near_sha256"))


def op4_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document; n_near and near_sha256 say the same of its proximity matches."""
    return digests(search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
n AS (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
t AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM n)),
s AS (SELECT DISTINCT k FROM t),
g AS (SELECT doc_id, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, s)),
h AS (SELECT g.doc_id, g.i, t.k, t.item_id FROM g JOIN t ON g.g = t.g AND g.k = t.k),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id),
q AS (SELECT item_id, k, i AS w0, unnest(range(i, i + k)) AS p, w FROM (SELECT item_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM n)),
o AS (SELECT word, count(*) AS c FROM (SELECT unnest(w) AS word FROM d) GROUP BY word),
r AS (SELECT item_id, k, w0, w[p] AS word, coalesce(c, 0) AS c, row_number() OVER (PARTITION BY item_id, w0 ORDER BY coalesce(c, 0), p) AS nth FROM q LEFT JOIN o ON o.word = q.w[q.p]),
e AS (SELECT DISTINCT item_id, k, words FROM (SELECT item_id, k, w0, list(word ORDER BY c, encode(word)) AS words FROM (SELECT DISTINCT item_id, k, w0, word, c FROM r WHERE nth <= 3) GROUP BY ALL)),
f AS (SELECT DISTINCT unnest(words) AS word FROM e),
v AS (SELECT doc_id, p, word FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d) SEMI JOIN f USING (word)),
y AS (SELECT DISTINCT a.doc_id, CAST(e.item_id AS VARCHAR) AS item FROM e JOIN v a ON a.word = e.words[1]
      WHERE (len(words) < 2 OR EXISTS (SELECT 1 FROM v b WHERE b.doc_id = a.doc_id AND b.word = e.words[2] AND abs(b.p - a.p) <= k + 10))
        AND (len(words) < 3 OR EXISTS (SELECT 1 FROM v b WHERE b.doc_id = a.doc_id AND b.word = e.words[3] AND abs(b.p - a.p) <= k + 10))),
z AS (SELECT doc_id, count(*) AS n_near, string_agg(item, ',' ORDER BY item) AS nears FROM y GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  coalesce(n_near, 0) AS n_near, sha256(coalesce(nears, '')) AS near_sha256 FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN z USING (doc_id)
"""
