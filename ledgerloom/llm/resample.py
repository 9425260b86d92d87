"""Importance resampling toward a target distribution, over hashed runs of words.

The texts of a batch are joined with a sentinel between them; one pass of one expression finds all words and
sentinels, positions of the sentinels (by ``searchsorted``) give each word its document, and runs that would cross into the
next document are masked before they are counted. Long texts go through in pieces, which share the words that a run
needs at their seam. Counts of all texts are vectors of one number per bucket and task, summed by Spark; what reaches the
driver is one number per bucket. Documents are drawn by weight plus Gumbel noise that hangs on the id alone: the counts of
documents per score give the lowest score that can be drawn, and only documents from there on are sorted.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, table
from .mixing import running
from .texts import _PLAIN, raw

#: Longest run of words, buckets, percent of the documents drawn, words that a document needs, the noise's seed.
GRAMS, BUCKETS, SHARE, LEAST, SEED = 1, 10_000, 10, 20, 2024
#: Bytes of text that are joined, or so; features that a task remembers at most, before it starts anew: both bound memory and change no result.
JOINED, REMEMBERED = 2 << 20, 400_000
#: Stands between texts: no byte of a text is zero once it is translated.
_SENTINEL = b"\x00"
_FOUND = re.compile(rb"[a-z0-9\x80-\xff]+|\x00")
OUT = ("n_features", "weight", "score", "rank")


class Buckets(dict):
    """The bucket of a feature; the sentinel's is -1."""

    def __init__(self, buckets: int):
        super().__init__({_SENTINEL: -1})
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
            self[_SENTINEL] = -1
        b = self[feature] = zlib.crc32(feature) % self.buckets
        return b


def _pieces(texts: list[bytes | None], grams: int) -> Iterator[tuple[list[int], list[bytes], int]]:
    """Runs of about JOINED bytes: whose text each piece is, the pieces, and how many words the first one repeats of the piece before.

    A text is cut between words only; a piece that goes on with a text starts with the ``grams - 1`` words before.
    """
    of, own, held, again = [], [], 0, 0
    for k, text in enumerate(texts):
        text, at = (text or b"").translate(_PLAIN), 0
        while True:
            end = len(text) if len(text) - at <= JOINED else text.find(b" ", at + JOINED)
            end = len(text) if end < 0 else end
            of.append(k)
            own.append(text[at:end])
            held += end - at
            if end < len(text) or held >= JOINED:
                yield of, own, again
                of, own, held, again = [], [], 0, 0
            if end == len(text):
                break
            lead = text[:end].rsplit(None, grams - 1)[-(grams - 1) :] if grams > 1 else []
            again, at = len(lead), end - sum(map(len, lead)) - len(lead) if lead else end
            if lead:  # white space between words may be longer than one byte: the piece starts with the words themselves
                text, at = b" ".join(lead) + text[end:], 0
    if own:
        yield of, own, again


def _features(of: list[int], own: list[bytes], again: int, grams: int, known: Buckets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, bucket) of every feature of the pieces, and the number of the text of every word."""
    found = _FOUND.findall(_SENTINEL.join(own))
    first = np.fromiter(map(known.__getitem__, found), np.int64, len(found))
    seams, places = np.flatnonzero(first < 0), np.flatnonzero(first >= 0)
    piece = np.searchsorted(seams, np.arange(len(found)))
    owner = np.array(of, np.int64)
    new = places[again:] if again else places  # only the first piece can repeat words
    texts, buckets = [owner[piece[new]]], [first[new]]
    for n in range(2, grams + 1):
        start = places[: max(0, len(places) - n + 1)]
        start = start[(start + n - 1 < len(found))]
        start = start[(piece[start] == piece[start + n - 1]) & (first[start + n - 1] >= 0)]  # a run that crosses a seam ends in another piece, or on the seam
        start = start[start + n > again] if again else start
        texts.append(owner[piece[start]])
        buckets.append(np.fromiter((known[b" ".join(found[i : i + n])] for i in start.tolist()), np.int64, len(start)))
    return np.concatenate(texts), np.concatenate(buckets), texts[0]


def _counted(rows: Iterator[pa.RecordBatch], grams: int, buckets: int) -> Iterator[pa.RecordBatch]:
    total, known = np.zeros(buckets, np.int64), Buckets(buckets)
    for batch in rows:
        for of, own, again in _pieces(raw(batch, "text"), grams):
            total += np.bincount(_features(of, own, again, grams, known)[1], minlength=buckets)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])


def counts(texts: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts, by bucket."""
    rows = texts.select(texts["text"].cast("string").alias("text")).mapInArrow(partial(_counted, grams=grams, buckets=buckets), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row per bucket at most
        out[r["bucket"]] = r["n"]
    return out


def gains(docs: DataFrame, target: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS) -> np.ndarray:
    """What a feature of each bucket tells for the target, in thousandths: its smoothed share there over that in ``docs``, as a logarithm."""
    have, want = counts(docs, grams, buckets).tolist(), counts(target, grams, buckets).tolist()
    s_all, t_all = sum(have) + buckets, sum(want) + buckets
    return np.array([math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(have, want, strict=True)], np.int64)


def _weighed(rows: Iterator[pa.RecordBatch], gain: np.ndarray, grams: int) -> Iterator[pa.RecordBatch]:
    known = Buckets(len(gain))
    for batch in rows:
        texts = pa.RecordBatch.from_arrays([pa.StructArray.field(batch.column("row"), "text")], ["text"])
        n, words, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
        for of, own, again in _pieces(raw(texts, "text"), grams):
            text, bucket, by_word = _features(of, own, again, grams, known)
            n += np.bincount(text, minlength=len(n))
            words += np.bincount(by_word, minlength=len(n))
            total += np.bincount(text, gain[bucket], minlength=len(n)).astype(np.int64)  # whole numbers below 2^53
        columns = [batch.column("row"), pa.array(words), pa.array(n), pa.array(total // np.maximum(n, 1))]
        yield pa.RecordBatch.from_arrays(columns, ["row", "n_words", "n_features", "weight"])


def scored(docs: DataFrame, gain: np.ndarray, grams: int = GRAMS, seed: int = SEED) -> DataFrame:
    """(row, n_words, n_features, weight, score): the rows of ``docs`` as structs, without columns named as in OUT.

    ``weight`` is the floored mean of the gains of a text's features, 0 without any; ``score`` is the weight plus noise from
    the seed and doc_id (null: as an empty one). Null texts have no words.
    """
    row = F.struct(*[(docs[c].cast("string") if c == "text" else docs[c]).alias(c) for c in docs.columns if c not in OUT])
    slim = docs.select(row.alias("row"))
    out = slim.withColumns({c: F.lit(0).cast("long") for c in ("n_words", "n_features", "weight")}).schema
    rows = slim.mapInArrow(partial(_weighed, gain=gain, grams=grams), out)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("row")["doc_id"].cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return rows.withColumn("score", F.col("weight") + noise)


def drawn(rows: DataFrame, share: int = SHARE, least: int = LEAST) -> DataFrame:
    """The rows of ``scored`` and ``rank``: 1, 2, 3... of the ``share`` percent (rounded down) with the highest scores among rows of at least
    ``least`` words; null for all others. Ties go to the smaller doc_id, a null one last, and then to any of the rows that are tied."""
    rows = kept(rows)  # read three times below
    can = F.col("n_words") >= least
    by_score = running(rows.filter(can).groupBy("score").agg(F.count("*").alias("n")), [F.col("score").desc()], above=F.col("n"))
    total = int(by_score.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"])
    most = total * share // 100
    lowest = by_score.filter(F.col("above") < most).agg(F.min("score").alias("score")).first()["score"]
    if lowest is None:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    high = can & (F.col("score") >= lowest)
    tied = rows.filter(high).withColumn("tied", F.monotonically_increasing_id())
    top = running(tied, [F.col("score").desc(), F.col("row")["doc_id"].asc_nulls_last(), F.col("tied").asc()], at=F.lit(1)).drop("tied")
    top = top.withColumn("rank", F.when(F.col("at") < most, F.col("at") + 1)).drop("at")
    return top.unionByName(rows.filter(~high).withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, share: int = SHARE, least: int = LEAST, grams: int = GRAMS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """The drawn rows of ``docs``, with all their columns and n_features, weight, score, rank (columns of these names are replaced).

    Both tables may be empty: without documents there are no rows, without a target (or without words in it) gains only
    tell common words from rare ones. Repeated rows are drawn one by one.
    """
    rows = drawn(scored(docs, gains(docs, target, grams, buckets), grams, seed), share, least).filter("rank IS NOT NULL")
    return rows.select("row.*", *OUT)


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null: not drawn) of every document; benchmark is the target.

    Nulls, ties, repeats and empty tables: see ``scored``, ``drawn`` and ``resampled``.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = scored(docs, gains(docs, table(spark, sf_dir, "benchmark")))
    slim = rows.select(F.struct(F.col("row")["doc_id"].alias("doc_id")).alias("row"), "n_words", "n_features", "weight", "score")
    return drawn(slim).select("row.doc_id", *OUT)


OP13_SQL = r"""
WITH k AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
dw AS (SELECT r, word, count(*) AS n FROM (SELECT r, unnest(w) AS word FROM d) GROUP BY r, word),
bw AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM b) GROUP BY word),
x AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
h AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(x) // 2), lambda i: (strpos('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', x[2 * i + 2]) - 1)),
             lambda c, v: xor(c // 256, t[xor(c % 256, v) + 1])), 4294967295) % 10000 AS bucket FROM x, k),
s AS (SELECT bucket, sum(n)::BIGINT AS s FROM dw JOIN h USING (word) GROUP BY bucket),
t AS (SELECT bucket, sum(n)::BIGINT AS t FROM bw JOIN h USING (word) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * (coalesce((SELECT sum(s) FROM s), 0) + 10000)::BIGINT AS DOUBLE) / CAST((coalesce(s, 0) + 1) * (coalesce((SELECT sum(t) FROM t), 0) + 10000)::BIGINT AS DOUBLE))) AS BIGINT) AS gain FROM s FULL JOIN t USING (bucket)),
e AS (SELECT r, CAST(floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE) AS BIGINT) AS weight FROM dw JOIN h USING (word) JOIN g USING (bucket) GROUP BY r),
f AS (SELECT r, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN e USING (r)),
o AS (SELECT *, n_features >= 20 AS can, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS nth, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM f)
SELECT doc_id, n_features, weight, score, CASE WHEN can AND nth <= 10 * n // 100 THEN nth END AS rank FROM o
"""
