"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its words, their first characters (3 to 7), and the order of magnitude of its length. The
machine learns a weight for each term and, through factors, for each pair of terms, so that what is harmless alone
can count together (an insult with a group's name; a coded stem in a short text). It is fitted on at most SAMPLE
labelled documents. A term that enough of them hold (COMMON) is in the machine whatever it tells alone, as pairs are
learned from rows that hold both; a rarer one is if it tells the labels apart by itself (G statistic). Terms that tell
nothing alone have factors and no weight of their own: they count by their pairs only. The hash space bounds the
terms, nothing else does. Texts are scored whole, in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, table
from .texts import plain, raw

#: Labelled documents that the machine is fitted on at most (those with the smallest hashes of doc_id); hash bits; factors.
SAMPLE, HASH_BITS, FACTORS = 20_000, 20, 8
#: G from which a term tells the labels apart (a chance of about one in ten thousand for a term that doesn't).
TELLING = 7.5
#: Share of the labelled documents from which a term is in the machine in any case; the part of its amount that its factors see, if it tells nothing alone.
COMMON, MUTED = 0.02, 0.3
#: Terms that are scored at once, or so.
RUN = 50_000
#: Words whose terms a task remembers at most, before it starts anew: bounds memory, changes no result.
REMEMBERED_WORDS = 150_000
_MASK = (1 << HASH_BITS) - 1
_STEMS = (3, 4, 5, 6, 7)


class TermHashes(dict):
    """Hashed terms of a word, only those that ``wanted`` (hash to number) has, if it is given."""

    def __init__(self, wanted: dict[int, int] | None = None):
        self.wanted = wanted

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > REMEMBERED_WORDS:
            self.clear()
        text = word.decode(errors="replace")
        terms = [b"=" + word] + [b"^" + text[:k].encode() for k in _STEMS if len(text) >= k]
        found = tuple(xxhash.xxh3_64_intdigest(t) & _MASK for t in terms)
        if self.wanted is not None:
            found = tuple(self.wanted[h] for h in found if h in self.wanted)
        self[word] = found
        return found

    def length(self, words: int) -> tuple[int, ...]:
        h = xxhash.xxh3_64_intdigest(b"#%d" % words.bit_length()) & _MASK
        if self.wanted is None:
            return (h,)
        return (self.wanted[h],) if h in self.wanted else ()

    def of(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """Terms of a text, in order, and the logarithm of how often it has each."""
        words = plain(text)
        every = np.fromiter(chain(chain.from_iterable(map(self.__getitem__, words)), self.length(len(words))), np.int64)
        terms, counts = np.unique(every, return_counts=True)
        return terms, np.log2(1 + counts)


def _tally(docs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each term, by label."""
    held, terms = np.zeros((2, 1 << HASH_BITS), np.int64), TermHashes()
    for batch in docs:
        for text, y in zip(raw(batch, "text"), batch.column("toxic").to_pylist(), strict=True):
            held[y, terms.of(text)[0]] += 1
    some = np.flatnonzero(held.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(held[0, some]), pa.array(held[1, some])], ["term", "clean", "toxic"])


def _rows(docs: Iterator[pa.RecordBatch], wanted: dict[int, int]) -> Iterator[pa.RecordBatch]:
    terms = TermHashes(wanted)
    for batch in docs:
        own = [terms.of(t) for t in raw(batch, "text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array([x.astype(np.int32) for x, _ in own], pa.list_(pa.int32())), pa.array([x.astype(np.float32) for _, x in own], pa.list_(pa.float32()))], ["doc_id", "toxic", "terms", "amounts"])


class Machine:
    """w0 + w.x + half of (|Vx|^2 - |V^2 x^2|), squashed; fitted by AdaGrad on log loss.

    ``alone`` says of each term whether it has a weight of its own; the factors of the others see MUTED of its amount.
    """

    def __init__(self, wanted: dict[int, int], alone: np.ndarray | None = None):
        self.wanted, self.fitted = wanted, False
        n = len(wanted)
        self.alone = np.ones(n, bool) if alone is None else alone
        self.bias, self.w, self.v = 0.0, np.zeros(n), np.random.default_rng(8).normal(0, 0.01, (n, FACTORS))

    def _forward(self, i: np.ndarray, x: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        z = np.bincount(row, self.w[i] * x, n) + self.bias
        vx = self.v[i] * np.where(self.alone[i], x, MUTED * x)[:, None]
        total = np.stack([np.bincount(row, vx[:, f], n) for f in range(FACTORS)], axis=1)
        z += 0.5 * ((total**2).sum(axis=1) - np.bincount(row, (vx**2).sum(axis=1), n))
        return z, total

    def fit(self, terms: list, amounts: list, y: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.1, decay: float = 1e-4, pair_decay: float = 1e-3) -> Machine:
        self.fitted = len(y) > 0
        rng = np.random.default_rng(9)
        share = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if len(y) else 0.5
        self.bias = float(np.log(share / (1 - share)))
        g0, gw, gv = 1e-8, np.full_like(self.w, 1e-8), np.full_like(self.v, 1e-8)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                sizes = [len(terms[k]) for k in own]
                if not sum(sizes):
                    continue
                i, x, row = np.concatenate([terms[k] for k in own]), np.concatenate([amounts[k] for k in own]), np.repeat(np.arange(len(own)), sizes)
                z, total = self._forward(i, x, row, len(own))
                e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[own]) / len(own)
                some, back = np.unique(i, return_inverse=True)
                dw = (np.bincount(back, e[row] * x, len(some)) + decay * self.w[some]) * self.alone[some]
                seen = np.where(self.alone[i], x, MUTED * x)[:, None]
                per = e[row][:, None] * seen * (total[row] - self.v[i] * seen)
                dv = np.stack([np.bincount(back, per[:, f], len(some)) for f in range(FACTORS)], axis=1) + pair_decay * self.v[some]
                gw[some] += dw**2
                gv[some] += dv**2
                g0 += e.sum() ** 2
                self.w[some] -= rate * dw / np.sqrt(gw[some])
                self.v[some] -= 0.3 * rate * dv / np.sqrt(gv[some])
                self.bias -= rate * e.sum() / np.sqrt(g0)
        return self

    def scores(self, texts: list[bytes | None], terms: TermHashes) -> np.ndarray:
        """Texts are scored in runs of about RUN terms, so that memory hangs on no batch's size."""
        if not self.fitted:
            return np.zeros(len(texts))
        out, own, held = [], [], 0
        for k, text in enumerate(texts):
            own.append(terms.of(text))
            held += len(own[-1][0])
            if held >= RUN or k + 1 == len(texts):
                i, x = (np.concatenate(c) for c in zip(*own, strict=True))
                z, _ = self._forward(i, x, np.repeat(np.arange(len(own)), [len(t) for t, _ in own]), len(own))
                out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
                own, held = [], 0
        return np.concatenate(out) if out else np.zeros(0)


def remainder(doc_id: str, of: int):
    """crc32 of the id as text, modulo ``of``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % of


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """The machine, from labelled rows whose crc32(doc_id) mod 5 is not 0.

    Labels of one document that disagree count as toxic; labels without an id or a value don't count. A document
    counts once, however many rows it has; of several texts of one id, that with the smallest md5 counts (null ones only
    if there is no other). Without any labelled document the machine is unfitted (``fitted`` is false): it says 0 for every
    text, as nothing is known against any.
    """
    known = labels.select(labels["doc_id"].cast("long").alias("id"), labels["toxic"].cast("int").alias("toxic")).filter("id IS NOT NULL AND toxic IN (0, 1)")
    known = known.filter(remainder("id", 5) != 0).groupBy("id").agg(F.max("toxic").alias("toxic"))
    known = kept(known.orderBy(F.xxhash64("id"), "id").limit(sample))  # at most ``sample`` rows of 12 bytes
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    own = own.join(F.broadcast(known), F.col("doc_id") == F.col("id"))
    own = own.groupBy("doc_id", "toxic").agg(F.min(F.when(F.col("text").isNotNull(), F.struct(F.md5("text").alias("md5"), "text"))).alias("one"))
    own = kept(own.select("doc_id", F.col("one")["text"].alias("text"), "toxic"))  # at most ``sample`` documents, read twice below
    held = own.mapInArrow(_tally, "term long, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    total = own.agg(F.count(F.when(F.col("toxic") == 0, 1)).alias("clean"), F.count(F.when(F.col("toxic") == 1, 1)).alias("toxic")).head()
    size = total["clean"] + total["toxic"]
    if not size:
        return Machine({})
    rate = (F.col("clean") + F.col("toxic")) / float(size)
    cell = lambda c, n: F.when((F.col(c) > 0) & (n > 0), F.col(c) * F.log(F.col(c) / (n * rate))).otherwise(0.0)
    told = held.select("term", (cell("clean", float(total["clean"])) + cell("toxic", float(total["toxic"])) >= TELLING).alias("alone"), (F.col("clean") + F.col("toxic")).alias("n"))
    terms = sorted((r["term"], r["alone"]) for r in told.filter(F.col("alone") | (F.col("n") >= max(2, COMMON * size))).select("term", "alone").toLocalIterator())
    wanted = {t: k for k, (t, _) in enumerate(terms)}
    rows = own.mapInArrow(partial(_rows, wanted=wanted), "doc_id long, toxic int, terms array<int>, amounts array<float>").toArrow().combine_chunks()
    machine = Machine(wanted, np.array([a for _, a in terms], bool))
    order = np.argsort(rows["doc_id"].to_numpy())
    lists = [_lists(rows[c].combine_chunks(), order) for c in ("terms", "amounts")]
    return machine.fit(*lists, rows["toxic"].to_numpy()[order].astype(float))


def _lists(column: pa.Array, order: np.ndarray) -> list[np.ndarray]:
    """The lists of a column, in the given order, as views of its values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    at, values = column.offsets.to_numpy(), column.values.to_numpy()
    return [values[at[k] : at[k + 1]] for k in order]


def _scored(docs: Iterator[pa.RecordBatch], machine: Machine, text: str) -> Iterator[pa.RecordBatch]:
    terms = TermHashes(machine.wanted)
    for batch in docs:
        scores = machine.scores(raw(batch, text), terms)
        rest = [n for n in batch.schema.names if n != "__text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in rest], pa.array(scores)], [*rest, "__score"])


def score(docs: DataFrame, machine: Machine, carry: list[str], out: str = "score") -> DataFrame:
    """The carried columns and the score (0 to 1) of every text, empty and null ones too. Only the text is looked at."""
    slim = docs.select(*[docs[c].alias(c) for c in carry], *([] if "text" in carry else [docs["text"].cast("string").alias("__text")]))
    schema = slim.drop("__text").withColumn("__score", F.lit(0.0)).schema
    return slim.mapInArrow(partial(_scored, machine=machine, text="text" if "text" in carry else "__text"), schema).withColumnRenamed("__score", out)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = table(spark, sf_dir, "documents")
    machine = fit(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    return score(docs, machine, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
