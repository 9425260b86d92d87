"""LM scoring by context-tree weighting over bytes, with a unigram base score beside it.

Bytes are decomposed into eight binary decisions; every decision has a tree of contexts, the last 0 to DEPTH
bytes. Each node keeps a Krichevsky-Trofimov estimate, and the weighted probability of a node is half its own
estimate's and half the product of its children's; a prediction so mixes the estimates of all depths, by how well
each depth coded the corpus. Every context that stands before a training byte has its node: the tree is a table of
the corpus's distinct grams (DEPTH bytes and the next), which grows with the corpus. Grams of one context of NEAR
bytes are in one group, whose task weighs the subtrees of those contexts; what is nearer the root, at most
one node per context of NEAR - 1 bytes and bit, is weighed by the driver; a second pass over the groups gives each gram,
those of texts that only are scored too, its log10 probability. Chunks send their distinct grams there, packed by
group, and get the logs back. A text ends with a byte that UTF-8 never has, so the probabilities of all texts sum to one.

The base score needs the count of every word of the corpus. Tasks number the words of a chunk of texts; one row per
chunk and distinct word goes to that word's total and back to its chunk. No vocabulary is ever in one place.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import kept, table
from .texts import mixed, raw, spaced

DEPTH, NEAR = 5, 3
#: Ends texts and stands before them.
END = 0xFF
#: Bytes that are counted, or scored, at once; tokens of a chunk, and its bytes.
COUNTED, SCORED, CHUNK, CHUNK_BYTES = 8 << 20, 1 << 20, 4_000_000, 16 << 20
#: Grams of chunks that a group gets, or so; their number decides the number of groups and no result.
GROUPED = 250_000
#: Logs of the driver's part are summed as whole numbers of this fraction, so that no order of rows changes them.
FINE = float(1 << 26)


def stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other, DEPTH end bytes before each and one after; the places of what is to be coded."""
    pad = bytes([END]) * DEPTH
    data = np.frombuffer(pad + pad.join(t + bytes([END]) for t in texts), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts])
    first = np.repeat((np.arange(len(texts)) + 1) * DEPTH, sizes)
    return data, np.arange(len(first)) + first


def coded(texts: list[bytes]) -> np.ndarray:
    """The gram of every byte that is coded: DEPTH bytes and the byte, oldest in the highest byte."""
    data, at = stream(texts)
    gram = np.zeros(len(at), np.uint64)
    for k in range(DEPTH, -1, -1):
        gram = (gram << np.uint64(8)) | data[at - k]
    return gram


def _grams(docs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, n): grams with their number in a run of texts."""

    def counted(texts: list[bytes]) -> pa.RecordBatch:
        gram, n = np.unique(coded(texts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))], ["gram", "n"])

    held, size = [], 0
    for batch in docs:
        for text in raw(batch, "text"):
            held.append(text or b"")
            size += len(held[-1])
            if size >= COUNTED:
                yield counted(held)
                held, size = [], 0
    if held:
        yield counted(held)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series, moved up by 8 first."""
    y = x + 8
    up = np.log(x)
    for k in range(1, 8):
        up += np.log(x + k)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - up


def _block_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of so many zeros and ones."""
    out = np.zeros(zeros.shape)
    some = (zeros + ones) > 0
    z, o = zeros[some].astype(float), ones[some].astype(float)
    out[some] = _lgamma(z + 0.5) + _lgamma(o + 0.5) - _lgamma(z + o + 1) - np.log(np.pi)
    return out


class Tree:
    """child[node, byte]: the node of the longer context, 0 if there is none; log10[node, byte]: what is coded there."""

    def __init__(self, levels: list[dict[int, np.ndarray]]):
        """levels[d]: contexts of d bytes (latest byte lowest) with the counts of the 256 bytes after them."""
        names = [(d, c) for d, level in enumerate(levels) for c in sorted(level)]
        number = {x: i for i, x in enumerate(names)}
        counts = np.stack([levels[d][c] for d, c in names]).astype(np.int64)
        depth = np.array([d for d, _ in names])
        parent = np.array([number[d - 1, c & ((1 << 8 * (d - 1)) - 1)] if d else -1 for d, c in names])
        self.child = np.zeros((len(names), 256), np.int32)
        for i, (d, c) in enumerate(names):
            if d:
                self.child[parent[i], c >> 8 * (d - 1)] = i
        inner = np.zeros(len(names), bool)
        inner[parent[1:]] = True
        other = counts.copy()
        np.subtract.at(other, parent[1:], counts[1:])
        logs = np.zeros((len(names), 1))
        for bit in range(8):
            n = counts.reshape(len(names), 1 << bit, 2, -1).sum(axis=3)
            o = other.reshape(len(names), 1 << bit, 2, -1).sum(axis=3)
            own, rest = _block_estimate(n[:, :, 0], n[:, :, 1]), _block_estimate(o[:, :, 0], o[:, :, 1])
            guess = lambda x: (x[:, :, 1] + 0.5) / (x.sum(axis=2) + 1)
            below, weighted = np.where(inner[:, None], rest, 0.0), own.copy()
            for d in range(depth.max(), -1, -1):
                here = np.flatnonzero((depth == d) & inner)
                weighted[here] = np.logaddexp(own[here], below[here]) - np.log(2)
                at = np.flatnonzero(depth == d)
                if d:
                    np.add.at(below, parent[at], weighted[at])
            stop = np.where(inner[:, None], np.exp(own - np.log(2) - weighted), 1.0)
            mix, left, p = np.zeros_like(own), np.ones_like(own), guess(n)
            for d in range(1, depth.max() + 1):
                at = np.flatnonzero(depth == d)
                up = parent[at]
                mix[at] = mix[up] + left[up] * stop[up] * p[up]
                left[at] = left[up] * (1 - stop[up])
            one = mix + left * np.where(inner[:, None], stop * p + (1 - stop) * guess(o), p)
            one = np.clip(one, 1e-12, 1 - 1e-12)
            logs = (logs[:, :, None] + np.stack([np.log10(1 - one), np.log10(one)], axis=2)).reshape(len(names), -1)
        self.log10 = logs.astype(np.float32)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text and its end."""
        data, at = stream(texts)
        node = np.zeros(len(at), np.int64)
        child = self.child.ravel()
        live = np.arange(len(at))
        own = node
        for k in range(1, DEPTH + 1):
            own = child[own * 256 + data[at[live] - k]].astype(np.int64)
            more = own > 0
            live, own = live[more], own[more]
            node[live] = own
        logs = self.log10.ravel()[node * 256 + data[at]].astype(np.float64)
        ends = np.cumsum([len(t) + 1 for t in texts])
        return np.add.reduceat(logs, np.concatenate([[0], ends[:-1]])) if len(texts) else np.zeros(0)


def fit(docs: DataFrame) -> Tree:
    """The tree of all texts of ``docs`` (null: empty), whole and in one place: for small corpora. score() has it as a table.

    Without rows every byte has the same probability.
    """
    grams = docs.select(docs["text"].cast("string").alias("text")).mapInArrow(_grams, "gram long, n long")
    rows = grams.groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    levels: list[dict[int, np.ndarray]] = [{} for _ in range(DEPTH + 1)]
    for gram, n in zip(rows["gram"].to_pylist(), rows["n"].to_pylist(), strict=True):
        for d, level in enumerate(levels):
            level.setdefault(gram >> 8 & ((1 << 8 * d) - 1), np.zeros(256, np.int64))[gram & 255] += n
    return Tree(levels if rows.num_rows else [{0: np.zeros(256, np.int64)}])


def _weigh(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ln of the weighted probability, the weight of a node's own estimate in a prediction, and that estimate of a one."""
    own, guess = _block_estimate(zeros, ones), (ones + 0.5) / (zeros + ones + 1)
    if below is None:
        return own, np.ones_like(own), guess
    weighted = np.logaddexp(own, below) - np.log(2)
    return weighted, np.exp(own - np.log(2) - weighted), guess


class Subtrees:
    """The nodes of depth NEAR to DEPTH of some grams, bit by bit; all grams of a context of NEAR bytes are there."""

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        self.gram, self.n = gram, n
        self.orders = {}
        for d in range(NEAR, DEPTH + 1):
            key = gram & ((1 << 8 * (d + 1)) - 1)
            order = np.argsort(key, kind="stable")
            self.orders[d] = order, key[order]

    def bit(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict]:
        """Gram of each node of depth NEAR, its zeros, ones and ln weighted; by depth: node of each gram, and what weighs it."""
        one = (self.gram >> (7 - k)) & 1
        below, levels = None, {}
        for d in range(DEPTH, NEAR - 1, -1):
            order, key = self.orders[d]
            fresh = np.diff(key >> (8 - k), prepend=-1) != 0
            first = np.flatnonzero(fresh)
            node = np.empty(len(order), np.int64)
            node[order] = np.cumsum(fresh) - 1
            n, ones = np.add.reduceat(self.n[order], first), np.add.reduceat((self.n * one)[order], first)
            if below is not None:
                below = np.bincount(node[under], below, len(first))
            below, stop, guess = _weigh(n - ones, ones, below)
            under = order[first]  # a gram of each node
            levels[d] = node, under, stop, guess
        return under, n - ones, ones, below, levels


def _near(gram: np.ndarray, k: int) -> np.ndarray:
    """The node of a gram's context of NEAR - 1 bytes at its k-th bit."""
    return ((gram >> 8) & ((1 << 8 * (NEAR - 1)) - 1)) << 8 | 1 << k | (gram & 255) >> (8 - k)


def _packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _unpacked(packed: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), kind)


def _by_group(gram: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of grams, group by group; the groups that have some; where these begin. A group has all grams of a near context."""
    of = (mixed(((gram >> 8) & ((1 << 8 * NEAR) - 1)).astype(np.uint64)) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    some, first = np.unique(of[order], return_index=True)
    return order, some, first


def _dealt(chunks: Iterator[pa.RecordBatch], groups: int) -> Iterator[pa.RecordBatch]:
    for batch in chunks:
        for name, grams, learned in zip(*[batch.column(c).to_pylist() for c in ("chunk", "grams", "learned")], strict=True):
            gram, n = np.cumsum(_unpacked(grams, np.int64)), _unpacked(learned, np.int64)
            order, some, first = _by_group(gram, groups)
            own = [_packed(np.diff(x, prepend=0)) for x in np.split(gram[order], first[1:])]
            times = [_packed(x) for x in np.split(n[order], first[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([name] * len(some)), pa.array(own, pa.binary()), pa.array(times, pa.binary())], ["of", "chunk", "grams", "learned"])


def _gathered(t: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Sorted distinct grams of a group, their number in training, and the places of each row's grams among them."""
    own = [np.cumsum(_unpacked(x, np.int64)) for x in t["grams"].to_pylist()]
    n = np.concatenate([_unpacked(x, np.int64) for x in t["learned"].to_pylist()])
    gram, back = np.unique(np.concatenate(own), return_inverse=True)
    return gram, np.bincount(back, n, len(gram)).astype(np.int64), np.split(back, np.cumsum([len(x) for x in own])[:-1])


def _up(t: pa.Table) -> pa.Table:
    gram, n, _ = _gathered(t)
    trees, out = Subtrees(gram, n), []
    for k in range(8):
        under, zeros, ones, weighted, _ = trees.bit(k)
        node, back = np.unique(_near(trees.gram[under], k), return_inverse=True)
        fine = np.rint(weighted * FINE).astype(np.int64)
        sums = np.zeros((3, len(node)), np.int64)
        for row, x in zip(sums, (zeros, ones, fine), strict=True):
            np.add.at(row, back, x)
        out.append(pa.table([pa.array(node), *map(pa.array, sums)], names=["node", "zeros", "ones", "below"]))
    return pa.concat_tables(out)


def _down(t: pa.Table, top) -> pa.Table:
    nodes, mixes, lefts = top.value
    gram, n, places = _gathered(t)
    trees, logs = Subtrees(gram, n), np.zeros(len(gram))
    for k in range(8):
        under, *_, levels = trees.bit(k)
        at = np.searchsorted(nodes, _near(gram, k))
        mix, left = mixes[at], lefts[at]
        for d in range(NEAR, DEPTH + 1):
            node, _, stop, guess = levels[d]
            mix = mix + left * (stop * guess)[node]
            left = left * (1 - stop)[node]
        one = np.clip(mix, 1e-12, 1 - 1e-12)
        logs += np.log10(np.where((gram >> (7 - k)) & 1, one, 1 - one))
    logs = logs.astype(np.float32)
    return pa.table([t["chunk"], t["of"], pa.array([_packed(logs[x]) for x in places], pa.binary())], names=["chunk", "of", "logs"])


def _top(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted nodes of depth NEAR - 1 with what the shorter contexts and their own add, and what weight is left below."""
    node, zeros, ones, below = (t[c].to_numpy() for c in ("node", "zeros", "ones", "below"))
    order = np.argsort(node)
    node, zeros, ones, below = node[order], zeros[order], ones[order], below[order] / FINE
    levels, own = [], node
    for d in range(NEAR - 1, -1, -1):
        weighted, stop, guess = _weigh(zeros, ones, below)
        if d:
            shorter = own & ((1 << 8 * d) - 1)  # contexts have their latest byte lowest, above the bits
            own, up = np.unique(shorter, return_inverse=True)
            zeros, ones = (np.bincount(up, x, len(own)).astype(np.int64) for x in (zeros, ones))
            below = np.bincount(up, weighted, len(own))
        else:
            up = np.zeros(len(own), np.int64)
        levels.append((up, stop, guess))
    mix, left = np.zeros(len(own)), np.ones(len(own))
    for d, (up, stop, guess) in enumerate(reversed(levels)):
        if d:
            mix, left = mix[up], left[up]
        mix, left = mix + left * stop * guess, left * (1 - stop)
    return node, mix, left


def weighed(chunks: DataFrame, groups: int) -> DataFrame:
    """chunk, of, logs: the log10 probability of each gram's last byte after its others, as _by_group puts a chunk's grams.

    chunks: chunk, grams (packed differences of its sorted distinct grams), learned (packed: their number in training, 0 or more).
    """
    dealt = chunks.select("chunk", "grams", "learned").mapInArrow(partial(_dealt, groups=groups), "of long, chunk string, grams binary, learned binary")
    dealt = dealt.repartition(groups, "of").groupBy("of")
    up = dealt.applyInArrow(lambda t: _up(t), "node long, zeros long, ones long, below long")
    top = _top(up.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")]).toArrow())
    shared = chunks.sparkSession.sparkContext.broadcast(top)
    return dealt.applyInArrow(lambda t: _down(t, shared), "chunk string, of long, logs binary")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


_DOC = pa.struct([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("words", pa.int64()), ("size", pa.int64())])
_CHUNKS = "chunk string, docs array<struct<doc_id:long,held_out:boolean,n_tokens:long,words:long,size:long>>, codes binary, times binary, hashes binary, trained binary, text binary, grams binary, learned binary, n_grams long"


def _chunked(docs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1).compress
    number: dict[bytes, int] = {}
    held, codes, texts, waiting, runs, tokens, size, total = [], [], [], [], [], 0, 0, 0
    packer = zstandard.ZstdCompressor(level=3).compressobj()

    def count() -> None:
        gram = coded(waiting)
        out = np.repeat([d["held_out"] for d in held[len(held) - len(waiting) :]], [len(t) + 1 for t in waiting])
        learned, n = np.unique(gram[~out], return_counts=True)
        other = np.unique(gram[out])
        runs.append((np.concatenate([learned, other]), np.concatenate([n, np.zeros(len(other), np.int64)])))
        if sum(len(g) for g, _ in runs) > 1_000_000:
            runs[:] = [together()]
        texts.append(packer.compress(b"".join(waiting)))
        waiting.clear()

    def together() -> tuple[np.ndarray, np.ndarray]:
        gram, back = np.unique(np.concatenate([g for g, _ in runs]), return_inverse=True)
        return gram, np.bincount(back, np.concatenate([n for _, n in runs]), len(gram)).astype(np.int64)

    def close() -> pa.RecordBatch:
        if waiting:
            count()
        gram, learned = together()
        runs.clear()
        v = len(number)
        key = np.repeat(np.arange(len(codes), dtype=np.int64) * v, [len(c) for c in codes]) + np.concatenate(codes)
        key, times = np.unique(key, return_counts=True)
        of, code = np.divmod(key, v)
        for d, n in zip(held, np.bincount(of, minlength=len(held)), strict=True):
            d["words"] = int(n)
        learns = np.array([not d["held_out"] for d in held])[of]
        trained = np.bincount(code[learns], times[learns], v).astype(np.int64)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in number), np.uint64, v)
        columns = [[uuid.uuid4().hex], [held], [pack(np.diff(code, prepend=0).astype(np.int32).tobytes())], [pack(times.astype(np.int32).tobytes())], [hashes.tobytes()], [pack(trained.tobytes())], [b"".join([*texts, packer.flush()])], [pack(np.diff(gram, prepend=np.uint64(0)).tobytes())], [pack(learned.tobytes())], [len(gram)]]
        kinds = [pa.string(), pa.list_(_DOC), *[pa.binary()] * 7, pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["chunk", "docs", "codes", "times", "hashes", "trained", "text", "grams", "learned", "n_grams"])

    for batch in docs:
        for doc, out, text in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), raw(batch, "text"), strict=True):
            words = [*spaced(text), b""]  # the empty word is the end
            own = np.fromiter([number.setdefault(w, len(number)) for w in words], np.int32, len(words))
            held.append({"doc_id": doc, "held_out": out, "n_tokens": len(words), "size": len(text or b"")})
            codes.append(own)
            waiting.append(text or b"")
            tokens += len(words)
            size += len(waiting[-1])
            total += len(waiting[-1])
            if size >= SCORED:
                count()
                size = 0
            if tokens >= CHUNK or total >= CHUNK_BYTES:
                yield close()
                number, held, codes, texts, runs, tokens, size, total = {}, [], [], [], [], 0, 0, 0
                packer = zstandard.ZstdCompressor(level=3).compressobj()
    if held:
        yield close()


def _terms(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in chunks:
        for name, hashes, trained in zip(*[batch.column(c).to_pylist() for c in ("chunk", "hashes", "trained")], strict=True):
            h, t = np.frombuffer(hashes, np.int64), np.frombuffer(unpack(trained), np.int64)
            for at in range(0, len(h), 100_000):
                part = slice(at, at + 100_000)
                n = len(h[part])
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(at, at + n, dtype=np.int32)), pa.array(h[part]), pa.array(t[part])], ["chunk", "code", "hash", "trained"])


def _scores(text: bytes, sizes: list[int], grams: np.ndarray, values: np.ndarray) -> list[float]:
    """log10 probability of each text and its end; ``values`` are those of the sorted ``grams``."""
    out: list[float] = []
    held, size, at = [], 0, 0
    for k, n in enumerate(sizes):
        held.append(text[at : at + n])
        at, size = at + n, size + n
        if size >= SCORED or k + 1 == len(sizes):
            gram, back = np.unique(coded(held), return_inverse=True)
            ends = np.cumsum([len(t) + 1 for t in held])
            out += np.add.reduceat(values[np.searchsorted(grams, gram)][back], np.concatenate([[0], ends[:-1]])).tolist()
            held, size = [], 0
    return out


def _base(docs: pa.Table, terms: pa.Table, groups: int) -> pa.Table:
    counts = np.zeros(terms.num_rows, np.int64)
    counts[terms["code"].to_numpy()] = terms["c"].to_numpy()
    logs = np.log10(counts + 1.0)
    rows, base, known, scores = [], [], [], []
    for own, codes, times, text, grams, got in zip(*[docs[x].to_pylist() for x in ("docs", "codes", "times", "text", "grams", "logs")], strict=True):
        code = np.cumsum(_unpacked(codes, np.int32), dtype=np.int64)
        n = _unpacked(times, np.int32)
        first = np.concatenate([[0], np.cumsum([d["words"] for d in own])[:-1]]).astype(np.int64)
        rows += own
        base += list(np.add.reduceat(logs[code] * n, first))
        known += list(np.add.reduceat(np.where(counts[code] > 0, n, 0), first))
        gram = np.cumsum(_unpacked(grams, np.int64))
        values = np.zeros(len(gram))
        values[_by_group(gram, groups)[0]] = np.concatenate([_unpacked(x["logs"], np.float32) for x in sorted(got, key=lambda x: x["of"])])
        scores += _scores(zstandard.ZstdDecompressor().decompressobj().decompress(text), [d["size"] for d in own], gram.astype(np.uint64), values)
    names = ["doc_id", "held_out", "n_tokens"]
    return pa.table([pa.array([d[c] for d in rows], _DOC.field(c).type) for c in names] + [pa.array(scores, pa.float64()), pa.array(base, pa.float64()), pa.array(known, pa.int64())], names=[*names, "score", "base", "n_known"])


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of ``docs``.

    Learns, for both scores, from the rows that aren't held out (crc32 of the id as text, mod 7, is 2; rows
    without an id learn). Null texts are empty: an end alone. Repeated rows count, and are scored, each time. Words
    are told apart by 64-bit hashes. If nothing is learned, train_tokens is 0 and every token is unknown.
    """
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), held_out(docs["doc_id"]).alias("held_out"), docs["text"].cast("string").alias("text"))
    chunks = kept(slim.mapInArrow(_chunked, _CHUNKS))
    groups = (chunks.agg(F.sum("n_grams")).head()[0] or 0) // GROUPED + 32
    logs = weighed(chunks, groups).groupBy("chunk").agg(F.collect_list(F.struct("of", "logs")).alias("logs"))
    terms = chunks.select("chunk", "hashes", "trained").mapInArrow(_terms, "chunk string, code int, hash long, trained long")
    same = W.partitionBy("hash")
    terms = terms.withColumn("c", F.sum("trained").over(same)).withColumn("first", F.row_number().over(same.orderBy("chunk")) == 1)
    terms = kept(terms.select("chunk", "code", "c", "first"))
    sums = terms.filter("first AND c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).head()
    chunks = chunks.select("chunk", "docs", "codes", "times", "text", "grams").join(logs, "chunk")
    base_ = lambda docs, terms: _base(docs, terms, groups)
    rows = chunks.groupBy("chunk").cogroup(terms.select("chunk", "code", "c").groupBy("chunk")).applyInArrow(base_, "doc_id long, held_out boolean, n_tokens long, score double, base double, n_known long")
    base = F.col("base") - F.col("n_tokens") * float(np.log10(sums["n"] + sums["v"] + 1))
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(sums["n"]).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op6_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    return score(table(spark, sf_dir, "documents"))
