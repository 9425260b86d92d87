"""Near copies by b-bit MinHash: signatures of minima's low bits, band candidates, exact confirmation.

Texts that are equal to the letter become one node first, so copies cost one row each and no pair. Nodes that
share a band bucket are candidates. In each bucket every member is held against one centre, the bucket's
smallest node: as many pairs as members, however large the bucket. Signatures of 4-bit minima estimate the
similarity, corrected for chance agreement, and drop what is far from the threshold; the rest is confirmed on
full shingle sets, each node with its smallest centre first and with others only if that left the two apart.
Where a bucket still holds several components, members of different components meet in blocks: signatures alone
first, then the full sets of those that have a possible partner, and only links that join two components come out.
So every pair of a bucket is either in one component or was tested, and nothing is capped.

Texts are packed when they are signed; those of nodes that share a bucket are written once, by node. What many rows
look up (a large bucket's centre, a centre's text, the label of a large class, the class of a text with many
copies) is handed out by salt, one copy for each salt that its rows have, so no key's rows meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import kept, table
from .texts import WordHashes, mixed, raw, shingles, spaced

SHINGLE, SIMILAR = 5, 75  # words; per cent
#: 32 bands of 4 minima: a pair at the threshold shares none with a chance of five in a million.
BANDS, ROWS = 32, 4
MINIMA = BANDS * ROWS
BITS = 4
#: Six standard deviations of the estimate at the threshold.
MARGIN = 0.24
#: Signatures in a block of the block-wise comparison.
BLOCK = 256
#: Parts that the rows of one key are dealt to.
SALTS = 32
_LANES = MINIMA * BITS // 64
_SIG = [f"s{i}" for i in range(_LANES)]
_BAND = [f"b{i}" for i in range(BANDS)]


def _salt(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int")


def _salts(column: str) -> Column:
    """An aggregate: the salts that ``column`` has in a group, as bits."""
    return F.expr(f"bit_or(shiftleft(1L, cast(pmod(xxhash64({column}), {SALTS}) AS int)))")


def _handed_out(df: DataFrame, salts: str = "salts") -> DataFrame:
    """Each row once for each of its ``salts``, with that as ``salt``."""
    every = F.sequence(F.lit(0), F.lit(SALTS - 1))
    return df.withColumn("salt", F.explode(F.filter(every, lambda k: F.getbit(F.col(salts), k) == 1))).drop(salts)


def _for_each(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """(a, salt, ...): the values, unique by ``a``, for the salts that b has in the pairs of that a."""
    return _handed_out(values.join(pairs.groupBy("a").agg(_salts("b").alias("salts")), "a"))


def _signed(docs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, key and the packed text, then the set's size, the packed signature and the band keys."""
    pack = zstandard.ZstdCompressor(level=1).compress
    rng = np.random.default_rng(20240229)
    a = rng.integers(0, 2**63, MINIMA, np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, MINIMA, np.uint64)[:, None]
    odd = rng.integers(0, 2**63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
    shift = np.arange(0, 64, BITS, dtype=np.uint64)
    number = np.arange(BANDS, dtype=np.uint64)
    words = WordHashes()
    for batch in docs:
        n = batch.num_rows
        size, sig, band = np.zeros(n, np.int64), np.zeros((n, _LANES), np.uint64), np.zeros((n, BANDS), np.uint64)
        texts = raw(batch, "text")
        for i, text in enumerate(texts):
            own = shingles(words.of(spaced(text)), SHINGLE)
            size[i] = len(own)
            if not len(own):
                continue
            low = np.full(MINIMA, np.iinfo(np.uint64).max)
            for at in range(0, len(own), 4096):
                np.minimum(low, (own[at : at + 4096] * a + b).min(axis=1), out=low)
            few = (low * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
            sig[i] = (few.reshape(_LANES, -1) << shift).sum(axis=1, dtype=np.uint64)
            band[i] = mixed((low.reshape(BANDS, ROWS) * odd).sum(axis=1, dtype=np.uint64) + number)
        columns = [batch.column("doc_id"), batch.column("key"), pa.array([pack(t or b"") for t in texts], pa.binary()), pa.array(size)]
        columns += [pa.array(x.view(np.int64)) for x in np.ascontiguousarray(sig.T)] + [pa.array(x.view(np.int64)) for x in np.ascontiguousarray(band.T)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "packed", "n", *_SIG, *_BAND])


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the text), packed (the text), n (distinct shingles), signature and band columns; one row per row of ``docs``."""
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce(docs["text"], F.lit("")))).alias("key"), docs["text"].alias("text"))
    return slim.mapInArrow(_signed, "doc_id long, key binary, packed binary, n long, " + ", ".join(f"{c} long" for c in _SIG + _BAND))


def agreement(a: str, b: str) -> Column:
    """Minima whose low bits agree, by bit counts over both packed signatures."""
    ones = int("1" * (64 // BITS), 16)

    def differ(x: Column) -> Column:
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(ones)))

    return F.lit(MINIMA) - reduce(lambda x, y: x + y, [differ(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in _SIG])


def least_agreement(similar: int = SIMILAR) -> float:
    """Agreeing minima from which a pair is confirmed: J = (share - 2^-b) / (1 - 2^-b), less the margin."""
    chance = 2.0**-BITS
    return MINIMA * (chance + (1 - chance) * (similar / 100 - MARGIN))


def _likely(pairs: DataFrame, nodes: DataFrame, similar: int) -> DataFrame:
    """Pairs (a, b) that signatures and set sizes leave possible."""
    s = nodes.select("key", "n", *_SIG)
    p = pairs.join(s.select(F.col("key").alias("b"), F.struct("n", *_SIG).alias("y")), "b").withColumn("salt", _salt("b"))
    p = p.join(_for_each(pairs, s.select(F.col("key").alias("a"), F.struct("n", *_SIG).alias("x"))), ["a", "salt"])
    sizes = 100 * F.least("x.n", "y.n") >= similar * F.greatest("x.n", "y.n")
    return p.filter(sizes & (agreement("x", "y") >= least_agreement(similar))).select("a", "b")


def _exact(pairs: Iterator[pa.RecordBatch], similar: int) -> Iterator[pa.RecordBatch]:
    words, last, left, unpack = WordHashes(), None, None, zstandard.ZstdDecompressor().decompress
    for batch in pairs:
        ok = []
        for x, y in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True):
            if x != last:
                last, left = x, shingles(words.of(spaced(unpack(x))), SHINGLE)
            right = shingles(words.of(spaced(unpack(y))), SHINGLE)
            both = len(np.intersect1d(left, right, assume_unique=True))
            ok.append(100 * both >= similar * (len(left) + len(right) - both) and both > 0)
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _confirmed(pairs: DataFrame, texts: DataFrame, similar: int) -> DataFrame:
    """The pairs whose full sets are similar."""
    both = pairs.join(texts.select(F.col("key").alias("b"), F.col("packed").alias("right")), "b").withColumn("salt", _salt("b"))
    both = both.join(_for_each(pairs, texts.select(F.col("key").alias("a"), F.col("packed").alias("left"))), ["a", "salt"])
    return kept(both.select("a", "b", "left", "right").mapInArrow(partial(_exact, similar=similar), "a binary, b binary"))


def _linked(pairs: DataFrame, texts: DataFrame, similar: int) -> tuple[DataFrame, DataFrame]:
    """Confirmed pairs that have the components of all that could be confirmed, and these components' labels."""
    least = kept(pairs.groupBy("b").agg(F.min("a").alias("a")))
    edges = _confirmed(least, texts, similar)
    labels = components(edges)
    rest = pairs.join(least.select("b", F.col("a").alias("least")), "b").filter("a > least").drop("least")
    rest = rest.join(labels.select(F.col("node").alias("b"), F.col("label").alias("own")), "b", "left").withColumn("salt", _salt("b"))
    centres = _for_each(pairs, labels.select(F.col("node").alias("a"), F.col("label").alias("other")))
    rest = kept(rest.join(centres, ["a", "salt"], "left").filter("coalesce(own, b) <> coalesce(other, a)").select("a", "b"))
    if rest.isEmpty():
        return edges, labels
    edges = edges.union(_confirmed(rest, texts, similar))
    return edges, components(edges)


def _texts(keys: DataFrame, nodes: DataFrame, own: DataFrame) -> DataFrame:
    """key, packed: the text of the nodes that ``keys`` names, each once."""
    need = keys.join(nodes.select("key", "rep"), "key").select(F.col("key").alias("node"), "rep")
    texts = own.select("doc_id", "key", "packed").join(need, (F.col("key") == F.col("node")) & F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
    return texts.groupBy("key").agg(F.max("packed").alias("packed"))  # repeated rows, and rows without an id


def components(edges: DataFrame) -> DataFrame:
    """(a, b) to (node, label): the smallest node that can be reached, for every node of an edge.

    Each round takes the smallest label around a node and then that label's own label, so that stars need two
    rounds and long chains few; rounds end when no label changes. Each round's labels are a written table.
    """
    both = kept(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = kept(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        fresh = labels.join(around, "node").select("node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        fresh = kept(fresh)
        moved = labels.select(F.col("node").alias("label"), F.col("label").alias("next")).filter("next < label")
        moved = _handed_out(moved.join(fresh.groupBy("label").agg(_salts("node").alias("salts")), "label"))
        fresh = fresh.withColumn("salt", _salt("node")).join(moved, ["label", "salt"], "left")
        fresh = kept(fresh.select("node", "was", F.least("label", "next").alias("label")))  # least() passes nulls over
        changed = fresh.filter(F.col("label") < F.col("was")).isEmpty()
        labels = fresh.select("node", "label")
        if changed:
            return labels


def _sets(docs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, unpack = WordHashes(), zstandard.ZstdDecompressor().decompress
    for batch in docs:
        sets = [shingles(words.of(spaced(unpack(t))), SHINGLE).tobytes() for t in batch.column("packed").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(sets, pa.binary())], ["key", "set"])


def _possible(t: pa.Table, least: float, similar: int) -> Iterator[tuple[int, np.ndarray]]:
    """One block of a bucket's smaller components against one block of all its members: places of those that may be
    similar by signature and size, of different components, and weren't tested with the centre. A pair that shares
    several buckets is looked at in that of the first band alone."""
    side, minor, n = (t[c].to_numpy() for c in ("side", "minor", "n"))
    band, centre = t["band"][0].as_py(), t["centre"][0].as_py()
    keys = np.array(t["key"].to_pylist(), object)
    is_centre, key = keys == centre, np.unique(keys, return_inverse=True)[1]
    label = np.unique(np.array(t["label"].to_pylist(), object), return_inverse=True)[1]
    sig = np.stack([t[c].to_numpy() for c in _SIG], axis=1).view(np.uint64)
    bands = np.stack([t[c].to_numpy() for c in _BAND], axis=1)
    lanes = ((sig[:, :, None] >> np.arange(0, 64, BITS, dtype=np.uint64)) & np.uint64(2**BITS - 1)).astype(np.uint8).reshape(len(sig), -1)
    right = np.flatnonzero((side == 1) & ~is_centre)
    for i in np.flatnonzero((side == 0) & ~is_centre):
        some = right[(label[right] != label[i]) & (~minor[right] | (key[right] > key[i]))]
        some = some[100 * np.minimum(n[some], n[i]) >= similar * np.maximum(n[some], n[i])]
        some = some[(lanes[some] == lanes[i]).sum(axis=1) >= least]
        some = some[(bands[some] == bands[i]).argmax(axis=1) == band]
        if len(some):
            yield i, some


def _seek(t: pa.Table, similar: int) -> pa.Table:
    """The rows of a block that have a possible partner in it."""
    found = np.zeros(t.num_rows, bool)
    for i, some in _possible(t, least_agreement(similar), similar):
        found[i] = found[some] = True
    return t.select(_PLACE).filter(pa.array(found))


def _settle(t: pa.Table, similar: int) -> pa.Table:
    """Links of a block's possible pairs, on full sets; a pair that earlier links of this block have joined isn't looked at again."""
    key, label = t["key"].to_pylist(), t["label"].to_pylist()
    sets = [np.frombuffer(x, np.uint64) for x in t["set"].to_pylist()]
    root = {x: x for x in label}

    def top(x: bytes) -> bytes:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    links = []
    for i, some in _possible(t, least_agreement(similar), similar):
        for j in some:
            if top(label[i]) == top(label[j]):
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= similar * (len(sets[i]) + len(sets[j]) - both):
                root[top(label[i])] = top(label[j])
                links.append(sorted((key[i], key[j])))
    return pa.table([pa.array([x[k] for x in links], pa.binary()) for k in (0, 1)], names=["a", "b"])


_PLACE = ["bucket", "x", "y", "band", "centre", "key", "label", "side", "minor"]


def _left_over(buckets: DataFrame, labels: DataFrame, nodes: DataFrame, texts: DataFrame, similar: int) -> DataFrame | None:
    """Links between components that share a bucket; None if no bucket has several."""
    own = buckets.join(labels, buckets["key"] == labels["node"], "left").select("bucket", "band", "centre", "key", F.coalesce("label", "key").alias("label"))
    per = own.groupBy("bucket", "label").agg(F.count("*").alias("c"), _salts("key").alias("salts"))
    per = per.groupBy("bucket").agg(F.sum("c").alias("all"), F.max(F.struct("c", "label")).alias("big"), F.count("*").alias("labels"), F.bit_or("salts").alias("salts"))
    blocks, minors = (F.ceil(n / BLOCK).cast("int") for n in (F.col("all"), F.col("all") - F.col("big.c")))
    per = kept(per.filter((F.col("labels") > 1) & (F.col("all") > 2)).select("bucket", blocks.alias("blocks"), minors.alias("minors"), F.col("big.label").alias("big"), "salts"))
    if per.isEmpty():
        return None
    signed_ = nodes.select("key", "n", *_SIG, *_BAND)
    own = own.withColumn("salt", _salt("key")).join(_handed_out(per), ["bucket", "salt"]).withColumn("minor", F.col("label") != F.col("big"))
    own = kept(own.join(signed_, "key"))
    place = lambda count: F.pmod(F.xxhash64("key"), F.col(count)).cast("int")
    every = own.select("*", F.lit(1).alias("side"), place("blocks").alias("y"), F.explode(F.sequence(F.lit(0), F.col("minors") - 1)).alias("x"))
    minor = own.filter("minor").select("*", F.lit(0).alias("side"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("y"), place("minors").alias("x"))
    columns = [*_PLACE, "n", *_SIG, *_BAND]
    rows = every.select(*columns).union(minor.select(*columns))
    seek = lambda t: _seek(t, similar)
    found = kept(rows.groupBy("bucket", "x", "y").applyInArrow(seek, rows.select(*_PLACE).schema))
    sets = texts.join(found.select("key").distinct(), "key", "left_semi").mapInArrow(_sets, "key binary, set binary")
    found = found.groupBy("bucket", "band", "centre", "key", "label", "side", "minor").agg(F.collect_list(F.struct("x", "y")).alias("at"))
    found = found.join(signed_.join(sets, "key"), "key").withColumn("at", F.explode("at")).select("*", "at.x", "at.y").drop("at")
    settle = lambda t: _settle(t, similar)
    return kept(found.groupBy("bucket", "x", "y").applyInArrow(settle, "a binary, b binary"))


def classes(docs: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """doc_id, key, n_shingles, component_id, label: one row per row of ``docs``.

    ``label`` names the class (the key of one of its texts), ``component_id`` is its smallest doc_id; rows
    without an id have no say in it, and a class of such rows has none. A text without words is linked with
    nothing, not even with its like: its component_id is its own id. Repeated rows are in one class. An empty
    table gives no rows; other columns don't matter.
    """
    own = kept(signed(docs))
    nodes = own.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), _salts("doc_id").alias("salts"), *[F.min(c).alias(c) for c in ["n", *_SIG, *_BAND]])
    nodes = kept(nodes)
    bands = nodes.select("key", F.posexplode(F.array(*_BAND)).alias("band", "bucket"))
    shared = bands.groupBy("bucket").agg(F.min("key").alias("centre"), F.count("*").alias("c"), _salts("key").alias("salts")).filter("c > 1")
    buckets = kept(bands.withColumn("salt", _salt("key")).join(_handed_out(shared.drop("c")), ["bucket", "salt"]).drop("salt"))
    texts = kept(_texts(buckets.select("key").distinct(), nodes, own))
    stars = buckets.filter(F.col("key") != F.col("centre")).select(F.col("centre").alias("a"), F.col("key").alias("b")).distinct()
    edges, labels = _linked(kept(_likely(kept(stars), nodes, similar)), texts, similar)
    more = _left_over(buckets, labels, nodes, texts, similar)
    if more is not None and not more.isEmpty():
        labels = components(edges.union(more))
    named = kept(labels.join(nodes.select("key", "rep"), F.col("key") == F.col("node")).select("key", "rep", "label"))
    least = _handed_out(named.groupBy("label").agg(F.min("rep").alias("component_id"), _salts("key").alias("salts")))
    known = named.withColumn("salt", _salt("key")).join(least, ["label", "salt"]).select("key", "label", "component_id")
    known = nodes.select("key", "rep", "salts").join(known, "key", "left")
    known = _handed_out(known.select("key", "salts", F.coalesce("label", "key").alias("label"), F.when(F.col("label").isNull(), F.col("rep")).otherwise(F.col("component_id")).alias("component_id")))
    slim = own.select("doc_id", "key", F.col("n").alias("n_shingles"))
    linked = slim.filter("n_shingles > 0").withColumn("salt", _salt("doc_id")).join(kept(known), ["key", "salt"]).select("doc_id", "key", "n_shingles", "component_id", "label")
    return linked.union(slim.filter("n_shingles = 0").select("doc_id", "key", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("binary").alias("label")))


def one_of_each(docs: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """The rows of ``docs``, with their columns, that stay: of each class that with the smallest id (rows without
    an id last; of repeated rows one), and every text without words."""
    found = kept(classes(docs, similar))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    best = found.filter("n_shingles > 0").groupBy("label").agg(first.alias("f")).select(F.col("f.doc_id").alias("__id"), F.col("f.key").alias("__key"), F.lit(True).alias("__one"))
    empty = found.filter("n_shingles = 0").select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), F.lit(False).alias("__one")).distinct()
    stay = kept(best.union(empty))
    own = docs.select(F.struct("*").alias("row"), docs["doc_id"].cast("long").alias("__doc"), F.unhex(F.md5(F.coalesce(docs["text"], F.lit("")))).alias("__md5"))
    own = own.join(stay, (F.col("__md5") == F.col("__key")) & F.col("__doc").eqNullSafe(F.col("__id")))
    nth = F.row_number().over(W.partitionBy("__md5", "__doc").orderBy(F.lit(0)))
    return own.withColumn("__nth", nth).filter("NOT __one OR __nth = 1").select("row.*")


def op3_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    found = classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


OP3_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT x, y FROM p JOIN n AS i ON i.doc_id = x JOIN n AS j ON j.doc_id = y WHERE 100 * c >= 75 * (i.n + j.n - c)),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
m AS (SELECT x, min(least(x, y)) AS c FROM r GROUP BY x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, doc_id) AS component_id, doc_id = coalesce(c, doc_id) AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.x = doc_id
"""
