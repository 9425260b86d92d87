"""Vector code compression: a codebook for each part of a vector, learned in whole numbers, with equal-average search.

Components become integers once, natively, in a written table; each round is one pass over it. A task finds the nearest entry of
every part and returns sums and counts per entry, which Spark adds up; the driver holds the codebooks only (PARTS x ENTRIES
entries). The search uses that the squared gap between the sums of two parts, over their dimension, is never above their
squared distance: a codebook's entries are sorted by sum, and a part looks outward from its own sum, nearest sum first,
until the squared gap over the dimension is strictly above its best distance. What is left out can't win and can't tie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, table

#: Parts of a vector, entries of a part's codebook, rounds of learning, steps of one unit.
PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Parts that are searched at once; rows among which a label's rows are dealt when its sum is joined to them.
AT_ONCE, SALT = 8192, 32


class Codebook:
    """The entries of one part, sorted by the sum of their components."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.order = np.argsort(entries.sum(axis=1), kind="stable")
        self.sorted = entries[self.order]
        self.sums = self.sorted.sum(axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Of each row: the nearest entry (ties to the lower index) and its squared distance; and how many distances were computed."""
        n, k, dim = len(x), len(self.sums), x.shape[1]
        best, at, looked = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64), 0
        sums, rows = x.sum(axis=1), np.arange(n)
        above = np.searchsorted(self.sums, sums)
        below = above - 1
        far = np.iinfo(np.int64).max
        while len(rows):
            low, high, own = below[rows], above[rows], sums[rows]
            to_low = np.where(low >= 0, own - self.sums[np.maximum(low, 0)], far)
            to_high = np.where(high < k, self.sums[np.minimum(high, k - 1)] - own, far)
            down = to_low <= to_high
            gap = np.where(down, to_low, to_high)
            go = gap != far
            go[go] = gap[go] ** 2 <= np.minimum(best[rows[go]], far // max(dim, 1)) * dim  # both nearest sums are beyond: so are all others
            rows, down, pick = rows[go], down[go], np.where(down, low, high)[go]
            if not len(rows):
                break
            d = x[rows] - self.sorted[pick]
            d = np.einsum("rd,rd->r", d, d)
            entry = self.order[pick]
            won = (d < best[rows]) | ((d == best[rows]) & (entry < at[rows]))
            best[rows[won]], at[rows[won]] = d[won], entry[won]
            below[rows] -= down
            above[rows] += ~down
            looked += len(rows)
        return at, best, looked


def cuts(dim: int, parts: int = PARTS) -> list[int]:
    """Bounds of the parts: equal ones, the first ones longer by one if ``dim`` can't be divided."""
    return np.cumsum([0] + [dim // parts + (p < dim % parts) for p in range(parts)]).tolist()


def integers(vectors: DataFrame, carry: list[str], column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """The carried columns and ``part``: floor(scale * x) of every component, of rows whose vector is neither null nor holds a null or non-finite component."""
    v = vectors[column].cast("array<double>")
    bad = F.exists("part", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(*[vectors[c].alias(c) for c in carry], v.alias("part")).filter("part IS NOT NULL").filter(~F.coalesce(bad, F.lit(True)))
    return rows.withColumn("part", F.transform("part", lambda x: F.floor(x * float(scale))))


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``dim`` components, as an array, and which rows they are."""
    sizes = np.diff(column.offsets.to_numpy())
    rows = np.flatnonzero(sizes == dim)
    values = column.flatten().to_numpy()
    if len(rows) != len(sizes):
        values = values[np.repeat(sizes == dim, sizes)]
    return values.reshape(len(rows), dim), rows


def _assigned(x: np.ndarray, books: list[Codebook], bounds: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of each part of each row."""
    at, far = np.zeros((len(x), len(books)), np.int64), np.zeros((len(x), len(books)), np.int64)
    for first in range(0, len(x), AT_ONCE):
        rows = slice(first, first + AT_ONCE)
        for p, book in enumerate(books):
            at[rows, p], far[rows, p], _ = book.nearest(np.ascontiguousarray(x[rows, bounds[p] : bounds[p + 1]]))
    return at, far


def _tally(rows: Iterator[pa.RecordBatch], books: list[Codebook], bounds: list[int]) -> Iterator[pa.RecordBatch]:
    """Sums and counts of what each entry got: a row per part and entry that got any."""
    k, dim = len(books[0].entries), bounds[-1]
    sums, n = np.zeros((k, dim), np.int64), np.zeros((len(books), k), np.int64)
    for batch in rows:
        x, _ = _matrix(batch.column("part"), dim)
        at, _ = _assigned(x, books, bounds)
        for p in range(len(books)):
            n[p] += np.bincount(at[:, p], minlength=k)
            np.add.at(sums[:, bounds[p] : bounds[p + 1]], at[:, p], x[:, bounds[p] : bounds[p + 1]])
    part, entry = np.nonzero(n)
    place = [np.arange(bounds[p], bounds[p + 1]) for p in part]
    width = [len(x) for x in place]
    place = np.concatenate(place) if place else np.zeros(0, np.int64)
    of, count = np.repeat(entry, width), np.repeat(n[part, entry], width)
    yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(of, pa.int64()), pa.array(sums[of, place], pa.int64()), pa.array(count, pa.int64())], ["place", "entry", "total", "n"])


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[Codebook]:
    """The codebooks of ``integers`` rows (vec_id, part), which are read once in each round: give a written table.

    Entries start as the parts of the rows with the smallest vec_ids (null ones last; repeated ids in order of their vectors);
    with fewer rows there are fewer. In each round an entry becomes the floored mean of the parts that it is nearest to;
    unused ones stay. Vectors of another length than the first row's don't count. No rows: no codebooks.
    Squared distances have to fit into 63 bits, else ValueError.
    """
    first = [r["part"] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "part").limit(entries).collect()]
    if not first:
        return []
    dim = len(first[0])
    bounds = cuts(dim, parts)
    own = rows.filter(F.size("part") == dim)
    largest = own.agg(F.max(F.greatest(F.abs(F.array_max("part")), F.abs(F.array_min("part")))).alias("m")).first()["m"] if dim else 0
    if (bounds[1] * 2 * int(largest or 0)) ** 2 >= 1 << 62 or dim * (2 * int(largest or 0)) ** 2 >= 1 << 62:
        raise ValueError(f"components as large as {largest} in {dim} dimensions: squared distances wouldn't fit into 63 bits")
    first = np.array([x for x in first if len(x) == dim], np.int64).reshape(-1, dim)
    now = [first[:, bounds[p] : bounds[p + 1]] for p in range(parts)]
    for _ in range(rounds):
        books = [Codebook(x) for x in now]
        tallies = own.select("part").mapInArrow(partial(_tally, books=books, bounds=bounds), "place long, entry long, total long, n long")
        got = tallies.groupBy("place", "entry").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()  # at most a row per component of the codebooks
        flat = np.concatenate(now, axis=1).copy()
        for r in got:
            flat[r["entry"], r["place"]] = r["total"] // r["n"]
        now = [flat[:, bounds[p] : bounds[p + 1]] for p in range(parts)]
    return [Codebook(x) for x in now]


def _encoded(rows: Iterator[pa.RecordBatch], books: list[Codebook], bounds: list[int]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        x, own = _matrix(batch.column("part"), bounds[-1])
        at, far = _assigned(x, books, bounds)
        codes, errors = [None] * batch.num_rows, [None] * batch.num_rows
        for r, code, error in zip(own.tolist(), at.astype(np.uint8), far.sum(axis=1).tolist(), strict=True):
            codes[r], errors[r] = code.tobytes(), error
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(codes, pa.binary()), pa.array(errors, pa.int64())], ["row", "code", "error"])


def encode(rows: DataFrame, books: list[Codebook]) -> DataFrame:
    """Columns of ``rows`` but ``part``, and code (a byte per part: the entry's index), error (squared distances, summed). Up to 256 entries a part.

    Vectors of another length than the codebooks' have a null code and error.
    """
    bounds = np.cumsum([0] + [b.entries.shape[1] for b in books]).tolist() if books else [0]
    slim = rows.select(F.struct(*[c for c in rows.columns if c != "part"]).alias("row"), "part")
    schema = slim.drop("part").withColumns({"code": F.lit(None).cast("binary"), "error": F.lit(None).cast("long")}).schema
    out = slim.mapInArrow(partial(_encoded, books=books, bounds=bounds), schema) if books else slim.select("row", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"))
    return out.select("row.*", "code", "error")


def _decoded(rows: Iterator[pa.RecordBatch], books: list[Codebook], scale: int) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        vectors = [None if c is None else np.concatenate([b.entries[k] for b, k in zip(books, c, strict=True)]) / scale for c in batch.column("code").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(vectors, pa.list_(pa.float64()))], ["row", "vector"])


def decode(codes: DataFrame, books: list[Codebook], scale: int = SCALE) -> DataFrame:
    """Columns of ``codes`` but ``code``, and ``vector``: the entries that a code names, one after the other, in the units before scaling."""
    slim = codes.select(F.struct(*[c for c in codes.columns if c != "code"]).alias("row"), "code")
    schema = slim.drop("code").withColumn("vector", F.lit(None).cast("array<double>")).schema
    return slim.mapInArrow(partial(_decoded, books=books, scale=scale), schema).select("row.*", "vector")


def digest(books: list[Codebook]) -> str:
    """SHA-256 of all components, decimal, by part, entry and position, with commas between."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.entries.ravel().tolist()).encode()).hexdigest()


def by_label(rows: DataFrame) -> DataFrame:
    """``rows`` (label, error, others) with label_error: the errors of the rows of its label, summed; null labels are one.

    A label's sum stands in SALT rows, and its own rows are dealt among them: no label is one task's work.
    """
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    sums = sums.select(F.col("label").alias("__label"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("__salt"))
    dealt = rows.withColumn("__dealt", F.pmod(F.monotonically_increasing_id(), F.lit(SALT)).cast("int"))
    return dealt.join(sums, F.col("label").eqNullSafe(F.col("__label")) & (F.col("__dealt") == F.col("__salt"))).drop("__label", "__salt", "__dealt")


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error, codebooks_sha256 of every row with a whole finite vector.

    Repeated rows stay; null ids and labels too. Vectors of another length than the first one's have no code and no error. An empty table gives no rows.
    """
    rows = kept(integers(table(spark, sf_dir, "embeddings"), ["vec_id", "label"]))
    books = fit(rows)
    coded = kept(encode(rows, books))
    return by_label(coded).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    cross = "SELECT p.r, p.part, c.entry, list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - c.v[i]) * (p.v[i] - c.v[i])))::BIGINT AS d FROM p JOIN c{k} c USING (part)"
    nearest = "SELECT r, part, entry, d FROM (SELECT *, row_number() OVER (PARTITION BY r, part ORDER BY d, entry) AS nth FROM ({cross})) WHERE nth = 1"
    rounds = []
    for k in range(ROUNDS):
        rounds.append(f"""a{k} AS MATERIALIZED ({nearest.format(cross=cross.format(k=k))}),
m{k} AS (SELECT part, entry, list(mean ORDER BY i) AS v FROM (SELECT part, entry, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*))::BIGINT // count(*) AS mean
     FROM (SELECT part, entry, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM p JOIN a{k} USING (r, part)) GROUP BY part, entry, i) GROUP BY part, entry),
c{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{k}.v, c{k}.v) AS v FROM c{k} LEFT JOIN m{k} USING (part, entry))""")
    return f"""
WITH e AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, part, list_slice(q, part * len(q) // {PARTS} + 1, (part + 1) * len(q) // {PARTS}) AS v FROM (SELECT r, q, unnest(range({PARTS})) AS part FROM e)),
c0 AS (SELECT part, r AS entry, v FROM p WHERE r < {ENTRIES}),
{", ".join(rounds)},
f AS MATERIALIZED ({nearest.format(cross=cross.format(k=ROUNDS))}),
s AS (SELECT sha256(string_agg(x, ',' ORDER BY part, entry, i)) AS h FROM (SELECT part, entry, unnest(range(len(v))) AS i, CAST(unnest(v) AS VARCHAR) AS x FROM c{ROUNDS})),
o AS (SELECT r, string_agg(lower(lpad(to_hex(entry), 2, '0')), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM f GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM o JOIN e USING (r), s
"""


OP11_SQL = _sql()
