"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, results merged.

Equal vectors are one node that names its smallest ids (as many as a result can hold), so a vector that
a third of all rows share is one node and no hub. Nodes are dealt to shards of bounded size by hash; a task builds
a shard's graph and stores it as flat arrays in a folder of its own. Queries are written in blocks; a task opens one shard's graph where it
lies, once, and the blocks one after the other, so neither graphs nor queries are shuffled or copied. The shards' nearest are merged by a window. Graphs grow in batches: a batch is searched at once
in the graph so far, and among itself. Distances of results are computed anew in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  used as pa.compute
from pyarrow import fs
from pyarrow import parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import kept, shared_folder, table

#: Nodes of a shard, neighbours of a node (twice as many on the ground layer), widths of the beams, queries of a block, blocks that one task takes.
SHARD, LINKS, BUILD_WIDTH, SEARCH_WIDTH, BLOCK, BLOCKS = 8192, 16, 96, 160, 4096, 16
_BATCH, _AT_ONCE = 256, 4


def _far(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of x[b, k] from q[b]."""
    d = x - q[:, None, :]
    return np.einsum("bkd,bkd->bk", d, d)


class Graph:
    """links[l][node]: neighbours on layer l, -1 where there are fewer. Nodes of higher layers have the smaller numbers."""

    def __init__(self, vectors: np.ndarray, links: list[np.ndarray]):
        self.x, self.links = vectors, links

    def beam(self, q: np.ndarray, start: np.ndarray, layer: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, squared distances) of each query's ``width`` nearest that are found from ``start``, nearest first, -1 where fewer."""
        links, b = self.links[layer], len(q)
        seen = np.zeros((b, len(links)), bool)
        ids, far = np.full((b, width), -1), np.full((b, width), np.inf, np.float32)
        start = start[:, :width]
        here = np.where(start >= 0, _far(self.x[start], q), np.inf)
        order = np.argsort(here, axis=1)
        ids[:, : start.shape[1]], far[:, : start.shape[1]] = np.take_along_axis(start, order, 1), np.take_along_axis(here, order, 1)
        ids[~np.isfinite(far)] = -1
        seen[np.arange(b)[:, None], np.maximum(start, 0)] |= start >= 0
        done = ids < 0
        while True:
            rows = np.flatnonzero((~done).any(axis=1))
            if not len(rows):
                return ids, far
            pick = np.argsort(done[rows], axis=1, kind="stable")[:, :_AT_ONCE]
            open_ = ~np.take_along_axis(done[rows], pick, 1)
            done[rows[:, None], pick] = True
            near = links[np.maximum(ids[rows[:, None], pick], 0)]
            near = np.where(open_[:, :, None], near, -1).reshape(len(rows), -1)
            fresh = (near >= 0) & ~seen[rows[:, None], np.maximum(near, 0)]
            r, c = np.nonzero(fresh)
            at = near[r, c]
            seen[rows[r], at] = True
            gap = self.x[at] - q[rows[r]]
            dist = np.full(near.shape, np.inf, np.float32)
            dist[r, c] = np.einsum("kd,kd->k", gap, gap)
            near = np.where(fresh, near, -1)
            all_ids, all_far = np.concatenate([ids[rows], near], 1), np.concatenate([far[rows], dist], 1)
            all_done = np.concatenate([done[rows], ~fresh], 1)
            order = np.lexsort((all_ids, all_far), axis=1)
            all_ids, all_far, all_done = (np.take_along_axis(x, order, 1) for x in (all_ids, all_far, all_done))
            twice = np.zeros(all_ids.shape, bool)
            twice[:, 1:] = (all_ids[:, 1:] == all_ids[:, :-1]) & (all_ids[:, 1:] >= 0)
            if twice.any():
                all_far[twice], all_ids[twice], all_done[twice] = np.inf, -1, True
                order = np.argsort(all_far, axis=1, kind="stable")
                all_ids, all_far, all_done = (np.take_along_axis(x, order, 1) for x in (all_ids, all_far, all_done))
            ids[rows], far[rows], done[rows] = all_ids[:, :width], all_far[:, :width], all_done[:, :width]

    def descend(self, q: np.ndarray, layer: int) -> np.ndarray:
        """The nearest node found on the layers above ``layer``."""
        at = np.zeros((len(q), 1), np.int64)
        for above in range(len(self.links) - 1, layer, -1):
            if len(self.links[above]):
                at = self.beam(q, at, above, 1)[0]
        return at

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        return self.beam(q, self.descend(q, 0), 0, width)


def _choose(x: np.ndarray, q: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` of each row's candidates: those nearer to q than to any chosen one, nearest first; then the nearest of the rest."""
    far = np.where(ids >= 0, _far(x[np.maximum(ids, 0)], q), np.inf)
    order = np.argsort(far, axis=1, kind="stable")
    ids, far = np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)
    v = x[np.maximum(ids, 0)]
    norm = np.einsum("bkd,bkd->bk", v, v)
    apart = norm[:, :, None] + norm[:, None, :] - 2 * (v @ v.transpose(0, 2, 1))
    out, hidden, n = np.zeros(ids.shape, bool), ~np.isfinite(far), np.zeros(len(ids), int)
    for j in range(ids.shape[1]):
        take = ~hidden[:, j] & (n < most)
        out[:, j] = take
        n += take
        hidden |= take[:, None] & (apart[:, j] < far)
    rank = np.where(out, 0, 1) + 2 * ~np.isfinite(far)
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    found = np.take_along_axis(np.where(np.isfinite(far), ids, -1), order, 1)
    return np.pad(found, ((0, 0), (0, most - found.shape[1])), constant_values=-1)


def build(vectors: np.ndarray, links: int = LINKS, width: int = BUILD_WIDTH) -> tuple[Graph, np.ndarray]:
    """The graph, and the order in which it holds the vectors."""
    n = len(vectors)
    level = np.floor(-np.log(1 - np.random.default_rng(n).random(n)) / np.log(links)).astype(int)
    order = np.argsort(-level, kind="stable")
    level, x = level[order], np.ascontiguousarray(vectors[order], np.float32)
    sizes = [int((level >= k).sum()) for k in range(int(level.max(initial=0)) + 1)]
    full = [np.full((s, links * (1 if k else 2)), -1, np.int64) for k, s in enumerate(sizes)]
    at = 1
    while at < n:
        own = np.arange(at, min(n, at + min(_BATCH, at)))
        layers = range(int(level[own].max()), -1, -1)
        graph = Graph(x, [f[: min(at, len(f))] for f in full])  # before this batch
        found = {k: graph.beam(x[h], graph.descend(x[h], k), k, width)[0] for k in layers if sizes[k] and len(h := own[level[own] >= k]) and min(at, sizes[k])}
        for k in layers:
            here = own[level[own] >= k]
            q = x[here]
            among = np.einsum("id,id->i", q, q)[:, None] + np.einsum("id,id->i", q, q) - 2 * q @ q.T
            np.fill_diagonal(among, np.inf)
            near = here[np.argsort(among, axis=1)[:, : min(len(here) - 1, width // 2)]]
            if k in found:
                near = np.concatenate([found[k], near], 1)
            if not near.shape[1]:
                continue
            chosen = _choose(x, q, near, links)
            full[k][here, :links] = chosen
            u, v = np.repeat(here, links), chosen.ravel()
            u, v = u[v >= 0], v[v >= 0]
            sort = np.argsort(v, kind="stable")
            u, v = u[sort], v[sort]
            while len(v):  # each round takes up to ``links`` new neighbours of each node
                first = np.flatnonzero(np.diff(v, prepend=-1))
                place = np.arange(len(v)) - np.repeat(first, np.diff(np.append(first, len(v))))
                now = place < links
                to = v[first]
                extra = np.full((len(to), links), -1)
                extra[np.searchsorted(to, v[now]), place[now]] = u[now]
                both = np.concatenate([full[k][to], extra], 1)
                both = np.where((both[:, :, None] == both[:, None, :]).argmax(axis=2) == np.arange(both.shape[1]), both, -1)
                for part in range(0, len(to), 512):
                    s = slice(part, part + 512)
                    full[k][to[s]] = _choose(x, x[to[s]], both[s], full[k].shape[1])
                u, v = u[~now], v[~now]
        at = int(own[-1]) + 1
    return Graph(x, full), order


def _build(nodes: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = pa.Table.from_batches(list(nodes)).combine_chunks()
    if not t.num_rows:
        return
    original = np.array(t["vector"].to_pylist(), np.float64)
    graph, order = build(original.astype(np.float32))
    sizes = [list(f.shape) for f in graph.links]
    flat = np.concatenate([f.ravel() for f in graph.links]).astype(np.int32)
    ids = t["ids"].to_pylist()
    columns = [[t["shard"][0].as_py()], [original.shape[1]], [original[order].tobytes()], [[ids[i] for i in order]], [flat.tobytes()], [sizes]]
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.list_(pa.int64())), pa.binary(), pa.list_(pa.list_(pa.int32()))]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["shard", "dim", "vectors", "ids", "links", "sizes"])


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, vector (doubles) of the rows that take part: with an id and a vector that is finite, not zero, without nulls."""
    v = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.filter("vec_id IS NOT NULL AND vector IS NOT NULL").filter(~bad).filter(F.exists("vector", lambda x: x != 0))


def index(vectors: DataFrame, k: int) -> tuple[str, int]:
    """The folder with the graphs, for results of ``k`` rows, and the number of shards: ``shard=<n>`` holds a shard's graphs, one for each
    length of vectors (dim, vectors, ids, links, sizes)."""
    rows = vectors.distinct()
    nth = F.row_number().over(W.partitionBy("vector").orderBy("vec_id"))
    nodes = rows.withColumn("nth", nth).filter(F.col("nth") <= k + 1)  # a query's own row may be one of them
    nodes = kept(nodes.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    shards = max(1, -(-nodes.count() // SHARD))
    nodes = nodes.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int"))
    nodes = nodes.repartitionByRange(int(shards), "shard")  # a task for each: a build is too long to share one
    graphs = nodes.groupBy("shard", F.size("vector")).applyInArrow(_build, "shard int, dim int, vectors binary, ids array<array<long>>, links binary, sizes array<array<int>>")
    folder = shared_folder(vectors.sparkSession)
    graphs.write.partitionBy("shard").parquet(folder)
    return folder, int(shards)


def _part(folder: str, name: str) -> pa.Table | None:
    """What a written folder holds in one of its parts; None if there is no such part."""
    store, base = fs.FileSystem.from_uri(folder)
    files = store.get_file_info(fs.FileSelector(f"{base}/{name}", allow_not_found=True))
    tables = [pq.read_table(store.open_input_file(f.path)) for f in files if f.base_name.startswith("part-")]
    return pa.concat_tables(tables) if tables else None


def _opened(row: dict) -> tuple[Graph, np.ndarray, list]:
    """The graph of a stored row, its vectors in double precision, and the ids of each node."""
    original = np.frombuffer(row["vectors"]).reshape(-1, row["dim"])
    flat, links, at = np.frombuffer(row["links"], np.int32).astype(np.int64), [], 0
    for rows, most in row["sizes"]:
        links.append(flat[at : at + rows * most].reshape(rows, most))
        at += rows * most
    return Graph(original.astype(np.float32), links), original, row["ids"]


def _found(opened: tuple[Graph, np.ndarray, list], ids: np.ndarray, q: np.ndarray, k: int, width: int) -> tuple[list, list, list]:
    (graph, original, names), out = opened, ([], [], [])
    for part in range(0, len(q), 512):
        found, _ = graph.search(q[part : part + 512].astype(np.float32), max(width, 2 * k))
        for query, own, nodes in zip(ids[part : part + 512], q[part : part + 512], found, strict=True):
            nodes = nodes[nodes >= 0]
            far = np.sqrt(((original[nodes] - own) ** 2).sum(axis=1))
            best = sorted((d, v) for d, node in zip(far.tolist(), nodes, strict=True) for v in names[node] if v != query)[:k]
            out[0].extend([int(query)] * len(best))
            out[1].extend(v for _, v in best)
            out[2].extend(d for d, _ in best)
    return out


def _searched(pairs: Iterator[pa.RecordBatch], graphs: str, queries: str, k: int, width: int) -> Iterator[pa.RecordBatch]:
    shard, opened = None, {}
    for batch in pairs:
        for to, block in zip(batch.column("shard").to_pylist(), batch.column("block").to_pylist(), strict=True):
            if to != shard:
                held = _part(graphs, f"shard={to}")
                shard, opened = to, {r["dim"]: _opened(r) for r in (held.to_pylist() if held else ())}
            asked = _part(queries, f"block={block}")
            for dim in opened if asked else ():
                own = asked.filter(pa.compute.equal(asked["dim"], dim))
                if own.num_rows:
                    q = own["vector"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
                    out = _found(opened[dim], own["query_id"].to_numpy(), q, k, width)
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])


def search(graphs: tuple[str, int], queries: DataFrame, k: int, width: int = SEARCH_WIDTH) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` nearest found, nearest first, ties to the smaller id."""
    spark, (folder, shards) = queries.sparkSession, graphs
    blocks = max(1, -(-queries.count() // BLOCK))
    asked = queries.select(F.col("vec_id").alias("query_id"), "vector", F.size("vector").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
    written = shared_folder(spark)
    asked.repartition(F.col("block")).write.partitionBy("block").parquet(written)
    runs = -(-blocks // BLOCKS)  # a task for each shard and BLOCKS blocks: the graph is opened once for them
    pairs = spark.range(0, shards * runs, 1, shards * runs).select(F.expr(f"cast(id div {runs} as int)").alias("shard"), F.expr(f"explode(sequence(cast(id % {runs} * {BLOCKS} as int), cast(least((id % {runs} + 1) * {BLOCKS}, {blocks}) - 1 as int)))").alias("block"))
    found = pairs.mapInArrow(partial(_searched, graphs=folder, queries=written, k=k, width=width), "query_id long, vec_id long, score double")
    nth = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", nth).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """The ``k`` nearest of each row whose id is divisible by ``every``, among all other rows; see ``search``.

    Rows that are equal in id and vector count once; rows with one id and other vectors are one query each and
    never each other's answer. Vectors are compared with those of their own length. Without rows there is no result.
    """
    rows = kept(valid(vectors).distinct())
    return search(index(rows, k), rows.filter(F.col("vec_id") % every == 0), k)


def op9_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score."""
    return nearest(table(spark, sf_dir, "embeddings"))
