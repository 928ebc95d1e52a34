"""Approximate nearest neighbours by largest inner product, on robust-pruned graphs.

Vectors are dealt to shards of bounded size by a hash of their id. In each shard a directed
graph is built: points are inserted in batches, a greedy search from the entry point
proposes neighbours, and pruning with a relaxed distance keeps few and diverse edges. Each
query then runs a beam search in every shard, in blocks of bounded size, and the shards'
best are merged.

Largest inner product is turned into least distance by one more coordinate that gives all
vectors of a shard the same norm; results carry the product of the original vectors in
double precision.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filigree.llm.common import written

#: Vectors of a shard (about), least number of shards, and queries of a block.
SHARD_ROWS, SHARDS, BLOCK_ROWS = 4096, 8, 4096
#: Edges of a point, beam of insertion and of queries, and the relaxation of each pass.
DEGREE, BUILD_BEAM, QUERY_BEAM, RELAXED = 32, 64, 96, (1.0, 1.2)
#: Points inserted at once, and beam entries expanded at once.
BATCH, WIDTH = 256, 4


def equal_norms(vectors: np.ndarray) -> np.ndarray:
    """Vectors with one more coordinate, so that all have the largest norm among them."""
    squares = (vectors * vectors).sum(axis=1)
    rest = np.sqrt(np.maximum(squares.max(initial=0.0) - squares, 0.0))
    return np.concatenate([vectors, rest[:, None]], axis=1).astype(np.float32)


def _distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Squared distances from each row of `to` (b, d) to its candidates `points` (b, k, d)."""
    gap = points - to[:, None, :]
    return np.einsum("bkd,bkd->bk", gap, gap)


def beam_search(points: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and squared distances of the `beam` nearest found for every query; -1 fills up.

    All queries step together; each step expands the nearest entries of a beam that have
    not been expanded, until none is left.
    """
    b, n = len(queries), len(points)
    ids = np.full((b, beam), -1, np.int32)
    gaps = np.full((b, beam), np.inf, np.float32)
    done = np.zeros((b, beam), bool)
    seen = np.zeros((b, n + 1), bool)  # the last column stands for -1
    seen[:, n] = True
    ids[:, 0], seen[:, entry] = entry, True
    gaps[:, 0] = _distances(points[None, [entry]].repeat(b, axis=0), queries)[:, 0]
    live = np.arange(b)
    while len(live):
        open_gaps = np.where(done[live] | (ids[live] < 0), np.inf, gaps[live])
        picks = np.argsort(open_gaps, axis=1, kind="stable")[:, :WIDTH]
        usable = np.isfinite(np.take_along_axis(open_gaps, picks, 1))
        keep = usable.any(axis=1)
        live, picks, usable = live[keep], picks[keep], usable[keep]
        if not len(live):
            break
        flags = done[live]
        np.put_along_axis(flags, picks, np.take_along_axis(flags, picks, 1) | usable, 1)
        done[live] = flags
        from_ = np.where(usable, np.take_along_axis(ids[live], picks, 1), -1)
        found = np.where(from_[:, :, None] >= 0, graph[from_], -1).reshape(len(live), -1)
        found = np.sort(found, axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        found[seen[live[:, None], found]] = -1
        seen[live[:, None], found] = True
        seen[:, n] = True
        gap = np.where(found >= 0, _distances(points[found], queries[live]), np.inf).astype(np.float32)
        all_ids = np.concatenate([ids[live], found], axis=1)
        all_gaps = np.concatenate([gaps[live], gap], axis=1)
        all_done = np.concatenate([done[live], np.zeros(found.shape, bool)], axis=1)
        order = np.argsort(all_gaps, axis=1, kind="stable")[:, :beam]
        ids[live] = np.take_along_axis(all_ids, order, 1)
        gaps[live] = np.take_along_axis(all_gaps, order, 1)
        done[live] = np.take_along_axis(all_done, order, 1)
    return ids, gaps


def robust_prune(points: np.ndarray, of: np.ndarray, candidates: np.ndarray, relaxed: float) -> np.ndarray:
    """At most `DEGREE` of the candidates (-1 fills up) of each point in `of`.

    The nearest is taken, and with it go all that are nearer to it, by the factor
    `relaxed`, than to the point; and so on with what is left.
    """
    candidates = np.sort(np.where(candidates == of[:, None], -1, candidates), axis=1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
    here = points[candidates]
    gap = np.where(candidates >= 0, _distances(here, points[of]), np.inf)
    order = np.argsort(gap, axis=1, kind="stable")
    candidates, gap = np.take_along_axis(candidates, order, 1), np.take_along_axis(gap, order, 1)
    here = np.take_along_axis(here, order[:, :, None], 1)
    out = np.full((len(of), DEGREE), -1, np.int32)
    alive = np.isfinite(gap)
    row = np.arange(len(of))
    for slot in range(DEGREE):
        if not alive.any():
            break
        first = alive.argmax(axis=1)
        has = alive[row, first]
        out[has, slot] = candidates[has, first[has]]
        between = _distances(here, here[row, first])
        alive &= ~has[:, None] | (relaxed * relaxed * between > gap)
        alive[row, first] = False
    return out


def build_graph(points: np.ndarray, seed: int = 5) -> tuple[np.ndarray, int]:
    """Edges (n, DEGREE) and the entry point, the one nearest to the mean."""
    n = len(points)
    rng = np.random.default_rng(seed)
    entry = int(_distances(points[None], points.mean(axis=0, keepdims=True))[0].argmin())
    graph = np.full((n, DEGREE), -1, np.int32)
    if n > 1:
        start = rng.integers(0, n - 1, (n, min(8, n - 1)))
        graph[:, : start.shape[1]] = start + (start >= np.arange(n)[:, None])
    for relaxed in RELAXED:
        order = rng.permutation(n)
        for begin in range(0, n, BATCH):
            batch = order[begin : begin + BATCH]
            found, _ = beam_search(points, graph, entry, points[batch], BUILD_BEAM)
            graph[batch] = robust_prune(points, batch, np.concatenate([found, graph[batch]], axis=1), relaxed)
            tail, head = np.nonzero(graph[batch] >= 0)
            into, from_ = graph[batch][tail, head], batch[tail]
            by = np.argsort(into, kind="stable")
            into, from_ = into[by], from_[by]
            nodes, first, count = np.unique(into, return_index=True, return_counts=True)
            more = np.full((len(nodes), count.max(initial=0)), -1, np.int64)
            more[np.repeat(np.arange(len(nodes)), count), np.arange(len(into)) - np.repeat(first, count)] = from_
            every = np.sort(np.concatenate([graph[nodes], more], axis=1), axis=1)
            every[:, 1:][every[:, 1:] == every[:, :-1]] = -1
            fits = (every >= 0).sum(axis=1) <= DEGREE
            graph[nodes[fits]] = np.sort(every[fits], axis=1)[:, -DEGREE:]
            for part in np.array_split(np.flatnonzero(~fits), max(1, -(-int((~fits).sum()) // BATCH))):
                if len(part):
                    graph[nodes[part]] = robust_prune(points, nodes[part], every[part], relaxed)
    return graph, entry


INDEX_FIELDS = "shard int, entry int, size int, owner binary, ids binary, vectors binary, graph binary"


def _build(frame: pd.DataFrame) -> pd.DataFrame:
    """The index of one shard, over its different vectors; `owner` gives each id its vector."""
    vectors = np.stack(frame["embedding"].to_numpy()).astype(np.float64)
    different, owner = np.unique(vectors, axis=0, return_inverse=True)
    graph, entry = build_graph(equal_norms(different))
    ids = frame["vec_id"].to_numpy().astype(np.int64)
    by = np.lexsort((ids, owner.reshape(-1)))
    return pd.DataFrame(
        {
            "shard": [int(frame["shard"].iloc[0])],
            "entry": [entry],
            "size": [vectors.shape[1]],
            "owner": [owner.reshape(-1)[by].astype(np.int32).tobytes()],
            "ids": [ids[by].tobytes()],
            "vectors": [different.tobytes()],
            "graph": [graph.tobytes()],
        }
    )


def _pack(frame: pd.DataFrame) -> pd.DataFrame:
    vectors = np.stack(frame["embedding"].to_numpy()).astype(np.float64)
    return pd.DataFrame(
        {
            "block": [int(frame["block"].iloc[0])],
            "query_ids": [frame["vec_id"].to_numpy().astype(np.int64).tobytes()],
            "queries": [vectors.tobytes()],
        }
    )


def _search(k: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                size = row["size"]
                vectors = np.frombuffer(row["vectors"]).reshape(-1, size)
                queries = np.frombuffer(row["queries"]).reshape(-1, size)
                query_ids, ids = np.frombuffer(row["query_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
                owner = np.frombuffer(row["owner"], np.int32)
                starts = np.searchsorted(owner, np.arange(len(vectors) + 1))
                graph = np.frombuffer(row["graph"], np.int32).reshape(-1, DEGREE)
                points = equal_norms(vectors)
                flat = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1).astype(np.float32)
                beam = min(max(QUERY_BEAM, 2 * k), len(vectors))
                for begin in range(0, len(queries), BATCH):
                    found, _ = beam_search(points, graph, row["entry"], flat[begin : begin + BATCH], beam)
                    out: list[tuple[int, int, float]] = []
                    for q, hits in enumerate(found, begin):
                        hits = hits[hits >= 0]
                        score = (vectors[hits] * queries[q]).sum(axis=1)
                        # each vector's least k + 1 ids are all that can be among its nearest k
                        mine = [(s, i) for s, h in zip(score.tolist(), hits.tolist()) for i in ids[starts[h] : min(starts[h + 1], starts[h] + k + 1)].tolist()]
                        mine = sorted((-s, i) for s, i in mine if i != query_ids[q])[:k]
                        out += [(int(query_ids[q]), i, -s) for s, i in mine]
                    if out:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64()))],
                            names=["query_id", "vec_id", "score"],
                        )

    return run


def usable_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part.

    Left out: null ids, vectors that are null, empty, zero or hold a null or non-finite
    component, and those whose size is not the commonest one. Of rows that repeat a vec_id,
    the one with the least vector counts.
    """
    doubles = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = doubles.where(F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False)))
    common = good.groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    return good.where(F.size("embedding") == (common["n"] if common else 0))


def build_index(vectors: DataFrame, n_shards: int) -> DataFrame:
    """One row per shard with its vectors and graph; the shard is bounded, so is the row."""
    sharded = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(n_shards)).cast("int"))
    return sharded.repartition(2 * n_shards, "shard").groupBy("shard").applyInPandas(_build, INDEX_FIELDS)


def nearest(embeddings: DataFrame, k: int, query_every: int) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of each vec_id divisible by `query_every`."""
    vectors = usable_vectors(embeddings).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    vectors = written(vectors, "vectors")
    n_shards = max(SHARDS, -(-vectors.count() // SHARD_ROWS))
    index = written(build_index(vectors, n_shards), "graphs")
    queries = vectors.where(F.col("vec_id") % query_every == 0)
    n_blocks = max(1, -(-queries.count() // BLOCK_ROWS))
    blocks = queries.withColumn("block", F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(n_blocks)).cast("int"))
    packed = blocks.groupBy("block").applyInPandas(_pack, "block int, query_ids binary, queries binary")
    packed = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    paired = index.join(packed, "shard").repartition(2 * n_shards, "shard", "block")
    found = paired.mapInArrow(_search(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
