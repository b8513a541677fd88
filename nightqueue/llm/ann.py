"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Equal vectors fall together first (each keeps its smallest ids, one more than are asked for), so a hot
vector is one node and ties among its copies are exact. Distinct vectors are dealt to shards of about
`shard_rows` by a hash. A shard's graph is stored as flat neighbour arrays, one per level, in a row of
a written table. Queries go in blocks to every shard; a task walks all queries of a block through the
graph in step, with numpy. Shard results are scored again in double precision and merged.

Vectors that are null, empty, zero, of another length than the longest, or hold null or non-finite
components take no part, neither as queries nor as candidates. Ties go to the smaller id. Repeated
ids are candidates as often as they stand. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .store import saved

LINKS = 16
BUILD_BEAM = 64
BEAM = 200
#: Candidates that every query expands in one step.
STRIDE = 4
#: Bytes of a shard's vectors at most, and of the marks of nodes that a walk has seen.
SHARD_BYTES = 256 << 20
SEEN_BYTES = 64 << 20


class Graph:
    """levels: for each level a matrix of neighbours by node (-1: none); nodes are in order of insertion."""

    def __init__(self, vectors: np.ndarray, seed: int = 11, levels: list[np.ndarray] | None = None, entry: int = 0):
        self.x, self.entry = vectors, entry
        if levels is not None:
            self.levels = levels
            return
        n = len(vectors)
        rng = np.random.default_rng(seed)
        height = np.minimum((-np.log(1 - rng.random(n)) / math.log(LINKS)).astype(int), 6) if n else np.zeros(0, int)
        self.levels = [np.full((n, LINKS * (2 if k == 0 else 1)), -1, np.int32) for k in range(int(height.max(initial=0)) + 1)]
        top, done = -1, 0
        while done < n:
            # batches double until they hold 512 nodes
            batch = np.arange(done, min(n, done + max(1, min(512, done))))
            self._insert(batch, height[batch], top)
            for i in batch:
                if height[i] > top:
                    top, self.entry = int(height[i]), int(i)
            done = int(batch[-1]) + 1

    def _insert(self, batch: np.ndarray, height: np.ndarray, top: int) -> None:
        q = self.x[batch]
        at = np.full((len(batch), 1), self.entry, np.int32)
        mates = q @ q.T
        for level in range(max(top, int(height.max())), -1, -1):
            here = height >= level
            if level <= top:
                ids, scores = self.walk(q, at, level, BUILD_BEAM if here.any() else 1)
                at = ids[:, :1].copy()
            else:
                ids, scores = np.full((len(batch), 1), -1, np.int32), np.full((len(batch), 1), -np.inf, np.float32)
            rows = np.flatnonzero(here)
            if not len(rows):
                continue
            own = np.where(here[None, :] & ~np.eye(len(batch), dtype=bool)[rows], mates[rows], -np.inf)
            few = np.argsort(-own, 1)[:, : LINKS * 2]
            all_ids = np.concatenate([ids[rows], np.where(np.isfinite(np.take_along_axis(own, few, 1)), batch[few], -1)], 1).astype(np.int32)
            all_scores = np.concatenate([scores[rows], np.take_along_axis(own, few, 1)], 1)
            chosen = self._diverse(all_ids, all_scores, LINKS)
            table = self.levels[level]
            table[batch[rows], :LINKS] = chosen
            source = np.repeat(batch[rows], LINKS)
            target = chosen.ravel()
            source, target = source[target >= 0], target[target >= 0]
            self._link_back(level, target, source)

    def _diverse(self, ids: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
        """Per row up to `most` candidates, best first, leaving out those nearer to one chosen than to the node; then the best of the rest."""
        order = np.argsort(-scores, 1, kind="stable")[:, : 4 * most]
        ids, scores = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)
        n, width = ids.shape
        vec = self.x[np.maximum(ids, 0)]
        among = np.matmul(vec, vec.transpose(0, 2, 1))
        taken = np.zeros((n, width), bool)
        count = np.zeros(n, int)
        for j in range(width):
            hidden = (taken & (among[:, j, :] > scores[:, j, None])).any(1)
            take = (ids[:, j] >= 0) & np.isfinite(scores[:, j]) & ~hidden & (count < most)
            taken[:, j] = take
            count += take
        rank = np.where(taken, 0, 1) + np.where((ids < 0) | ~np.isfinite(scores), 2, 0)
        first = np.argsort(rank, 1, kind="stable")[:, :most]
        out = np.where(np.take_along_axis(rank, first, 1) < 2, np.take_along_axis(ids, first, 1), -1)
        return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1).astype(np.int32)

    def _link_back(self, level: int, target: np.ndarray, source: np.ndarray) -> None:
        table = self.levels[level]
        width = table.shape[1]
        order = np.argsort(target, kind="stable")
        nodes, first, counts = np.unique(target[order], return_index=True, return_counts=True)
        most = int(counts.max(initial=0))
        if not most:
            return
        new = np.full((len(nodes), most), -1, np.int32)
        row = np.repeat(np.arange(len(nodes)), counts)
        new[row, np.arange(len(order)) - np.repeat(first, counts)] = source[order]
        both = np.sort(np.concatenate([table[nodes], new], 1), 1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        free = (both >= 0).sum(1) <= width
        kept = np.argsort(both < 0, 1, kind="stable")[:, :width]
        table[nodes[free]] = np.take_along_axis(both, kept, 1)[free]
        if not free.all():
            full, ids = nodes[~free], both[~free]
            score = np.where(ids >= 0, np.einsum("nkd,nd->nk", self.x[np.maximum(ids, 0)], self.x[full]), -np.inf)
            table[full] = self._diverse(ids, score, width)

    def walk(self, q: np.ndarray, at: np.ndarray, level: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of all queries in step: up to `beam` ids and inner products each, best first."""
        n, m, table = len(self.x), len(q), self.levels[level]
        seen = np.zeros((m, n + 1), bool)
        ids = np.full((m, beam), -1, np.int32)
        scores = np.full((m, beam), -np.inf, np.float32)
        width = min(beam, at.shape[1])
        ids[:, :width] = at[:, :width]
        scores[:, :width] = np.einsum("qkd,qd->qk", self.x[ids[:, :width]], q)
        np.put_along_axis(seen, ids[:, :width].astype(np.int64), True, 1)
        opened = np.zeros((m, beam), bool)
        stride = min(STRIDE, beam)
        live = np.arange(m)
        while len(live):
            own_scores, own_ids, own_open = scores[live], ids[live], opened[live]
            able = ~own_open & (own_ids >= 0)
            live_now = able.any(1)
            live = live[live_now]
            if not len(live):
                break
            own_scores, own_ids, own_open, able = own_scores[live_now], own_ids[live_now], own_open[live_now], able[live_now]
            pick = np.argsort(~able, 1, kind="stable")[:, :stride]
            valid = np.take_along_axis(able, pick, 1)
            np.put_along_axis(own_open, pick, True, 1)
            around = np.where(valid[:, :, None], table[np.maximum(np.take_along_axis(own_ids, pick, 1), 0)], -1).reshape(len(live), -1)
            known = seen[live[:, None], around] | (around < 0)
            around = np.where(known, -1, around)
            around = np.sort(around, 1)
            around[:, 1:][around[:, 1:] == around[:, :-1]] = -1
            keep = int((around >= 0).sum(1).max())
            around = -np.sort(-around, 1)[:, :keep]
            seen[live[:, None], around] = True
            seen[:, n] = False
            near = np.where(around >= 0, np.einsum("qkd,qd->qk", self.x[np.maximum(around, 0)], q[live]), -np.inf).astype(np.float32)
            all_scores = np.concatenate([own_scores, near], 1)
            best = np.argsort(-all_scores, 1, kind="stable")[:, :beam]
            scores[live] = np.take_along_axis(all_scores, best, 1)
            ids[live] = np.take_along_axis(np.concatenate([own_ids, around], 1), best, 1)
            opened[live] = np.take_along_axis(np.concatenate([own_open, np.zeros_like(around, bool)], 1), best, 1)
        return ids, scores

    def search(self, q: np.ndarray, k: int, beam: int = BEAM) -> np.ndarray:
        """The ids of up to k near nodes of each query (-1: none)."""
        at = np.full((len(q), 1), self.entry, np.int32)
        for level in range(len(self.levels) - 1, 0, -1):
            at = self.walk(q, at, level, 4)[0][:, :1]
        return self.walk(q, at, 0, max(beam, k))[0][:, :k]


INDEX = "shard int, size int, entry int, ids binary, vectors binary, levels array<binary>"


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id and v (doubles) of the rows that take part."""
    v = F.col("v")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(~bad & F.exists(v, lambda x: x != 0))
    longest = rows.agg(F.max(F.size("v"))).first()[0]
    return rows.where(F.size("v") == (longest or 0))


def distinct_vectors(rows: DataFrame, copies: int) -> DataFrame:
    """node (smallest id), v, members: the `copies` smallest ids of each distinct vector."""
    order = Window.partitionBy("v").orderBy("id")
    first = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= copies)
    return first.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("members")).select(F.col("members")[0].alias("node"), "v", "members")


def build(nodes: DataFrame, shards: int) -> DataFrame:
    """One row per shard: its ids, vectors and flat neighbour arrays."""

    def one(table: pa.Table) -> pa.Table:
        ids = table.column("node").to_numpy()
        flat = table.column("v").combine_chunks()
        x = flat.values.to_numpy(zero_copy_only=False)[flat.offsets[0].as_py() :].reshape(len(ids), -1)
        order = np.argsort(ids, kind="stable")
        order = order[np.random.default_rng(3).permutation(len(order))]
        ids, x = ids[order], x[order]
        g = Graph(x.astype(np.float32))
        return pa.table({
            "shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "size": pa.array([len(ids)], pa.int32()), "entry": pa.array([g.entry], pa.int32()),
            "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()), "vectors": pa.array([x.astype("<f8").tobytes()], pa.binary()), "levels": pa.array([[t.tobytes() for t in g.levels]], pa.list_(pa.binary())),
        })

    dealt = nodes.select("node", "v", F.pmod(F.xxhash64("v", F.lit(5)), F.lit(shards)).cast("int").alias("shard"))
    return dealt.groupBy("shard").applyInArrow(one, INDEX)


def rows_of_shards(nodes: int, length: int) -> int:
    """Vectors of a shard: 32 times the square root of all, at least 8192, in at most SHARD_BYTES."""
    return min(max(8192, 32 * math.isqrt(nodes)), max(1, SHARD_BYTES // (8 * max(1, length))))


def search(index: DataFrame, shards: int, blocks: DataFrame, k: int, beam: int) -> DataFrame:
    """query_id, node, score: the k best nodes of every shard for every query."""

    def body(batches):
        for batch in batches:
            for row in batch.to_pylist():
                size = row["size"]
                ids = np.frombuffer(row["ids"], "<i8")
                x = np.frombuffer(row["vectors"], "<f8").reshape(size, -1)
                g = Graph(x.astype(np.float32), levels=[np.frombuffer(t, np.int32).reshape(size, -1) for t in row["levels"]], entry=row["entry"])
                queries = np.frombuffer(row["query_ids"], "<i8")
                q = np.frombuffer(row["query_vectors"], "<f8").reshape(len(queries), -1)
                step = max(1, min(512, SEEN_BYTES // (size + 1)))
                for lo in range(0, len(queries), step):
                    part = q[lo : lo + step]
                    found = g.search(part.astype(np.float32), k, beam)
                    score = np.einsum("qkd,qd->qk", x[np.maximum(found, 0)], part)
                    r, c = np.nonzero(found >= 0)
                    yield pa.RecordBatch.from_arrays([pa.array(queries[lo + r]), pa.array(ids[found[r, c]]), pa.array(score[r, c])], names=["query_id", "node", "score"])

    pairs = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    met = pairs.join(index, "shard").select("size", "entry", "ids", "vectors", "levels", "query_ids", "query_vectors")
    return met.mapInArrow(body, "query_id long, node long, score double")


def query_blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    """Queries packed into blocks of about `block_rows`."""
    total = rows.count()
    n = max(1, math.ceil(total / block_rows))

    def one(table: pa.Table) -> pa.Table:
        flat = table.column("v").combine_chunks()
        x = flat.values.to_numpy(zero_copy_only=False)[flat.offsets[0].as_py() :]
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "query_ids": pa.array([table.column("id").to_numpy().astype("<i8").tobytes()], pa.binary()), "query_vectors": pa.array([x.astype("<f8").tobytes()], pa.binary())})

    dealt = rows.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("block"))
    return dealt.groupBy("block").applyInArrow(one, "block int, query_ids binary, query_vectors binary")


def nearest(df: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int | None = None, block_rows: int = 2048, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest by inner product among all rows but the query's own.

    shard_rows: vectors of a shard; by default as many as `rows_of_shards` says."""
    rows = saved(usable(df, id_col, vec_col), "vectors")
    nodes = saved(distinct_vectors(rows, k + 1), "nodes")
    n, length = nodes.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    shards = max(1, math.ceil(n / (shard_rows or rows_of_shards(n, length))))
    index = saved(build(nodes, shards), "hnsw")
    blocks = saved(query_blocks(rows.where(is_query(F.col("id"))), block_rows), "query-blocks")
    found = saved(search(index, shards, blocks, k + 1, beam), "found")
    spread = found.join(nodes.select("node", "members"), "node").select("query_id", "score", F.explode("members").alias("vec_id")).where("vec_id <> query_id")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return spread.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
