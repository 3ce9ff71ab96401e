"""Embedding near-duplicates with navigable small-world graphs.

Vectors are compared within a label (and a length).  Equal vectors are one point with a weight.  The points of a label
are dealt over shards of bounded size; a task builds a hierarchical navigable small-world graph of a shard and answers
the queries of all points of the label, in blocks, so neither the index nor the queries of a task grow with the data.
Search runs in step for many queries as a beam down the levels; a beam filled with similar points is widened.  In each
batch some queries are also answered by brute force; while the recall of that audit is short, the beam is widened and
the batch searched anew, in the end over the whole shard.  What is found is verified by cosine in double precision.

A task gives, for each query, the number of its links and one of them, and for its shard which points have links in
common: rows in proportion to the points, however many pairs there are.

Defined results: null labels, and vectors that are null, zero, empty or hold null or non-finite numbers, are linked
with nothing; repeated rows of one id are merged (their links are counted once, an id is not linked with itself), rows
with a null id are left out; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import components, stored

COSINE = 0.93
SHARD, QUERIES, BATCH = 16_384, 65_536, 256  #: points of an index; queries of a task; queries in step
LINKS, UPPER_LINKS, CLOSE_LINKS = 24, 12, 16  #: per point at the bottom, above; of them kept for being closest
BUILD_BEAM, BEAM, AUDITED, RECALL = 32, 64, 32, 0.99
WHOLE = 8  #: a beam of this part of a shard costs as much as the whole shard, so that is searched instead
KEY = ["label", "dim", "shard", "block"]


class Graph:
    """A hierarchical navigable small-world graph over unit vectors, built and searched in batches."""

    def __init__(self, units: np.ndarray, seed: int = 5):
        self.units = units.astype(np.float32)
        n = len(units)
        rng = np.random.default_rng(seed)
        heights = np.minimum((-np.log(1 - rng.random(n)) / np.log(UPPER_LINKS)).astype(int), 6)
        self.top = int(heights.max()) if n else 0
        heights[rng.integers(n)] = self.top
        self.links = [np.full((n, LINKS if level == 0 else UPPER_LINKS), -1, np.int32) for level in range(self.top + 1)]
        self.used = [np.zeros(n, np.int32) for _ in range(self.top + 1)]
        order = np.argsort(-heights, kind="stable")  # tall ones first, so that every level has its way in
        self.entry = order[:1]
        done = 1
        while done < n:
            some = order[done:done + min(BATCH, max(1, done // 2))]
            self._insert(some, heights[some])
            done += len(some)

    def _insert(self, some: np.ndarray, heights: np.ndarray) -> None:
        among = self.units[some] @ self.units[some].T
        np.fill_diagonal(among, -2)
        start = np.repeat(self.entry[None, :], len(some), axis=0)
        new: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for level in range(self.top, -1, -1):
            ids, sims = self.beam(self.units[some], start, level, BUILD_BEAM if level <= heights.max() else 4)
            at = np.flatnonzero(heights >= level)
            if len(at):
                new.append((level, at, ids[at], sims[at]))
            start = ids[:, :4]
        for level, at, ids, sims in new:
            width = self.links[level].shape[1]
            # Points of one batch don't see each other in the graph yet.
            fellows = np.argsort(-among[np.ix_(at, at)], axis=1)[:, :width // 2]
            ids = np.concatenate([ids, some[at][fellows]], axis=1)
            sims = np.concatenate([sims, np.take_along_axis(among[np.ix_(at, at)], fellows, axis=1)], axis=1)
            best = np.argsort(-sims, axis=1)[:, :width // 2]
            ids, sims = np.take_along_axis(ids, best, axis=1), np.take_along_axis(sims, best, axis=1)
            for row, node in enumerate(some[at]):
                for other, sim in zip(ids[row].tolist(), sims[row].tolist(), strict=True):
                    if other >= 0 and sim > -2 and other != node:
                        self._link(level, int(node), other)
                        self._link(level, other, int(node))

    def _link(self, level: int, a: int, b: int) -> None:
        links, used = self.links[level], self.used[level]
        if used[a] and (links[a, :used[a]] == b).any():
            return
        if used[a] < links.shape[1]:
            links[a, used[a]] = b
            used[a] += 1
            return
        # Full: keep the closest, and the farthest as ways out of dense regions.
        pool = np.append(links[a], b)
        order = np.argsort(-(self.units[pool] @ self.units[a]))
        near = CLOSE_LINKS * links.shape[1] // LINKS
        links[a] = pool[np.concatenate([order[:near], order[near - links.shape[1]:]])]

    def beam(self, queries: np.ndarray, start: np.ndarray, level: int, width: int):
        """For each query the best ``width`` points met (-1: none), the best first, and their similarities."""
        many, n = len(queries), len(self.units)
        met = np.zeros((many, n), bool)
        ids = np.full((many, width), -1, np.int64)
        sims = np.full((many, width), -2, np.float32)
        begin = np.where(start >= 0, start, 0)[:, :width]
        first = np.einsum("qd,qsd->qs", queries, self.units[begin])
        for c in range(begin.shape[1]):
            fresh = (start[:, c] >= 0) & ~met[np.arange(many), begin[:, c]]
            met[np.flatnonzero(fresh), begin[fresh, c]] = True
            ids[fresh, c], sims[fresh, c] = begin[fresh, c], first[fresh, c]
        opened = np.zeros((many, width), bool)
        links, rows = self.links[level], np.arange(many)
        while len(rows):
            waiting = ~opened[rows] & (ids[rows] >= 0)
            alive = waiting.any(axis=1)
            rows, waiting = rows[alive], waiting[alive]
            if not len(rows):
                break
            pick = np.where(waiting, sims[rows], -3).argmax(axis=1)
            opened[rows, pick] = True
            near = links[ids[rows, pick]].astype(np.int64)
            fresh = (near >= 0) & ~met[rows[:, None], np.maximum(near, 0)]
            near = np.maximum(near, 0)
            r, c = np.nonzero(fresh)
            met[rows[r], near[r, c]] = True
            found = np.where(fresh, np.einsum("qd,qsd->qs", queries[rows], self.units[near]), -2)
            pool = np.concatenate([sims[rows], found], axis=1)
            keep = np.argpartition(-pool, width - 1, axis=1)[:, :width]
            sims[rows] = np.take_along_axis(pool, keep, axis=1)
            ids[rows] = np.take_along_axis(np.concatenate([ids[rows], np.where(fresh, near, -1)], axis=1), keep, axis=1)
            opened[rows] = np.take_along_axis(np.concatenate([opened[rows], ~fresh & False], axis=1), keep, axis=1)
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)

    def within(self, queries: np.ndarray, least: float, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, point) of at least that similarity, as found with a beam of that width.

        A beam filled with similar points is too narrow for that query: it is searched again with a wider one, at
        last with the whole shard.
        """
        if width * WHOLE >= len(self.units):
            return np.nonzero(queries @ self.units.T >= least)
        start = np.repeat(self.entry[None, :], len(queries), axis=0)
        for level in range(self.top, 0, -1):
            start = self.beam(queries, start, level, 8)[0]
        ids, sims = self.beam(queries, start, 0, width)
        full = np.flatnonzero((sims[:, -1] >= least) & (ids[:, -1] >= 0))
        sims[full] = -2
        r, c = np.nonzero((sims >= least) & (ids >= 0))
        if not len(full):
            return r, ids[r, c]
        q, p = self.within(queries[full], least, 4 * width)
        return np.concatenate([r, full[q]]), np.concatenate([ids[r, c], p])


def audited(graph: Graph, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a batch of queries, with a beam wide enough for the audit."""
    width, least = BEAM, COSINE - 1e-5
    sample = np.unique(np.linspace(0, len(queries) - 1, min(AUDITED, len(queries))).astype(int))
    truth = queries[sample] @ graph.units.T >= least
    while True:
        q, p = graph.within(queries, least, width)
        got = np.zeros((len(queries), len(graph.units)), bool)
        got[q, p] = True
        if (got[sample] & truth).sum() >= RECALL * truth.sum() or width * WHOLE >= len(graph.units):
            return q, p
        width *= 2


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


class _Shard:
    """Collects a shard's index rows, then answers its queries batch by batch."""

    def __init__(self):
        self.ids, self.parts, self.weights, self.graph = [], [], [], None

    def add(self, batch: pa.RecordBatch) -> None:
        self.ids.append(batch["vec_id"].to_numpy())
        self.weights.append(batch["weight"].to_numpy())
        self.parts.append(_matrix(batch["embedding"]))

    def build(self) -> None:
        self.ids, self.weights = np.concatenate(self.ids), np.concatenate(self.weights)
        self.vectors = np.concatenate(self.parts)
        self.lengths = np.linalg.norm(self.vectors, axis=1)
        self.graph = Graph(self.vectors / self.lengths[:, None])
        self.root = np.arange(len(self.ids))

    def answer(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.graph is None:
            self.build()
        ids, vectors = batch["vec_id"].to_numpy(), _matrix(batch["embedding"])
        lengths = np.linalg.norm(vectors, axis=1)
        counts, ones = np.zeros(len(ids), np.int64), np.full(len(ids), -1, np.int64)
        for begin in range(0, len(ids), BATCH):
            part = slice(begin, begin + BATCH)
            q, p = audited(self.graph, (vectors[part] / lengths[part, None]).astype(np.float32))
            q = q + begin
            cosine = np.concatenate([np.einsum("nd,nd->n", vectors[q[i:i + 65536]], self.vectors[p[i:i + 65536]])
                                     for i in range(0, len(q), 65536)] or [np.zeros(0)])
            cosine /= lengths[q] * self.lengths[p]
            keep = (cosine >= COSINE) & (ids[q] != self.ids[p])
            q, p = q[keep], p[keep]
            np.add.at(counts, q, self.weights[p])
            order = np.argsort(q, kind="stable")
            q, p = q[order], p[order]
            cuts = [0, *(np.flatnonzero(q[1:] != q[:-1]) + 1).tolist(), len(q)] if len(q) else []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                ones[q[lo]] = p[lo]
                roots = np.unique(self.root[p[lo:hi]])
                for r in roots[1:]:
                    self.root[self.root == r] = roots[0]
        return ids, counts, np.where(ones >= 0, self.ids[ones], -1)


OUT = ["vec_id", "n_links", "other"]


def _linked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard, index rows before queries."""
    key, shard = None, _Shard()

    def out(ids: np.ndarray, counts: np.ndarray, others: np.ndarray) -> pa.RecordBatch:
        other = pa.array(others, pa.int64(), mask=others == -1)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), other], names=OUT)

    def rest() -> Iterator[pa.RecordBatch]:
        if shard.graph is not None:
            yield out(shard.ids, np.zeros(len(shard.ids), np.int64), shard.ids[shard.root])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in [*KEY, "role"]])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            part, now = batch.slice(lo, hi - lo), tuple(keys[:4, lo])
            if now != key:
                yield from rest()
                key, shard = now, _Shard()
            if keys[4, lo] == 0:
                shard.add(part)
            else:
                yield out(*shard.answer(part))
    yield from rest()


def linked(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    rows = stored(vectors.where("vec_id is not null").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding")), "vectors")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite
                        & F.exists("embedding", lambda x: x != 0))
    # A point is a vector of a label; its rows may carry several ids.
    members = stored(usable.withColumn("dim", F.size("embedding")).dropDuplicates(["vec_id", "label", "embedding"])
                     .select("vec_id", "label", "dim", F.xxhash64("embedding").alias("h1"),
                             F.hash("embedding").alias("h2"), "embedding"), "vector-members")
    name = ["label", "dim", "h1", "h2"]
    points = stored(members.groupBy(*name).agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight"),
                                               F.first("embedding").alias("embedding")), "vector-points")
    sizes = points.groupBy("label", "dim").agg(F.count("*").alias("points"))
    dealt = points.join(F.broadcast(sizes) if sizes.count() <= 100_000 else sizes, ["label", "dim"])
    shards, blocks = F.ceil(F.col("points") / SHARD).cast("int"), F.ceil(F.col("points") / QUERIES).cast("int")
    spread = F.xxhash64("h1", "h2")
    whole = lambda column: F.explode(F.sequence(F.lit(0), column - 1))
    columns = [*KEY, "role", "vec_id", "weight", "embedding"]
    index = (dealt.withColumn("shard", F.pmod(spread, shards).cast("int")).withColumn("block", whole(blocks))
             .withColumn("role", F.lit(0)).select(columns))
    queries = (dealt.withColumn("block", F.pmod(F.xxhash64(spread), blocks).cast("int"))
               .withColumn("shard", whole(shards)).withColumn("role", F.lit(1)).select(columns))
    found = stored(index.unionByName(queries).repartition(*KEY).sortWithinPartitions(*KEY, "role", "vec_id")
                   .mapInArrow(_linked, "vec_id long, n_links long, other long"), "vector-links")
    counts = found.groupBy("vec_id").agg(F.sum("n_links").alias("others"))
    # Rows of a point are linked with each other, and with what the point is linked with.
    of = members.select("vec_id", *name).join(points.select(*name, F.col("vec_id").alias("point"), "weight"), name)
    total = (of.join(counts.withColumnRenamed("vec_id", "point"), "point", "left")
             .groupBy("vec_id").agg(F.sum(F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    edges = (found.where("other is not null").select(F.col("vec_id").alias("a"), F.col("other").alias("b"))
             .unionByName(of.select(F.col("point").alias("a"), F.col("vec_id").alias("b"))))
    named = components(edges).withColumnRenamed("node", "vec_id")
    return (rows.select("vec_id").distinct().join(total, "vec_id", "left").join(named, "vec_id", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component", "vec_id").alias("component_id"))
            .withColumn("kept", F.col("vec_id") == F.col("component_id")))
