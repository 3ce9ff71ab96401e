"""N-gram Jaccard join with count-vector R-trees.

Documents are sets of word shingles.  Texts with equal sets are one class; what follows works on classes.

Routing.  In order of hash, the first ``n - ceil(0.8 n) + l`` shingles of a class are its prefix; two classes that
link share at least ``l`` prefix shingles, so a class with fewer prefix shingles that occur elsewhere has no partner,
and the ``l - 1`` most frequent ones of a prefix need not be followed.  That takes passages that many documents share
out of the routing without losing a link.  Shingles routed to by the same classes are followed once.

Candidates.  A shard holds the classes that share a shingle, large ones cut into blocks that meet in pairs.  Shingles
are hashed to ``GROUPS`` groups; the counts by group are a point, and the points of a shard are packed into an R-tree.
The overlap of two sets is at most the sum of the coordinate minima, of a set and a node at most the sum of the minima
with the node's upper corner; branches and pairs that cannot reach the similarity are cut.

Verification.  Only pairs across components are given.  A shard gives at first a forest (fewer pairs than classes),
then some for each pair of components (a shard of one leaf another forest), then all that are left.  A row names the ``FIRST``
shards of its class, in order of hash, that come before its own: a pair that meets in one of these is given there.  After
each round the pairs are verified on the full sets, links join components, and pairs that fail are remembered.  So every link between
different components is found, and groups of copies cost time in proportion to their size.

Defined results: null texts and texts without words have no shingles and are linked with nothing; ids may repeat or be
null (a component's id is the smallest id of its rows, null if all are null); no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm import tokens
from tallyfold.llm.common import components, give_back, stored, text_batches

WORDS, PERCENT = 5, 80
SPARE = 0.04  #: part of a prefix that may be shared with unrelated texts without being followed
GROUPS, LEAF, BLOCK = 128, 16, 2048
MAP_BITS = 23  #: size of the filter that keeps sets without candidates from being shuffled
MOST = (None, 32)  #: candidates a shard tries in a round: a forest, some for a pair of components, then all
ALL = 1 << 62
FIRST = 16  #: earlier shards of its class that a row names
NONE = np.iinfo(np.int64).max  #: no shard comes before another one by this name
BOUNDS = 1 << 13  #: bounds computed at once
SET_KEY = ["n", "c1", "c2"]


def least_overlap(n):
    return -(-PERCENT * n // 100)


def spare_of(n):
    """Prefix shingles that any link of a set of ``n`` shares with its partner."""
    return np.floor(SPARE * least_overlap(n)).astype(np.int64) + 1


def prefix_size(n: int) -> int:
    return int(n - least_overlap(n) + np.floor(SPARE * n) + 1)


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _digest(values: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return (int(_signed(tokens.mixed(values).sum(keepdims=True, dtype=np.uint64))[0]),
                int(_signed(np.bitwise_xor.reduce(tokens.mixed(values ^ tokens.SEEDS[3]), keepdims=True))[0]))


def _digests(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes and digests of many sets, as three rows; zeros for an empty one."""
    out = np.zeros((3, len(sets)), np.int64)
    out[0] = [len(s) for s in sets]
    some = np.flatnonzero(out[0])
    if len(some):
        values, begins = np.concatenate(sets), (np.cumsum(out[0]) - out[0])[some]
        out[1, some] = _signed(np.add.reduceat(tokens.mixed(values), begins))
        out[2, some] = _signed(np.bitwise_xor.reduceat(tokens.mixed(values ^ tokens.SEEDS[3]), begins))
    return out


def set_key(text: str = "text") -> Column:
    """Size of a text's shingle set and a 128-bit digest of it."""
    @F.arrow_udf("struct<n:long,c1:long,c2:long>")
    def keyed(texts: pa.Array) -> pa.Array:
        keys = [_digests(list(tokens.shingle_sets(part, WORDS))) for _, part in text_batches(texts)]
        columns = np.concatenate(keys, axis=1) if keys else np.zeros((3, 0), np.int64)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=SET_KEY)

    return keyed(F.col(text))


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(id, set) of the rows of a batch (id, text); a null id is replaced by the set's digest."""
    ids = batch["id"]
    for start, part in text_batches(batch["text"]):
        for i, values in enumerate(tokens.shingle_sets(part, WORDS)):
            if len(values):
                own = ids[start + i].as_py()
                yield _digest(values)[0] if own is None else own, values


def _prefixes(wanted: bytes):
    def prefixes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(wanted, np.uint8)
        for batch in batches:
            owners, sizes, parts = [], [], []
            for own, values in _sets(_passing(batch, bits)):
                parts.append(values[:prefix_size(len(values))])
                owners.append(own)
                sizes.append(len(parts[-1]))
            if parts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_signed(np.concatenate(parts))), pa.array(np.repeat(np.array(owners, np.int64), sizes))],
                    names=["h", "id"])

    return prefixes


def _passing(batch: pa.RecordBatch, bits: np.ndarray) -> pa.RecordBatch:
    """Rows whose id a filter lets through, and those without one."""
    at = slots(pc.fill_null(batch["id"], 0).to_numpy(zero_copy_only=False))
    held = ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
    return batch.filter(pa.array(held | batch["id"].is_null().to_numpy(zero_copy_only=False)))


def slots(ids: np.ndarray) -> np.ndarray:
    return (tokens.mixed(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - MAP_BITS)).astype(np.int64)


def _kept_sets(wanted: bytes):
    def kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(wanted, np.uint8)
        for batch in batches:
            owners, blobs, points = [], [], []
            for own, values in _sets(_passing(batch, bits)):
                owners.append(own)
                blobs.append(values.tobytes())
                points.append(np.bincount((tokens.mixed(values) >> np.uint64(57)).astype(np.int64), minlength=GROUPS)
                              .astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(owners, pa.int64()), pa.array(blobs, pa.binary()), pa.array(points, pa.binary())],
                names=["id", "members", "point"])

    return kept


def bitmap(ids: DataFrame) -> bytes:
    """A filter of fixed size over ids; what it lets through by mistake is sorted out by the join that follows."""
    @F.arrow_udf("long")
    def slot(column: pa.Array) -> pa.Array:
        return pa.array(slots(column.to_numpy(zero_copy_only=False)))

    bit = F.expr("shiftleft(1, cast(slot % 8 as int))")
    rows = (ids.select(slot(F.col("id")).alias("slot")).groupBy(F.shiftright("slot", 3).alias("byte"))
            .agg(F.bit_or(bit).cast("int").alias("bits")).toArrow())
    bits = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    bits[rows["byte"].to_numpy()] = rows["bits"].to_numpy().astype(np.uint8)
    return bits.tobytes()


class CountTree:
    """An R-tree over count vectors, packed by size and by the counts that vary most."""

    def __init__(self, points: np.ndarray):
        self.points, self.sizes = points, points.sum(axis=1)
        spread = points.std(axis=0)
        axes = np.argsort(-spread)[:2]
        order = np.lexsort((points[:, axes[1]], points[:, axes[0]] // 4, np.round(np.log(self.sizes) * 16)))
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]] = []
        children: list[np.ndarray] = [order[i:i + LEAF] for i in range(0, len(order), LEAF)]
        upper, least, largest = points, self.sizes, self.sizes
        while True:
            upper = np.stack([upper[c].max(axis=0) for c in children])
            least = np.array([least[c].min() for c in children])
            largest = np.array([largest[c].max() for c in children])
            self.levels.append((upper, least, largest, children))
            if len(children) <= LEAF:
                break
            children = [np.arange(i, min(i + LEAF, len(children))) for i in range(0, len(children), LEAF)]

    def partners(self, q: int) -> np.ndarray:
        """Points whose overlap with point ``q`` may suffice."""
        return self.pairs(np.array([q]))[1]

    def pairs(self, asked: np.ndarray,
              wanted: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Of each point asked for the points whose overlap with it may suffice, as pairs; only ``wanted`` ones."""
        def passes(q: np.ndarray, upper: np.ndarray, sizes: np.ndarray, nodes: np.ndarray) -> np.ndarray:
            kept = np.zeros(len(q), bool)
            for lo in range(0, len(q), BOUNDS):
                a, b = q[lo:lo + BOUNDS], nodes[lo:lo + BOUNDS]
                # The union is at least the larger set, and the sum of sizes without the overlap.
                bound, size = _overlap(upper[b], self.points[a]), self.sizes[a]
                kept[lo:lo + BOUNDS] = (((100 + PERCENT) * bound >= PERCENT * (size + sizes[b]))
                                        & (100 * bound >= PERCENT * size))
            return kept

        def alike(q: np.ndarray, least: np.ndarray, largest: np.ndarray) -> np.ndarray:
            """Whether a set of some size between these may be similar, by size alone: cheaper than a bound."""
            return (100 * self.sizes[q] >= PERCENT * least) & (100 * largest >= PERCENT * self.sizes[q])

        many = len(self.levels[-1][3])
        q, nodes = np.repeat(asked, many), np.tile(np.arange(many), len(asked))
        for upper, least, largest, children in reversed(self.levels):
            kept = alike(q, least[nodes], largest[nodes])
            q, nodes = q[kept], nodes[kept]
            kept = passes(q, upper, least, nodes)
            q, nodes = q[kept], nodes[kept]
            if not len(q):
                return q, nodes
            widths = np.array([len(c) for c in children])
            q, nodes = np.repeat(q, widths[nodes]), np.concatenate([children[i] for i in nodes])
        kept = alike(q, self.sizes[nodes], self.sizes[nodes])
        if wanted is not None:
            kept &= wanted(q, nodes)
        q, nodes = q[kept], nodes[kept]
        kept = passes(q, self.points, self.sizes, nodes)
        return q[kept], nodes[kept]


def _overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of the coordinate minima; a set's size is far below 2^31."""
    return np.minimum(a, b).sum(axis=1, dtype=np.int32).astype(np.int64)


def shard_pairs(ids: np.ndarray, points: np.ndarray, labels: np.ndarray, sides: np.ndarray,
                failed: list[list[int]], most: int | None = None,
                before: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Candidates across components; ``sides`` 0 and 1 meet only each other, 2 meet all.  Rows that stand together in a
    shard that both name in ``before`` do not meet.

    Without ``most`` as a forest, as if each would succeed; else up to ``most`` for each pair of components.
    """
    order = np.argsort(ids, kind="stable")
    ids, points, labels, sides = ids[order], points[order], labels[order], sides[order]
    names, root = np.unique(labels, return_inverse=True)
    root = root.copy()
    if len(names) < 2:
        return []
    tree, found, left = CountTree(points), [], len(names)
    taken: dict[tuple[int, int], int] = {}
    # Any pair across components has an end outside the largest one; of two such ends the first asks.
    large = -1 if most is None else int(np.bincount(root).argmax())
    if before is not None:
        before = before[order]

    def near() -> Iterator[tuple[int, list[int]]]:
        asking = np.flatnonzero(root != large)
        at_once = max(1, BOUNDS // LEAF)
        for lo in range(0, len(asking), at_once):
            q, p = tree.pairs(asking[lo:lo + at_once], lambda q, p: (
                ((p > q) | (root[p] == large)) & (root[p] != root[q]) & ((sides[p] != sides[q]) | (sides[p] == 2))))
            if before is not None:
                kept = ~_met(before, q, p)
                q, p = q[kept], p[kept]
            by = np.lexsort((p, q))
            q, p = q[by], p[by]
            cuts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1], [True]])) if len(q) else q
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield int(q[a]), p[a:b].tolist()

    for q, partners in near():
        if left == 1:
            break
        bad = set(failed[order[q]] or ())
        for p in partners:
            if root[p] == root[q] or int(ids[p]) in bad or p < q and int(ids[q]) in (failed[order[p]] or ()):
                continue
            if most is None:
                root[root == root[p]] = root[q]
                left -= 1
            else:
                pair = (min(root[p], root[q]), max(root[p], root[q]))
                if taken.get(pair, 0) >= most:
                    continue
                taken[pair] = taken.get(pair, 0) + 1
            found.append((int(min(ids[q], ids[p])), int(max(ids[q], ids[p]))))
    return found


def _passes(points: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the bound lets pairs of points be similar."""
    bound = _overlap(points[i], points[j])
    a, b = sizes[i], sizes[j]
    return (((100 + PERCENT) * bound >= PERCENT * (a + b)) & (100 * bound >= PERCENT * np.maximum(a, b))
            & (100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b)))


def _met(before: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the rows of a pair name a shard in common."""
    met = np.zeros(len(i), bool)
    for lo in range(0, len(i), BOUNDS):
        a, b = before[i[lo:lo + BOUNDS]], before[j[lo:lo + BOUNDS]]
        for c in range(before.shape[1]):
            met[lo:lo + BOUNDS] |= ((b == a[:, c, None]) & (b != NONE)).any(axis=1)
    return met


def _earlier(shards: pa.Array) -> np.ndarray:
    """The shards that each row names, as a row of as many numbers as the longest has, at most ``FIRST``."""
    many = pc.list_value_length(shards).to_numpy(zero_copy_only=False)
    out = np.full((len(many), max(1, int(many.max(initial=0)))), NONE)
    out[np.repeat(np.arange(len(many)), many),
        np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)] = shards.flatten().to_numpy(zero_copy_only=False)
    return out


def _leaf_pairs(ids, points, labels, shard, failed: pa.Array, forest: bool, before=None) -> list[tuple[int, int]]:
    """Pairs of many shards of at most one leaf each, all at once; ``shard`` numbers the shard of a row.

    As a ``forest`` each row meets the first later one that the bound lets pass; else all later ones.
    """
    sizes, found, free = points.sum(axis=1), [], np.ones(len(ids), bool)
    own, row = np.unique(ids, return_index=True)
    lists = failed.take(pa.array(row)).to_pylist() if failed.null_count < len(failed) else []
    bad = {a: set(b) for a, b in zip(own.tolist(), lists, strict=False) if b}
    for step in range(1, LEAF):
        i = np.flatnonzero(shard[step:] == shard[:-step])
        if not len(i):
            break
        small, large = np.minimum(sizes[i], sizes[i + step]), np.maximum(sizes[i], sizes[i + step])
        i = i[free[i] & (labels[i] != labels[i + step]) & (100 * small >= PERCENT * large)]
        if before is not None:
            i = i[~_met(before, i, i + step)]
        i = i[_passes(points, sizes, i, i + step)]
        a, b = np.minimum(ids[i], ids[i + step]), np.maximum(ids[i], ids[i + step])
        if bad:
            left = np.array([y not in bad.get(x, ()) for x, y in zip(a.tolist(), b.tolist(), strict=True)], bool)
            i, a, b = i[left], a[left], b[left]
        free[i] = not forest
        found.append(np.stack([a, b]))
    return list(map(tuple, np.unique(np.concatenate(found, axis=1), axis=1).T.tolist())) if found else []


def _candidates(most: int | None):
    """Rows come sorted by shard; one shard, or a batch of small ones, is held at a time."""
    def one(column: pa.Array | pa.ChunkedArray) -> pa.Array:
        return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column

    def read(part: pa.RecordBatch | pa.Table) -> tuple:
        points = np.frombuffer(b"".join(part["point"].to_pylist()), "<u4").reshape(-1, GROUPS).astype(np.int32)
        return part["id"].to_numpy(), points, part["label"].to_numpy()

    def leaves(part: pa.RecordBatch | pa.Table, shard: np.ndarray) -> list[tuple[int, int]]:
        return _leaf_pairs(*read(part), shard, one(part["failed"]), most != ALL, _earlier(one(part["before"])))

    def solved(rows: list[pa.RecordBatch]) -> list[tuple[int, int]]:
        part = pa.Table.from_batches(rows)
        if len(part) <= LEAF:
            return leaves(part, np.zeros(len(part), np.int64))
        return shard_pairs(*read(part), part["side"].to_numpy(), part["failed"].to_pylist(), most,
                           _earlier(one(part["before"])))

    def out(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        a, b = zip(*pairs, strict=True) if pairs else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def candidates(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch[c].to_numpy(zero_copy_only=False) for c in ("h", "i", "j")])
            new = np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
            cuts = np.flatnonzero(new)
            ends = np.append(cuts[1:], batch.num_rows)
            pairs: list[tuple[int, int]] = []
            small = (ends - cuts <= LEAF) & (cuts > 0) & (ends < batch.num_rows)
            for lo, hi in zip(cuts[~small].tolist(), ends[~small].tolist(), strict=True):
                part = batch.slice(lo, hi - lo)
                if held and any(held[0][c][0] != part[c][0] for c in ("h", "i", "j")):
                    pairs += solved(held)
                    held = []
                held.append(part)
            if small.any():
                shard = np.cumsum(new) - 1
                rows = small[shard]
                pairs += leaves(batch.filter(pa.array(rows)), shard[rows])
            yield out(pairs)
        if held:
            yield out(solved(held))
        held.clear()
        give_back()

    return candidates


def similar(a: bytes, b: bytes) -> bool:
    a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    small, large = (a, b) if len(a) < len(b) else (b, a)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    @F.arrow_udf("boolean")
    def linked(a: pa.Array, b: pa.Array) -> pa.Array:
        found = pa.array([similar(x.as_buffer(), y.as_buffer()) for x, y in zip(a, b, strict=True)], pa.bool_())
        give_back()
        return found

    one = sets.select(F.col("id").alias("a"), F.col("members").alias("set_a"))
    other = sets.select(F.col("id").alias("b"), F.col("members").alias("set_b"))
    return (pairs.join(one, "a").join(other, "b")
            .select("a", "b", linked(F.col("set_a"), F.col("set_b")).alias("linked")))


def _routes(work: DataFrame, classes: DataFrame) -> DataFrame:
    """(h, id): the shingles along which a class looks for partners.

    Copies of the row that names a class have the same shingles, and would make each look as if it occurred elsewhere.
    """
    prefixes = work.mapInArrow(_prefixes(bitmap(classes.select("id"))), "h long, id long")
    often = prefixes.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    shared = (prefixes.join(often, "h").groupBy("id").agg(F.collect_set(F.struct("df", "h")).alias("shared")))
    shared = shared.join(classes.select("id", "n"), "id")
    # Floating point as in spare_of; the filter may only ever be too loose, so one unit is given.
    spare = F.greatest(F.lit(1), F.floor(F.lit(SPARE) * F.ceil(F.lit(PERCENT / 100) * F.col("n") - 1e-6) - 1e-6) + 1)
    most = F.size("shared") - spare + 1
    followed = F.slice(F.array_sort("shared"), 1, most.cast("int"))
    return shared.where(most > 0).select("id", F.explode(followed).alias("s")).select("s.h", "id")


def _sharded(routes: DataFrame, labels: DataFrame, points: DataFrame, failed: DataFrame) -> DataFrame:
    """Rows of the shards that still hold several components, large shards as pairs of blocks."""
    rows = routes.join(labels, "id")
    mixed = (rows.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("many"),
                                   F.bit_xor(F.xxhash64("id")).alias("x1"),
                                   F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("x2"))
             .where(F.col("lo") != F.col("hi"))
             .groupBy("x1", "x2", "many").agg(F.min("h").alias("h")))
    rows = rows.join(mixed.select("h", "many"), "h")
    # One row for each class until its points are there.
    held = rows.groupBy("id", "label").agg(F.array_sort(F.collect_list(F.struct("h", "many"))).alias("shards"))
    held = (held.join(points, "id").join(failed, "id", "left")
            .withColumn("first", F.slice(F.col("shards.h"), 1, FIRST)))
    rows = held.select("id", "label", "point", "failed", "first", F.posexplode("shards").alias("at", "shard"))
    before = F.slice("first", F.lit(1), F.least("at", F.lit(FIRST)))
    rows = rows.select("id", "label", "point", "failed", before.alias("before"), "shard.*")
    blocks = F.ceil(F.col("many") / BLOCK).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return (rows.select("h", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                    F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
                    .alias("side"), "id", "label", "point", "failed", "before"))


def labelled(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """doc_id and shingle-set class of every row; label and least id of every class that has shingles.

    Classes of one component have one label, classes of two never do, also if ids repeat or are null.
    """
    base = stored(docs.select(F.col(key).cast("long").alias("doc_id"), set_key(text).alias("k"))
                  .select("doc_id", "k.*"), "shingle-keys")
    # Ids name classes unless one id has several texts, or none; then the set's digest does.
    clear = base.where("n > 0").groupBy("doc_id").agg((F.min("c1") == F.max("c1")).alias("one")) \
        .where("not one or doc_id is null").isEmpty()
    own = F.col("doc_id") if clear else F.col("c1")
    classes = stored(base.where("n > 0").groupBy(*SET_KEY).agg(F.min(own).alias("id"),
                                                               F.min("doc_id").alias("least")), "classes")
    work = docs.select((F.col(key).cast("long") if clear else F.lit(None).cast("long")).alias("id"),
                       F.col(text).alias("text"))
    routes = stored(_routes(work, classes), "routes")
    ids = routes.select("id").distinct()
    sets = work.mapInArrow(_kept_sets(bitmap(ids)), "id long, members binary, point binary")
    sets = stored(sets.join(ids, "id", "left_semi").dropDuplicates(["id"]), "shingle-sets")
    labels, failed, tested = sets.select("id", F.col("id").alias("label")), None, None
    nothing = sets.limit(0).select("id", F.array("id").alias("failed"))
    for number in range(len(MOST) + 1):
        last = number == len(MOST)
        shards = _sharded(routes, labels, sets.select("id", "point"), failed or nothing)
        found = (shards.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j", "id")
                 .mapInArrow(_candidates(ALL if last else MOST[number]), "a long, b long").distinct())
        judged = stored(_verified(found, sets), "judged")
        if judged.isEmpty():
            break
        tested = judged if tested is None else tested.unionByName(judged)
        if not judged.where("linked").isEmpty():
            joined_ids = components(tested.where("linked").select("a", "b")).withColumnRenamed("node", "id")
            labels = stored(sets.select("id").join(joined_ids, "id", "left")
                            .select("id", F.coalesce("component", "id").alias("label")), "labels")
        failed = (tested.where("not linked").groupBy(F.col("a").alias("id"))
                  .agg(F.collect_set("b").alias("failed")))
    return base, classes.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))


def joined(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles and component_id of every row."""
    return named(*labelled(docs, key, text))


def named(base: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``joined``: a component's id is the smallest id of any of its rows."""
    least = groups.groupBy("label").agg(F.min("least").alias("component_id"))
    ids = groups.join(least, "label").select(*SET_KEY, "component_id")
    return (base.join(ids, SET_KEY, "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")))
