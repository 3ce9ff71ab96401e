"""Prefix trie of conversations by vertical bitmaps.

Conversations that begin with the same turns share the nodes of those turns.  The conversations are cut into shards of
neighbouring ids.  A shard keeps a vertical index: for each (position, turn) the bitset of its conversations that have
that turn there.  Starting from all of them, the bitset of a node intersected with the postings of the next position
gives its children; the number of bits is the number of conversations, the lowest bit the smallest id, and the bits
that stop at this depth are the list of ends.  Shards' nodes meet under a 128-bit hash of their turns, so a prefix that
a third of all conversations share is one row of each shard.

Sums over subtrees need no walk over the whole trie: a node belongs to the shard that holds its smallest
conversation, each shard adds up what belongs to it over its own depth-first numbering, and the shards' sums are added.

Nothing is bounded by a conversation: turns are numbered over sorted partitions, and longer conversations are cut into
bands of positions, each a member of a shard of its own, which begin at the hash of all turns before.  Bands pass what
lies below them upwards as one row each.  A task therefore holds at most ``SHARD`` x ``BAND`` turns, as 16-byte digests;
texts are never shuffled.  The SHA-256 of a list of ends is one sequence by nature: its ids, already gathered by shard
and sorted, stream through the digest in order, a batch at a time.

Defined results: rows with a null conversation id belong to no conversation and are left out; a null turn number comes
first, rows of equal number are ordered by the SHA-256 of length of role, role and text; repeated rows are repeated
turns; a null role or text counts as empty; empty and very long texts are turns like any other; no rows give no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import stored
from tallyfold.operators.numbering import with_ordinals

SHARD = 512  #: conversations of a shard
BAND = 512  #: turns of a conversation that are one member
FAMILY = 20  #: conversations that may begin with the turns of the first of them
HEADS = 4  #: such a conversation takes fewer than this many
WORD_BREAKS = r"[\x20\x09-\x0D]+"

TURNS = "conv long, turn long, id binary, words long, part int, place long"
NODES = ("no int, size int, parent_no int, path binary, parent binary, depth long, conv long, n long, words long, "
         "real boolean, ends array<long>, goes array<long>")


def turns(conversations: DataFrame) -> DataFrame:
    """Turns as (conv, turn, id, words): digest of role and text, and words of the text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)
    words = F.size(F.filter(F.split(text, WORD_BREAKS), lambda w: w != ""))
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.substring(digest, 1, 32)).alias("id"), words.cast("long").alias("words"))


def placed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every turn with its place ``pos`` (1, 2, ...) in its conversation, and the length ``n`` of each conversation.

    Sorted partitions number their own turns; only the first conversation of a partition can have begun in an earlier
    one, so what is to be added is at most one row for each partition.
    """
    order = ["conv", F.col("turn").asc_nulls_first(), "id"]
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv").to_numpy()
            begins = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
            at = np.arange(len(conv)) - np.repeat(begins, np.diff(np.r_[begins, len(conv)]))
            if conv[0] == last:
                at[:begins[1] if len(begins) > 1 else len(at)] += count
            last, count = conv[-1], at[-1] + 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(conv), part), pa.int32()), pa.array(at, pa.int64())],
                names=[*batch.schema.names, "part", "place"])

    numbered = stored(sorted_rows.mapInArrow(number, TURNS), "turns")
    counts = numbered.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    added = counts.select("conv", "part", F.sum("n").over(before).alias("before")).where("before > 0")
    pos = F.col("place") + F.coalesce("before", F.lit(0)) + 1
    return (numbered.join(F.broadcast(added), ["conv", "part"], "left").select("conv", pos.alias("pos"), "id", "words"),
            counts.groupBy("conv").agg(F.sum("n").alias("n")))


def members(rows: DataFrame) -> DataFrame:
    """Turns (conv, pos, id, words) as bands: (conv, band, items), items being at most ``BAND`` turns in order."""
    band = F.floor((F.col("pos") - 1) / BAND).cast("int")
    items = F.array_sort(F.collect_list(F.struct("pos", "id", "words")))
    return rows.groupBy("conv", band.alias("band")).agg(items.alias("items"))


def rebuilt(bands: DataFrame, lengths: DataFrame) -> DataFrame:
    """Conversations whose first turns are replaced by those of the first of their family.

    Returns (conv, band, start, last, items): turns before the band, and whether it is the last one.  A conversation
    takes h turns (CRC-32 of its decimal id, modulo ``HEADS``) and drops as many of its own.
    """
    own = F.col("conv")
    taken = F.when(own % FAMILY == 0, 0).otherwise(F.crc32(own.cast("string").cast("binary")) % HEADS).cast("int")
    wanted = lengths.select("conv", "n", taken.alias("h"), (own - own % FAMILY).alias("base"))
    heads = bands.where((F.col("band") == 0) & (own % FAMILY == 0)).select(
        own.alias("base"), F.slice("items", 1, HEADS - 1).alias("heads"))
    none = F.array().cast(bands.schema["items"].dataType)
    lead = F.slice(F.coalesce("heads", none), F.lit(1), F.col("h"))
    begun = wanted.join(heads, "base", "left").select("conv", "n", "h", lead.alias("lead"))
    first = F.col("band") == 0
    items = F.when(first, F.concat("lead", F.slice("items", F.col("h") + 1, F.lit(BAND)))).otherwise(F.col("items"))
    start = F.when(first, 0).otherwise(F.col("band") * BAND - F.col("h") + F.size("lead")).cast("long")
    return bands.join(begun, "conv").select(
        "conv", "band", start.alias("start"), (F.col("band") == F.floor((F.col("n") - 1) / BAND)).alias("last"),
        items.alias("items"))


def mixed(depth: int, digest: bytes) -> int:
    """128-bit hash of a turn at a depth; a path is the exclusive or of those of its turns."""
    return int.from_bytes(hashlib.blake2b(digest, digest_size=16, salt=depth.to_bytes(16, "little")).digest(), "little")


def _halves(path: int) -> tuple[int, int]:
    both = np.frombuffer(path.to_bytes(16, "little"), "<i8")
    return int(both[0]), int(both[1])


def _joined(low: int, high: int) -> int:
    return int.from_bytes(np.array([low, high], "<i8").tobytes(), "little")


def _prefixes(bands: DataFrame) -> DataFrame:
    """(conv, band, p1, p2): the path before each band but the first."""
    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for start, items in zip(batch.column("start").to_pylist(), batch.column("items").to_pylist()):
                path = 0
                for k, item in enumerate(items):
                    path ^= mixed(start + k + 1, item["id"])
                sums.append(_halves(path))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), batch.column("band"), *(pa.array([s[i] for s in sums], pa.int64()) for i in (0, 1))],
                names=["conv", "band", "x1", "x2"])

    # Only conversations of several bands have one that is not the last.
    sums = bands.where("not last").select("conv", "band", "start", "items").mapInArrow(
        totals, "conv long, band int, x1 long, x2 long")
    upto = Window.partitionBy("conv").orderBy("band").rowsBetween(Window.unboundedPreceding, 0)
    return sums.select("conv", (F.col("band") + 1).alias("band"), F.bit_xor("x1").over(upto).alias("p1"),
                       F.bit_xor("x2").over(upto).alias("p2"))


def _grown(shard: pa.Table) -> pa.Table:
    """The nodes of one shard, in depth-first order."""
    shard = shard.sort_by("conv")
    convs, starts, lasts = (shard[c].to_pylist() for c in ("conv", "start", "last"))
    paths = [_joined(a, b) for a, b in zip(shard["p1"].to_pylist(), shard["p2"].to_pylist())]
    items = [[(i["id"], i["words"]) for i in each] for each in shard["items"].to_pylist()]
    postings: dict[tuple[int, bytes], int] = {}
    stops: dict[int, int] = {}
    roots: dict[tuple[int, int], int] = {}
    final = 0
    for i, (start, turns_) in enumerate(zip(starts, items)):
        bit = 1 << i
        final |= bit if lasts[i] else 0
        roots[start, paths[i]] = roots.get((start, paths[i]), 0) | bit
        stops[start + len(turns_)] = stops.get(start + len(turns_), 0) | bit
        for k, (turn, _) in enumerate(turns_):
            at = start + k + 1, turn
            postings[at] = postings.get(at, 0) | bit
    rows, sizes = [], []
    for (start, path), bits in sorted(roots.items()):
        # bitset, depth, path, parent's number and path, words of the last turn
        below = [(bits, start, path, -1, None, 0)]
        while below:
            bits, depth, path, parent_no, parent, words = below.pop()
            no, here = len(rows), bits & stops.get(depth, 0)
            sizes.append(1)
            real = parent is not None or depth == 0
            rows.append((no, parent_no, path.to_bytes(16, "little"), parent, depth, convs[_lowest(bits)],
                         bits.bit_count(), words, real, _named(here & final, convs), _named(here & ~final, convs)))
            rest = bits & ~here
            while rest:
                one = _lowest(rest)
                turn, words = items[one][depth - starts[one]]
                child = rest & postings[depth + 1, turn]
                below.append((child, depth + 1, path ^ mixed(depth + 1, turn), no, rows[no][2], words))
                rest ^= child
    for no in range(len(rows) - 1, -1, -1):
        if rows[no][1] >= 0:
            sizes[rows[no][1]] += sizes[no]
    names = ["no", "parent_no", "path", "parent", "depth", "conv", "n", "words", "real", "ends", "goes"]
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(),
             pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    table = {n: pa.array([r[i] for r in rows], kind) for i, (n, kind) in enumerate(zip(names, kinds))}
    table["size"] = pa.array(sizes, pa.int32())
    groups = {n: pa.array([shard[n][0].as_py()] * len(rows), pa.int32()) for n in ("band", "shard")}
    return pa.table({**groups, **{n: table[n] for n in ("no", "size", *names[1:])}})


def _lowest(bits: int) -> int:
    return (bits & -bits).bit_length() - 1


def _named(bits: int, convs: list[int]) -> list[int]:
    found = []
    while bits:
        found.append(convs[_lowest(bits)])
        bits &= bits - 1
    return found


def _added_up(shard: pa.Table) -> pa.Table:
    """Over one shard's numbering: what belongs to this shard in the subtree of each node, and the node's parent."""
    shard = shard.sort_by("no")
    size, parent, saved, leaves, conv = (shard[c].to_numpy() for c in ("size", "parent_no", "own_saved", "own_leaves",
                                                                       "whole_conv"))
    at = np.arange(len(size))
    sums = []
    for own in (saved, leaves):
        upto = np.r_[0, np.cumsum(own)]
        sums.append(pa.array(upto[at + size] - upto[at], pa.int64()))
    above = pa.array(conv[parent], pa.int64(), mask=parent < 0)
    table = pa.table({"path": shard["path"], "saved": sums[0], "leaves": sums[1], "above": above})
    return table.filter(shard["real"])


def trie(bands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of the trie of all conversations, and where conversations end.

    ``bands`` is (conv, band, start, last, items) as from ``rebuilt``; every conversation has a first band, perhaps
    an empty one.  Returns nodes (path, parent, depth, words, conv, n_convs, n_children, n_leaves, saved, parent_conv),
    and lists of ends (path, shard, ends): ids in ascending order, shards in that order too.
    """
    bands = stored(bands, "bands")
    shards = with_ordinals(bands.where("band = 0").select("conv"), ["conv"]).select(
        "conv", F.floor((F.col("ordinal") - 1) / SHARD).cast("int").alias("shard"))
    zero = F.lit(0).cast("long")
    dealt = (bands.join(shards, "conv").join(_prefixes(bands), ["conv", "band"], "left")
             .select("band", "shard", "conv", "start", "last", F.coalesce("p1", zero).alias("p1"),
                     F.coalesce("p2", zero).alias("p2"), "items"))
    local = stored(dealt.groupBy("band", "shard").applyInArrow(_grown, f"band int, shard int, {NODES}"), "shard-nodes")

    nodes = (local.where("real").groupBy("path", "parent", "depth", "words")
             .agg(F.min("conv").alias("conv"), F.sum("n").alias("n_convs")))
    nodes = stored(nodes, "nodes")
    kids = nodes.where("parent is not null").groupBy(F.col("parent").alias("path")).agg(
        F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(kids, "path", "left").withColumn("n_children", F.coalesce("n_children", zero))

    whole = nodes.select("path", F.col("conv").alias("whole_conv"), "n_convs", "n_children")
    own = F.col("real") & (F.col("conv") == F.col("whole_conv"))
    seen = local.join(whole, "path").select(
        "band", "shard", "no", "size", "parent_no", "path", "real", "whole_conv", "goes",
        F.when(own, (F.col("n_convs") - 1) * F.col("words")).otherwise(zero).alias("own_saved"),
        F.when(own & (F.col("n_children") == 0), 1).otherwise(0).cast("long").alias("own_leaves"))
    seen = stored(seen, "seen-nodes")
    sums = [F.sum(c).alias(c) for c in ("own_saved", "own_leaves")]
    # What belongs to a conversation in its later bands, added where its band ends.
    later = Window.partitionBy("conv").orderBy(F.col("band").desc()).rowsBetween(Window.unboundedPreceding, 0)
    tails = (seen.where("band > 0 and (own_saved > 0 or own_leaves > 0)")
             .groupBy(F.col("whole_conv").alias("conv"), "band").agg(*sums))
    every = seen.where("size(goes) > 0").select("band", "shard", "no", F.explode("goes").alias("conv"))
    below = (every.select("conv", (F.col("band") + 1).alias("band"), "shard", "no")
             .join(tails, ["conv", "band"], "left")
             .select("conv", "band", "shard", "no", *[F.sum(F.coalesce(c, zero)).over(later).alias(c)
                                                      for c in ("own_saved", "own_leaves")])
             .withColumn("band", F.col("band") - 1).groupBy("band", "shard", "no")
             .agg(*[F.sum(c).alias(f"{c}_below") for c in ("own_saved", "own_leaves")]))
    full = seen.drop("goes").join(below, ["band", "shard", "no"], "left").withColumns(
        {c: F.col(c) + F.coalesce(f"{c}_below", zero) for c in ("own_saved", "own_leaves")})
    added = (full.drop("own_saved_below", "own_leaves_below").groupBy("band", "shard")
             .applyInArrow(_added_up, "path binary, saved long, leaves long, above long")
             .groupBy("path").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("n_leaves"),
                                  F.max("above").alias("parent_conv")))
    ends = (local.where("size(ends) > 0").groupBy("path", "shard")
            .agg(F.array_sort(F.flatten(F.collect_list("ends"))).alias("ends")))
    return nodes.join(added, "path"), ends


def ends_digest(ends: DataFrame) -> DataFrame:
    """(path, ends_sha256): SHA-256 of the decimal ids of all ends of a node, ascending and joined by commas."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, state = None, None
        for batch in batches:
            done = []
            for at, ids in zip(batch.column("path").to_pylist(), batch.column("ids").to_pylist()):
                if at == path:
                    state.update(b",")
                else:
                    if path is not None:
                        done.append((path, state.hexdigest()))
                    path, state = at, hashlib.sha256()
                state.update(ids.encode())
            yield _digests(done)
        if path is not None:
            yield _digests([(path, state.hexdigest())])

    lists = ends.select("path", "shard", F.concat_ws(",", F.transform("ends", lambda i: i.cast("string"))).alias("ids"))
    return (lists.repartition("path").sortWithinPartitions("path", "shard")
            .mapInArrow(digest, "path binary, ends_sha256 string"))


def _digests(done: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()),
                                       pa.array([d[1] for d in done], pa.string())], names=["path", "ends_sha256"])


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations."""
    rows, lengths = placed(turns(conversations))
    nodes, ends = trie(rebuilt(stored(members(rows), "own-bands"), lengths))
    return nodes.join(ends_digest(ends), "path", "left").select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children",
        "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


ORACLE = r"""
    WITH t AS (SELECT conv_id, length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS id, turn,
            len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w
            FROM conversations WHERE conv_id IS NOT NULL),
        own AS (SELECT conv_id, list(struct_pack(id := id, w := w) ORDER BY turn NULLS FIRST, sha256(id)) AS items
            FROM t GROUP BY 1),
        h AS (SELECT conv_id, items, conv_id - conv_id % 20 AS base, CASE WHEN conv_id % 20 = 0 THEN 0 ELSE
            xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''),
                lambda c: ascii(c)::BIGINT)), lambda sum, byte: list_reduce([xor(sum, byte), 0, 0, 0, 0, 0, 0, 0, 0],
                lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 4 END AS h
            FROM own),
        s AS (SELECT h.conv_id, coalesce(own.items, [])[1:h] || h.items[h + 1:] AS items
            FROM h LEFT JOIN own ON own.conv_id = base),
        p AS (SELECT conv_id AS m, items, unnest(range(0, len(items) + 1)) AS depth FROM s),
        k AS (SELECT m, depth, len(items) AS n, items[depth].w AS w,
            sha256(array_to_string(list_transform(items[1:depth], lambda x: sha256(x.id)), '')) AS path,
            sha256(array_to_string(list_transform(items[1:depth - 1], lambda x: sha256(x.id)), '')) AS parent FROM p),
        v AS (SELECT path, depth, any_value(CASE WHEN depth > 0 THEN parent END) AS parent, min(m) AS conv_id,
            count(*) AS n_convs, coalesce(any_value(w), 0) AS w,
            sha256(coalesce(string_agg(m::VARCHAR, ',' ORDER BY m) FILTER (depth = n), '')) AS ends_sha256
            FROM k GROUP BY 1, 2),
        c AS (SELECT parent AS path, count(*) AS n_children FROM v WHERE parent IS NOT NULL GROUP BY 1),
        u AS (SELECT k.path, sum((own.n_convs - 1) * own.w) AS saved,
            count(*) FILTER (own.path NOT IN (SELECT path FROM c)) AS n_leaves
            FROM k JOIN v AS own ON own.conv_id = k.m AND own.depth >= k.depth GROUP BY 1)
    SELECT v.conv_id, v.depth, up.conv_id AS parent_conv_id, v.n_convs, coalesce(n_children, 0) AS n_children,
        n_leaves, saved::BIGINT AS saved_tokens, v.ends_sha256
    FROM v LEFT JOIN v AS up ON up.path = v.parent LEFT JOIN c ON c.path = v.path JOIN u ON u.path = v.path"""
