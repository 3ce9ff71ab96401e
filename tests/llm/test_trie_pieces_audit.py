"""Conversation trie, SentencePiece encoding and filter audit."""

import hashlib
import random
import zlib
from collections import defaultdict
from itertools import permutations

import pytest
import sentencepiece
from helpers import WORD, corpus, frame, prose
from oracle_compare import compare, connection
from pyspark.sql import functions as F

from tallyfold.llm import filter_audit, pieces, trie
from tallyfold.llm.common import importable
from tallyfold.llm.queries import ORACLE, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def _workers(spark):
    importable(spark)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    assert compare(QUERIES[name](spark, SMALL), connection(SMALL), ORACLE[name]) is None


# -- conversation trie ---------------------------------------------------------------------


def turn_order(row):
    _, turn, role, text = row
    role, text = role or "", text or ""
    return turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def brute_trie(rows):
    own = defaultdict(list)
    for row in sorted((r for r in rows if r[0] is not None), key=turn_order):
        own[row[0]].append((row[2] or "", row[3] or ""))
    convs = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        convs[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    found = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            found[tuple(convs[c][:d])].append(c)
    kids = defaultdict(list)
    for node in found:
        if node:
            kids[node[:-1]].append(node)
    sums = {}
    for node in sorted(found, key=len, reverse=True):
        saved = (len(found[node]) - 1) * len(WORD.findall(node[-1][1])) if node else 0
        leaves = 0 if kids[node] else 1
        for child in kids[node]:
            saved, leaves = saved + sums[child][0], leaves + sums[child][1]
        sums[node] = saved, leaves
    return sorted((ids[0], len(node), found[node[:-1]][0] if node else None, len(ids), len(kids[node]), sums[node][1],
                   sums[node][0], hashlib.sha256(",".join(str(c) for c in ids if len(convs[c]) == len(node)).encode())
                   .hexdigest()) for node, ids in found.items())


def conversations(seed=5):
    rng = random.Random(seed)
    rows, shared = [], [("system", "you are  helpful"), ("user", "hello there")]
    for c in range(130):
        if c in (40, 41, 43):  # the first of this family is missing, and some of its conversations are short
            rows += [(c, 0, "user", "alone")] if c > 40 else []
            continue
        length = rng.choice([1, 2, 3, 3, 5, 8, 30])
        for t in range(length):
            role, text = shared[t] if t < 2 and rng.random() < 0.8 else ("user", rng.choice("ab") * rng.randint(1, 2))
            rows.append((c, t, role, text))
    rows += [(60, None, "system", "before all"), (61, 3, None, None), (61, 3, "", ""), (61, 3, "user", ""), (None, 1, "user", "x"),
             (7, 2, "user", "word " * 5000), (1 << 40, 0, "user", "far away"), (1 << 40, 1, "user", "\t \n")]
    return rows + rows[:40]


@pytest.mark.parametrize("shard,band", [(512, 512), (7, 4), (16, 5), (1, 1000)])
def test_trie(spark, monkeypatch, shard, band):
    monkeypatch.setattr(trie, "SHARD", shard)
    monkeypatch.setattr(trie, "BAND", band)
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns(
        {"path": F.lit(1), "conv": F.lit("x"), "n": F.lit(0), "band": F.lit(None).cast("string"), "shard": F.lit(2.5)})
    found = trie.rebuilt_trie(df.repartition(5))
    assert sorted(map(tuple, found.collect()), key=lambda r: (r[0], r[1])) == brute_trie(rows)


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.rebuilt_trie(none).collect() == []


def test_trie_splits_a_hot_conversation(spark):
    """One conversation with most turns is spread over the sorted partitions, and its bands over groups."""
    rows = spark.range(6000).select(F.when(F.col("id") < 5000, 20).otherwise(F.col("id")).alias("conv_id"),
                                    F.col("id").alias("turn"), F.lit("user").alias("role"),
                                    (F.col("id") % 7).cast("string").alias("text"))
    placed, lengths = trie.placed(trie.turns(rows))
    bands = trie.members(placed)
    assert bands.agg(F.max(F.size("items"))).first()[0] <= trie.BAND
    assert lengths.where("conv = 20").first().n == 5000
    assert placed.where("conv = 20").agg(F.count_distinct("pos"), F.max("pos")).first() == (5000, 5000)
    found = trie.rebuilt_trie(rows)
    assert found.agg(F.max("depth")).first()[0] == 5000
    root = found.where("depth = 0").first()
    assert root.n_convs == 1001


# -- pieces --------------------------------------------------------------------------------


def odd_texts():
    rng = random.Random(3)
    signs = [" ", "  ", "▁", "\n", "\t", "a", "the", " the", "Ä", "ä", "日本", "𝒳", "😀", "\x00", "\x7f", "<s>", "</s>",
             "<unk>", "<0x0A>", "​", "\r\n", "ﬁ", "１", "﻿", " ▁", "0", ".", "　", "\x85"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    return texts + ["", " ", "   ", "▁", "x" * 40_000, " " * 5000, "ab c " * 30_000, "é" * 3000]


def test_pieces_equal_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    rows = corpus() + [(1000 + i, t) for i, t in enumerate(odd_texts())]
    docs = frame(spark, rows).withColumns({c: F.lit(c) for c in ("ids", "block", "no", "chunk", "row", "numbers", "of")})
    found = pieces.encoded(docs.repartition(6), carry=("doc_id", "text", "block"))
    assert found.columns == ["doc_id", "text", "block", "ids"]
    found = pieces.decoded(found)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2, "numbers stay where they are"
    read = found.withColumn("digest", pieces.ids_digest()).collect()
    assert sorted(((r.doc_id, r.text) for r in read), key=str) == sorted(rows, key=str)
    for r in read:
        ids = sp.encode(r.text or "")
        assert r.ids == ids, r.text
        assert r.decoded == sp.decode(ids), r.text
        assert r.digest == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_pieces_of_nothing(spark):
    assert pieces.decoded(pieces.encoded(frame(spark, []))).collect() == []
    nulls = spark.createDataFrame([(1, None), (2, [])], "n int, ids array<int>")
    assert [r.decoded for r in pieces.decoded(nulls).collect()] == ["", ""]


def test_lists_hold_each_chunk_once(spark):
    texts = ["the same words", "the same words again", "the  same"]
    rows = frame(spark, list(enumerate(texts))).coalesce(1).select(F.struct("doc_id").alias("row"), "text")
    lists = pieces._blocks(rows, 4).where("slice is not null").collect()
    chunks = [c.decode() for r in lists for c in pieces._restored(bytes(r.packed)).split(b"\xff")]
    assert sorted(chunks) == sorted([" the", " same", " words", " again", "  same"])


def test_a_slice_segments_each_chunk_once():
    """Whatever the number of blocks that hold it."""
    seen = []

    class Library:
        def __init__(self):
            self.real = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())

        def piece_to_id(self, piece):
            return self.real.piece_to_id(piece)

        def encode(self, texts, num_threads=1):
            seen.extend(texts)
            return self.real.encode(texts)

    import pyarrow as pa
    library, lists = Library(), [[" a", " b"], [" a", " c"], [" b", " c", " d"]]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([1, 2, 3]), pa.array([0, 0, 0], pa.int32()),
         pa.array([pieces._squeezed(b"\xff".join(c.encode() for c in x)) for x in lists])],
        names=["block", "slice", "packed"])
    before, pieces.processor = pieces.processor, lambda path: library
    try:
        found = list(pieces._segmented("")(iter([batch])))
    finally:
        pieces.processor = before
    assert sorted(seen) == ["a", "b", "c", "d"] and len(found) == 3


# -- filter audit --------------------------------------------------------------------------


def brute_audit(docs, labels):
    first = {}
    for own, text, _ in docs:
        if own is not None:
            first[text or ""] = min(own, first.get(text or "", own))
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    judged = []
    for own, text, lang in docs:
        text = text or ""
        words = WORD.findall(text)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
                 "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), "D": any(c in "#$%&*|" for c in text),
                 "E": own is not None and first[text] < own}
        judged.append((lang or "", fails, own in good, own in toxic))
    rows = []
    for part in {j[0] for j in judged}:
        mine = [j for j in judged if j[0] == part]
        removed_in_all = defaultdict(int)
        new = []
        for order in map("".join, permutations("ABCDE")):
            for step, letter in enumerate(order, 1):
                gone = [any(f[x] for x in order[:step - 1]) for _, f, _, _ in mine]
                here = [f[letter] and not g for g, (_, f, _, _) in zip(gone, mine)]
                removed_in_all[letter] += sum(here)
                new.append((part, order, step, sum(not g and not h for g, h in zip(gone, here)), sum(here),
                            sum(g and m[1][letter] for g, m in zip(gone, mine)),
                            sum(m[1][letter] and sum(m[1].values()) == 1 for m in mine),
                            sum(h and m[2] for h, m in zip(here, mine)), sum(h and m[3] for h, m in zip(here, mine))))
        rows += [(*r, removed_in_all[r[1][r[2] - 1]]) for r in new]
    return sorted(rows)


def test_audit(spark):
    rng = random.Random(1)
    texts = [" ".join(prose(rng, rng.choice([5, 99, 100, 140]))) for _ in range(30)]
    texts += [" ".join(rng.choice(["one", "two", "three"]) for _ in range(120)), "LOUD " * 100, "calm # " * 60, "", None,
              "x" * 200_000, "word " * 30_000, " \t\n\x0b", "ÄÖÜ " * 100]
    docs = [(i, rng.choice(texts), rng.choice(["de", "en", None, ""])) for i in range(400)]
    docs += [(None, texts[0], "de"), (None, texts[0], "de"), (5, texts[1], "fr"), *docs[:20]]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 400, 3)]
    labels += [(None, 1, 1), (3, 1, 1), (3, 0, 0), (9999, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns(
        {"part": F.lit(1), "mask": F.lit("m"), "n": F.lit(7), "digest": F.lit(None).cast("string"), "good": F.lit("g")})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumns(
        {"own_id": F.lit(1), "good": F.lit(False), "n": F.lit(3)})
    found = filter_audit.audit(filter_audit.flagged(df, marks))
    assert sorted(map(tuple, found.collect())) == brute_audit(docs, labels)
    assert filter_audit.audit(filter_audit.flagged(df.limit(0), marks)).collect() == []
    assert filter_audit.audit(filter_audit.flagged(df, marks.limit(0))).agg(F.max("good_lost")).first()[0] == 0


def test_audit_of_other_filters_and_no_overflow(spark):
    """Fields hold any count Spark can: two rows of 2^61 documents each."""
    rows = spark.createDataFrame([("p", True, False, 1 << 61), ("p", True, True, 1 << 61)],
                                 "part string, short boolean, odd boolean, n long")
    found = filter_audit.audit(rows, ("short", "odd"), ()).collect()
    assert {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in found} == {
        ("shortodd", 1): (0, 1 << 62, 0, 1 << 61, (1 << 62) + (1 << 61)), ("shortodd", 2): (0, 0, 1 << 61, 0, 1 << 61),
        ("oddshort", 1): (1 << 61, 1 << 61, 0, 0, 1 << 61),
        ("oddshort", 2): (0, 1 << 61, 1 << 61, 1 << 61, (1 << 62) + (1 << 61))}


def test_texts_are_cut_into_the_same_chunks_either_way():
    rng = random.Random(2)
    for text in ["", " ", "  ", "a", " a", "a ", "a b", "a  b", "a\tb\n c", "\u2581", "a\u2581b c", "ü 語", "a \u2581 b",
                 *("".join(rng.choice("a b\n\u2581") for _ in range(rng.randint(1, 9))) for _ in range(500)),
                 *(" ".join(rng.choice(["x", "yy", "z\n"]) for _ in range(rng.randint(1, 9))) for _ in range(200))]:
        assert pieces.chunks_of(text) == (pieces.CHUNK.findall(" " + text) if text else [])
