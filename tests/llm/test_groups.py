"""Operators that relate documents: shingle join, passages, vectors, decontamination."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from helpers import corpus, frame, groups, prose, shingles, words
from pyspark.sql import functions as F
from tallyfold.llm import decontam, jaccard, neardup, substring, tokens
from tallyfold.llm.common import components, importable, table


@pytest.fixture(autouse=True)
def _workers(spark):
    importable(spark)


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)]
    got = {r.node: r.component for r in components(spark.createDataFrame([*links, (None, 3), (7, 7)], "a long, b long"))
           .collect()}
    exact = groups({x for link in links for x in link}, links)
    assert got == {node: least for node, least in exact.items() if node != least}


@pytest.mark.parametrize("unique", [True, False])
def test_jaccard_join(spark, unique):
    rows = corpus()
    if unique:  # without repeated and null ids
        rows = [r for i, r in enumerate(rows) if r[0] is not None and r[0] not in {x[0] for x in rows[:i]}]
    sets = [shingles(text) for _, text in rows]
    links = [(i, j) for i, j in combinations(range(len(rows)), 2)
             if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    top = groups(range(len(rows)), links)
    least = {}
    for i, (own, _) in enumerate(rows):
        if own is not None:
            least[top[i]] = min(own, least.get(top[i], own))
    exact = sorted(((own, len(sets[i]), least.get(top[i])) for i, (own, _) in enumerate(rows)), key=str)
    got = sorted((tuple(r) for r in jaccard.joined(frame(spark, rows)).collect()), key=str)
    assert got == exact


def test_jaccard_join_of_nothing(spark):
    assert jaccard.joined(frame(spark, [], "doc_id long, text string")).count() == 0
    got = jaccard.joined(frame(spark, [(5, None), (6, "")])).collect()
    assert sorted(map(tuple, got)) == [(5, 0, 5), (6, 0, 6)]


def test_copies_alone_are_not_followed(spark):
    """Only the row that names a class is routed, so shingles of copies do not count as found elsewhere."""
    text = " ".join(f"w{i}" for i in range(60))
    docs = frame(spark, [(i, text) for i in range(1, 5)] + [(9, "a b c d e f g h")])
    classes = docs.select("doc_id", jaccard.set_key().alias("k")).groupBy("k").agg(F.min("doc_id").alias("id")).select("k.*", "id")
    assert jaccard._routes(docs.select(F.col("doc_id").alias("id"), "text"), classes).count() == 0
    assert {r.component_id for r in jaccard.joined(docs).collect()} == {1, 9}


def test_digests_of_many_sets_are_those_of_each():
    sets = [np.arange(3, 9, dtype=np.uint64), np.zeros(0, np.uint64), np.array([5], np.uint64), np.zeros(0, np.uint64)]
    assert jaccard._digests(sets).T.tolist() == [[len(s), *jaccard._digest(s)] if len(s) else [0, 0, 0] for s in sets]


def test_count_tree_never_loses_a_partner():
    rng = np.random.default_rng(3)
    points = rng.poisson(4, (300, jaccard.GROUPS))
    points[150:] = np.maximum(0, points[:150] + rng.integers(-1, 2, (150, jaccard.GROUPS)) * (rng.random((150, 1)) < .3))
    tree, sizes = jaccard.CountTree(points), points.sum(axis=1)
    for q in range(0, 300, 7):
        bound = np.minimum(points, points[q]).sum(axis=1)
        wanted = (180 * bound >= 80 * (sizes + sizes[q])) & (100 * bound >= 80 * np.maximum(sizes, sizes[q]))
        assert set(np.flatnonzero(wanted)) <= set(tree.partners(q).tolist())


def test_shards_in_rounds_reach_every_pair():
    points = np.full((50, jaccard.GROUPS), 3)
    ids, sides = np.arange(50), np.full(50, 2)
    none = [[] for _ in ids]
    assert len(jaccard.shard_pairs(ids, points, ids.copy(), sides, none)) == 49
    some = jaccard.shard_pairs(ids, points, ids // 25, sides, none, 4)
    assert len(some) == 4 and all(a < 25 <= b for a, b in some)
    assert len(jaccard.shard_pairs(ids, points, ids // 25, sides, none, 1 << 62)) == 625
    failed = [[int(j) for j in ids if j >= 25] if i < 24 else [] for i in ids]
    left = jaccard.shard_pairs(ids, points, ids // 25, sides, failed, 1 << 62)
    assert sorted(left) == [(24, j) for j in range(25, 50)]


def test_leaves_give_forests_then_all():
    points, ids = np.full((8, jaccard.GROUPS), 3), np.arange(8)
    shard = np.repeat([0, 1], 4)
    none = pa.nulls(8, pa.list_(pa.int64()))
    given = lambda failed, forest: jaccard._leaf_pairs(ids, points, ids, shard, failed, forest)
    assert given(none, True) == [(0, 1), (1, 2), (2, 3), (4, 5), (5, 6), (6, 7)]
    assert given(none, False) == [(a + s, b + s) for s in (0, 4) for a, b in combinations(range(4), 2)]
    failed = pa.array([[1, 2], [2], None, None, None, [7], None, None], pa.list_(pa.int64()))
    assert given(failed, True) == [(0, 3), (1, 3), (2, 3), (4, 5), (5, 6), (6, 7)]
    assert (5, 7) not in given(failed, False) and (4, 7) in given(failed, False)


def test_a_pair_of_many_shards_is_given_by_one():
    points = np.full((40, jaccard.GROUPS), 3)
    sides, none = np.full(40, 2), [[] for _ in range(40)]
    shards = {h: np.array([i for i in range(40) if i % 5 != h % 5 or h > 5]) for h in range(1, 30)}
    first = {i: [h for h in shards if i in shards[h]][:jaccard.FIRST] for i in range(40)}
    given = []
    for h, ids in shards.items():
        before = jaccard._earlier(pa.array([[x for x in first[i] if x < h] for i in ids.tolist()], pa.list_(pa.int64())))
        args = points[ids], ids, sides[ids], [none[i] for i in ids], jaccard.ALL, before
        given += jaccard.shard_pairs(ids, *args)
        small = ids[:jaccard.LEAF]
        again = jaccard._leaf_pairs(small, points[small], small, np.zeros(len(small), int), pa.nulls(len(small),
                                    pa.list_(pa.int64())), False, before[:len(small)])
        assert set(again) == {p for p in jaccard.shard_pairs(ids, *args) if set(p) <= set(small.tolist())}
    assert sorted(given) == list(combinations(range(40), 2))


def test_candidates_do_not_multiply_with_the_shards_of_a_pair(spark, monkeypatch):
    rng, given = random.Random(8), spark.sparkContext.accumulator(0)
    base, rows = prose(rng, 400), []
    for i in range(30):  # each like no other, all in the same shards
        near = list(base)
        for place in range(3, 400, 40):
            near[place] = f"own{i}"
        rows.append((i, " ".join(near)))
    plain = jaccard._candidates

    def counted(most):
        def read(batches):
            for batch in plain(most)(batches):
                given.add(batch.num_rows)
                yield batch

        return read

    monkeypatch.setattr(jaccard, "_candidates", counted)
    assert all(r.component_id == r.doc_id for r in
               jaccard.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert 0 < given.value <= 2 * 30 * 29 // 2


@pytest.mark.parametrize("many", [12, 40])
def test_jaccard_join_where_few_pairs_of_a_group_are_alike(spark, many):
    rng = random.Random(many)
    base, rows = prose(rng, 150), []
    for i in range(many):  # a walk: only neighbours are alike, all share most words
        base = list(base)
        for _ in range(2):
            base[rng.randrange(len(base))] = "other"
        rows.append((i * 7 % 41, " ".join(base)))
    sets = {i: shingles(text) for i, text in rows}
    links = [(a, b) for a, b in combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    got = {r.doc_id: r.component_id for r in jaccard.joined(spark.createDataFrame(rows, "doc_id long, text string"))
           .collect()}
    assert got == groups(sorted(sets), links)


def test_passages(spark):
    rng = random.Random(3)
    docs = [prose(rng, rng.randint(0, 300), "abcdefgh") for _ in range(48)]
    shared, holders = [prose(rng, n, "abcdefgh") for n in (60, 80, 55)], {}
    for i in range(0, 48, 4):
        passage = list(shared[i // 4 % 3])
        if i % 8 == 0:
            for _ in range(4):
                passage[rng.randrange(5, len(passage) - 5)] = "changed"
        at = rng.randint(0, len(docs[i]))
        docs[i][at:at] = passage
        holders.setdefault(i // 4 % 3, set()).add(i)
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    got = substring.passages(frame(spark, [*rows, (900, None), (901, ""), rows[5]])).collect()
    for members in holders.values():
        linked = groups(members, [(r.doc_id, r.other_id) for r in got if r.doc_id in members and r.other_id in members])
        assert len(set(linked.values())) == 1
    held = set().union(*holders.values())
    texts = dict(rows)
    for r in got:
        if r.doc_id != r.other_id:
            assert r.doc_id in held and r.other_id in held
        a, b = words(texts[r.doc_id])[r.start:r.end], words(texts[r.other_id])[r.other_start:r.other_end]
        assert min(len(a), len(b)) >= substring.LEAST and r.words <= min(len(a), len(b))
        assert r.share == r.words / max(len(a), len(b)) >= substring.IDENTITY
    assert substring.passages(frame(spark, [], "doc_id long, text string")).count() == 0


def test_chains_score_equals_quadratic():
    rng = random.Random(8)
    for _ in range(60):
        parts = sorted({(rng.randrange(200), rng.randrange(200), 6) for _ in range(25)})
        best = [0.0] * len(parts)
        for i, (a, b, n) in enumerate(parts):
            best[i] = n
            for j in range(i):
                x, y, m = parts[j]
                if x + m <= a and y + m <= b:
                    best[i] = max(best[i], best[j] + n - substring.GAP * (a - x - m + b - y - m))
        found = substring.chains(parts)
        if max(best) >= substring.CHAINED:
            assert found
        for start, end, other, other_end in found:
            assert end > start and other_end > other


def test_vectors(spark):
    rng = np.random.default_rng(2)
    rows, n = [], 0
    for label in (0, 1, None):
        base = rng.standard_normal((60, 16))
        near = base[:20] + rng.standard_normal((20, 16)) * 0.15
        dense = base[0] + rng.standard_normal((150, 16)) * 0.05
        for v in np.concatenate([base, near, dense, base[:3]]):
            rows.append((n, label, [float(x) for x in v.astype(np.float32)]))
            n += 1
    odd = [(n, 0, None), (n + 1, 0, [0.0] * 16), (n + 2, 0, [float("nan")] + [1.0] * 15), (n + 3, 0, [None] + [1.0] * 15),
           (n + 4, 0, [float("inf")] * 16), (n + 5, 0, []), (n + 6, 0, [1.0, 2.0]), (None, 0, [1.0] * 16), rows[0]]
    vectors = spark.createDataFrame([*rows, *odd], "vec_id long, label int, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neardup.linked(vectors).collect()}
    links = []
    unit = {i: np.array(v) / np.linalg.norm(v) for i, label, v in rows if label is not None}
    for (a, la, _), (b, lb, _) in combinations([r for r in rows if r[1] is not None], 2):
        if la == lb and unit[a] @ unit[b] >= neardup.COSINE:
            links.append((a, b))
    ids = {r[0] for r in [*rows, *odd] if r[0] is not None}
    top, many = groups(ids, links), {i: 0 for i in ids}
    for a, b in links:
        many[a] += 1
        many[b] += 1
    assert got == {i: (many[i], top[i], top[i] == i) for i in ids}
    assert neardup.linked(vectors.limit(0)).count() == 0


def test_graph_recall():
    rng = np.random.default_rng(6)
    base = rng.standard_normal((1500, 24))
    units = np.concatenate([base, base[:400] + rng.standard_normal((400, 24)) * 0.1])
    units /= np.linalg.norm(units, axis=1)[:, None]
    graph, found, exact = neardup.Graph(units), set(), set()
    for at in range(0, len(units), 256):
        q, p = graph.within(units[at:at + 256].astype(np.float32), neardup.COSINE, 24)
        found |= set(zip((q + at).tolist(), p.tolist()))
        i, j = np.nonzero(units[at:at + 256] @ units.T >= neardup.COSINE)
        exact |= set(zip((i + at).tolist(), j.tolist()))
    assert len(found & exact) >= 0.9 * len(exact)


def test_decontamination(spark):
    rng = random.Random(9)
    items = [(i, " ".join(prose(rng, n)) + ". " + " ".join(prose(rng, 8))) for i, n in enumerate([9, 20, 30, 45, 60])]
    rows = [(i, " ".join(prose(rng, rng.randint(5, 300)))) for i in range(60)]
    leaked = {}
    for i in range(0, 60, 3):
        item = words(items[i // 3 % 5][1])
        if i % 2:  # a paraphrase: some words changed, one dropped
            item = ["changed" if k % 9 == 4 else w for k, w in enumerate(item) if k != 1]
        text = rows[i][1].split()
        at = rng.randint(0, len(text))
        text[at:at] = item
        rows[i] = (i, " ".join(text))
        leaked[i] = i // 3 % 5
    odd = [(100, None), (101, ""), (None, items[2][1]), rows[1]]
    benchmark = spark.createDataFrame([*items, (7, None), (8, "")], "item_id long, text string")
    got = decontam.contaminated(frame(spark, [*rows, *odd]), benchmark)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {*leaked.items(), (None, 2)}
    assert decontam.contaminated(frame(spark, rows), benchmark.limit(0)).count() == 0
    assert decontam.contaminated(frame(spark, [], "doc_id long, text string"), benchmark).count() == 0


def test_coded_texts_give_back_words_and_passages():
    rng = random.Random(8)
    texts = [" ".join(prose(rng, n, "abc")) for n in (0, 1, 32, 33, 200, 0, 64)] + [None, "x y z"]
    hashes, first, _, _ = tokens.words(pa.array(texts))
    block = decontam.Items([1], [], [], np.unique(hashes[::3]))
    coded, = decontam._coded(block)([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])])
    assert coded.num_rows == len(texts)
    got = [tuple(x.tolist() for x in part) for part in decontam._decoded(coded.slice(1))]
    begin, exact = 0, []
    for t in range(1, len(texts)):
        own = block.numbers(hashes[first[t]:first[t + 1]])
        exact += [(int(w), t - 1, begin + at // decontam.PASSAGE) for at, w in enumerate(own) if w >= 0]
        begin += -(-len(own) // decontam.PASSAGE)
    assert [x for part in got for x in zip(*part, strict=True)] == exact


def test_common_subsequence_equals_quadratic():
    rng = random.Random(10)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(0, 25))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            last = row
            row = [0]
            for k, y in enumerate(b):
                row.append(last[k] + 1 if x == y else max(last[k + 1], row[k]))
        assert decontam.lcs(a, b, len(a)) == row[-1] == substring.common(a, b)


def test_windows_are_summed_for_all_spans():
    steps = np.random.default_rng(4).integers(-9, 9, (40, 3)).astype(np.float32)
    seen = []
    for span, sums in decontam._window_sums(steps, [1, 2, 5, 30, 31, 38, 64, 65]):
        seen.append(span)
        for w in range(40 - span + 1):
            assert sums[w].tolist() == steps[w:w + span].sum(axis=0).tolist()
    assert seen == [1, 2, 5, 30, 31, 38, 64, 65]


def test_windows_with_too_few_words_of_an_item_are_not_aligned():
    places = decontam.places_of([1, 2, 1, 3])
    assert decontam.lcs_of(places, [7, 1, 3, 8, 2], 4) == decontam.lcs([1, 2, 1, 3], [7, 1, 3, 8, 2], 4) == 2
    assert decontam.lcs_of(places, [7, 1, 3, 8, 2], 4, 3.5) == 0 and decontam.lcs_of(places, [], 4) == 0
    assert decontam.lcs_of(places, [1, 9, 2, 1, 3], 4, 4) == 4


def test_an_item_most_documents_hold_is_found(spark):
    rng = random.Random(12)
    common, rare = " ".join(prose(rng, 25)), " ".join(prose(rng, 25))
    rows = [(i, f"{' '.join(prose(rng, 40))} {common} {' '.join(prose(rng, 10))}") for i in range(60)]
    rows += [(100 + i, " ".join(prose(rng, 60))) for i in range(20)] + [(200, f"a b {rare} c d")]
    benchmark = spark.createDataFrame([(1, common), (2, rare), (3, " ".join(prose(rng, 30))),
                                       (4, " ".join(prose(rng, 30)))], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(frame(spark, rows), benchmark).collect()}
    assert got == {*((i, 1) for i in range(60)), (200, 2)}


def test_rows_are_handed_to_python_in_small_batches(spark, tmp_path):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("text "), 800).alias("text"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], names=["size"])

    got = [r.size for r in table(spark, str(tmp_path), "documents").mapInArrow(sizes, "size long").collect()]
    assert sum(got) >= 12_000_000 and max(got) < 5_000_000


def _found(spark, docs):
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    return {(r.doc_id, r.other_id) for r in substring.passages(frame(spark, rows)).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_passages_of_changed_words_are_found(spark, seed):
    rng = random.Random(seed)
    docs, wanted = [], set()

    def put(passage, other):
        docs.append(prose(rng, 40) + passage + prose(rng, 40))
        docs.append(prose(rng, 30) + other + prose(rng, 50))
        wanted.add((len(docs) - 1, len(docs) - 2))

    base = prose(rng, 60)
    put(base, [w if k % 6 != 5 else "changed" for k, w in enumerate(base)])
    base = prose(rng, 50)
    put(base, base[:25] + ["more"] + base[25:])
    for _ in range(20):  # about 85% alike, words left out, put in or changed anywhere
        base = prose(rng, 80)
        other = list(base)
        for _ in range(11):
            k = rng.randrange(len(other))
            other[k:k + 1] = rng.choice(([], ["changed"], [other[k], "more"]))
        put(base, other)
    assert _found(spark, docs) == wanted


@pytest.mark.parametrize("many", [2, 10])  # places of a seed: matched all with all, or by runs
def test_passages_whose_seeds_stand_in_other_documents_too(spark, many):
    rng = random.Random(21)
    passage = prose(rng, 60)
    parts = [part for part in (passage[:35], passage[25:]) for _ in range(many)]  # each too short for a passage
    docs = [prose(rng, 40) + part + prose(rng, 20) for part in [*parts, passage, passage, *parts]]
    assert _found(spark, docs) == {(2 * many + 1, 2 * many)}


def test_a_changed_passage_whose_seeds_all_stand_in_many_documents(spark):
    rng = random.Random(22)
    passage = prose(rng, 60)
    changed = [w if k % 12 != 11 else "changed" for k, w in enumerate(passage)]
    parts = [part for part in (passage[:35], passage[25:]) for _ in range(10)]  # each too short for a passage
    docs = [prose(rng, 40) + part + prose(rng, 20) for part in [*parts, passage, changed, *parts]]
    assert _found(spark, docs) == {(21, 20)}
    rows = [*enumerate(map(" ".join, docs)), (99, None), (98, ""), (21, " ".join(docs[21]))]
    got = substring.grouped(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted(
        [*((i, i if i != 21 else 20) for i in range(42)), (99, 99), (98, 98), (21, 20)])
    assert all([p.other_id for p in r.passages] == ([20] if r.doc_id == 21 else []) for r in got)


def test_places_of_a_seed_are_joined_across_blocks_and_panels(spark, monkeypatch):
    rng = random.Random(23)
    line, kinds = prose(rng, 8), [prose(rng, 60) for _ in range(12)]  # a line many texts hold, between passages some share
    docs = []
    for i in range(96):
        kind = [w if rng.random() > 0.05 else "changed" for w in kinds[i % 12]]
        docs.append(prose(rng, 70) + kind[:30] + line + kind[30:] + prose(rng, 70))
    words_of = [np.array([hash(w) & 0xFFFF for w in d], "<u2")[70 + 30 - 64:70 + 30 + 68] for d in docs]
    ids = np.arange(96)
    for panel in (7, 32, 1024):
        monkeypatch.setattr(substring, "PANEL", panel)
        for before in (ids, ids // 48 * 100, np.where(ids < 80, 0, ids)):
            got = substring.seed_links(ids, ids, before, np.full(96, 2), np.full(96, 64), words_of)
            met = [(a, b) for a in range(96) for b in range(a) if a % 12 == b % 12 and before[a] != before[b]]
            assert groups(range(96), got) == groups(range(96), met)
    sides = ids % 2
    got = substring.seed_links(ids, ids, ids, sides, np.full(96, 64), words_of)
    assert not got  # of each kind all are of one side
    monkeypatch.setattr(substring, "FEW", 2)
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    monkeypatch.setattr(substring, "BLOCK", 24)
    assert {r.doc_id: r.component_id for r in substring.grouped(frame(spark, rows)).collect()} \
        == {i: i % 12 for i in range(96)}


def test_pairs_of_places_fit_as_their_alignment_does():
    rng, own, others, lefts = np.random.default_rng(1), [], [], []
    for _ in range(400):
        n, most = int(rng.integers(1, 80)), rng.choice([0.1, 0.2, 0.3])
        words_of = rng.integers(0, 3000, 4 + 2 * n)
        other = np.where(rng.random(len(words_of)) < most, rng.integers(0, 3000, len(words_of)), words_of)
        other[n:n + 4] = words_of[n:n + 4]
        other = np.insert(other, n + 4 + rng.integers(0, n), rng.integers(0, 3000, rng.integers(0, 6)))
        begin = max(0, n - substring.REACH)
        own.append(words_of[begin:n + 4 + substring.REACH])
        others.append(other[begin:n + 4 + substring.REACH])
        lefts.append(n - begin)
    wanted = [substring.around(a, b, (x, x + 4, x, x + 4)) is not None for a, b, x in zip(own, others, lefts, strict=True)]
    assert 50 < sum(wanted) < 350
    assert substring.fit(own, others, np.array(lefts), np.array(lefts)).tolist() == wanted
    assert not (np.array(wanted) & ~substring._in_common(own, others)).any()


def test_items_of_ordinary_words_beside_rarer_ones_are_found(spark):
    rng = random.Random(14)
    ordinary, rare = prose(rng, 12), prose(rng, 4)
    items = [rare[:1] + ordinary[:5] + rare[1:] + ordinary[5:]] + [prose(rng, 16) for _ in range(60)]
    rows = [prose(rng, 40) + rng.sample(ordinary, 6) + prose(rng, 30) for _ in range(200)]
    for i in range(0, 40, 2):  # between words of other items: as it is, or without its rare words
        around = [w for k in range(4) for w in items[1 + (4 * i + k) % 60][:8]]
        own = [w if i % 4 else "changed" if w in rare else w for w in items[0]]
        rows[i] = prose(rng, 20) + around[:16] + own + around[16:] + prose(rng, 20)
    benchmark = spark.createDataFrame([(k, " ".join(item)) for k, item in enumerate(items)], "item_id long, text string")
    docs = frame(spark, [(i, " ".join(row)) for i, row in enumerate(rows)])
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, benchmark).collect()}
    assert got == {(i, 0) for i in range(0, 40, 2)}


def test_equal_places_are_compared_once(monkeypatch):
    """Copies of a component need not all be compared, and many pairs are aligned as each alone."""
    rng = np.random.default_rng(11)
    one, other, third = (rng.integers(0, 60000, 132).astype("<u2") for _ in range(3))
    third[30:110] = other[30:110]
    rows = [one] * 60 + [other] * 60 + [third] * 60
    labels, seen, ranked = np.repeat([1, 2, 3], 60), [], substring._ranked
    monkeypatch.setattr(substring, "_ranked", lambda rows, *a: seen.append(len(rows)) or ranked(rows, *a))
    found = substring.seed_links(np.arange(180), labels, labels + 10, np.full(180, 2), np.full(180, 64), rows)
    assert [(labels[x], labels[y]) for x, y in found] in ([(2, 3)], [(3, 2)]) and sum(seen) == 3
    pairs = [(a, b, (64, 68, 64, 68)) for a in (one, other, third) for b in (one, other, third)]
    assert substring.around_each(pairs) == [substring.around(*p) for p in pairs]
    assert substring.around(other, third, (64, 68, 64, 68)) == (30, 110, 30, 110, 80)


def _hidden(rng, passage):
    """Texts that hold parts of a passage, so that all its seeds are frequent; none holds a passage."""
    parts = [passage[k:k + 35] for k in range(0, len(passage) - 34, 20)] + [passage[-35:]]
    return [prose(rng, 40) + part + prose(rng, 20) for part in parts for _ in range(18)]


def test_passages_of_frequent_seeds_are_found_within_a_component(spark):
    rng = random.Random(31)
    shared, passage = prose(rng, 60), prose(rng, 60)  # the first joins both texts, the other stands in them as well
    docs = [prose(rng, 20) + shared + prose(rng, 80) + passage + prose(rng, 20), *_hidden(rng, passage),
            prose(rng, 90) + passage + prose(rng, 70) + shared]
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    got = substring.passages(frame(spark, rows)).collect()
    assert {(r.doc_id, r.other_id) for r in got} == {(len(docs) - 1, 0)}
    assert len(got) == 2
    for text in (shared, passage):
        assert any(set(text) <= set(docs[r.doc_id][r.start:r.end]) & set(docs[0][r.other_start:r.other_end]) for r in got)


def test_a_long_passage_of_frequent_seeds_is_found_whole(spark):
    rng = random.Random(32)
    passage = prose(rng, 300)
    docs = [prose(rng, 30) + passage + prose(rng, 30), *_hidden(rng, passage), prose(rng, 50) + passage + prose(rng, 30)]
    got = substring.passages(frame(spark, [(i, " ".join(d)) for i, d in enumerate(docs)])).collect()
    assert [(r.doc_id, r.other_id) for r in got] == [(len(docs) - 1, 0)]
    assert got[0].words >= 300 and got[0].start <= 50 and got[0].end >= 350


def test_each_place_that_lies_in_a_passage_gets_one():
    rng = np.random.default_rng(12)
    one, other = (rng.integers(0, 60000, 132).astype("<u2") for _ in range(2))
    contexts = [one, one, other, other, rng.integers(0, 60000, 132).astype("<u2")]
    ids, ones, full = np.arange(5), np.full(5, 1), np.full(5, 64)
    found = substring.seed_links(ids, ones, ids, np.full(5, 2), full, contexts)
    assert sorted(sorted(p) for p in found) == [[0, 1], [2, 3]]  # although all are of one component
    held = np.array([True, True, True, False, False])
    assert [sorted(p) for p in substring.seed_links(ids, ones, ids, np.full(5, 2), full, contexts, ids, held)] == [[2, 3]]
    assert not substring.seed_links(ids, ones, ids, np.full(5, 2), full, contexts, ids, np.full(5, True))
