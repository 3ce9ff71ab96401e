"""Packing, sharding, page extraction and the pipeline."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from helpers import corpus, frame, prose, shingles
from tallyfold.llm import html, packing, pii, sharding
from tallyfold.llm.common import importable, stored, table

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def _workers(spark):
    importable(spark)


def check_packing(rows, found):
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    exact = []
    for own, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]
        for k, at in enumerate(range(0, len(ids), packing.CAPACITY)):
            part = np.array(ids[at:at + packing.CAPACITY], "<u4")
            exact.append((own, k, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found), key=str) == sorted(exact, key=str)
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    return len(sequences), sum(x[3] for x in exact)


def test_packing(spark):
    rows = corpus() + [(700, "long words and more " * 6000), (701, "it's <|endoftext|> don't\x1cÉté 12,5!? 's")]
    sequences, total = check_packing(rows, packing.packed_documents(frame(spark, rows)).collect())
    assert sequences == -(-total // packing.CAPACITY)
    assert packing.packed_documents(frame(spark, [], "doc_id long, text string")).count() == 0


def test_partitions_exchange_what_is_left(spark):
    rng = random.Random(5)
    lengths = [rng.choice([1500, 1400, 1300, 700, 3000, 100, 2000]) for _ in range(400)]
    rows = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)],
                                 "doc_id long, piece int, start long, length long, ids_crc32 long")
    found = packing.pack(rows, per_part=40).collect()
    assert len(found) == 400 and len({r.doc_id for r in found}) == 400
    used = len({r.sequence_id for r in found})
    bound = packing.least_bins(np.array(lengths))
    alone = sum(len(set(packing.best_fit_decreasing(np.array(sorted(lengths[k::10], reverse=True)))[0]))
                for k in range(10))
    assert bound <= used < alone


def test_rows_alike_are_dealt_evenly(spark):
    same = stored(spark.range(20_000, numPartitions=4).selectExpr("cast(null as long) as doc_id", "0 as piece", "0L as start",
                                                           "9L as length", "9L as ids_crc32"), "same")
    parts = packing.placed(same).groupBy(F.pmod("place", F.lit(50))).count().agg(F.count("*"), F.max("count")).first()
    assert parts[0] == 50 and parts[1] < 600
    found = packing.pack(same, per_part=1000).collect()
    assert len(found) == 20_000 and len({(r.sequence_id, r.offset) for r in found}) == 20_000
    assert len({r.sequence_id for r in found}) <= 20 * 3  # in 20 parts, each as few as its bound allows


def test_plain_words_are_only_cut_at_blanks(monkeypatch):
    """Only words that are not letters with signs go through all that the tokenizer does to whole texts."""
    texts = ["Plain words, (here) AND there. \u00c4pfel, caf\u00e9; again plain", None, "", "  a  b ", "x_y __ ... a.b.c 1234 a1 1a '' a'",
             "H\u0331a A\u0301b J\u030cx a\u0301 !\u0301", "Don't DON'T'S it's. 'll", "<|ENDOFTEXT|> <|endoftext|>. w.<|endoftext|>",
             "\u00d7a \u00f7 \u00dfA \u0130x \ufb01 \u2167", "a\u00a0b c\u2003d\x1ce\x0bf"]
    whole = Tokenizer.from_file(packing.tokenizer_path())
    words, sent = packing.Words(packing.tokenizer_path()), []
    encoded = words._encoded
    monkeypatch.setattr(words, "_encoded", lambda some: sent.extend(some) or encoded(some))
    for _ in range(2):
        assert words.ids(pa.array(texts)) == [
            np.array(whole.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert not {"Plain", "words,", "there.", "\u00c4pfel,", "again"} & {x for text in sent for x in text.split(" ")}
    assert not {"plain", "words", "\u00e4pfel", "b"} & {x for text in sent for x in text.split(" ")}


def test_personal_data_takes_one_worker_a_task(spark):
    """Each step of Python in a task is a worker, and a scan that a filter repeats is done twice."""
    docs = frame(spark, [(1, "call (555) 201-3344 or write to a.b@example.com now"), (2, None), (3, "")])
    for made in (pii._tokens(docs), pii.redacted(docs)):
        assert made._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [r.text_hash is not None and len(r.seen) for r in pii._tokens(docs).collect()] == [2]


def test_bounds_hold_against_exact_packing():
    rng = random.Random(6)

    def exact(items, capacity):
        best = [len(items)]

        def place(k, bins):
            if len(bins) >= best[0]:
                return
            if k == len(items):
                best[0] = len(bins)
                return
            for b in sorted(set(bins)):
                if b >= items[k]:
                    rest = list(bins)
                    rest[rest.index(b)] -= items[k]
                    place(k + 1, rest)
            place(k + 1, [*bins, capacity - items[k]])

        place(0, [])
        return best[0]

    for _ in range(60):
        items = sorted((rng.randint(1, 20) for _ in range(9)), reverse=True)
        least, made = packing.least_bins(np.array(items), 20), packing.best_fit_decreasing(np.array(items), 20)[0].max() + 1
        assert least <= exact(items, 20) <= made


@pytest.mark.parametrize("shards", [8, 5])
def test_sharding(spark, shards):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "src", None if i is None else "en") for i, t in rows],
                                 "doc_id long, text string, source string, lang string")
    found = sharding.sharded(docs, shards).collect()
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in found) == sorted(
        (i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots, where = {}, {}
    for r in found:
        slots.setdefault(r.shard, []).append(r.slot)
        assert where.setdefault((r.size, r.text_crc32), r.shard) == r.shard  # equal texts stay together
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))


def test_shards_are_balanced_and_chunks_numbered(spark):
    docs = table(spark, SMALL, "documents")
    found = sharding.sharded(docs, 8)
    size = [r.b for r in found.groupBy("shard").agg({"size": "sum"}).withColumnRenamed("sum(size)", "b").collect()]
    largest = found.agg({"size": "max"}).first()[0]
    assert len(size) == 8 and max(size) - min(size) <= 2 * largest
    chunked = sharding.numbered(found.drop("slot"), chunk_rows=17).collect()
    for s in {r.shard for r in chunked}:
        own = sorted(r.slot for r in chunked if r.shard == s)
        assert own == list(range(len(own)))
    assert sharding.sharded(docs.limit(0), 8).count() == 0


PAGE = ("<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=x>Menu</a></li></ul></nav>"
        "<div class='ad'>Buy</div><{tag}><h1>Head &amp; line</h1><p><b>First<br>line.<p>Second&nbsp; \n one</p>"
        "<script>var t='</p>';</script><aside>By the way</aside><!-- <p>hidden</p> --><ul><li>item</ul></{tag}>"
        "<section class='comments'><p>me first</p></section><footer>&copy; us</footer></body></html>")
TEXT = "Head & line\n\nFirst line.\n\nSecond one\n\nitem"


def test_pages(spark):
    rows = [(i, f"https://a.example/{i}", PAGE.replace("{tag}", "article")) for i in range(30)]
    rows += [(100, "https://a.example/other", PAGE.replace("{tag}", "main")), (101, None, PAGE.replace("{tag}", "article")),
             (102, "https://b.example/", None), (103, "https://b.example/", ""), (104, "x", "<p>plain &lt;text"),
             (105, "https://c.example", "<article><p>open <b>only"), (0, "https://a.example/0", rows[0][2]),
             (106, "https://d.example", "<div id=main-content><p>deep</p></div><div class=sidebar>no</div>"),
             (107, "https://e.example", "<" * 2000 + "a" * 2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r.page_id): (r.text, r.n_chars) for r in html.extracted(pages).collect()}
    for i in (*range(30), 100, 101):
        assert got[i] == (TEXT, len(TEXT)), i
    assert got[102] == got[103] == ("", 0)
    assert got[104][0] == "plain <text" and got[105][0] == "open only" and got[106][0] == "deep"
    assert html.extracted(pages).count() == len(rows) and html.extracted(pages.limit(0)).count() == 0


def test_pipeline_stages(spark):
    docs = table(spark, SMALL, "documents")
    columns = docs.columns
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, corpus_pipeline.stored(stage(spark, kept, SMALL), "test-stage")
        assert kept.columns == columns
        texts = {r.doc_id: r.text for r in kept.collect()}
        assert set(texts) <= {r.doc_id for r in before.collect()}
        if name == "near copies":
            sets = [shingles(t) for t in texts.values()]
            assert not any(a and b and 100 * len(a & b) >= 80 * len(a | b)
                           for i, a in enumerate(sets) for b in sets[:i])
        if name == "personal data":
            assert not any(pii.base_spans(t or "") for t in texts.values())
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    check_packing(rows, corpus_pipeline.STAGES[-1][1](spark, kept, SMALL).collect())


def test_stages_take_empty_tables(spark):
    docs = table(spark, SMALL, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).count() == 0


def test_stages_keep_columns_of_any_name(spark):
    docs = frame(spark, [(1, "mail a.b@c.de now"), (2, None), (3, "w " * 60_000), (None, "")])
    for _, stage in corpus_pipeline.STAGES[2:4]:
        got = stage(spark, docs, SMALL)
        assert got.columns == docs.columns
        rows = {r.doc_id: r for r in got.collect()}
        assert len(rows) == 4 and all((r.leaks, r.text_hash, r.added, r.row) == (1, "t", "a", 2) for r in rows.values())


def test_near_copies_of_repeated_and_null_ids(spark):
    rng = random.Random(5)
    one, two, three, four = (" ".join(prose(rng, 60)) for _ in range(4))
    rows = [(1, one), (2, one + " more"), (2, two), (2, two), (3, three), (3, four), (None, three + " more"),
            (None, "a " + one), (4, ""), (4, ""), (5, None), (None, None)]
    lone = " ".join(prose(rng, 60))
    rows += [(None, lone), (None, lone + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.drop_near_copies(spark, docs, SMALL).collect()]
    assert sum(r in ((None, lone), (None, lone + " more")) for r in got) == 1
    assert sorted((r for r in got if not (r[1] or "").startswith(lone)), key=str) == sorted(
        [(1, one), (2, two), (3, three), (3, four), (4, ""), (5, None), (None, None)], key=str)


@pytest.mark.parametrize("host", ["https://many.example/", ""])
def test_a_host_of_many_layouts_keeps_its_articles(spark, host):
    rows = [(i, f"{host}{i}" if host else None, f'<html><body class="{c * 3}"><div>Menu of the site</div>'
             f"<article><p>Text {i}.</p></article><div>See also</div></body></html>")
            for i, c in enumerate("abcdefghijklmnopqrstuvwx")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html.extracted(pages).collect()} == {i: f"Text {i}." for i in range(len(rows))}
