"""Operators that judge each row alone: quality, language, personal data."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from helpers import frame, prose
from tallyfold.llm import langid, pii, quality
from tallyfold.llm.common import importable, table
from tallyfold.llm.queries import op1_quality, op4_language

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(autouse=True)
def _workers(spark):
    importable(spark)


def test_quality_holds_out(spark):
    got = op1_quality(spark, SMALL).join(table(spark, SMALL, "labels"), "doc_id").where("held_out")
    right = got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert right >= 0.95
    assert got.where("score < 0 or score > 1 or score is null").isEmpty()


def test_quality_odd_rows(spark):
    rows = [(1, "good words here"), (2, None), (3, ""), (None, "x"), (1, "good words here"), (4, "w " * 50_000)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, None), (None, 1), (9, 0)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    scores = docs.select("doc_id", quality.score(model).alias("s")).collect()
    assert len(scores) == len(rows) and all(0 <= r.s <= 1 for r in scores)
    assert len({r.s for r in scores if r.doc_id == 1}) == 1
    # No labelled row: the constant 0.5; no rows: no rows.
    empty = quality.train(docs, labels.limit(0))
    assert {r.s for r in docs.select(quality.score(empty).alias("s")).collect()} == {0.5}
    assert docs.limit(0).select(quality.score(model)).count() == 0


def test_one_id_on_many_rows_is_one_row_of_the_samples(spark):
    docs = spark.range(20_000).selectExpr("8L as doc_id", "concat('words of row ', id) as text", "'en' as lang")
    labels = spark.createDataFrame([(8, 1)], "doc_id long, quality int")
    assert [r.text for r in quality.labelled(docs, labels, quality.Settings()).collect()] == ["words of row 0"]
    assert langid.learn(docs) == (("en", "words of row 0"),)


def test_language_holds_out(spark):
    got = op4_language(spark, SMALL).where("held_out").join(table(spark, SMALL, "documents"), "doc_id")
    assert got.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] >= 0.97


def test_parse_is_greedy_longest_match():
    rng = random.Random(5)
    sample = {"a": "".join(rng.choice("abc ") for _ in range(300)), "b": "".join(rng.choice("cde ") for _ in range(200))}
    parser = langid.Parser(sample)
    texts = ["".join(rng.choice("abcdez!9") for _ in range(rng.randint(1, 120))) for _ in range(40)]
    found, _ = parser.pieces(texts)
    for text, row in zip(texts, found):
        plain = re.sub(r"[^a-z]+", "\0", text)
        for lang, n in zip(parser.languages, row):
            known = re.sub(r"[^a-z]+", "\0", sample[lang])
            pieces, at = 1, 0
            start = 0
            while at < len(plain):
                if plain[start:at + 1] in known:
                    at += 1
                elif start < at:
                    pieces, start = pieces + 1, at
                    if plain[at] not in known:
                        at, start = at + 1, at + 1
                    else:
                        at += 1
                else:
                    pieces, at, start = pieces + 1, at + 1, at + 1
            assert (n == pieces) or not any(c.isalpha() for c in text)


def test_language_odd_rows(spark):
    rows = [(1, "aaa bbb aab", "x"), (2, "ccc ddd ccd", "y"), (3, None, "x"), (4, "12 !?", "x"), (5, "", None),
            (6, "aab" * 30_000, None), (None, "ccd", "y"), (1, "aaa bbb aab", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [tuple(r) for r in docs.select("doc_id", langid.predicted((("x", "aaa bbb aab"), ("y", "ccc ddd ccd")))
                                         .alias("p")).select("doc_id", "p.lang", "p.score").collect()]
    assert [g[1] for g in got] == ["x", "y", "und", "und", "und", "x", "y", "x"]
    assert all(0 <= g[2] <= 1 for g in got)
    assert langid.learn(docs.limit(0)) == ()
    assert {r[0] for r in docs.select(langid.predicted(()).alias("p")).select("p.lang").collect()} == {"und"}


# The base expressions as they are given.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 12 <= len(digits) <= 19 and pii.luhn(digits):
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(found)


def test_base_spans_equal_the_expressions():
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice("ab1234.@+- ()_%.\n9é") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.luhn("4539578763621486") and not pii.luhn("4539578763621487")


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "a." * 150_000 + "@", "+1" + "." * 300_000, "1111." * 60_000):
        started = time.perf_counter()
        assert pii.base_spans(text) == [] and time.perf_counter() - started < 10


def test_personal_data_found_and_replaced(spark):
    rng = random.Random(2)
    rows = []
    for i in range(60):  # seeds: the same words stand around every phone number
        rows.append((i, f"{' '.join(prose(rng, 5))} please call +1 (555) 555-{1000 + i} before noon {i}"))
    rows += [(100, "x please call (555) 555-9999 before noon"), (101, "a number 12345678 as such"), (102, None), (103, ""),
             (None, "mail a.b@c.de now"), (0, rows[0][1])]
    docs = frame(spark, rows)
    got = {(r.doc_id, r.spans): r for r in pii.digest(docs).collect()}
    assert (100, "phone:14:28") in got  # found by its context alone
    assert got[100, "phone:14:28"].n_phone == 0  # but it is no base span
    assert (101, "") in got and (102, "") in got and (103, "") in got and (None, "email:5:13") in got
    text = rows[0][1]
    spans = ",".join(f"phone:{a}:{b}" for a, _, b in plain_spans(text))
    assert got[0, spans].base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
    clean = pii.redacted(docs)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[100] == "x please call [PHONE] before noon" and texts[None] == "mail [EMAIL] now" and texts[102] is None
    assert pii.digest(docs.limit(0)).count() == 0
