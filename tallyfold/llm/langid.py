"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of labelled text is built.  A text is parsed from left to
right into the longest pieces that occur in the sample; the language that needs the fewest pieces, weighted by what
naming a place in its sample costs (the logarithm of the sample's length), wins.  All letters count, lower-cased;
every run of other characters is one separator.

Parsing runs in step over many texts at once: a step is one table look-up for all of them.  To bound the number of
steps, parsing starts anew after ``LANE`` symbols of a text, which adds at most one piece there; all symbols count.

Defined results: texts that are null or without a letter are ``und`` with score 0; ties go to the language that
sorts first; without labelled text all are ``und``.  Repeated rows get equal results; of rows of one id and language
only the smallest text can be in the sample.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import text_batches

FOLDS, HELD_OUT = 4, 2
SAMPLE_TEXTS = 200  #: texts looked at for each language
SAMPLE_SYMBOLS = 20_000  #: most symbols of a language's sample
MOST_SYMBOLS = 160_000  #: of all samples together, whatever the number of languages
LANE = 2048
_table: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if "letters" not in _table:
        _table["letters"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _table["letters"]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def symbols(points: np.ndarray) -> np.ndarray:
    """Letters as they are, each run of other characters as one 0."""
    marked = np.where(_letters()[points], points, 0)
    again = np.zeros(len(marked), bool)
    again[1:] = (marked[1:] == 0) & (marked[:-1] == 0)
    return marked[~again]


def automaton(sample: np.ndarray, alphabet: int) -> np.ndarray:
    """Suffix automaton of the symbols as a table state x symbol -> state (-1: none)."""
    longest, link, moves = [0], [-1], [{}]
    last = 0
    for c in sample.tolist():
        new = len(longest)
        longest.append(longest[last] + 1)
        link.append(0)
        moves.append({})
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if longest[p] + 1 == longest[q]:
                link[new] = q
            else:
                copy = len(longest)
                longest.append(longest[p] + 1)
                link.append(link[q])
                moves.append(dict(moves[q]))
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    table = np.full((len(longest), alphabet), -1, np.int64)
    for state, to in enumerate(moves):
        if to:
            table[state, list(to)] = list(to.values())
    return table


class Parser:
    """The automata of all languages in one table; an entry is the next row, negative where a new piece begins."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        points = {k: symbols(code_points(v)) for k, v in samples.items()}
        known = np.unique(np.concatenate([*points.values(), np.zeros(1, np.uint32)]))
        self.known, self.width = known, len(known) + 1  # the last column: letters of no sample
        tables, base = [], 0
        self.roots = []
        for k in self.languages:
            table = automaton(np.searchsorted(known, points[k]), self.width)
            fresh = table[0]
            begun = np.where(fresh < 0, 0, fresh)  # a new piece begins with the symbol, or after it if it is unknown
            table = np.where(table >= 0, (table + base) * self.width, -((begun + base) * self.width) - 1)
            self.roots.append(base * self.width)
            tables.append(table)
            base += len(table)
        self.table = np.concatenate(tables).astype(np.int32).ravel()
        self.cost = np.array([math.log2(max(2, len(points[k]))) for k in self.languages])

    def pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces by text and language; whether the text has a letter."""
        coded, lanes, owner = [], [], []
        has = np.zeros(len(texts), bool)
        for i, text in enumerate(texts):
            points = symbols(code_points(text.lower()))
            has[i] = bool(points.any())
            if has[i]:
                at = np.minimum(np.searchsorted(self.known, points), len(self.known) - 1)
                points = np.where(self.known[at] == points, at, self.width - 1).astype(np.int32)
                for begin in range(0, len(points), LANE):
                    coded.append(points[begin:begin + LANE])
                    lanes.append(len(coded[-1]))
                    owner.append(i)
        found = np.zeros((len(texts), len(self.languages)))
        if not coded:
            return found, has
        sizes = np.array(lanes)
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        grid = np.zeros((sizes[0], len(sizes)), np.int32)  # one row for each step
        for column, k in enumerate(order):
            grid[:sizes[column], column] = coded[k]
        active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")
        many = len(self.languages)
        state = np.repeat(np.array(self.roots, np.int32)[:, None], len(sizes), axis=1)
        count = np.ones((many, len(sizes)), np.int32)
        for step in range(sizes[0]):
            n = active[step]
            to = self.table[state[:, :n] + grid[step, :n]]
            new = to < 0
            count[:, :n] += new
            state[:, :n] = np.where(new, ~to, to)
        np.add.at(found, np.array(owner)[order], count.T)
        return found, has

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        languages, scores = [], np.zeros(len(texts))
        for start, part in text_batches(texts, 1 << 20):
            found, has = self.pieces([x or "" for x in part.to_pylist()])
            needed = found * self.cost
            best = needed.argmin(axis=1) if needed.shape[1] else None
            for i in range(len(part)):
                if not has[i] or best is None:
                    languages.append("und")
                    continue
                languages.append(self.languages[best[i]])
                rest = np.delete(needed[i], best[i])
                scores[start + i] = 1 - needed[i, best[i]] / rest.min() if len(rest) else 1.0
        return languages, scores


@lru_cache(maxsize=2)
def _parser(samples: tuple[tuple[str, str], ...]) -> Parser:
    return Parser(dict(samples))


def learn(docs: DataFrame) -> tuple[tuple[str, str], ...]:
    """A bounded sample of text for each language, from rows outside the held-out fold."""
    place = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    rows = (docs.select("doc_id", "lang", "text").where("lang is not null and text is not null and doc_id is not null")
            .where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != HELD_OUT))
    # Only ids are ranked; the few chosen texts are then looked up.
    chosen = (rows.select("doc_id", "lang").withColumn("place", F.row_number().over(place))
              .where(F.col("place") <= SAMPLE_TEXTS).drop("place").distinct())
    many = max(1, rows.select("lang").distinct().count())
    most = max(200, min(SAMPLE_SYMBOLS, MOST_SYMBOLS // many))
    # An id on many rows of a language gives the smallest of its texts.
    picked = (rows.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("lang", "doc_id")
              .agg(F.min(F.substring("text", 1, most)).alias("text")).toPandas())
    samples = []
    for lang, group in picked.groupby("lang"):
        taken, used, seen = [], 0, set()
        share = max(200, most // 16)  # of one text, so that a few long ones don't fill the sample
        for text in group.sort_values(["doc_id", "text"])["text"].str.lower():
            if used < most and text not in seen and any(c.isalpha() for c in text[:share]):
                taken.append(text[:min(share, most - used)])
                seen.add(text)
                used += len(taken[-1])
        if taken:
            samples.append((lang, " ".join(taken)))
    return tuple(samples)


def predicted(samples: tuple[tuple[str, str], ...], text: str = "text") -> Column:
    """A struct of language and score of a text column."""
    @F.arrow_udf("lang string, score double")
    def parsed(texts: pa.Array) -> pa.Array:
        languages, scores = (_parser(samples).predict(texts) if samples else
                             (["und"] * len(texts), np.zeros(len(texts))))
        return pa.StructArray.from_arrays([pa.array(languages, pa.string()), pa.array(scores, pa.float64())],
                                          names=["lang", "score"])

    return parsed(F.col(text))
