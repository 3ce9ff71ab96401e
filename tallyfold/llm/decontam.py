"""Benchmark decontamination by latent semantic retrieval.

Passages of the corpus are TF-IDF vectors over the words of the benchmark; document frequencies are counted over all
documents.  A randomised SVD (subspace iteration) finds the leading directions of all passages: each pass projects
every passage and sums the projections back by word, in tasks of bounded memory.  Windows about as long as a benchmark
item are compared with it in that space; those that point its way (cosine) and reach far enough along it are
candidates.  A candidate leaks the item if the
longest common subsequence of their words covers most of the item and also most of its answer (its last sentence).

That space loses items of ordinary words and items beside rarer words of other items, so a second, exact source of
candidates stands next to it: a window that leaks an item holds ``SHARE`` of its words.  Then at least one of its rarest
words is there, one more than may be missing; an inverted list of these gives the items of a text, the words that the
text holds at all sort most of them out, and of the rest every window that holds enough is compared.

The benchmark is the stated query set: it is split into blocks of at most ``BLOCK_WORDS`` words, each compared with all
documents, so what tasks carry has a fixed bound (words x rank numbers) whatever the benchmark's size.  Documents are
never shuffled.

Defined results: null and empty texts leak nothing; items that are null or without words are ignored, items of fewer
than ``SHORT`` words must occur whole; repeated rows get equal results; without items nothing leaks.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm import tokens
from tallyfold.llm.common import stored, text_batches

RANK, STEP, PASSAGE = 64, 8, 32  #: of the latent space; words between window starts; words of a fitted passage
COSINE, ALONG, SHARE, ANSWER_SHARE, SHORT = 0.35, 0.5, 0.7, 0.5, 8
FREQUENT = 0.05  #: share of documents that makes a word frequent
PAIRS = 1 << 14  #: texts and items whose words are looked up at once
BLOCK_WORDS = 100_000
NEAR = 16  #: steps by which sums of windows are made longer one by one
CHUNK = 512  #: words whose sums travel together
SALTS = 16
LEAK = "item_id long, start long, end long, common int, share double"


@dataclass
class Items:
    """Items of one block: their words as numbers of the vocabulary, and what of them is the answer."""

    ids: list[int]
    words: list[np.ndarray]  #: vocabulary numbers in order
    answers: list[int]  #: where the answer begins
    vocabulary: np.ndarray  #: sorted word hashes
    idf: np.ndarray = field(default=None)
    basis: np.ndarray = field(default=None)  #: word x rank, weighted by idf
    df: np.ndarray = field(default=None)  #: documents that hold a word

    def __post_init__(self):
        # Most words of the corpus are not in the vocabulary: a small table tells quickly.
        self.bits = 20
        self.maybe = np.zeros(1 << self.bits, bool)
        self.maybe[self._slot(self.vocabulary)] = True

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary number of each word, -1 for others."""
        found = np.full(len(hashes), -1, np.int32)
        at = np.flatnonzero(self.maybe[self._slot(hashes)])
        place = np.minimum(np.searchsorted(self.vocabulary, hashes[at]), len(self.vocabulary) - 1)
        hit = self.vocabulary[place] == hashes[at]
        found[at[hit]] = place[hit]
        return found


def read_items(benchmark: DataFrame) -> list[Items]:
    """The benchmark in blocks of bounded size, in order of id."""
    rows = [r for r in benchmark.select("item_id", "text").where("text is not null").distinct().toLocalIterator()]
    rows.sort(key=lambda r: (r.item_id is None, r.item_id, r.text))
    blocks: list[Items] = []
    ids, hashed, answers, used = [], [], [], 0

    def close() -> None:
        vocabulary = np.unique(np.concatenate(hashed))
        blocks.append(Items(list(ids), [np.searchsorted(vocabulary, h).astype(np.int32) for h in hashed],
                            list(answers), vocabulary))

    for row in rows:
        found, _, starts, _ = tokens.words(pa.array([row.text]))
        if not len(found):
            continue
        if used and used + len(found) > BLOCK_WORDS:
            close()
            ids, hashed, answers, used = [], [], [], 0
        sentences = [m.end() for m in re.finditer(r"[.!?][\s]+", row.text) if m.end() < len(row.text.rstrip())]
        last = len(row.text[:sentences[-1]].encode()) if sentences else 0
        begin = int(np.searchsorted(starts, last))
        ids.append(row.item_id)
        hashed.append(found)
        answers.append(begin if 0 < begin < len(found) else max(0, len(found) - max(3, len(found) // 4)))
        used += len(found)
    if ids:
        close()
    return blocks


def _numbered(texts: pa.Array, items: Items) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of parts of a text column: first row, vocabulary number of all words, first word of each text."""
    for start, part in text_batches(texts):
        hashes, first, _, _ = tokens.words(part)
        yield start, items.numbers(hashes), first


def _binary(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Parts of an array as the rows of a binary column."""
    offsets = (cuts * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def _parts(rows: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a binary column one after the other, and how many each row has."""
    rows = rows.cast(pa.large_binary())
    offsets = np.frombuffer(rows.buffers()[1], np.int64)[rows.offset:rows.offset + len(rows) + 1]
    data = np.frombuffer(rows.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]].view(kind)
    return data, np.diff(offsets) // data.itemsize


def _coded(items: Items):
    """Of each text its words that are in the vocabulary, and how many of them each passage holds."""
    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, numbers, first in _numbered(batch["text"], items):
                at, sizes = np.flatnonzero(numbers >= 0), np.diff(first)
                text = np.repeat(np.arange(len(sizes)), sizes)[at]
                # Passages get numbers of their own: at most one for each PASSAGE words and text.
                begin = np.cumsum(np.concatenate([[0], -(-np.diff(first) // PASSAGE)]))
                held = np.bincount(begin[text] + (at - first[text]) // PASSAGE, minlength=begin[-1]).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([_binary(numbers[at], np.searchsorted(at, first)),
                                                  _binary(held, begin)], names=["words", "held"])

    return code


def _decoded(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Words of the vocabulary in some texts of a batch, with the numbers of their texts and passages."""
    for start, part in text_batches(batch["words"]):
        words, sizes = _parts(part, "<i4")
        held, _ = _parts(batch["held"].slice(start, len(part)), "u1")
        yield words, np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.arange(len(held)), held)


def _frequencies(size: int):
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for words, text, _ in _decoded(batch):
                both = np.unique(text * size + words)
                total += np.bincount(both % size, minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["word", "df"])

    return count


def _passages(words: np.ndarray, passage: np.ndarray, weight: np.ndarray):
    """Unit vectors of passages as (passage, word, value), ordered by passage."""
    at = np.flatnonzero(weight[words] > 0)
    both, count = np.unique(passage[at] * len(weight) + words[at], return_counts=True)
    row, word = both // len(weight), both % len(weight)
    value = count * weight[word]
    if not len(row):
        return row, word, value
    begins = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    lengths = np.diff(np.append(begins, len(row)))
    norm = np.sqrt(np.add.reduceat(value * value, begins))
    return np.repeat(np.arange(len(begins)), lengths), word, value / np.repeat(np.maximum(norm, 1e-12), lengths)


def _projected(weight: np.ndarray, basis: np.ndarray):
    """Sums over all passages a of a (a . basis), by chunk of words."""
    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(basis.shape)
        for batch in batches:
            for words, _, passage in _decoded(batch):
                row, word, value = _passages(words, passage, weight)
                if not len(row):
                    continue
                value = value.astype(np.float32)[:, None]
                begins = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                latent = np.add.reduceat(basis[word] * value, begins)
                order = np.argsort(word, kind="stable")
                back = latent[row[order]] * value[order]
                word = word[order]
                begins = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
                total[word[begins]] += np.add.reduceat(back, begins)
        yield _chunks(total)

    return project


def _chunks(total: np.ndarray) -> pa.RecordBatch:
    chunks = range(0, len(total), CHUNK)
    return pa.RecordBatch.from_arrays([
        pa.array([c // CHUNK for c in chunks], pa.int32()),
        pa.array([total[c:c + CHUNK].astype("<f8").tobytes() for c in chunks], pa.binary())], names=["chunk", "sums"])


def _summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the rows of a task, one running sum for each chunk."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, sums in zip(batch["chunk"].to_pylist(), batch["sums"].to_pylist(), strict=True):
            values = np.frombuffer(sums, "<f8")
            total[chunk] = total[chunk] + values if chunk in total else values
    yield pa.RecordBatch.from_arrays([
        pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())],
        names=["chunk", "sums"])


def _pass(coded: DataFrame, items: Items, basis: np.ndarray) -> np.ndarray:
    """A'A basis, A being all passages; the driver gets SALTS partial sums of words x rank numbers."""
    schema = "chunk int, sums binary"
    rows = (coded.mapInArrow(_projected(items.idf, basis.astype(np.float32)), schema)
            .withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
            .repartition(SALTS, "salt").drop("salt").mapInArrow(_summed, schema))
    out = np.zeros(basis.shape)
    for row in rows.toLocalIterator():
        part = np.frombuffer(row.sums, "<f8").reshape(-1, basis.shape[1])
        out[row.chunk * CHUNK:row.chunk * CHUNK + len(part)] += part
    return out


def fit(docs: DataFrame, items: Items, rank: int = RANK) -> Items:
    """Weights and latent directions of one block's vocabulary, from all documents.

    Texts are read and cut into words once; the passes go over the numbers of their words, stored as small as they are.
    """
    size = len(items.vocabulary)
    coded = stored(docs.select("text").mapInArrow(_coded(items), "words binary, held binary"), "block-words")
    counted = (coded.mapInArrow(_frequencies(size), "word long, df long").groupBy("word").agg(F.sum("df").alias("df"))
               .toArrow())
    df = np.zeros(size)
    df[counted["word"].to_numpy()] = counted["df"].to_numpy()
    items.df = df
    many = coded.count()
    # Frequent words say nothing about a passage and are most of all words: they get no weight.
    items.idf = np.where(df > max(20, FREQUENT * many), 0, np.log((many + 1) / (df + 1)) ** 2 + 1e-3)
    rank = min(rank, size)
    start = np.random.default_rng(7).standard_normal((size, rank))
    directions, _ = np.linalg.qr(_pass(coded, items, start) + 1e-9 * start)
    again = _pass(coded, items, directions)
    values, turn = np.linalg.eigh(directions.T @ again)
    # Half whitened: the few strongest directions don't drown the rest.
    order = np.argsort(-values)
    scale = np.maximum(values[order], 1e-9 * max(1e-9, values.max())) ** -0.25
    items.basis = ((directions @ turn[:, order]) * scale * items.idf[:, None]).astype(np.float32)
    return items


def places_of(words: list[int]) -> dict[int, int]:
    """Where each word stands, as bits."""
    places: dict[int, int] = {}
    for i, x in enumerate(words):
        places[x] = places.get(x, 0) | 1 << i
    return places


def lcs(a: list[int], b: list[int], length: int) -> int:
    """Length of the longest common subsequence, bit-parallel; ``length`` is that of ``a``."""
    return lcs_of(places_of(a), b, length)


def lcs_of(places: dict[int, int], b: list[int], length: int, least: float = 0) -> int:
    """The same by the places of ``a``; less than ``least`` may be given as 0."""
    there = [places[x] for x in b if x in places]
    if len(there) < least:
        return 0
    full = (1 << length) - 1
    row = full
    for x in there:
        both = row & x
        row = ((row + both) | (row - both)) & full
    return length - row.bit_count()


class Rarest:
    """Inverted list of the rarest words of each item: one more than a leak may leave out."""

    def __init__(self, block: Items):
        sizes = np.array([len(w) for w in block.words])
        self.needed = np.where(sizes < SHORT, sizes, np.ceil(SHARE * sizes - 1e-9)).astype(np.int64)
        self.words, self.first = np.concatenate(block.words), np.concatenate([[0], np.cumsum(sizes)])
        size = len(block.vocabulary)
        keys = [np.unique(w[np.argsort(block.df[w], kind="stable")[:len(w) - need + 1]]).astype(np.int64) * len(sizes) + i
                for i, (w, need) in enumerate(zip(block.words, self.needed.tolist(), strict=True))]
        keys = np.sort(np.concatenate(keys))
        self.items, self.size = keys % len(sizes), size
        self.begin = np.searchsorted(keys // len(sizes), np.arange(size + 1))

    def reached(self, numbers: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts and items of which the text holds enough words to leak them."""
        at, sizes = np.flatnonzero(numbers >= 0), np.diff(first)
        held = np.unique(np.repeat(np.arange(len(sizes)), sizes)[at] * self.size + numbers[at])
        text, word = held // self.size, held % self.size
        many = self.begin[word + 1] - self.begin[word]
        into = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.begin[word], many)
        pairs = np.unique(np.repeat(text, many) * len(self.needed) + self.items[into])
        text, item = pairs // len(self.needed), pairs % len(self.needed)
        enough = np.zeros(len(pairs), bool)
        for lo in range(0, len(pairs), PAIRS):
            t, i = text[lo:lo + PAIRS], item[lo:lo + PAIRS]
            sizes = self.first[i + 1] - self.first[i]
            cuts = np.cumsum(sizes) - sizes
            words = self.words[np.arange(sizes.sum()) - np.repeat(cuts, sizes) + np.repeat(self.first[i], sizes)]
            keys = np.repeat(t, sizes) * self.size + words
            there = held[np.minimum(np.searchsorted(held, keys), len(held) - 1)] == keys
            enough[lo:lo + PAIRS] = np.add.reduceat(there.astype(np.int64), cuts) >= self.needed[i]
        return text[enough], item[enough]


def leaks(items: Items, text: str = "text") -> Column:
    """The items that a text leaks, with the words (from, to) of the best window."""
    shared = {"items": items}

    @F.arrow_udf("array<struct<" + LEAK.replace(" ", ":").replace(",:", ",") + ">>")
    def search(texts: pa.Array) -> pa.Array:
        block = shared["items"]
        if "latent" not in shared:
            shared["latent"] = np.stack([block.basis[w].sum(axis=0) for w in block.words]).astype(np.float32)
            shared["blocks"] = np.array([-(-len(w) // STEP) + 1 for w in block.words])
            # Of each item the places of its words, and of those of its answer.
            shared["lists"] = [(places_of(w), len(w), places_of(w[a:]), len(w) - a) for w, a in
                               zip((w.tolist() for w in block.words), block.answers, strict=True)]
            shared["length"] = np.linalg.norm(shared["latent"], axis=1)
            shared["rarest"] = Rarest(block)
        latent, spans, lists, length = (shared[k] for k in ("latent", "blocks", "lists", "length"))
        rows, offsets = [], [0]
        for _, numbers, first in _numbered(texts, block):
            found = _in_texts(block, lists, latent, length, shared["rarest"], spans, numbers, first)
            for t in range(len(first) - 1):
                rows += found.get(t, [])
                offsets.append(len(rows))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64())
        struct = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                            names=[x.split()[0] for x in LEAK.split(", ")])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct)

    return search(F.col(text))


def _in_texts(block: Items, lists, latent, length, rarest, spans, numbers: np.ndarray,
              first: np.ndarray) -> dict[int, list[tuple]]:
    """Leaks by text, for many texts one after the other; a window never leaves its text."""
    sizes = np.diff(first)
    steps = -(-sizes // STEP)
    begins_at = np.concatenate([[0], np.cumsum(steps)])  # first step of each text
    text_of = np.repeat(np.arange(len(steps)), steps)
    at = np.flatnonzero((numbers >= 0) & (block.idf > 0)[numbers])
    stepped = np.zeros((begins_at[-1], latent.shape[1]), np.float32)
    if len(at):
        text = np.repeat(np.arange(len(sizes)), sizes)[at]
        owner = begins_at[text] + (at - first[text]) // STEP
        cuts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        stepped[owner[cuts]] = np.add.reduceat(block.basis[numbers[at]], cuts)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    compared: set[tuple[int, int]] = set()

    def words_of(window: int, end: int) -> tuple[int, int, int]:
        """Text, first and last word there of a window of steps."""
        t = int(text_of[window])
        return t, int(window - begins_at[t]) * STEP, min(int(end - begins_at[t]) * STEP, int(sizes[t]))

    def compare(item: int, window: int, end: int) -> None:
        t, lo, hi = words_of(window, end)
        (words, length, answer, ending), here = lists[item], numbers[first[t] + lo:first[t] + hi].tolist()
        least = length if length < SHORT else SHARE * length
        common = lcs_of(words, here, length, least)
        if common < least:
            return
        if lcs_of(answer, here, ending) >= ANSWER_SHARE * ending and common > best.get((t, item), (0,))[0]:
            best[t, item] = (common, lo, hi)

    every, last = np.arange(begins_at[-1]), begins_at[text_of + 1]
    for span, sums in _window_sums(stepped, np.unique(spans).tolist()):
        # All windows of so many steps, and the whole text where it is shorter.
        windows = np.flatnonzero((every + span <= last) | (every == begins_at[text_of]))
        ends = np.minimum(windows + span, last[windows])
        which = np.flatnonzero((spans == span) & (length > 0))
        if len(which):
            # What is shorter than this cannot reach far enough along any item.
            least = ALONG * length[which].min()
            rows = sums[windows]
            for w in np.flatnonzero(ends - windows < span).tolist():
                rows[w] = stepped[windows[w]:ends[w]].sum(axis=0)
            norm = np.sqrt(np.einsum("wk,wk->w", rows, rows))
            far = np.flatnonzero(norm >= least)
            inner = rows[far] @ latent[which].T
            # A window may hold more than the item, so next to the cosine its part along the item counts.
            w, k = np.divmod(np.flatnonzero(inner >= (ALONG * length[which] ** 2).astype(np.float32)), len(which))
            keep = inner[w, k] >= COSINE * norm[far[w]] * length[which[k]]
            for w, k in zip(far[w[keep]].tolist(), which[k[keep]].tolist(), strict=True):
                compared.add((k, int(windows[w])))
                compare(k, windows[w], ends[w])
    for t, item in zip(*(x.tolist() for x in rarest.reached(numbers, first)), strict=True):
        # All windows of the text that hold enough of the item's words in any order.
        begin, span = int(begins_at[t]), int(spans[item])
        windows = np.arange(begin, max(begin, int(begins_at[t + 1]) - span) + 1)
        ends = np.minimum(windows + span, begins_at[t + 1])
        held = np.concatenate([[0], np.cumsum(np.isin(numbers[first[t]:first[t + 1]], block.words[item]))])
        hi = np.minimum((ends - begin) * STEP, sizes[t])
        for w in np.flatnonzero(held[hi] - held[(windows - begin) * STEP] >= rarest.needed[item]):
            if (item, int(windows[w])) not in compared:
                compare(item, int(windows[w]), int(ends[w]))
    found: dict[int, list[tuple]] = {}
    for (t, i), (common, lo, hi) in sorted(best.items()):
        found.setdefault(t, []).append((block.ids[i], lo, hi, common, common / lists[i][1]))
    return found


def _window_sums(steps: np.ndarray, spans: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each span the sums of so many steps from each one on, as far as there are so many; the array is used again."""
    sums, done = np.zeros_like(steps), 0
    for span in spans:
        if span - done > NEAR:
            upto = np.cumsum(np.concatenate([np.zeros((1, steps.shape[1])), steps]), axis=0, dtype=float)
            sums[:max(0, len(upto) - span)] = upto[span:] - upto[:max(0, len(upto) - span)]
        else:
            for k in range(done, min(span, len(steps))):
                sums[:len(steps) - k] += steps[k:]
        done = span
        yield span, sums


def with_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """Documents with ``leaks``: an array of the leaked items."""
    texts = docs.select(F.col(text).alias("text"))
    found = [leaks(fit(texts, block), text) for block in read_items(benchmark)]
    none = F.expr("cast(array() as array<struct<" + LEAK.replace(" ", ":").replace(",:", ",") + ">>)")
    return docs.withColumn("leaks", F.concat(*found) if found else none)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id and place of every leaked item."""
    found = with_leaks(docs.select("doc_id", "text"), benchmark)
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
