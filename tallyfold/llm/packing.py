"""Best-fit packing with certified bin counts.

Texts become token ids, each closed by one end id; only documents longer than a sequence are cut.  The pieces are
dealt over partitions, each packed by best-fit decreasing.  Dual feasible functions give for every partition a number
of sequences that no packing of its pieces can undercut.  A partition that meets its bound is done; the others keep
their full sequences and exchange the rest, which is dealt anew over fewer partitions and packed again, until the
bounds are met or nothing is gained.

Only (document, piece, length, checksum) rows are shuffled, never texts or ids.  They are dealt by where the stored table
holds them, so a partition has a bounded number of pieces, whatever the ids and texts.  Words are encoded once per worker and looked up after that: the tokenizer never joins
anything over a blank, so a text's ids are those of its words one after the other.

Defined results: null and empty texts are one piece holding the end id; repeated rows are packed like different
documents; a null id is carried along; no rows give no sequences.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import parts_for, stored, text_batches

CAPACITY, END_ID = 4096, 1
TOKENIZER = "word_bpe_49k.json"
PER_PART = 20_000  #: pieces packed together
MOST_ROUNDS = 8
KNOWN_WORDS = 500_000  #: entries of a worker's word table before it starts anew
#: Letters that no normalisation changes but by lower-casing, and signs that never form a unit with them.
LETTERS = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
SIGNS = "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"
UNITS = 200  #: units encoded at once
GATHERED = 1 << 20  #: words whose ids are put in place at once
_state: dict = {}

PIECES = "piece int, start long, length long, ids_crc32 long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, place long, part long, bin long, offset long, " \
         "fill long, gap long"


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(TOKENIZER)


class Words:
    """Ids of words as little-endian 32-bit bytes, encoded on first sight.

    Plain words (letters, then perhaps a run of signs) are put together from units, the letters in lower case and the
    signs.  Units are encoded many at a time as one text: each ends where a token does that closes a word.  What the
    tokenizer does to texts before it forms tokens leaves units as they are, so they are only cut at blanks.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        self.of_units = Tokenizer(self.tokenizer.model)
        self.of_units.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.known: dict[str, bytes] = {}
        closing = [i for x, i in self.tokenizer.get_vocab().items() if x.endswith("</w>")]
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.closes[closing] = True

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        known, composed, stems, ends_with, units, other = self.known, [], [], [], set(), []
        for word in words:
            stem = word.rstrip(SIGNS)
            if not (stem.isascii() and stem.isalpha() or LETTERS.fullmatch(stem)):
                other.append(word)
                continue
            low, signs = stem.lower(), word[len(stem):]
            units.add(low)
            if signs:
                units.add(signs)
            if low != word:
                composed.append(word)
                stems.append(low)
                ends_with.append(signs)
        units = list(units.difference(known))
        for begin in range(0, len(units), UNITS):
            some = units[begin:begin + UNITS]
            ids = np.array(self.of_units.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(some):
                other += some  # not as foreseen: one by one
                continue
            data, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
            known.update(zip(some, map(data.__getitem__, map(slice, cuts, cuts[1:])), strict=True))
        for begin in range(0, len(other), 1000):
            some = other[begin:begin + 1000]
            known.update(zip(some, [x.tobytes() for x in self._encoded(some)], strict=True))
        for word, low, signs in zip(composed, stems, ends_with, strict=True):
            known[word] = known[low] + known[signs] if signs else known[low]

    def _looked_up(self, words: list[str]) -> list[bytes]:
        if len(self.known) > KNOWN_WORDS:
            self.known = {}
        found = [*map(self.known.get, words)]
        at = [i for i, ids in enumerate(found) if ids is None]
        self._learn([words[i] for i in at])
        for i in at:
            found[i] = self.known[words[i]]
        return found

    def ids(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text.  Words end at ASCII blanks; one with other blanks in it is encoded as it is."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = split.values.dictionary_encode()
        # Words hold no blank, so they can be handed over as one text.
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(words.dictionary)], words.dictionary), " ")[0].as_py()
        ids = self._looked_up(joined.split(" ") if len(words.dictionary) else [])
        each = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, first = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(each) - each
        index = words.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(each[index])])
        out = np.empty(ends[-1], "<u4")
        for begin in range(0, len(index), GATHERED):
            part = index[begin:begin + GATHERED]
            at = ends[begin:begin + len(part) + 1]
            out[at[0]:at[-1]] = flat[np.repeat(first[part] - at[:-1], each[part]) + np.arange(at[0], at[-1])]
        cuts = ends[split.offsets.to_numpy()]
        return [out[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


def _words(path: str) -> Words:
    if path not in _state:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _state[path] = Words(path)
    return _state[path]


def pieces(path: str, text: str = "text", capacity: int = CAPACITY) -> Column:
    """The pieces of a text column: number, ids before it, length and checksum of its ids."""
    @F.arrow_udf(f"array<struct<{', '.join(x.replace(' ', ':') for x in PIECES.split(', '))}>>")
    def cut(texts: pa.Array) -> pa.Array:
        coder, end = _words(path), np.array([END_ID], "<u4").tobytes()
        number, start, length, crc, offsets = [], [], [], [], [0]
        for _, some in text_batches(texts):
            for ids in coder.ids(some):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    number.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                offsets.append(len(number))
        rows = pa.StructArray.from_arrays([pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (
            start, length, crc))], names=["piece", "start", "length", "ids_crc32"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)

    return cut(F.col(text))


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place there of each length; the lengths come longest first."""
    bins, places = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by what they have left
    mask, made = 0, 0  # bit i: some bin has i left
    for i, n in enumerate(lengths.tolist()):
        fits = mask >> n
        if fits:
            left = n + (fits & -fits).bit_length() - 1
            b = free[left].pop()
            if not free[left]:
                mask &= ~(1 << left)
        else:
            left, b = capacity, made
            made += 1
        bins[i], places[i] = b, capacity - left
        if left > n:
            free[left - n].append(b)
            mask |= 1 << (left - n)
    return bins, places


def least_bins(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """A number of bins that no packing can undercut: the largest bound of two families of dual feasible functions."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)[:capacity + 1].astype(np.int64)
    size = np.arange(capacity + 1)
    best = -(-int((count * size).sum()) // capacity)
    rows, tokens = np.cumsum(count), np.cumsum(count * size)
    # Above capacity - t counts a whole bin, below t nothing, between its share.
    t = np.arange(1, capacity // 2 + 1)
    large = rows[-1] - rows[capacity - t]
    between = tokens[capacity - t] - tokens[t - 1]
    best = max(best, int((large + -(-between // capacity)).max()))
    for k in range(1, 100):  # rounds shares to multiples of 1 / k, those that divide evenly stay
        whole = (k + 1) * size % capacity == 0
        value = np.where(whole, size * k, (k + 1) * size // capacity * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def _packed(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["length", "doc_id", "piece", "start"], ascending=[False, True, True, True])
    lengths = group["length"].to_numpy()
    bins, places = best_fit_decreasing(lengths)
    fills = np.bincount(bins, weights=lengths).astype(np.int64)
    return group.assign(bin=bins, offset=places, fill=fills[bins], gap=len(fills) - least_bins(lengths))


def placed(pieces_stored: DataFrame) -> DataFrame:
    """Rows of a stored table with a number drawn from their place in it: equal rows get different ones."""
    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1)
    return pieces_stored.select("*", F.xxhash64(part, F.col("_metadata.row_index")).alias("place"))


def pack(rows: DataFrame, per_part: int = PER_PART) -> DataFrame:
    """Sequence and place of pieces (doc_id, piece, start, length, ids_crc32), as few sequences as found."""
    rows = placed(stored(rows, "pieces"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    # Whole sequences need no partner.
    done = [rows.where(F.col("length") == CAPACITY)
            .select(*columns, F.expr("shiftleft(1L, 61) + monotonically_increasing_id()").alias("sequence_id"),
                    F.lit(0).cast("long").alias("offset"))]
    open_rows, before = rows.where(F.col("length") < CAPACITY), None
    for number in range(MOST_ROUNDS):
        parts = parts_for(open_rows.count(), per_part << number)  # rows are small: each round over half as many
        dealt = open_rows.select(*columns, "place", F.pmod(F.xxhash64("place", F.lit(number)), F.lit(parts)).alias("part"))
        packed = stored(dealt.groupBy("part").applyInPandas(_packed, PACKED), "packed")
        sequence = (F.lit(number << 56) + F.col("part") * (1 << 24) + F.col("bin")).alias("sequence_id")
        made = packed.select(*columns, "place", sequence, "offset", "fill", "gap", "part")
        now = made.agg(F.countDistinct("sequence_id")).first()[0]
        if before is not None and now >= before[1]:
            done.append(before[0].select(*columns, "sequence_id", "offset"))
            break
        loose = made.where(f"gap > 0 and fill < {CAPACITY}")
        done.append(made.where(f"not (gap > 0 and fill < {CAPACITY})").select(*columns, "sequence_id", "offset"))
        left = loose.agg(F.countDistinct("sequence_id")).first()[0]
        if left == 0:
            break
        if parts == 1 or number == MOST_ROUNDS - 1:
            done.append(loose.select(*columns, "sequence_id", "offset"))
            break
        open_rows, before = loose, (loose, left)
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result


def packed_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.explode(pieces(path or tokenizer_path())).alias("p"))
    return pack(found.select("doc_id", "p.*"))
