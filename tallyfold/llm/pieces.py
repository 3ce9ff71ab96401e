"""SentencePiece encoding and decoding with a table of distinct chunks.

A vocabulary none of whose pieces holds a whitespace marker after another character can never join anything over the
place where a marked word begins.  So a text falls into chunks, each a run of markers with the characters up to the
next one, and its ids are those of its chunks one after the other.  Chunks repeat: every distinct one of the corpus is
segmented once, by the library itself, and the ids are joined back by position.

Texts are read in blocks.  A block turns into the list of its distinct chunks and, for each document, the numbers of
its chunks in that list.  The lists are dealt by a hash of the chunk into a fixed number of slices; the slices of all
blocks stream, sorted by slice, past the library, which sees each chunk once, and go back to their blocks, which look
their documents' numbers up.  Lists and numbers travel packed, as one value for many chunks.  The blocks stand in a
table bucketed by block, so that numbers never move: only lists and their ids are shuffled, never texts.

Nothing is broadcast, and a task holds one block, or the distinct chunks of one slice (forgotten above ``MOST_KNOWN``
of them, which only makes the library see some again).

Defined results: null and empty texts have no ids and decode to the empty text; texts and single words of any length
are encoded whole; repeated rows and repeated or null ids are rows like any other; no rows give no rows.  A vocabulary
or normalisation for which chunks are not independent is refused.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyfold.llm.common import text_batches
from tallyfold.session import work_dir

MODEL = "piece_bpe_32k.model"
MARK = "\u2581"
#: In a text, a blank and a literal marker are the same to the library.
CHUNK = re.compile(f"[ {MARK}]+[^ {MARK}]*")
BLOCK_BYTES = 16 << 20  #: text of a block (at least one document)
RUN_NUMBERS = 1 << 20  #: chunk numbers stored as one value (at least one document's)
MOST_SLICES = 4096
MOST_KNOWN = 1_000_000  #: distinct chunks that a task holds


def model_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(MODEL)


@lru_cache(2)
def processor(path: str):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=path)


def chunks_of(text: str) -> list[str]:
    """The chunks of a text; where single blanks part its words and nothing else marks them, they are only cut."""
    marked = " " + text
    if not text or MARK in text or "  " in marked or text[-1] == " ":
        return CHUNK.findall(marked) if text else []
    return [" " + word for word in text.split(" ")]


def chunk_ids(sp, chunks: list[str]) -> list[list[int]]:
    """Ids of chunks.  The library puts one marker before each text, so the first one of the chunk is left out; of a
    bare marker nothing would be left, its id is known."""
    bare = [sp.piece_to_id(MARK)]
    return [ids if len(c) > 1 else bare for c, ids in zip(chunks, sp.encode([c[1:] for c in chunks], num_threads=1))]


def require_independent_chunks(path: str) -> None:
    """Refuse a model whose pieces cross whitespace markers or that changes texts before segmenting them."""
    sp = processor(path)
    for i in range(sp.get_piece_size()):
        if MARK in sp.id_to_piece(i).lstrip(MARK):
            raise ValueError(f"piece {i} of {path} crosses a whitespace marker")
    # What normalisations change: compatibility forms, case, runs of blanks, blanks at the ends, control characters.
    for probe in ("a  b ", " \ufb01 \u2460 \u00c4a\u0308 \uff21\u3000x", "A\tB\n\nC", "\u200b \x00\x7f\u00ad"):
        ids = sp.encode(probe)
        if sp.decode(ids) != probe or ids != sum(chunk_ids(sp, CHUNK.findall(" " + probe)), []):
            raise ValueError(f"{path} normalises texts, so chunks cannot be segmented apart")


def encoded(docs: DataFrame, text: str = "text", carry: Sequence[str] = ("doc_id",), path: str | None = None) -> DataFrame:
    """The ``carry`` columns of every row with ``ids``, the ids of its whole text without begin and end."""
    path = path or model_path()
    require_independent_chunks(path)
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.struct(*carry).alias("row"), F.col(text).cast("string").alias("text"))
    blocks = _bucketed(_blocks(rows, min(MOST_SLICES, max(32, parts))), parts)
    lists = blocks.where("slice is not null").select("slice", "block", "packed")
    known = (lists.repartition("slice").sortWithinPartitions("slice")
             .mapInArrow(_segmented(path), "of long, slice int, packed binary"))
    runs = blocks.where("slice is null").select("block", "rows", "sizes", "packed")
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType),
                           T.StructField("ids", T.ArrayType(T.IntegerType()))])
    found = runs.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(_looked_up(path, schema), schema)
    return found.select("row.*", "ids")


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    """Write to the folder shared by all executors, bucketed by block, and read back."""
    spark, path = df.sparkSession, work_dir(df.sparkSession, "piece-blocks")
    name = "piece_blocks_" + path[-32:]
    df.write.options(path=path, compression="zstd").bucketBy(buckets, "block").saveAsTable(name)
    read = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # a table with a path of its own: only its name goes, the files stay
    return read


def _blocks(rows: DataFrame, slices: int) -> DataFrame:
    """The blocks' documents as chunk numbers (many documents a row), and their lists of chunks (a row per slice)."""
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("slice", T.IntegerType()),
                           T.StructField("rows", T.ArrayType(rows.schema["row"].dataType)),
                           T.StructField("sizes", T.BinaryType()), T.StructField("packed", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(TaskContext.get().partitionId() << 32)
        for batch in batches:
            row = batch.column("row")
            for start, texts in text_batches(batch.column("text")):
                block.add(row.slice(start, len(texts)), texts)
                if block.size >= BLOCK_BYTES:
                    yield from block.packed(arrow, slices)
                    block = Block(block.no + 1)
                    _give_back()
        if block.size or block.rows:
            yield from block.packed(arrow, slices)

    return rows.mapInArrow(split, schema)


class Block:
    """Documents whose chunks are numbered together."""

    def __init__(self, no: int):
        self.no, self.size = no, 0
        self.known: dict[str, int] = defaultdict(count().__next__)  # a new chunk gets the next number
        self.rows: list[pa.Array] = []
        self.numbers: list[np.ndarray] = []

    def add(self, rows: pa.Array, texts: pa.Array) -> None:
        for value in texts.to_pylist():
            found = chunks_of(value or "")
            self.numbers.append(np.fromiter(map(self.known.__getitem__, found), "<u4", len(found)))
        self.rows.append(rows)
        self.size += texts.nbytes

    def packed(self, schema: pa.Schema, slices: int) -> Iterator[pa.RecordBatch]:
        """A chunk's final number is its place in order of slice and text."""
        dealt: list[list[str]] = [[] for _ in range(slices)]
        for chunk in self.known:
            dealt[zlib.crc32(chunk.encode()) % slices].append(chunk)
        final = np.zeros(len(self.known), "<u4")
        n = 0
        for no, chunks in enumerate(dealt):
            if chunks:
                chunks.sort()
                final[[self.known[c] for c in chunks]] = np.arange(n, n + len(chunks))
                n += len(chunks)
                yield self._row(schema, slice=no, packed=_squeezed(b"\xff".join(c.encode() for c in chunks)))
        rows = pa.concat_arrays(self.rows)
        sizes = np.array([len(x) for x in self.numbers], "<u4")
        ends = np.cumsum(sizes, dtype=np.int64)
        begin = 0
        while begin < len(sizes):
            stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + RUN_NUMBERS)))
            numbers = final[np.concatenate(self.numbers[begin:stop])]
            yield self._row(schema, rows=rows.slice(begin, stop - begin), sizes=sizes[begin:stop].tobytes(),
                            packed=_planes(numbers))
            begin = stop

    def _row(self, schema: pa.Schema, **values) -> pa.RecordBatch:
        rows = values.pop("rows", None)
        arrays = {k: pa.array([v], schema.field(k).type) for k, v in values.items()}
        if rows is not None:
            arrays["rows"] = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
        arrays["block"] = pa.array([self.no], pa.int64())
        return pa.RecordBatch.from_arrays([arrays[f.name].cast(f.type) if f.name in arrays else pa.nulls(1, f.type)
                                           for f in schema], names=schema.names)


def _give_back() -> None:
    """Hand freed memory back: workers live on, and two of them share a machine with Spark."""
    pa.default_memory_pool().release_unused()


def _squeezed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _restored(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers packed byte by byte: all lowest bytes first, which compress apart from the others."""
    return _squeezed(numbers.astype("<u4").view("u1").reshape(-1, 4).T.tobytes())


def _numbers(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_restored(data), "u1").reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def _segmented(path: str):
    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ids for every list, in its order; a slice's distinct chunks are segmented when they first come by."""
        sp, at, known = processor(path), None, {}
        for batch in batches:
            for of, no, packed in zip(*(batch.column(c) for c in ("block", "slice", "packed"))):
                if no != at or len(known) > MOST_KNOWN:
                    at, known = no, {}
                chunks = [c.decode() for c in _restored(packed.as_py()).split(b"\xff")]
                new = [c for c in chunks if c not in known]
                known.update(zip(new, chunk_ids(sp, new)))
                ids = [known[c] for c in chunks]
                sizes = np.array([len(ids), *map(len, ids)], "<u4")
                flat = np.fromiter(chain.from_iterable(ids), "<u4", int(sizes[1:].sum(dtype=np.int64)))
                both = np.concatenate([sizes, flat])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([of.as_py()], pa.int64()), pa.array([no.as_py()], pa.int32()),
                     pa.array([_planes(both)], pa.binary())], names=["of", "slice", "packed"])

    return segment


def _looked_up(path: str, schema: T.StructType):
    arrow = to_arrow_schema(schema)

    def look_up(runs: pa.Table, known: pa.Table) -> pa.Table:
        """Ids of the documents of one block: its chunks' ids, taken in the order of the numbers."""
        _give_back()
        sizes, ids = [np.zeros(0, "<u4")], [np.zeros(0, "<u4")]
        for packed in known.sort_by("slice")["packed"]:
            both = _numbers(packed.as_py())
            sizes.append(both[1:1 + both[0]])
            ids.append(both[1 + both[0]:])
        sizes, ids = np.concatenate(sizes).astype(np.int64), np.concatenate(ids).astype(np.int32)
        starts = np.cumsum(sizes) - sizes
        found = []
        for rows, counts, packed in zip(runs["rows"], runs["sizes"], runs["packed"]):
            at = _numbers(packed.as_py())
            n = sizes[at]
            stop = np.cumsum(n)
            # Place of each id in the table: its chunk's first place plus how far it is into the chunk.
            flat = ids[np.arange(stop[-1] if len(stop) else 0) + np.repeat(starts[at] - (stop - n), n)]
            ends = np.r_[0, stop][np.r_[0, np.cumsum(np.frombuffer(counts.as_py(), "<u4"), dtype=np.int64)]]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            found.append(pa.RecordBatch.from_arrays([rows.values.cast(arrow.field("row").type), lists],
                                                    names=["row", "ids"]))
        return pa.Table.from_batches(found, arrow) if found else arrow.empty_table()

    return look_up


def decoded(rows: DataFrame, ids: str = "ids", into: str = "decoded", path: str | None = None) -> DataFrame:
    """All rows with the text that the library's ``decode`` gives for their ids; null ids are none."""
    path = path or model_path()
    schema = T.StructType([T.StructField("row", rows.schema), T.StructField(into, T.StringType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(path)
        for batch in batches:
            lists = batch.column("ids")
            ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            begin = 0
            while begin < len(ends):  # texts of some hundred thousand ids at a time
                stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + (1 << 18))))
                part = [i or [] for i in lists.slice(begin, stop - begin).to_pylist()]
                texts = pa.array([sp.decode(i) if i else "" for i in part], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(begin, stop - begin), texts],
                                                 names=["row", into])
                begin = stop
            _give_back()

    found = rows.select(F.struct(*rows.columns).alias("row"), F.col(ids).alias("ids")).mapInArrow(decode, schema)
    return found.select("row.*", into)


def ids_digest(ids: str = "ids") -> Column:
    """SHA-256 of the decimal ids joined by commas, as lower-case hex."""
    return F.sha2(F.concat_ws(",", F.transform(F.col(ids), lambda i: i.cast("string"))), 256)
