"""List catalog: which lists a folder holds and what their headers look like."""

from __future__ import annotations

import csv
import io
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tallyfold.functions.convert import NULL_TOKENS
from tallyfold.functions.names import normalize_name
from tallyfold.sources import storage

CSV, PARQUET = "csv", "parquet"
CSV_GLOB = "*.[cC][sS][vV]"
SMALL = 4 << 20  # lists up to this size are read whole when only the header is wanted
HEADER_START = 1 << 16  # bytes first read of a larger list; more only if its header is longer
HEADER_BYTES = 64 << 20  # a header record still open after so much is a broken quote
FORMATS = {".csv": CSV, ".parquet": PARQUET}

_LINE_END = re.compile(rb"\r\n|\r|\n")

CATALOG_SCHEMA = T.StructType([
    T.StructField("list_id", T.StringType(), False),
    T.StructField("path", T.StringType(), False),
    T.StructField("columns", T.ArrayType(T.StringType()), True),
    T.StructField("load_rule", T.StringType(), True),
])


class InputError(ValueError):
    """The input folder as a whole is unusable."""


@dataclass(frozen=True)
class Dialect:
    """How delimited lists are written.  Always UTF-8 with a header line; nothing is guessed.

    Quoted fields may hold line breaks.  The checking pass of a run finds the lists in which they do; ``multiline``
    says beforehand that all lists may.
    """

    sep: str = ";"
    decimal: str = "."
    quote: str = '"'
    null_tokens: tuple[str, ...] = NULL_TOKENS
    multiline: bool = False

    def __post_init__(self) -> None:
        for name in ("sep", "decimal", "quote"):
            mark = getattr(self, name)
            if len(mark) != 1 or not mark.isascii():
                raise ValueError(f"{name} must be one ASCII character, not {mark!r}")


@dataclass(frozen=True)
class ListFile:
    """One list: its header, or the rule it broke so that it cannot be read at all."""

    list_id: str
    path: str
    format: str
    size: int
    columns: tuple[str, ...] | None = None
    schema: T.StructType | None = None
    load_rule: str | None = None
    crossing: bool = False  # a quoted field of some record holds a line break
    joined: str | None = None  # folder with the joined records of this list, among others


def discover(spark: SparkSession, folder: str) -> list[ListFile]:
    """The supported files directly in ``folder``, by name."""
    if not storage.exists(spark, folder):
        raise InputError(f"input folder not found: {folder}")
    if not storage.is_directory(spark, folder):
        raise InputError(f"input path is not a folder: {folder}")
    found = []
    for entry in storage.entries(spark, folder):
        stem, dot, suffix = entry.name.rpartition(".")
        kind = FORMATS.get((dot + suffix).lower()) if stem else None
        if entry.is_file and kind:
            found.append(ListFile(entry.name, entry.path, kind, entry.size, load_rule=_unreadable(entry)))
    if not found:
        raise InputError(f"no lists ({', '.join(FORMATS)}) in {folder}")
    return sorted(found, key=lambda f: f.list_id)


def _unreadable(entry: storage.Entry) -> str | None:
    # Spark scans skip empty files and names with these prefixes without a word.
    if entry.size == 0:
        return "empty_file"
    return "hidden_name" if entry.name.startswith(("_", ".")) else None


def read_headers(spark: SparkSession, files: list[ListFile], dialect: Dialect = Dialect()) -> list[ListFile]:
    """Fill in the header of every readable list."""
    ready = [f for f in files if f.load_rule is None]
    headers = _csv_headers(spark, [f for f in ready if f.format == CSV], dialect)
    with ThreadPoolExecutor(16) as pool:
        parquet = dict(pool.map(lambda f: (f.path, _parquet_header(spark, f)),
                                [f for f in ready if f.format == PARQUET]))
    return [f if f.load_rule else parquet.get(f.path) or _with_header(f, headers.get(f.list_id), dialect)
            for f in files]


def catalog_frame(spark: SparkSession, files: list[ListFile]) -> DataFrame:
    """One row per list."""
    table = pa.table({name: pa.array([getattr(f, name) for f in files], to_arrow_type(field.dataType))
                      for name, field in zip(CATALOG_SCHEMA.names, CATALOG_SCHEMA)})
    return spark.createDataFrame(table, CATALOG_SCHEMA)


def _csv_headers(spark: SparkSession, files: list[ListFile], dialect: Dialect) -> dict[str, bytes]:
    """The header record of each list as raw bytes, blank lines before it skipped."""
    small = [f for f in files if f.size <= SMALL]
    large = [f for f in files if f.size > SMALL]
    found = {}
    if small:
        rows = _small_headers(spark, small, dialect).select(decoded_name("name"), "record").collect()
        found = {name: bytes(record) for name, record in rows}
    with ThreadPoolExecutor(16) as pool:
        return found | dict(pool.map(lambda f: (f.list_id, _large_header(spark, f, dialect)), large))


def _small_headers(spark: SparkSession, files: list[ListFile], dialect: Dialect) -> DataFrame:
    """Small lists are cheap to read whole, many to a task; only the first line leaves the scan."""
    whole = storage.read_files(partial(spark.read.text, wholetext=True), [f.path for f in files], CSV_GLOB)
    # Only a byte-order mark and blank lines may stand before the header; its own blanks belong to it.
    # Latin-1 maps every byte to one character and back, so that bad UTF-8 stays as it is.
    text = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    text = F.regexp_replace(text, r"^(?:\u00ef\u00bb\u00bf)?(?:[ \t]*+(?:\r\n|\r|\n))*+", "")
    line = F.substring_index(F.substring_index(text, "\n", 1), "\r", 1)
    q, s = f"\\Q{dialect.quote}\\E", f"\\Q{dialect.sep}\\E"
    field = f"(?:{q}[^{q}]*+(?:{q}{q}[^{q}]*+)*+{q}[^{s}\\r\\n]*+|(?!{q})[^{s}\\r\\n]*+)"
    several = F.regexp_extract(text, f"^({field}(?:{s}{field})*+)(?=[\\r\\n]|\\z)", 1)
    # A quote that is never closed leaves the first line, which the parser will refuse.
    quoted = F.contains(line, F.lit(dialect.quote)) & (several != "")
    record = F.when(quoted, F.regexp_replace(several, "\r\n?", "\n")).otherwise(line)
    return whole.select(F.col("_metadata.file_name").alias("name"), F.encode(record, "ISO-8859-1").alias("record"))


def _large_header(spark: SparkSession, f: ListFile, dialect: Dialect) -> bytes | None:
    """Of a large list only the start is read, as of a stored one only the footer."""
    is_open, quote = _open_header(dialect), dialect.quote.encode()
    lines: list[bytes] = []
    held = 0
    for line in _lines_of(storage.chunks(spark, f.path, HEADER_START)):
        if not lines and not line.strip(b" \t"):
            continue
        lines.append(line)
        # A line without a quote closes nothing.
        if len(lines) == 1 or quote in line:
            record = b"\n".join(lines)
            if not is_open(record):
                return record
        held += len(line)
        if held > HEADER_BYTES:
            break
    # The quote is never closed: the first line, which the parser will refuse.
    return lines[0] if lines else None


def _lines_of(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The lines of a text that comes in pieces, without its byte-order mark."""
    rest, first = b"", True
    for chunk in chunks:
        rest += chunk
        if first and len(rest) >= 3:
            rest, first = rest.removeprefix(b"\xef\xbb\xbf"), False
        # Whether a line feed follows a carriage return at the end is not known yet.
        held = rest.removesuffix(b"\r")
        *whole, last = _LINE_END.split(held)
        yield from whole
        rest = last + rest[len(held):]
    yield from _LINE_END.split(rest.removeprefix(b"\xef\xbb\xbf") if first else rest)


def _open_header(dialect: Dialect) -> Callable[[bytes], bool]:
    """Whether a quote is open at the end of a text; quotes only count where a field begins."""
    q, s = re.escape(dialect.quote).encode(), re.escape(dialect.sep).encode()
    closed = rb"%b[^%b]*+(?:%b%b[^%b]*+)*+%b[^%b]*+" % (q, q, q, q, q, q, s)
    field, whole, mark = re.compile(rb"%b(%b|[^%b]*+)" % (s, closed, s)), re.compile(closed), dialect.quote.encode()

    def is_open(text: bytes) -> bool:
        return any(x.startswith(mark) and not whole.fullmatch(x) for x in field.findall(dialect.sep.encode() + text))

    return is_open


def decoded_name(column: str) -> F.Column:
    """File name as listed; scans report it URL-encoded (where a plus sign stays as it is)."""
    return F.url_decode(F.replace(F.col(column), F.lit("+"), F.lit("%2B")))


def _with_header(f: ListFile, record: bytes | None, dialect: Dialect) -> ListFile:
    if not record:
        return replace(f, load_rule="empty_file")
    try:
        text = record.decode("utf-8-sig")
    except UnicodeDecodeError:
        return replace(f, load_rule="encoding")
    csv.field_size_limit(max(csv.field_size_limit(), len(text) + 1))
    try:
        # Strict, so that a quote that is never closed is an error of this list.
        names = next(csv.reader(io.StringIO(text, newline=""), delimiter=dialect.sep, quotechar=dialect.quote,
                                strict=True))
    except (csv.Error, StopIteration):
        return replace(f, load_rule="malformed_record")
    return _checked(replace(f, crossing="\n" in text), names)


def _parquet_header(spark: SparkSession, f: ListFile) -> ListFile:
    try:
        schema = spark.read.parquet(storage.literal(f.path)).schema
    except Exception:  # any unreadable footer is a finding about this list only
        return replace(f, load_rule="unreadable")
    return _checked(replace(f, schema=schema), schema.names)


def _checked(f: ListFile, names: list[str]) -> ListFile:
    columns = tuple(normalize_name(n) or f"Unnamed: {i}" for i, n in enumerate(names))
    rule = None
    if len(columns) <= 1:
        rule = "single_column"
    elif max(Counter(columns).values()) > 1:
        rule = "duplicate_column"
    return replace(f, columns=columns, load_rule=rule)
