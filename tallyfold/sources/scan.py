"""Reading the rows of many lists as one DataFrame, aligned by column name.

Every required column becomes three: ``v<i>`` is its converted value (NULL when missing or
invalid), ``m<i>`` whether it is missing and ``r<i>`` the text as it stands, where ``<i>`` is
its position in the spec.  Being plain columns, Spark prunes those a plan does not use.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Mapping
from dataclasses import replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.functions import convert
from tallyfold.functions.names import col
from tallyfold.session import work_dir
from tallyfold.sources import storage
from tallyfold.sources.catalog import CSV, CSV_GLOB, Dialect, ListFile, decoded_name
from tallyfold.spec import Spec

LINE, WIDTH = "_line", "_width"
# Provenance and record-level flags that a checking scan adds.
FILE, BLOCK, SEQ, MALFORMED, BAD_TEXT = "_file", "_block", "_seq", "_malformed", "_bad_text"
UNCLOSED = "_unclosed"  # a quote is open at the end of the line
RECORDS = f"{FILE} string, {BLOCK} bigint, {SEQ} bigint, {LINE} string"
LOOKUP_BYTES = 64 << 20
RECORD_BYTES = 64 << 20  # a record of several lines still open after so much is a broken quote
MOST = (1 << 31) - 1
WHOLE_FILE = -1  # block of rows whose record number already counts from the start of the list


def cells(df: DataFrame, spec: Spec, carry: Iterable[str] = (), dialect: Dialect = Dialect(),
          names: Mapping[str, str] | None = None) -> DataFrame:
    """Cells for any table; ``names`` maps spec columns to differently named ones."""
    types = {f.name: f.dataType for f in df.schema}
    source = {n: (names or {}).get(n, n) for n in spec.required}
    return df.select(*[col(c) for c in carry],
                     *[part for n, at in source.items() for part in _cell(col(at), types[at], spec, n, dialect)])


def _cell(source: Column, kind: T.DataType, spec: Spec, name: str, dialect: Dialect) -> list[Column]:
    if isinstance(kind, T.StringType):
        return _text_cell(source, source, spec, name, dialect)
    missing = source.isNull()
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        missing = missing | F.isnan(source)
    value = convert.from_typed(source, kind, spec.column(name), name in spec.exact)
    return _parts(spec, name, value, missing, source.cast("string"))


def _text_cell(text: Column, shown: Column, spec: Spec, name: str, dialect: Dialect,
               null_tokens: tuple[str, ...] | None = None) -> list[Column]:
    """``text`` is judged, ``shown`` is what it says when properly decoded."""
    column = spec.column(name)
    missing = convert.is_missing(text, dialect.null_tokens if null_tokens is None else null_tokens)
    value = convert.from_text(text if column.is_numeric else shown, column, name in spec.exact, dialect.decimal)
    if not column.is_numeric or any(convert.reads_as_number(t, dialect.decimal) for t in dialect.null_tokens):
        value = F.when(~missing, value)
    else:
        # The default tokens are no numbers: only what is not a number needs a look at them.
        missing = value.isNull() & missing
    return _parts(spec, name, value, missing, shown)


def _parts(spec: Spec, name: str, value: Column, missing: Column, raw: Column) -> list[Column]:
    return [part.alias(alias) for part, alias in zip((value, missing, raw), part_names(spec, name))]


def part_names(spec: Spec, name: str) -> tuple[str, str, str]:
    """Columns holding the value, the missing flag and the text of a spec column."""
    i = spec.required.index(name)
    return f"v{i}", f"m{i}", f"r{i}"


def scan(spark: SparkSession, files: list[ListFile], spec: Spec, dialect: Dialect = Dialect(),
         checking: bool = True) -> DataFrame:
    """Cells of all given lists.

    A checking scan also judges encoding and malformed records in the same pass as the cells, and numbers the records.
    A plain scan is for lists already found clean.

    Delimited lists of whatever widths and headers are one scan of records, which are taken apart afterwards; where
    headers differ, each record looks up where its list keeps the required columns.  Lists whose records go over
    several lines are a second one.
    """
    csv_files = [f for f in files if f.format == CSV]
    crossing = [f for f in csv_files if f.crossing or dialect.multiline]
    plain = [f for f in csv_files if not (f.crossing or dialect.multiline)]
    # First, so that a plan over the delimited lists alone still numbers their records alike.
    read = [records(spark, part, dialect) for records, part in ((_lines, plain), (_joined, crossing)) if part]
    tables = []
    if read:
        placed = _placed(spark, spec, reduce(DataFrame.unionByName, read), csv_files, dialect, checking)
        tables.append(_csv_cells(placed, spec, dialect, checking))
    # Stored lists are read by name: only the required columns tell their layouts apart.
    for members in _grouped([f for f in files if f.format != CSV], lambda f: _stored_fields(f, spec).json()):
        tables.append(_parquet_cells(spark, members, spec, dialect, checking))
    return reduce(DataFrame.unionByName, tables) if tables else _no_rows(spark, spec, checking)


def _grouped(files: list[ListFile], key: Callable[[ListFile], Any]) -> list[list[ListFile]]:
    groups: dict[Any, list[ListFile]] = defaultdict(list)
    for f in files:
        groups[key(f)].append(f)
    return [groups[k] for k in sorted(groups, key=repr)]


def _places(f: ListFile, spec: Spec) -> tuple[int | None, ...]:
    """Where a list keeps the required columns; names of unknown columns do not matter."""
    return tuple(f.columns.index(n) if n in f.columns else None for n in spec.required)


def _stored_fields(f: ListFile, spec: Spec) -> T.StructType:
    """The required columns as a stored list has them, in the order of the spec."""
    return T.StructType([T.StructField(f.schema.names[at], f.schema[at].dataType)
                         for at in _places(f, spec) if at is not None])


# -- records of delimited lists -----------------------------------------------------------


def _lines(spark: SparkSession, files: list[ListFile], dialect: Dialect) -> DataFrame:
    """Each line but the header as one record, unparsed.

    Read as Latin-1, which maps every byte to one character and back, so bad UTF-8 survives to be seen.  The reader
    leaves out blank lines and each list's header; it is given marks that such text cannot hold, so it never looks
    into a line, whatever its length or number of fields.
    """
    options = dict(sep="\u0100", quote="\u0101", escape="\u0101", comment="\u0102", header=True, encoding="ISO-8859-1")

    def load(path: str | list[str], **more: str) -> DataFrame:
        return spark.read.schema(f"{LINE} string").options(**options, **more).csv(path)

    raw = storage.read_files(load, [f.path for f in files], CSV_GLOB)
    return raw.select(F.col("_metadata.file_name").alias(FILE), F.col("_metadata.file_block_start").alias(BLOCK),
                      F.monotonically_increasing_id().alias(SEQ), LINE)


def with_joined(spark: SparkSession, files: list[ListFile], dialect: Dialect) -> list[ListFile]:
    """The lists, with the records of those whose records cross lines stored: every later scan only reads them."""
    lacking = [f for f in files if f.format == CSV and f.load_rule is None and f.joined is None
               and (f.crossing or dialect.multiline)]
    if not lacking:
        return files
    path = _store(joined_lines(spark, lacking, dialect), "records")
    names = {f.list_id for f in lacking}
    return [replace(f, joined=path) if f.list_id in names else f for f in files]


def _joined(spark: SparkSession, files: list[ListFile], dialect: Dialect) -> DataFrame:
    """Records of lists whose records cross lines: of those among the stored ones, or put together now."""
    found = []
    for members in _grouped(files, lambda f: f.joined):
        path = members[0].joined
        if path is None:
            found.append(joined_lines(spark, members, dialect))
            continue
        names = spark.createDataFrame([(f.list_id,) for f in members], "_list string")
        records = spark.read.schema(RECORDS).parquet(path).withColumn("_list", _list_name())
        found.append(records.join(names, "_list", "left_semi").drop("_list"))
    return reduce(DataFrame.unionByName, found)


def joined_lines(spark: SparkSession, files: list[ListFile], dialect: Dialect) -> DataFrame:
    """Records of lists in which a quoted field may hold line breaks, without reading a list in one piece.

    What a line does to an open quote is one of four things, whatever stands before it: it leaves things as they
    are, turns them round, or ends outside or inside a quote in any case.  Running counts give that for the lines of a
    split, one row per split gives it for the splits of a list, and so every line knows whether it begins a record.
    Only the lines of records that really cross lines are brought together.
    """
    raw = storage.read_files(spark.read.text, [f.path for f in files], CSV_GLOB)
    text = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    bom = "\u00ef\u00bb\u00bf"
    lines = raw.select(F.col("_metadata.file_name").alias(FILE), F.col("_metadata.file_block_start").alias(BLOCK),
                       F.monotonically_increasing_id().alias("at"), text.alias(LINE))
    lines = lines.withColumn(LINE, F.when((F.col(BLOCK) == 0) & F.startswith(LINE, F.lit(bom)), F.substring(LINE, 4, MOST))
                             .otherwise(F.col(LINE)))
    ends = [_open(F.col(LINE), dialect), _open(F.concat(F.lit(dialect.quote), LINE), dialect)]
    lines = lines.select("*", *[e.alias(c) for e, c in zip(ends, ("o", "i"))])
    split = Window.partitionBy(FILE, BLOCK).orderBy("at")
    some = F.trim(F.translate(LINE, "\t", "")) != ""
    lines = _states(lines.withColumn("some", some), split)
    # How many records begin up to a line, if its split begins outside a quote and if it begins inside one.  Lines are
    # brought together by split, and stored, once; all that follows reads that.
    for c, first in (("n_o", F.lit(False)), ("n_i", F.lit(True))):
        begins = ~_before(F.col("known"), F.col("turns"), first) & F.col("some")
        lines = lines.withColumn(c, F.sum(begins.cast("long")).over(split))
    lines = _stored(lines, "lines")
    # One row per split: what it does as a whole, and what the splits before it make of it.
    whole = lines.groupBy(FILE, BLOCK).agg(F.max_by(F.struct("known", "turns", "o", "i"), "at").alias("z"),
                                           F.max("n_o").alias("n_o"), F.max("n_i").alias("n_i"))
    whole = whole.select(FILE, BLOCK, "n_o", "n_i", *[_after(
        F.col("z.known"), F.col("z.turns"), F.col("z.o"), F.col("z.i"), F.lit(s)).alias(c) for c, s in (("o", False), ("i", True))])
    before = _states(whole, Window.partitionBy(FILE).orderBy(BLOCK))
    splits = before.select(FILE, BLOCK, "n_o", "n_i", _before(F.col("known"), F.col("turns"), F.lit(False)).alias("inside_first"))
    # Lines before the first record of a split belong to the last one of the splits before.
    splits = splits.withColumn("held", F.when(F.col("inside_first"), F.col("n_i")).otherwise(F.col("n_o")))
    upto = Window.partitionBy(FILE).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    latest = F.last(F.when(F.col("held") > 0, F.struct(F.col(BLOCK).alias("block"), F.col("held").alias("n"))), True)
    first = F.min(F.when(F.col("held") > 0, F.col(BLOCK))).over(Window.partitionBy(FILE))
    splits = _stored(splits.select(FILE, BLOCK, "inside_first", latest.over(upto).alias("owner"), first.alias("first")), "splits")
    known, turns, starts = F.col("known"), F.col("turns"), F.col("inside_first")
    lines = lines.join(splits, [FILE, BLOCK]).withColumns({
        "inside": _before(known, turns, starts), "inside_after": _after(known, turns, F.col("o"), F.col("i"), starts),
        "n": F.when(starts, F.col("n_i")).otherwise(F.col("n_o"))})
    own = F.col("n") > 0
    lines = lines.where(F.col("inside") | F.col("some")).select(
        FILE, F.when(own, F.col(BLOCK)).otherwise(F.col("owner.block")).alias("block"),
        F.when(own, F.col("n")).otherwise(F.col("owner.n")).alias("n"), "first", F.col(BLOCK).alias("line_block"), "at",
        LINE, (F.col("inside") | F.col("inside_after")).alias("crosses"))
    key = [FILE, "block", "n", "first"]
    parts = lines.where("crosses")
    sizes = parts.groupBy(*key).agg(F.sum(F.length(LINE).cast("long")).alias("size"))
    fits = sizes.where(F.col("size") <= RECORD_BYTES)
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("line_block", "at", LINE))), lambda x: x[LINE])
    whole = (parts.join(fits, key).groupBy(*key).agg(F.array_join(pieces, "\n").alias(LINE)).select(*key, LINE))
    # A record beyond that is a quote that was never closed: it stands for itself as one.
    endless = sizes.where(F.col("size") > RECORD_BYTES).select(*key, F.lit(dialect.quote).alias(LINE))
    found = lines.where("not crosses").select(*key, LINE).unionByName(whole).unionByName(endless)
    header = (F.col("block") == F.col("first")) & (F.col("n") == 1)
    return found.where(~header).select(FILE, F.col("block").alias(BLOCK), F.col("n").alias(SEQ), LINE)


def _store(rows: DataFrame, purpose: str) -> str:
    path = work_dir(rows.sparkSession, purpose)
    rows.write.parquet(path)
    return path


def _stored(rows: DataFrame, purpose: str) -> DataFrame:
    """Rows written to the folder shared by all executors, and read back."""
    return rows.sparkSession.read.schema(rows.schema).parquet(_store(rows, purpose))


def _states(rows: DataFrame, order: WindowSpec) -> DataFrame:
    """Add, for each row, what the rows before it settle: the last state that holds in any case, with the turns made
    up to it, and the turns made in all."""
    turn = (F.col("o") & ~F.col("i")).cast("int")
    rows = rows.withColumn("turned", F.sum(turn).over(order))
    settled = F.when(F.col("o") == F.col("i"), F.struct(F.col("o").alias("inside"), F.col("turned").alias("turns")))
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("*", F.last(settled, True).over(earlier).alias("known"),
                       (F.col("turned") - turn).alias("turns")).drop("turned")


def _before(known: Column, turns: Column, first: Column) -> Column:
    """Whether a quote is open where a row begins, if ``first`` says so for the first row."""
    odd = (turns - F.coalesce(known["turns"], F.lit(0))) % 2 == 1
    return F.coalesce(known["inside"], first) != odd


def _after(known: Column, turns: Column, outside: Column, inside: Column, first: Column) -> Column:
    return F.when(_before(known, turns, first), inside).otherwise(outside)


def _marks(dialect: Dialect) -> tuple[str, str]:
    return f"\\Q{dialect.quote}\\E", f"\\Q{dialect.sep}\\E"


def _closed(dialect: Dialect) -> str:
    """Pattern of a field in quotes, from its first quote on, what stands between and what follows."""
    q, _ = _marks(dialect)
    return f"^{q}([^{q}]*+(?:{q}{q}[^{q}]*+)*+){q}([\\s\\S]*)$"


def _tokens(record: Column, dialect: Dialect) -> Column:
    """The fields of a record as they stand, quotes and all."""
    q, s = _marks(dialect)
    field = f"{s}({q}[^{q}]*+(?:{q}{q}[^{q}]*+)*+{q}[^{s}]*+|[^{s}]*+)"
    return F.regexp_extract_all(F.concat(F.lit(dialect.sep), record), F.lit(field), 1)


def _open(record: Column, dialect: Dialect) -> Column:
    """Whether a quote is still open at the end of a text that begins outside one.

    Quotes only count where a field begins.  The earliest line of a list for which this holds does begin outside, so
    a list has no such line exactly if none of its records crosses lines.
    """
    q = F.lit(dialect.quote)
    unclosed = F.exists(_tokens(record, dialect), lambda x: F.startswith(x, q) & ~x.rlike(_closed(dialect)))
    return F.contains(record, q) & unclosed


def _fields(record: Column, dialect: Dialect) -> Column:
    """The fields of a record; most have no quotes and are only cut."""
    q, mark = dialect.quote, dialect.sep if dialect.sep.isalnum() else "\\" + dialect.sep

    def unquoted(x: Column) -> Column:
        inner, rest = (F.regexp_extract(x, _closed(dialect), i) for i in (1, 2))
        plain = F.concat(F.replace(inner, F.lit(q + q), F.lit(q)), rest)
        return F.when(F.startswith(x, F.lit(q)), plain).otherwise(x)

    quoted = F.transform(_tokens(record, dialect), unquoted)
    return F.when(F.contains(record, F.lit(q)), quoted).otherwise(F.split(record, mark))


def _placed(spark: SparkSession, spec: Spec, records: DataFrame, files: list[ListFile], dialect: Dialect,
            checking: bool) -> DataFrame:
    """The required columns of records as texts under their names, with provenance if they are to be checked."""
    layouts = {(len(f.columns), _places(f, spec)) for f in files}
    if len(layouts) == 1:
        (width, at), = layouts
        width, places = F.lit(width), [None if p is None else F.lit(p) for p in at]
    else:
        records = _with_layout(spark, spec, records, files)
        width, places = F.col("_width"), [F.col(f"_p{i}") for i in range(len(spec.required))]
    kept = [FILE, BLOCK, SEQ, LINE] if checking else []
    split = records.select(*kept, width.alias(WIDTH), *[p.alias(f"_p{i}") for i, p in enumerate(places) if p is not None],
                           _fields(F.col(LINE), dialect).alias("_fields"))
    fields = F.col("_fields")
    # An empty field is a missing one; a record may be shorter than its header.
    texts = [(F.lit(None).cast("string") if p is None else F.nullif(F.get(fields, F.col(f"_p{i}")), F.lit(""))).alias(n)
             for i, (n, p) in enumerate(zip(spec.required, places))]
    flags = []
    if checking:
        unclosed = _open(F.col(LINE), dialect)
        flags = [FILE, BLOCK, SEQ, unclosed.alias(UNCLOSED), (unclosed | (F.size(fields) > F.col(WIDTH))).alias(MALFORMED),
                 _bad_text(F.col(LINE)).alias(BAD_TEXT)]
    return split.select(*flags, *texts)


def _with_layout(spark: SparkSession, spec: Spec, records: DataFrame, files: list[ListFile]) -> DataFrame:
    """Width and places of each record's list."""
    lookup = spark.createDataFrame([(f.list_id, len(f.columns), *_places(f, spec)) for f in files],
                                   "_list string, _width int, " + ", ".join(f"_p{i} int" for i in range(len(spec.required))))
    # A few integers and a name per list: shipped to all tasks only while that stays small.
    size = sum(len(f.list_id) + 24 + 8 * len(spec.required) for f in files)
    if size <= LOOKUP_BYTES:
        lookup = F.broadcast(lookup)
    found = records.withColumn("_list", _list_name()).join(lookup, "_list", "left")
    # A record whose list is not found must never vanish: that would be a fault of this engine.
    lost = F.raise_error(F.concat(F.lit("no layout is known for list "), F.col("_list"))).cast("int")
    return found.withColumn("_width", F.coalesce("_width", lost)).drop("_list")


def _list_name() -> Column:
    return F.when(F.col(FILE).contains("%"), decoded_name(FILE)).otherwise(F.col(FILE))


def _csv_cells(texts: DataFrame, spec: Spec, dialect: Dialect, checking: bool) -> DataFrame:
    flags = [FILE, BLOCK, SEQ, MALFORMED, BAD_TEXT, UNCLOSED] if checking else []
    tokens = tuple(t.encode().decode("latin-1") for t in dialect.null_tokens)
    return texts.select(*flags, *[part for n in spec.required
                                  for part in _text_cell(col(n), _utf8(col(n)), spec, n, dialect, tokens)])


def _bad_text(line: Column) -> Column:
    """Whether a line read as Latin-1 is not valid UTF-8; only text outside ASCII can be."""
    return (F.octet_length(line) != F.length(line)) & ~F.is_valid_utf8(_utf8(line))


def _parquet_cells(spark: SparkSession, files: list[ListFile], spec: Spec, dialect: Dialect,
                   checking: bool) -> DataFrame:
    schema = _stored_fields(files[0], spec)
    stored = spark.read.schema(schema).parquet(*[storage.literal(f.path) for f in files])
    flags = []
    if checking:
        flags = [F.col("_metadata.file_name").alias(FILE), F.lit(WHOLE_FILE).cast("bigint").alias(BLOCK),
                 F.col("_metadata.row_index").alias(SEQ), *[F.lit(False).alias(c) for c in (MALFORMED, BAD_TEXT, UNCLOSED)]]
    wanted = []
    for name, at in zip(spec.required, _places(files[0], spec)):
        held = None if at is None else files[0].schema[at]
        source = T.StringType() if held is None else held.dataType
        value = F.lit(None).cast(source) if held is None else col(held.name)
        wanted.extend(_cell(value, source, spec, name, dialect))
    return stored.select(*flags, *wanted)


def _utf8(latin1: Column) -> Column:
    # ASCII, as most text is, reads the same in both.
    same = F.octet_length(latin1) == F.length(latin1)
    return F.when(same, latin1).otherwise(F.encode(latin1, "ISO-8859-1").cast("string"))


def _no_rows(spark: SparkSession, spec: Spec, checking: bool) -> DataFrame:
    fields = []
    if checking:
        fields = [T.StructField(FILE, T.StringType()), T.StructField(BLOCK, T.LongType()), T.StructField(SEQ, T.LongType()),
                  *[T.StructField(c, T.BooleanType()) for c in (MALFORMED, BAD_TEXT, UNCLOSED)]]
    for name in spec.required:
        value = convert.value_type(spec.column(name), name in spec.exact)
        fields.extend(T.StructField(*f) for f in zip(part_names(spec, name),
                                                     (value, T.BooleanType(), T.StringType())))
    return spark.createDataFrame([], T.StructType(fields))
