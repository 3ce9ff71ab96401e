"""The test tables seen as lists: one list per shipping year of lineitem."""

from __future__ import annotations

from pyspark.sql import Column as Expression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold import Bounds, Column, Dialect, Rule, Spec
from tallyfold.plans.publish import write_result
from tallyfold.session import work_dir
from tallyfold.sources import storage
from tallyfold.sources.scan import BLOCK, FILE, SEQ, WHOLE_FILE

LIST_ID = "concat('lineitem_', cast(year(l_shipdate) as string))"

PART_QUANTITY = Spec(
    "quantity by part and status",
    (Column("l_partkey", "int"), Column("l_linestatus", "string"), Column("l_quantity", "float", scale=2)),
    keys=("l_partkey", "l_linestatus"), rules=(Rule("l_quantity", "sum"),),
    order=("l_partkey", "l_linestatus", "l_quantity"), sort_by=("l_linestatus",))

PART_MEAN = Spec(
    "mean quantity by part and status", PART_QUANTITY.columns, PART_QUANTITY.keys, (Rule("l_quantity", "mean"),),
    PART_QUANTITY.order)

PART_PRICE = Spec(
    "price by part and status",
    (Column("l_partkey", "int"), Column("l_linestatus", "string"), Column("l_extendedprice", "float", scale=2)),
    keys=("l_partkey", "l_linestatus"), rules=(Rule("l_extendedprice", "sum"),),
    order=("l_partkey", "l_linestatus", "l_extendedprice"))

SUPPLIER_RULES = Spec(
    "several rules by supplier and flag",
    (Column("l_suppkey", "int"), Column("l_returnflag", "string"), Column("l_quantity", "float", scale=2),
     Column("l_discount", "float", scale=2), Column("l_extendedprice", "float", scale=2)),
    keys=("l_suppkey", "l_returnflag"),
    rules=(Rule("l_quantity", "sum"), Rule("l_discount", "mean"), Rule("l_extendedprice", "count")),
    order=("l_suppkey", "l_returnflag", "l_quantity", "l_discount", "l_extendedprice"))

STATUS_COUNT = Spec(
    "count over a key", (Column("l_partkey", "int"), Column("l_linestatus", "string")),
    keys=("l_partkey", "l_linestatus"), rules=(Rule("l_linestatus", "count"),), order=("l_partkey", "l_linestatus"))

MISSING_KEYS = Spec(
    "keys with missing values",
    (Column("l_partkey", "int"), Column("linestatus", "string", allow_missing=True), Column("n", "int")),
    keys=("l_partkey", "linestatus"), rules=(Rule("n", "count"),), order=("l_partkey", "linestatus", "n"))

ALL_MISSING = Spec(
    "groups without any value",
    (Column("l_orderkey", "int"), Column("qty", "float", True, scale=2), Column("n", "float", True)),
    keys=("l_orderkey",), rules=(Rule("qty", "sum"), Rule("n", "count")), order=("l_orderkey", "qty", "n"))

ACCOUNT_BOUNDS = Spec(
    "balance by nation and segment",
    (Column("c_nationkey", "int"), Column("c_mktsegment", "string"), Column("c_acctbal", "float", scale=2)),
    keys=("c_nationkey", "c_mktsegment"), rules=(Rule("c_acctbal", "sum"),),
    order=("c_nationkey", "c_mktsegment", "c_acctbal"), bounds={"c_acctbal": Bounds(20000, 90000)})

# Dirty lists: a text quantity that is sometimes no number, and a status that may not be missing.
DIRTY = Spec(
    "dirty lists",
    (Column("linestatus", "string"), Column("qty_raw", "float", allow_missing=True, scale=2)),
    keys=("linestatus",), rules=(Rule("qty_raw", "sum"),), order=("linestatus", "qty_raw"))

SHIPPING = Spec(
    "dates and whole numbers written in different ways",
    (Column("day", "date", formats=("yyyy-MM-dd", "dd.MM.yyyy")), Column("line", "int")),
    keys=("day",), rules=(Rule("line", "sum"),), order=("day", "line"))


NOTED = Spec(
    "notes over several lines", (Column("l_partkey", "int"), Column("note", "string"), Column("l_quantity", "float", scale=2)),
    keys=("l_partkey", "note"), rules=(Rule("l_quantity", "sum"),), order=("l_partkey", "note", "l_quantity"))

ANY_SIZE = Spec(
    "numbers of any size", (Column("l_partkey", "int"), Column("kind", "string"), Column("amount", "float")),
    keys=("l_partkey", "kind"), rules=(Rule("amount", "sum"),), order=("l_partkey", "kind", "amount"))

COUNT_BOUNDS = Spec(
    "bounds of a counted and a summed column",
    (Column("c_nationkey", "int"), Column("c_custkey", "int"), Column("c_acctbal", "float", scale=2)),
    keys=("c_nationkey",), rules=(Rule("c_custkey", "count"), Rule("c_acctbal", "sum")),
    order=("c_nationkey", "c_custkey", "c_acctbal"), bounds={"c_custkey": Bounds(max=1), "c_acctbal": Bounds(min=100000)})


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem with the list each row belongs to and its place in the stored table."""
    return table(spark, folder, "lineitem").select(
        "*", F.expr(LIST_ID).alias("list_id"), F.col("_metadata.file_name").alias(FILE),
        F.lit(WHOLE_FILE).cast("bigint").alias(BLOCK), F.col("_metadata.row_index").alias(SEQ))


def dirty(rows: DataFrame, clean_until: int = 0) -> DataFrame:
    """Inject findings that depend on the order key only, in the lists after a year."""
    key = F.when(F.year("l_shipdate") > clean_until, F.col("l_orderkey")).otherwise(1)
    return rows.select(
        "*", F.when(key % 101 != 0, F.col("l_linestatus")).alias("linestatus"),
        F.when(key % 103 == 0, "n/a").when(key % 97 == 0, "not_a_number")
        .otherwise(F.col("l_quantity").cast("int").cast("string")).alias("qty_raw"))


def header(rows: DataFrame, extra_year: int) -> DataFrame:
    """A catalog of the year lists, where those up to ``extra_year`` carry an unknown column."""
    ids = rows.select("list_id", F.right("list_id", F.lit(4)).cast("int").alias("y")).distinct()
    known = F.array(*[F.lit(n) for n in DIRTY.required])
    more = F.when(F.col("y") <= extra_year, F.array(F.lit("note"))).otherwise(F.array().cast("array<string>"))
    return ids.select("list_id", F.concat(known, more).alias("columns"), F.lit(None).cast("string").alias("load_rule"))


def named_lists(spark: SparkSession, lists: dict[str, DataFrame], kind: str = "csv", into: str | None = None) -> str:
    """Write each table as one list of that name, its rows in their order; as ``text`` tables of many partitions, too."""
    path = into or work_dir(spark, "lists")
    storage.make_directory(spark, path)
    for name, df in lists.items():
        part = work_dir(spark, "part")
        if kind == "text":
            in_blocks(df).write.text(part)
        else:
            write_result(df, part, kind)
        file = next(e.path for e in storage.entries(spark, part) if e.name.startswith("part-"))
        storage.move(spark, file, f"{path}/{name}")
    return path


def in_blocks(rows: DataFrame, dialect: Dialect = Dialect()) -> DataFrame:
    """A delimited list with its header as one partition of blocks of lines, in the order of the rows.

    One task has to write a list, but it only gets finished lines: rows are read, sorted and written out by many.
    """
    options = {"sep": dialect.sep, "quote": dialect.quote, "escape": dialect.quote, "emptyValue": "", "nullValue": "",
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    names = F.struct(*[F.lit(c).alias(f"c{i}") for i, c in enumerate(rows.columns)])
    header = rows.sparkSession.range(1).select(F.lit(-1).cast("bigint").alias("block"), F.to_csv(names, options).alias("value"))
    placed = rows.select(F.monotonically_increasing_id().alias("at"), F.to_csv(F.struct(*rows.columns), options).alias("line"))
    lines = F.array_sort(F.collect_list(F.struct("at", "line")))
    blocks = (placed.groupBy(F.shiftright("at", 16).alias("block")).agg(lines.alias("lines"))
              .select("block", F.array_join("lines.line", "\n").alias("value")))
    return header.unionByName(blocks).repartition(1).sortWithinPartitions("block").select("value")


def each_with(rows: DataFrame, marked: Expression) -> DataFrame:
    """The rows dealt to as many partitions as are read, none of which is without a marked row if there are any."""
    parts = rows.rdd.getNumPartitions()
    share = F.pmod(F.xxhash64(FILE, SEQ), F.lit(parts)).cast("int")
    held = sorted(r[0] for r in rows.where(marked).select(share).distinct().collect())
    if not held:
        return rows
    other = F.element_at(F.array(*map(F.lit, held)), share % len(held) + 1)
    return rows.repartition(parts, F.when(share.isin(held), share).otherwise(other))


def by_year(rows: DataFrame, order: tuple[str, ...]) -> dict[str, DataFrame]:
    """One sorted table per list."""
    years = [r[0] for r in rows.select(F.year("l_shipdate")).distinct().collect()]
    return {f"lineitem_{y}.csv": rows.where(F.year("l_shipdate") == y).orderBy(*order) for y in sorted(years)}


def split_session(spark: SparkSession, path: str, splits: int = 50) -> SparkSession:
    """A sibling session that cuts the lists of a folder into about so many splits."""
    session = spark.newSession()
    size = sum(e.size for e in storage.entries(spark, path)) // splits
    session.conf.set("spark.sql.files.maxPartitionBytes", str(max(size, 1)))
    session.conf.set("spark.sql.files.openCostInBytes", "0")
    return session


def csv_folder(spark: SparkSession, variants: list[DataFrame], dialect: Dialect = Dialect()) -> str:
    """Write each variant's partitions as delimited lists of their own into one folder."""
    path = work_dir(spark, "lists")
    for n, variant in enumerate(variants):
        write_result(variant, path, "csv", dialect, mode="overwrite" if n == 0 else "append")
    return path
