"""How the acceptance queries write their lists."""

from conftest import rows
from pyspark.sql import functions as F

from tallyfold.sources.scan import FILE, SEQ
from workloads import spark_queries
from workloads import tables as t


def test_a_list_of_many_partitions_is_written_in_order(spark, tmp_path):
    df = spark.range(0, 150_000, 1, 6).select(F.when(F.col("id") % 7 != 0, F.col("id").cast("string")).alias("a b"),
                                              F.when(F.col("id") % 5 == 0, 'x;"y').otherwise("z").alias("c"))
    sizes = t.in_blocks(df).select(F.length("value")).collect()
    assert len(sizes) == 7 and sizes[0][0] == 5  # of what the writing task gets: a header and six blocks, no rows
    written = tmp_path / "lists" / "one.csv"
    t.named_lists(spark, {"one.csv": df}, "text", str(tmp_path / "lists"))
    t.named_lists(spark, {"one.csv": df.coalesce(1)}, "csv", str(tmp_path / "plain"))
    assert written.read_text() == (tmp_path / "plain" / "one.csv").read_text()


def test_years_are_sorted_by_many_tasks(spark):
    df = spark.range(0, 20_000, 1, 4).select(((F.col("id") * 7919) % 20_000).alias("k"), F.expr("date'1996-01-01'").alias("l_shipdate"))
    (name, year), = t.by_year(df, ("k",)).items()
    assert name == "lineitem_1996.csv" and [r.k for r in year.collect()] == list(range(20_000))
    assert "SinglePartition" not in year._jdf.queryExecution().toString() and "Coalesce 1" not in year._jdf.queryExecution().toString()


def test_lists_with_wide_records_are_several_and_have_each_one(spark):
    df = spark.range(0, 5000, 1, 8).select("id", F.lit("f").alias(FILE), F.col("id").alias(SEQ))
    for every in (100, 1250, 1 << 40):
        dealt = t.each_with(df, F.col("id") % every == 1)
        held = dict(rows(dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.count_if(F.col("id") % every == 1))))
        assert dealt.count() == 5000 and min(held.values()) >= 1 and (len(held) > 1 or every > 5000)
    assert t.each_with(df, F.lit(False)).count() == 5000


def test_the_lists_of_run_modes_are_made_by_many_tasks(spark, monkeypatch):
    made, done = [], []
    csv_folder, named_lists = t.csv_folder, t.named_lists

    def plain(spark, variants, *more):
        made.extend(variants)
        return csv_folder(spark, variants, *more)

    def named(spark, lists, kind="csv", into=None):
        made.extend(t.in_blocks(df) if kind == "text" else df.coalesce(1) for df in lists.values())
        return named_lists(spark, lists, kind, into)

    def noted(spark, spec, path, *more, **options):
        done.append({e.name for e in spark_queries.storage.entries(spark, path) if e.name.endswith("csv")})
        return run(spark, spec, path, *more, **options)

    run = spark_queries.run
    monkeypatch.setattr(t, "csv_folder", plain)
    monkeypatch.setattr(t, "named_lists", named)
    monkeypatch.setattr(spark_queries, "run", noted)
    assert spark_queries.run_modes(spark, "/root/testdata/sf0.001").count() == 4
    assert len(made) == 4 and not any("Coalesce 1" in df._jdf.queryExecution().toString() for df in made)
    assert "noted.csv" in done[0] and done[3] == {"whole.csv", "lacking.csv"}
