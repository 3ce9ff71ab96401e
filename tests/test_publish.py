"""Versions and pointers: readers always see one whole result."""

import os

import pytest
from conftest import base_spec, rows

from tallyfold import InputError, Spec, published, run
from tallyfold.plans import publish

HEAD = "berth;hydrant;opened;cubic\n"


def names(target):
    return sorted(os.listdir(target)), sorted(n for n in os.listdir(target / publish.POINTERS) if n.isdigit())


def put(spark, target, run_id, *values):
    version = publish.begin(spark, str(target), run_id)
    spark.createDataFrame([(v,) for v in values], "v long").write.parquet(version)
    return version


def test_each_publication_is_a_version(spark, tmp_path):
    target = tmp_path / "t"
    with pytest.raises(InputError, match="nothing was published"):
        published(spark, str(target))
    for i in range(4):
        publish.publish(spark, str(target), put(spark, target, f"r{i}", i))
        assert rows(published(spark, str(target))) == [(i,)]
    # The version before stays for those who are still reading it.
    assert names(target) == ([publish.POINTERS, "v-r2", "v-r3"], [f"{3:020d}", f"{4:020d}"])


def test_a_reader_keeps_its_version_while_the_next_is_published(spark, tmp_path):
    target = tmp_path / "t"
    publish.publish(spark, str(target), put(spark, target, "a", 1))
    reader = published(spark, str(target))
    publish.publish(spark, str(target), put(spark, target, "b", 2))
    assert rows(reader) == [(1,)] and rows(published(spark, str(target))) == [(2,)]


def test_interrupted_between_any_two_steps(spark, tmp_path):
    target = tmp_path / "t"
    publish.publish(spark, str(target), put(spark, target, "good", 1))
    put(spark, target, "no pointer yet", 2)
    assert rows(published(spark, str(target))) == [(1,)]
    (target / publish.POINTERS / f"{2:020d}").write_text("")                       # cut off when it was created
    assert rows(published(spark, str(target))) == [(1,)]
    (target / publish.POINTERS / f"{3:020d}").write_text('{"version": "v-no poi')  # or while it was written
    assert rows(published(spark, str(target))) == [(1,)]
    publish.publish(spark, str(target), put(spark, target, "next", 3))
    assert rows(published(spark, str(target))) == [(3,)]
    assert names(target)[0] == [publish.POINTERS, "v-good", "v-next"]              # what was half-finished is gone


def test_a_pointer_that_another_run_made_is_not_overwritten(spark, tmp_path, monkeypatch):
    target = tmp_path / "t"
    publish.publish(spark, str(target), put(spark, target, "a", 1))
    real = publish._pointers
    stale = iter([[]])                                                             # as listed before the other run
    monkeypatch.setattr(publish, "_pointers", lambda *a: next(stale, None) if stale else real(*a))
    monkeypatch.setattr(publish, "_clear", lambda *a: None)
    publish.publish(spark, str(target), put(spark, target, "b", 2))
    monkeypatch.undo()
    assert rows(published(spark, str(target))) == [(2,)] and len(names(target)[1]) == 2


def test_abandoned_versions_leave_no_trace(spark, tmp_path):
    target = tmp_path / "t"
    publish.abandon(spark, str(target), put(spark, target, "a", 1))
    assert not target.exists()
    publish.publish(spark, str(target), put(spark, target, "b", 2))
    publish.abandon(spark, str(target), put(spark, target, "c", 3))
    assert names(target)[0] == [publish.POINTERS, "v-b"] and rows(published(spark, str(target))) == [(2,)]


def test_data_is_never_renamed(spark, folder, spec, tmp_path, monkeypatch):
    from tallyfold.sources import storage
    monkeypatch.setattr(storage, "move", lambda *a: pytest.fail("renamed"))
    outcome = run(spark, spec, folder({"a.csv": HEAD + "w;1;1;1\n"}), str(tmp_path / "t"))
    assert outcome.published and rows(outcome.result) == [(1, "w", 1.0, 1)]


@pytest.mark.parametrize("kind", ["parquet", "csv"])
def test_partitioned_output(spark, folder, spec, tmp_path, kind):
    path = folder({"a.csv": HEAD + 'w;1;1;1\nv;1;2;2\n"x\ny";2;3;3\n'})
    outcome = run(spark, spec, path, str(tmp_path / "t"), output_format=kind, partition_by=["hydrant"])
    version = publish.current(spark, str(tmp_path / "t"))["path"]
    assert {n for n in os.listdir(version) if "=" in n} == {"hydrant=1", "hydrant=2"}
    assert outcome.result.columns == list(spec.order)
    assert sorted((int(a), b, float(c), int(d)) for a, b, c, d in rows(outcome.result)) == [
        (1, "v", 2.0, 2), (1, "w", 1.0, 1), (2, "x\ny", 3.0, 3)]
    for wrong in (["tide"], list(spec.order)):
        with pytest.raises(ValueError, match="partition_by"):
            run(spark, spec, path, str(tmp_path / "u"), partition_by=wrong)


def test_default_output_is_named_after_the_spec():
    spec = base_spec(name=" harbour/water: 2024 ", suffix="_all")
    assert publish.default_output("s3a://b/lists/", spec) == "s3a://b/merged_harbour_water_2024_all"
    doc = {"template_name": "t", "version": "1", "duplicate_keys": ["a"], "aggregate": [{"column": "b", "method": "sum"}],
           "input": {"required_columns": ["a", "b"], "column_types": {"a": "string", "b": "int"}, "allow_missing_values": {}},
           "output": {"columns_order": ["a", "b"], "filename_suffix": "_x"}}
    assert Spec.from_dict(doc).suffix == "_x"
