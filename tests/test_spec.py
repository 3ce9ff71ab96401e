import copy

import pytest
from conftest import base_spec

from tallyfold import Bounds, Column, Rule, Spec, SpecError

HARBOUR = {
    "template_name": "harbour water", "version": "1.0",
    "input": {"required_columns": ["berth", "hydrant", "opened", "cubic"],
              "column_types": {"berth": "string", "hydrant": "int", "opened": "int", "cubic": "float"},
              "allow_missing_values": {"opened": True}},
    "duplicate_keys": ["berth", "hydrant"],
    "aggregate": [{"column": "cubic", "method": "sum"}, {"column": "opened", "method": "sum"}],
    "output": {"columns_order": ["hydrant", "berth", "cubic", "opened"], "sort_by": ["hydrant"]},
    "validation_rules": {"cubic": {"max": 900}},
}


def harbour(path="", value=None):
    """The mapping with one place changed, or taken out if the value is ``...``."""
    doc = copy.deepcopy(HARBOUR)
    *outer, last = path.split("/")
    at = doc
    for step in outer:
        at = at[step]
    if value is ...:
        del at[last]
    elif path:
        at[last] = value
    return doc


def test_mapping_gives_the_constructed_spec():
    assert Spec.from_dict(HARBOUR) == base_spec()


def test_what_may_be_left_out():
    doc = harbour("validation_rules", ...)
    del doc["output"]["sort_by"]
    spec = Spec.from_dict(doc)
    assert (spec.sort_by, dict(spec.bounds), spec.column("cubic").scale) == ((), {}, None)


@pytest.mark.parametrize("path, value, problem", [
    ("duplicate_keys", ["quay"], "keys: 'quay' is not a required column"),
    ("input/column_types/quay", "int", "input.column_types: 'quay' is not a required column"),
    ("input/column_types/opened", ..., "input.column_types: 'opened' has no type"),
    ("input/column_types/opened", "number", "columns: 'opened' has the unknown type 'number'"),
    ("aggregate", [{"column": "quay", "method": "count"}], "rules: 'quay' is not a required column"),
    ("aggregate", [{"column": "berth", "method": "mean"}], "rules: 'berth' is not an int or float column"),
    ("aggregate", [{"column": "hydrant", "method": "sum"}], "rules: 'hydrant' can only be counted, being a key"),
    ("aggregate", [{"column": "cubic", "method": "max"}], "rules: 'cubic' has the unknown method 'max'"),
    ("aggregate", [], "rules: at least one entry is needed"),
    ("duplicate_keys", [], "keys: at least one entry is needed"),
    ("output/columns_order", ["quay"], "order: 'quay' is neither a key nor a merged column"),
    ("output/sort_by", ["quay"], "sort_by: 'quay' is neither a key nor a merged column"),
    ("validation_rules", {"berth": {"max": 1}}, "bounds: 'berth' is not an int or float column"),
    ("tide", 1, "tide: unknown field"),
    ("input/tide", 1, "input.tide: unknown field"),
    ("validation_rules/cubic/most", 1, "validation_rules.cubic.most: unknown field"),
    ("output", ..., "output: field is missing"),
    # Values of the wrong kind are found here, not later inside a job.
    ("validation_rules/cubic/max", "many", "validation_rules.cubic.max: a number is needed"),
    ("validation_rules/cubic/max", True, "validation_rules.cubic.max: a number is needed"),
    ("validation_rules/cubic", 5, "validation_rules.cubic: a mapping is needed"),
    ("duplicate_keys", "berth", "duplicate_keys: a list is needed"),
    ("output/columns_order", [1], "output.columns_order.0: a text is needed"),
    ("aggregate", {"column": "cubic"}, "aggregate: a list is needed"),
    ("input/allow_missing_values", {"opened": "yes"}, "input.allow_missing_values.opened: true or false is needed"),
    ("input/column_types", ["int"], "input.column_types: a mapping is needed"),
    ("input/scales", {"cubic": 2.5}, "input.scales.cubic: a whole number is needed"),
    ("version", 1, "version: a text is needed"),
    ("input", None, "input.: a mapping is needed"),
])
def test_each_problem_is_named_with_its_field(path, value, problem):
    with pytest.raises(SpecError) as e:
        Spec.from_dict(harbour(path, value))
    assert problem in e.value.problems


def test_bounds_need_a_result_column():
    with pytest.raises(SpecError, match="bounds: 'depth' is neither a key nor a merged column"):
        base_spec(columns=(*base_spec().columns, Column("depth", "float")), bounds={"depth": Bounds(0)})


def test_names_come_once():
    with pytest.raises(SpecError, match="rules: 'cubic' is named more than once"):
        base_spec(rules=(Rule("cubic", "sum"), Rule("cubic", "mean"), Rule("opened", "sum")))
    with pytest.raises(SpecError, match="keys: 'berth' is named more than once"):
        base_spec(keys=("berth", "hydrant", "berth"))


def test_all_problems_at_once():
    with pytest.raises(SpecError) as e:
        base_spec(keys=("x",), order=("y",), sort_by=("z",), bounds={"w": Bounds(1)})
    assert {p.split(":")[0] for p in e.value.problems} == {"keys", "order", "sort_by", "bounds"}


def test_scale_and_formats():
    with pytest.raises(SpecError, match="'cubic' needs a scale from 0 to 36"):
        base_spec(columns=(*base_spec().columns[:3], Column("cubic", "float", scale=40)))
    with pytest.raises(SpecError, match="'day' needs a date format"):
        base_spec(columns=(*base_spec().columns, Column("day", "date", formats=())))
