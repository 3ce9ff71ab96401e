"""Consolidate many tabular lists of the same layout into one checked table, on Spark."""

from tallyfold.operators.checks import check, control_totals, gated, reconcile, residual_duplicates
from tallyfold.operators.consolidate import consolidate, merge
from tallyfold.operators.validate import cell_issues, typed_rows
from tallyfold.plans.publish import published
from tallyfold.plans.run import Run, run
from tallyfold.plans.tables import Validation, validate_tables
from tallyfold.sources.catalog import Dialect, InputError
from tallyfold.sources.scan import cells
from tallyfold.spec import Bounds, Column, Rule, Spec, SpecError

__all__ = ["Bounds", "Column", "Dialect", "InputError", "Rule", "Run", "Spec", "SpecError", "Validation", "cell_issues", "cells",
           "check", "consolidate", "control_totals", "gated", "merge", "published", "reconcile", "residual_duplicates",
           "run", "typed_rows", "validate_tables"]
