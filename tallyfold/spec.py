"""The job parameters: which columns a list must have and how lists are consolidated.

A ``Spec`` is a small immutable object on the driver.  Constructing one checks it for
consistency and reports every problem at once, so the operators never have to re-check it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from types import MappingProxyType
from typing import Any

COLUMN_TYPES = ("string", "int", "float", "date")
NUMERIC_TYPES = ("int", "float")
METHODS = ("sum", "mean", "count")


class SpecError(ValueError):
    """The spec is inconsistent; ``problems`` lists every violated rule."""

    def __init__(self, problems: Iterable[str]):
        self.problems = tuple(problems)
        super().__init__("invalid spec:\n" + "\n".join(f"  - {p}" for p in self.problems))


@dataclass(frozen=True)
class Column:
    """One required column.

    A ``float`` column that is summed or averaged holds doubles of any size, whose sums are exact and rounded once;
    with a ``scale`` it holds decimals with so many places instead.  ``formats`` are the accepted patterns of a
    ``date`` column.
    """

    name: str
    type: str
    allow_missing: bool = False
    scale: int | None = None
    formats: tuple[str, ...] = ("yyyy-MM-dd",)

    @property
    def is_numeric(self) -> bool:
        return self.type in NUMERIC_TYPES


@dataclass(frozen=True)
class Rule:
    """Merge rule for one column: ``sum``, ``mean`` or ``count`` of its present values."""

    column: str
    method: str


@dataclass(frozen=True)
class Bounds:
    """Inclusive limits for a result column; either side may be open."""

    min: float | None = None
    max: float | None = None


@dataclass(frozen=True)
class Spec:
    name: str
    columns: tuple[Column, ...]
    keys: tuple[str, ...]
    rules: tuple[Rule, ...]
    order: tuple[str, ...]
    sort_by: tuple[str, ...] = ()
    bounds: Mapping[str, Bounds] = field(default_factory=dict)
    version: str = "1.0"
    suffix: str = ""

    def __post_init__(self) -> None:
        for name in ("columns", "keys", "rules", "order", "sort_by"):
            object.__setattr__(self, name, tuple(getattr(self, name)))
        object.__setattr__(self, "bounds", MappingProxyType(dict(self.bounds)))
        problems = list(self._problems())
        if problems:
            raise SpecError(problems)

    # -- lookups used by the operators --------------------------------------------------

    @property
    def required(self) -> tuple[str, ...]:
        return tuple(c.name for c in self.columns)

    def column(self, name: str) -> Column:
        return next(c for c in self.columns if c.name == name)

    def columns_with(self, *methods: str) -> tuple[str, ...]:
        return tuple(r.column for r in self.rules if r.method in methods)

    @property
    def exact(self) -> frozenset[str]:
        """Float columns held as decimals because they are summed or averaged."""
        return frozenset(c for c in self.columns_with("sum", "mean")
                         if self.column(c).type == "float" and self.column(c).scale is not None)

    @property
    def free(self) -> tuple[str, ...]:
        """Float columns that are summed or averaged as doubles of any size."""
        return tuple(c for c in self.columns_with("sum", "mean")
                     if self.column(c).type == "float" and self.column(c).scale is None)

    @property
    def counted_keys(self) -> tuple[str, ...]:
        """Key columns whose place in the result is taken by a count."""
        return tuple(c for c in self.columns_with("count") if c in self.keys)

    @property
    def result_names(self) -> tuple[str, ...]:
        """Keys followed by merged columns, each name once."""
        return tuple(dict.fromkeys(self.keys + tuple(r.column for r in self.rules)))

    # -- consistency --------------------------------------------------------------------

    def _problems(self) -> Iterable[str]:
        """Every violated rule, each with the field it concerns."""
        required, result = set(self.required), set(self.result_names)
        numeric = {c.name for c in self.columns if c.is_numeric}
        ruled = tuple(r.column for r in self.rules)
        summed = tuple(r.column for r in self.rules if r.method != "count")
        a_column, a_result = "is not a required column", "is neither a key nor a merged column"
        a_number, a_value = "is not an int or float column", "can only be counted, being a key"
        # Field, the names it gives, the names it may give, what is wrong with others.
        for field_name, names, allowed, fault in (
                ("keys", self.keys, required, a_column), ("rules", ruled, required, a_column),
                ("rules", summed, numeric | (set(summed) - required), a_number),
                ("rules", summed, set(summed) - set(self.keys), a_value),
                ("order", self.order, result, a_result), ("sort_by", self.sort_by, result, a_result),
                ("bounds", tuple(self.bounds), numeric, a_number),
                ("bounds", tuple(n for n in self.bounds if n in numeric), result, a_result)):
            yield from (f"{field_name}: '{n}' {fault}" for n in dict.fromkeys(names) if n not in allowed)
        # Field, its entries, whether there must be one; no name may come twice.
        for field_name, names, needed in (("columns", self.required, True), ("keys", self.keys, True),
                                          ("rules", ruled, True), ("order", self.order, True),
                                          ("sort_by", self.sort_by, False)):
            if needed and not names:
                yield f"{field_name}: at least one entry is needed"
            repeated = [n for n, times in Counter(names).items() if times > 1]
            yield from (f"{field_name}: '{n}' is named more than once" for n in repeated)
        # What a single entry may look like.
        for field_name, name, wrong, fault in (
                *(("columns", c.name, c.type not in COLUMN_TYPES, f"has the unknown type '{c.type}'")
                  for c in self.columns),
                *(("columns", c.name, c.scale is not None and not 0 <= c.scale <= 36, "needs a scale from 0 to 36") for c in self.columns),
                *(("columns", c.name, c.type == "date" and not c.formats, "needs a date format") for c in self.columns),
                *(("rules", r.column, r.method not in METHODS, f"has the unknown method '{r.method}'")
                  for r in self.rules)):
            if wrong:
                yield f"{field_name}: '{name}' {fault}"

    # -- interchange --------------------------------------------------------------------

    @classmethod
    def from_dict(cls, doc: Mapping[str, Any]) -> Spec:
        """Build a spec from the nested mapping users keep as JSON.

        The field names are fixed by that file format.  ``scales`` and ``date_formats`` in
        ``input`` are optional additions; any other unknown field is an error.
        """
        problems: list[str] = []

        def take(where: str, source: Any, needed: tuple[str, ...], optional: tuple[str, ...] = ()) -> dict:
            if not isinstance(source, Mapping):
                problems.append(f"{where or 'spec'}: a mapping is needed")
                source = {}
            else:
                problems.extend(f"{where}{k}: unknown field" for k in source if k not in needed + optional)
                problems.extend(f"{where}{k}: field is missing" for k in needed if k not in source)
            return dict(source)

        top = take("", doc, ("template_name", "version", "input", "duplicate_keys", "aggregate", "output"),
                   ("validation_rules",))
        inp = take("input.", top.get("input", {}), ("required_columns", "column_types", "allow_missing_values"),
                   ("scales", "date_formats"))
        out = take("output.", top.get("output", {}), ("columns_order",), ("sort_by", "filename_suffix"))

        def typed(where: str, value: Any, kind: type | tuple[type, ...], what: str, default: Any) -> Any:
            """The value if it is of that kind; text is no list, and a truth value no number."""
            if not isinstance(value, kind) or isinstance(value, bool) and kind is not bool:
                problems.append(f"{where}: {what} is needed")
                return default
            return value

        def names_of(where: str, source: dict, key: str) -> list[str]:
            found = typed(f"{where}{key}", source.get(key, []), (list, tuple), "a list", [])
            return [typed(f"{where}{key}.{i}", n, str, "a text", "") for i, n in enumerate(found)]

        def mapping_of(where: str, source: dict, key: str, kind, what: str) -> dict:
            found = typed(f"{where}{key}", source.get(key, {}), Mapping, "a mapping", {})
            return {n: typed(f"{where}{key}.{n}", v, kind, what, None) for n, v in found.items()}

        for key in ("template_name", "version"):
            typed(key, top.get(key, ""), str, "a text", "")
        suffix = typed("output.filename_suffix", out.get("filename_suffix") or "", str, "a text", "")
        listed = typed("aggregate", top.get("aggregate", []), (list, tuple), "a list", [])
        rules = [take(f"aggregate.{i}.", r, ("column", "method")) for i, r in enumerate(listed)]
        for i, rule in enumerate(rules):
            for key, value in rule.items():
                typed(f"aggregate.{i}.{key}", value, str, "a text", "")
        bounds = {n: take(f"validation_rules.{n}.", b, (), ("min", "max"))
                  for n, b in mapping_of("", top, "validation_rules", Mapping, "a mapping").items() if b is not None}
        for n, sides in bounds.items():
            for key, value in sides.items():
                typed(f"validation_rules.{n}.{key}", value if value is not None else 0, (int, float), "a number", None)
        required = names_of("input.", inp, "required_columns")
        types = mapping_of("input.", inp, "column_types", str, "a text")
        keys = names_of("", top, "duplicate_keys")
        order, sort_by = (names_of("output.", out, key) for key in ("columns_order", "sort_by"))
        missing = mapping_of("input.", inp, "allow_missing_values", bool, "true or false")
        scales = mapping_of("input.", inp, "scales", int, "a whole number")
        formats = names_of("input.", inp, "date_formats") if "date_formats" in inp else Column.formats
        problems.extend(f"input.column_types: '{n}' is not a required column" for n in types if n not in required)
        problems.extend(f"input.column_types: '{n}' has no type" for n in required if n not in types)
        if problems:
            raise SpecError(problems)

        return cls(
            name=top["template_name"],
            version=top["version"],
            columns=tuple(Column(n, types[n], bool(missing.get(n, False)), scales.get(n, Column.scale),
                                 tuple(formats)) for n in required),
            keys=tuple(keys),
            rules=tuple(Rule(r["column"], r["method"]) for r in rules),
            order=tuple(order),
            sort_by=tuple(sort_by),
            bounds={n: Bounds(**b) for n, b in bounds.items()},
            suffix=suffix,
        )
