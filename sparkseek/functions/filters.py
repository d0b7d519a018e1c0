"""Metadata schemas and filters. A filter is a real predicate, applied before anything is scored."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidFieldValue, SearchError, UndeclaredCombination

MOST_BITS = 10


def width(cardinality: int) -> int:
    """Bits for the value ids of a field: the smallest power of two above them all, 1024 at most."""
    bits = max(1, (cardinality - 1).bit_length())
    if bits > MOST_BITS:
        raise SearchError(f"{cardinality} values are too many; {1 << MOST_BITS} are possible")
    return bits


def bits_of(value_id: int, size: int) -> list[int]:
    """A value id in binary, the highest bit first."""
    return [value_id >> i & 1 for i in range(size - 1, -1, -1)]


@dataclass(frozen=True)
class Predicate:
    field: str
    value: int | str
    op: str = "Equal"

    def column(self, col) -> Column:
        c = col(self.field)
        if self.op == "Equal":
            return c == F.lit(self.value)
        if self.op == "NotEqual":
            return c.isNotNull() & (c != F.lit(self.value))
        raise SearchError(f"no operator {self.op}")


@dataclass(frozen=True)
class Filter:
    """How predicates go together: Is (one), And, Or. Filters can be nested."""

    kind: str
    parts: tuple[Predicate | Filter, ...]

    def __post_init__(self):
        if self.kind not in ("Is", "And", "Or") or not self.parts or self.kind == "Is" and len(self.parts) != 1:
            raise SearchError(f"not a filter: {self.kind} of {len(self.parts)}")

    def predicates(self) -> list[Predicate]:
        return [q for p in self.parts for q in (p.predicates() if isinstance(p, Filter) else [p])]

    def column(self, col=F.col) -> Column:
        each = [p.column(col) for p in self.parts]
        return reduce((lambda a, b: a | b) if self.kind == "Or" else (lambda a, b: a & b), each)


def is_(field: str, value: int | str, op: str = "Equal") -> Filter:
    return Filter("Is", (Predicate(field, value, op),))


def and_(*parts: Predicate | Filter) -> Filter:
    return Filter("And", parts)


def or_(*parts: Predicate | Filter) -> Filter:
    return Filter("Or", parts)


def parse_filter(form: dict) -> Filter:
    """A filter from its JSON: {"Is": p}, {"And": [p]}, {"Or": [p]}, or the forms with $eq, $ne, $and, $or."""
    if not isinstance(form, dict) or not form:
        raise SearchError(f"not a filter: {form!r}")
    if len(form) > 1:
        return Filter("And", tuple(parse_filter({k: v}) for k, v in form.items()))
    ((key, value),) = form.items()
    if key in ("And", "Or", "$and", "$or"):
        return Filter(key.lstrip("$").capitalize(), tuple(_part(p) for p in value))
    if key == "Is":
        return Filter("Is", (_part(value),))
    if isinstance(value, dict):
        ops = {"$eq": "Equal", "$ne": "NotEqual"}
        if not value or any(o not in ops for o in value):
            raise SearchError(f"{key}: one of {sorted(ops)} is possible")
        parts = tuple(Predicate(key, v, ops[o]) for o, v in value.items())
        return Filter("Is" if len(parts) == 1 else "And", parts)
    return is_(key, value)


def _part(form: dict) -> Predicate | Filter:
    if isinstance(form, dict) and "field_name" in form:
        return Predicate(form["field_name"], form["field_value"], form.get("operator", "Equal"))
    inner = parse_filter(form)
    return inner.parts[0] if inner.kind == "Is" else inner


@dataclass(frozen=True)
class Field:
    """A field with all values that it may have, all of one type; ids are the places in sorted order, from 1."""

    name: str
    values: tuple[int | str, ...]

    def __post_init__(self):
        kinds = {type(v) for v in self.values}
        if len(kinds) != 1 or not kinds <= {int, str}:
            raise SearchError(f"{self.name}: values must all be whole numbers or all be strings")
        object.__setattr__(self, "values", tuple(sorted(set(self.values))))
        width(len(self.values) + 1)

    @property
    def size(self) -> int:
        return width(len(self.values) + 1)

    def value_id(self, value: int | str) -> int:
        try:
            return self.values.index(value) + 1
        except ValueError:
            raise InvalidFieldValue(f"{self.name} has no value {value!r}") from None


@dataclass(frozen=True)
class MetadataSchema:
    """Declared fields, and which conjunctions and disjunctions of fields are meant to be asked for."""

    fields: tuple[Field, ...]
    conditions: tuple[tuple[str, tuple[str, ...]], ...] = field(default=())

    def __post_init__(self):
        names = [f.name for f in self.fields]
        if len(set(names)) != len(names):
            raise SearchError("a field is declared twice")
        unique = []
        for op, over in self.conditions:
            if op not in ("And", "Or"):
                raise SearchError(f"no condition {op}")
            if unknown := set(over) - set(names):
                raise SearchError(f"conditions name fields that aren't declared: {sorted(unknown)}")
            item = (op, tuple(sorted(set(over))))
            if item not in unique:
                unique.append(item)
        object.__setattr__(self, "conditions", tuple(unique))

    def field(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise SearchError(f"no field {name}")

    def struct_type(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, T.IntegerType() if isinstance(f.values[0], int) else T.StringType()) for f in self.fields])

    def check(self, f: Filter, strict: bool = False) -> Filter:
        """The filter, if all of its values are declared and, with strict, its conjunctions too."""
        for p in f.predicates():
            self.field(p.field).value_id(p.value)
        if strict and f.kind == "And":
            over = tuple(sorted({p.field for p in f.predicates()}))
            if len(over) > 1 and ("And", over) not in self.conditions:
                raise UndeclaredCombination(f"And of {', '.join(over)} isn't declared")
        return f

    def check_metadata(self, metadata: dict[str, int | str]) -> dict[str, int | str]:
        for name, value in metadata.items():
            if isinstance(value, bool) or not isinstance(value, (int, str)) or isinstance(value, int) and not -(1 << 31) <= value < 1 << 31:
                raise InvalidFieldValue(f"{name}: {value!r} is neither a 32-bit whole number nor a string")
            self.field(name).value_id(value)
        return metadata

    # Encodings into bits, for exchange with systems that fold filters into vectors; searches here don't need them.

    def encode(self, f: Filter) -> list[list[int]]:
        """Dimension vectors: 1 and -1 for the bits of an Equal and NotEqual value, 0 where a field isn't asked for.

        Or gives a vector for each predicate.
        """

        def one(predicates: list[Predicate]) -> list[int]:
            asked = {p.field: p for p in predicates}
            out = []
            for fld in self.fields:
                if p := asked.get(fld.name):
                    bits = bits_of(fld.value_id(p.value), fld.size)
                    out += bits if p.op == "Equal" else [-1 if b else 1 for b in bits]
                else:
                    out += [0] * fld.size
            return out

        return [one([p]) for p in f.predicates()] if f.kind == "Or" else [one(f.predicates())]

    def replicas(self, metadata: dict[str, int | str]) -> list[list[int]]:
        """Dimension vectors of a record: the base, one for each field, one for each declared conjunction."""
        asked = [()] + [(f.name,) for f in self.fields if f.name in metadata]
        asked += [over for op, over in self.conditions if op == "And" and len(over) > 1 and all(n in metadata for n in over)]
        return [[b for f in self.fields for b in (bits_of(f.value_id(metadata[f.name]), f.size) if f.name in over else [0] * f.size)] for over in asked]

    def max_replicas(self) -> int:
        return 1 + len(self.fields) + sum(op == "And" for op, _ in self.conditions)

    def combinations(self) -> list[dict[str, int | str]]:
        """All records' metadata that the schema allows."""
        return [dict(zip([f.name for f in self.fields], values)) for values in product(*[f.values for f in self.fields])]
