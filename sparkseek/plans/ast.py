"""Syntax trees of the graph language."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Literal:
    value: object
    type: str


@dataclass(frozen=True)
class Unary:
    op: str
    argument: Expr


@dataclass(frozen=True)
class Binary:
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Call:
    name: str
    arguments: tuple[Expr, ...]


Expr = Var | Literal | Unary | Binary | Call


@dataclass(frozen=True)
class Attribute:
    name: str
    value: Expr


@dataclass(frozen=True)
class Role:
    """role is None where roles are given by position."""

    role: str | None
    variable: str


@dataclass(frozen=True)
class EntityDefinition:
    name: str
    attributes: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class RelationDefinition:
    name: str
    roles: tuple[tuple[str, str], ...]
    attributes: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class EntityInsertion:
    variable: str
    type: str
    attributes: tuple[Attribute, ...] = ()


@dataclass(frozen=True)
class RelationInsertion:
    variable: str
    roles: tuple[Role, ...]
    type: str
    attributes: tuple[Attribute, ...] = ()


@dataclass(frozen=True)
class EntityPattern:
    variable: str
    type: str
    attributes: tuple[Attribute, ...] = ()


@dataclass(frozen=True)
class RelationPattern:
    variable: str | None
    roles: tuple[Role, ...]
    type: str
    attributes: tuple[Attribute, ...] = ()


@dataclass(frozen=True)
class Condition:
    test: Expr


@dataclass(frozen=True)
class Negation:
    pattern: EntityPattern | RelationPattern


Pattern = EntityPattern | RelationPattern | Condition | Negation


@dataclass(frozen=True)
class Compute:
    variable: str
    expression: Expr


@dataclass(frozen=True)
class EntityInference:
    variable: str
    type: str
    attributes: tuple[Attribute, ...] = ()


@dataclass(frozen=True)
class RelationInference:
    roles: tuple[Role, ...]
    type: str
    attributes: tuple[Attribute, ...] = ()


@dataclass(frozen=True)
class Extension:
    variable: str
    attributes: tuple[Attribute, ...]


@dataclass(frozen=True)
class Query:
    patterns: tuple[Pattern, ...]
    get: tuple[str, ...]
    computes: tuple[Compute, ...] = ()


@dataclass(frozen=True)
class Rule:
    name: str
    patterns: tuple[Pattern, ...]
    kind: str
    inferences: tuple[EntityInference | RelationInference | Extension, ...]
    computes: tuple[Compute, ...] = ()
