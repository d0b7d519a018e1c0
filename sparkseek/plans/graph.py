"""Graphs of entities and relationships: statements compile to joins, recursive rules to a fixpoint of joins."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import NotFound, SearchError
from ..shared import shared_root
from . import ast as a
from .parser import parse

SPARK_TYPES = {"string": "string", "int": "bigint", "double": "double", "date": "date", "boolean": "boolean"}
EID, RID = "eid", "rid"
#: Rounds of a fixpoint after which what they found is written as one table.
COMPACT = 4

FUNCTIONS: dict[str, Callable[..., Column]] = {
    "date": lambda x: F.coalesce(F.try_to_date(x, "yyyy-M-d"), F.try_to_date(x, "d-M-yyyy")),
    "years_between": lambda x, y: F.floor(F.abs(F.months_between(y, x)) / 12).cast("bigint"),
    "current_date": lambda: F.current_date(),
    "current_year": lambda: F.year(F.current_date()).cast("bigint"),
    "current_timestamp": lambda: F.current_timestamp(),
    "abs": F.abs,
    "lower": F.lower,
    "upper": F.upper,
}
_BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "/": lambda x, y: x / y, "%": lambda x, y: x % y, "**": F.pow,
    "==": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y,
    "and": lambda x, y: x & y, "or": lambda x, y: x | y,
}


def variables(e: a.Expr) -> set[str]:
    match e:
        case a.Var(name):
            return {name}
        case a.Unary(_, x):
            return variables(x)
        case a.Binary(_, x, y):
            return variables(x) | variables(y)
        case a.Call(_, xs):
            return set().union(*map(variables, xs))
    return set()


def bound(p: a.Pattern) -> set[str]:
    """Variables that a pattern binds."""
    if isinstance(p, a.EntityPattern):
        return {p.variable} | {v for x in p.attributes for v in variables(x.value)}
    if isinstance(p, a.RelationPattern):
        return ({p.variable} if p.variable else set()) | {r.variable for r in p.roles} | {v for x in p.attributes for v in variables(x.value)}
    return set()


class Graph:
    """Entity and relationship tables by type, with rules. Entities have the column eid, relationships rid."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.entity_types: dict[str, a.EntityDefinition] = {}
        self.relation_types: dict[str, a.RelationDefinition] = {}
        self.entities: dict[str, DataFrame] = {}
        self.relations: dict[str, DataFrame] = {}
        self.rules: dict[str, a.Rule] = {}
        self.procedures = dict(FUNCTIONS)
        self._inferred: dict[tuple[str, str], DataFrame] | None = None

    # facts

    def define(self, d: a.EntityDefinition | a.RelationDefinition) -> None:
        if isinstance(d, a.EntityDefinition):
            self.entity_types[d.name] = d
        else:
            if unknown := [t for _, t in d.roles if t not in self.entity_types]:
                raise NotFound(f"{d.name}: no entity types {unknown}")
            self.relation_types[d.name] = d

    def _columns(self, kind: str, name: str) -> list[tuple[str, str]]:
        if kind == "entity":
            if name not in self.entity_types:
                raise NotFound(f"entity type {name}")
            return [(EID, "string"), *[(n, SPARK_TYPES[t]) for n, t in self.entity_types[name].attributes]]
        if name not in self.relation_types:
            raise NotFound(f"relationship type {name}")
        d = self.relation_types[name]
        return [(RID, "string"), *[(n, "string") for n, _ in d.roles], *[(n, SPARK_TYPES[t]) for n, t in d.attributes]]

    def _add(self, kind: str, name: str, df: DataFrame) -> None:
        columns = self._columns(kind, name)
        if missing := [c for c, _ in columns if c not in df.columns]:
            raise SearchError(f"{name}: no columns {missing}")
        plain = df.select(*[F.col(c).cast(t).alias(c) for c, t in columns])
        tables = self.entities if kind == "entity" else self.relations
        tables[name] = tables[name].unionByName(plain) if name in tables else plain
        self._inferred = None

    def add_entities(self, name: str, df: DataFrame) -> None:
        self._add("entity", name, df)

    def add_relations(self, name: str, df: DataFrame, check: bool = False) -> None:
        """Adds facts; with check, only if each role is held by an entity of the role's type."""
        if check and (bad := self.violations(name, df).first()) is not None:
            raise SearchError(f"{name}: {bad['role']} {bad['id']} isn't there")
        self._add("relation", name, df)

    def violations(self, name: str, facts: DataFrame | None = None) -> DataFrame:
        """(role, id) of the roles in facts, by default all of the type, whose holder isn't an entity of the role's type."""
        if name not in self.relation_types:
            raise NotFound(f"relationship type {name}")
        facts = self._facts(("relation", name)) if facts is None else facts
        found = []
        for role, kind in self.relation_types[name].roles:
            there = self._facts(("entity", kind)).select(F.col(EID).alias("id"))
            held = facts.select(F.lit(role).alias("role"), F.col(role).alias("id")).where("id IS NOT NULL").distinct()
            found.append(held.join(there, "id", "left_anti").select("role", "id"))
        return reduce(DataFrame.union, found)

    def register(self, name: str, procedure: Callable[..., Column]) -> None:
        """A procedure for expressions: a function of columns, such as a UDF."""
        self.procedures[name] = procedure

    def _insert(self, s: a.EntityInsertion | a.RelationInsertion) -> None:
        kind = "entity" if isinstance(s, a.EntityInsertion) else "relation"
        columns = dict(self._columns(kind, s.type))
        row: dict[str, Column] = {EID if kind == "entity" else RID: F.lit(s.variable)}
        if kind == "relation":
            row |= {name: F.lit(r.variable) for name, r in zip(self._roles(s.type, s.roles), s.roles)}
        for x in s.attributes:
            if x.name not in columns:
                raise SearchError(f"{s.type} has no attribute {x.name}")
            self._check(x, columns[x.name])
            row[x.name] = self.compile(x.value)
        self._add(kind, s.type, self.spark.range(1).select(*[row.get(c, F.lit(None)).cast(t).alias(c) for c, t in columns.items()]))

    def _check(self, x: a.Attribute, wanted: str) -> None:
        if isinstance(x.value, a.Literal):
            given = SPARK_TYPES[x.value.type]
            if given != wanted and (given, wanted) != ("bigint", "double"):
                raise SearchError(f"{x.name} is a {wanted}, not a {given}")

    def _roles(self, name: str, roles: tuple[a.Role, ...]) -> list[str]:
        """Role columns of a relationship, by name or by position."""
        declared = [n for n, _ in self.relation_types[name].roles] if name in self.relation_types else None
        if declared is None:
            raise NotFound(f"relationship type {name}")
        if len(roles) > len(declared):
            raise SearchError(f"{name} has {len(declared)} roles")
        out = [r.role if r.role is not None else declared[i] for i, r in enumerate(roles)]
        if unknown := set(out) - set(declared):
            raise SearchError(f"{name} has no roles {sorted(unknown)}")
        return out

    # expressions and patterns

    def compile(self, e: a.Expr) -> Column:
        match e:
            case a.Var(name):
                return F.col(f"`{name}`")
            case a.Literal(value, kind):
                return F.lit(value).cast(SPARK_TYPES[kind])
            case a.Unary("-", x):
                return -self.compile(x)
            case a.Unary(_, x):
                return ~self.compile(x)
            case a.Binary(op, x, y):
                return _BINARY[op](self.compile(x), self.compile(y))
            case a.Call(name, xs):
                if name not in self.procedures:
                    raise NotFound(f"function {name}")
                return self.procedures[name](*map(self.compile, xs))
        raise SearchError(f"not an expression: {e}")

    def _bindings(self, table: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
        """table with variables for columns; a variable of two columns unifies them."""
        by: dict[str, list[str]] = {}
        for column, variable in columns:
            by.setdefault(variable, []).append(column)
        for same in by.values():
            for other in same[1:]:
                table = table.where(F.col(same[0]).eqNullSafe(F.col(other)) & F.col(other).isNotNull())
        return table.select(*[F.col(own[0]).alias(v) for v, own in by.items()])

    def _scan(self, p: a.EntityPattern | a.RelationPattern, table: DataFrame) -> DataFrame:
        if isinstance(p, a.EntityPattern):
            known, columns = dict(self._columns("entity", p.type)), [(EID, p.variable)]
            known |= {c: t for c, t in table.dtypes}
        else:
            known = dict(self._columns("relation", p.type))
            columns = [(RID, p.variable)] if p.variable else []
            columns += [(c, r.variable) for c, r in zip(self._roles(p.type, p.roles), p.roles)]
        for x in p.attributes:
            if x.name not in known:
                raise SearchError(f"{p.type} has no attribute {x.name}")
            if isinstance(x.value, a.Var):
                columns.append((x.name, x.value.name))
            else:
                table = table.where(F.col(x.name) == self.compile(x.value))
        return self._bindings(table, columns)

    def match(self, patterns: tuple[a.Pattern, ...], tables: Callable[[int, a.Pattern], DataFrame], computes: tuple[a.Compute, ...] = ()) -> DataFrame:
        """All bindings: equi-joins on shared variables, connected patterns first; conditions as soon as they can."""
        atoms = [(i, p) for i, p in enumerate(patterns) if isinstance(p, a.EntityPattern | a.RelationPattern)]
        tests = [p.test for p in patterns if isinstance(p, a.Condition)]
        if not atoms:
            raise SearchError("nothing to match but conditions")
        out, have = None, set()
        while atoms:
            i, p = next(((i, p) for i, p in atoms if bound(p) & have), atoms[0])
            atoms.remove((i, p))
            scan = self._scan(p, tables(i, p))
            shared = sorted(bound(p) & have)
            out = scan if out is None else (out.join(scan, shared) if shared else out.crossJoin(scan))
            have |= bound(p)
            for t in [t for t in tests if variables(t) <= have]:
                out = out.where(self.compile(t))
                tests.remove(t)
        for i, p in enumerate(patterns):
            if isinstance(p, a.Negation):
                shared = sorted(bound(p.pattern) & have)
                if not shared:
                    raise SearchError("a negated pattern shares no variable with the others")
                out = out.join(self._scan(p.pattern, tables(i, p.pattern)).select(*shared).distinct(), shared, "left_anti")
        for c in computes:
            out = out.withColumn(c.variable, self.compile(c.expression))
            have.add(c.variable)
        for t in tests:
            if not variables(t) <= have:
                raise SearchError(f"no pattern binds {sorted(variables(t) - have)}")
            out = out.where(self.compile(t))
        return out

    # rules

    def _conclusion(self, rule: a.Rule, found: DataFrame, i) -> tuple[tuple[str, str], DataFrame]:
        if isinstance(i, a.RelationInference):
            columns = self._columns("relation", i.type)
            values = {c: F.col(f"`{r.variable}`") for c, r in zip(self._roles(i.type, i.roles), i.roles)} | {x.name: self.compile(x.value) for x in i.attributes}
            key, own = ("relation", i.type), RID
        elif isinstance(i, a.EntityInference):
            columns = self._columns("entity", i.type)
            values = {x.name: self.compile(x.value) for x in i.attributes}
            key, own = ("entity", i.type), EID
        else:
            values = {x.name: self.compile(x.value) for x in i.attributes}
            return ("extend", self._type_of(rule, i.variable)), found.select(F.col(f"`{i.variable}`").alias(EID), *[v.alias(c) for c, v in values.items()]).distinct()
        facts = found.select(*[values.get(c, F.lit(None)).cast(t).alias(c) for c, t in columns if c != own]).distinct()
        content = F.to_json(F.struct(*[c for c, _ in columns if c != own]))
        return key, facts.select(F.sha2(F.concat(F.lit(f"{i.type}|"), content), 256).alias(own), *[c for c, _ in columns if c != own])

    def _type_of(self, rule: a.Rule, variable: str) -> str:
        for p in rule.patterns:
            if isinstance(p, a.EntityPattern) and p.variable == variable:
                return p.type
        raise SearchError(f"{rule.name}: ${variable} is no entity of a pattern")

    @staticmethod
    def _key(p) -> tuple[str, str]:
        return ("entity" if isinstance(p, a.EntityPattern | a.EntityInference) else "relation", p.type)

    def _strata(self) -> list[list[a.Rule]]:
        """Rules in layers, so that what a rule negates is complete before it."""
        makes = {r.name: {self._key(i) for i in r.inferences if not isinstance(i, a.Extension)} for r in self.rules.values()}
        level = dict.fromkeys(self.rules, 0)
        for _ in range(len(self.rules) + 1):
            changed = False
            for r in self.rules.values():
                for p in r.patterns:
                    if isinstance(p, a.Condition):
                        continue
                    key, more = (self._key(p.pattern), 1) if isinstance(p, a.Negation) else (self._key(p), 0)
                    for other, made in makes.items():
                        if key in made and level[r.name] < level[other] + more:
                            level[r.name], changed = level[other] + more, True
            if not changed:
                return [[r for r in self.rules.values() if level[r.name] == n] for n in sorted(set(level.values()))]
        raise SearchError("a rule depends on its own negation")

    def _settled(self, df: DataFrame) -> DataFrame:
        """Written to the folder that all executors share, which ends its lineage."""
        path = f"{shared_root(self.spark)}/facts-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _facts(self, key: tuple[str, str]) -> DataFrame:
        tables = self.entities if key[0] == "entity" else self.relations
        if key[1] in tables:
            return tables[key[1]]
        return self.spark.createDataFrame([], ", ".join(f"`{c}` {t}" for c, t in self._columns(*key)))

    def infer(self) -> dict[tuple[str, str], DataFrame]:
        """All facts that rules give, by semi-naive evaluation: a round joins what the last one found with all else.

        Facts are sets, so cycles end; a round that finds nothing ends a layer. What is found is checkpointed each
        round, and only its emptiness comes to the driver.
        """
        if self._inferred is not None:
            return self._inferred
        total: dict[tuple[str, str], DataFrame] = {}
        extra: dict[tuple[str, str], DataFrame] = {}
        rounds: dict[tuple[str, str], int] = {}

        def every(key: tuple[str, str]) -> DataFrame:
            base = self._facts(key)
            return base.unionByName(total[key]) if key in total else base

        for layer in self._strata():
            made = {self._key(i) for r in layer for i in r.inferences if not isinstance(i, a.Extension)}
            delta: dict[tuple[str, str], DataFrame] | None = None
            while delta is None or delta:
                fresh: dict[tuple[str, str], list[DataFrame]] = {}
                for r in layer:
                    if delta is None:
                        runs = [None]
                    else:
                        runs = [i for i, p in enumerate(r.patterns) if isinstance(p, a.EntityPattern | a.RelationPattern) and self._key(p) in delta]
                    for at in runs:
                        found = self.match(r.patterns, lambda i, p, at=at: delta[self._key(p)] if at is not None and i == at else every(self._key(p)), r.computes)
                        for i in r.inferences:
                            key, facts = self._conclusion(r, found, i)
                            (extra if key[0] == "extend" else fresh).setdefault(key, []).append(facts)
                delta = {}
                for key in sorted(made & set(fresh)):
                    own = [c for c, _ in self._columns(*key) if c not in (EID, RID)]
                    parts = reduce(DataFrame.unionByName, fresh[key]).dropDuplicates(own)
                    known = every(key).select(*[F.col(c).alias(f"k_{c}") for c in own])
                    test = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in own])
                    new = self._settled(parts.join(known, test, "left_anti"))
                    if not new.isEmpty():
                        delta[key] = new
                        total[key] = total[key].unionByName(new) if key in total else new
                        rounds[key] = rounds.get(key, 0) + 1
                        if rounds[key] % COMPACT == 0:  # so that a plan doesn't grow with the rounds
                            total[key] = self._settled(total[key])
        out = dict(total)
        for (_, name), parts in extra.items():
            out[("extend", name)] = parts
        self._inferred = out
        return out

    def table(self, kind: str, name: str) -> DataFrame:
        """Facts of a type, stated and inferred, with the columns that rules extend entities by."""
        out = self._facts((kind, name))
        if not self.rules:
            return out
        inferred = self.infer()
        if (kind, name) in inferred:
            out = out.unionByName(inferred[(kind, name)])
        for part in inferred.get(("extend", name), []) if kind == "entity" else []:
            own = [c for c in part.columns if c != EID]
            clash = [c for c in own if c in out.columns]
            renamed = part.select(EID, *[F.col(c).alias(f"x_{c}" if c in clash else c) for c in own])
            out = out.join(renamed, EID, "left")
            for c in clash:
                out = out.withColumn(c, F.coalesce(F.col(f"x_{c}"), F.col(c))).drop(f"x_{c}")
        return out

    def materialize(self, root: str) -> list[str]:
        """Writes what rules marked so infer, a folder a type, and returns the types."""
        wanted = {self._key(i) for r in self.rules.values() if r.kind == "materialize" for i in r.inferences if not isinstance(i, a.Extension)}
        out = []
        for key in sorted(wanted):
            if key in self.infer():
                self.infer()[key].write.mode("overwrite").parquet(f"{root}/{key[1]}")
                out.append(key[1])
        return out

    # statements

    def query(self, q: a.Query) -> DataFrame:
        found = self.match(q.patterns, lambda _, p: self.table(*self._key(p)), q.computes)
        if missing := [v for v in q.get if v not in found.columns]:
            raise SearchError(f"no pattern binds {missing}")
        return found.select(*[F.col(f"`{v}`") for v in q.get])

    def run(self, source: str) -> list[DataFrame]:
        """Statements in order; the results of those that match something."""
        out = []
        for s in parse(source):
            if isinstance(s, a.EntityDefinition | a.RelationDefinition):
                self.define(s)
            elif isinstance(s, a.EntityInsertion | a.RelationInsertion):
                self._insert(s)
            elif isinstance(s, a.Rule):
                self.rules[s.name] = s
                self._inferred = None
            else:
                out.append(self.query(s))
        return out
