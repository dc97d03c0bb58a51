"""Models: a table's columns, key, uniqueness, allowed values and relations, declared in Python.

A model is what a Spark user would pass around as a StructType, with what Spark doesn't keep: keys,
foreign keys and relation names. There is no schema language of its own and no generated code.
"""

from __future__ import annotations

import difflib
import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import types as T

from tessella.functions.columns import Token


@dataclass(frozen=True)
class Relation:
    """Rows of ``model`` whose ``column`` equals this model's ``key``; many of them or at most one.

    With ``through`` (model, column to this one, column to the other) the rows meet in a join model,
    and ``column`` is the key of ``model``.
    """

    name: str
    model: str
    column: str
    key: str
    many: bool = True
    through: tuple[str, str, str] | None = None


#: What a delete of the parent does to children.
ON_DELETE = ("no_action", "restrict", "cascade", "set_null")


@dataclass(frozen=True)
class ForeignKey:
    column: str
    model: str
    key: str
    on_delete: str = "no_action"


@dataclass
class Model:
    """``columns`` maps names to Spark types; a type that ends in ``?`` may be null."""

    name: str
    columns: dict[str, str]
    key: Sequence[str] = ("id",)
    unique: Sequence[Sequence[str]] = ()
    allowed: dict[str, Sequence[str]] = field(default_factory=dict)
    foreign: Sequence[ForeignKey] = ()
    relations: dict[str, Relation] = field(default_factory=dict)
    defaults: dict[str, str] = field(default_factory=dict)
    table: str | None = None

    def __post_init__(self) -> None:
        self.table = self.table or self.name
        self.schema = T.StructType([T.StructField(n, _type(t.rstrip("?")), t.endswith("?")) for n, t in self.columns.items()])
        problems = [f"{self.name}: no column {c!r}{_near(c, self.columns)}" for c in [*self.key, *(c for u in self.unique for c in u), *self.allowed, *self.defaults, *(f.column for f in self.foreign)] if c not in self.columns]
        if not self.key:
            problems.append(f"{self.name}: no key")
        problems += [f"{self.name}.{f.column}: on_delete {f.on_delete!r}" for f in self.foreign if f.on_delete not in ON_DELETE]
        problems += [f"{self.name}.{f.column}: set_null needs a nullable column" for f in self.foreign if f.on_delete == "set_null" and not self.columns.get(f.column, "?").endswith("?")]
        problems += [f"{self.name}: relation {n!r} has no key column {r.key!r}{_near(r.key, self.columns)}" for n, r in self.relations.items() if r.key not in self.columns]
        if problems:
            raise ValueError("; ".join(problems))

    def __getattr__(self, name: str) -> Token:
        try:
            f = self.__dict__["schema"][name]
        except KeyError:
            raise AttributeError(f"{self.__dict__.get('name')}: no column {name!r}{_near(name, self.__dict__.get('columns', {}))}") from None
        return Token(self.name, f.name, f.dataType, f.nullable)

    def relation(self, name: str) -> Relation:
        """A declared relation."""
        if name not in self.relations:
            raise AttributeError(f"{self.name}: no relation {name!r}{_near(name, self.relations)}")
        return self.relations[name]

    def fingerprint(self) -> str:
        """SHA-256 over the declaration; changes if and only if it does."""
        parts = [self.table, self.columns, list(self.key), [list(u) for u in self.unique], {k: list(v) for k, v in self.allowed.items()}, [vars(f) for f in self.foreign], self.defaults]
        return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()


SIMPLE = {t.typeName(): t for t in (T.StringType(), T.LongType(), T.IntegerType(), T.ShortType(), T.DoubleType(), T.FloatType(), T.BooleanType(), T.BinaryType(), T.DateType(), T.TimestampType(), T.TimestampNTZType())}
SIMPLE |= {"bigint": T.LongType(), "int": T.IntegerType()}


def _type(text: str) -> T.DataType:
    """A type by its SQL name; works before any session exists."""
    if text.startswith("array<"):
        return T.ArrayType(_type(text[6:-1]))
    if text.startswith("decimal("):
        return T.DecimalType(*map(int, text[8:-1].split(",")))
    return SIMPLE[text]


def validate(models: Sequence[Model]) -> list[str]:
    """What is wrong between models: foreign keys and relations to models, columns or types that don't fit."""
    by_name, out = {m.name: m for m in models}, []

    def target(owner: str, model: str, column: str) -> T.DataType | None:
        if model not in by_name:
            out.append(f"{owner}: no model {model!r}{_near(model, by_name)}")
        elif column not in by_name[model].columns:
            out.append(f"{owner}: {model} has no column {column!r}{_near(column, by_name[model].columns)}")
        else:
            return by_name[model].schema[column].dataType
        return None

    for m in models:
        for f in m.foreign:
            kind = target(f"{m.name}.{f.column}", f.model, f.key)
            if kind is not None and kind != m.schema[f.column].dataType:
                out.append(f"{m.name}.{f.column} is {m.schema[f.column].dataType.simpleString()}, {f.model}.{f.key} is {kind.simpleString()}")
        for n, r in m.relations.items():
            target(f"{m.name}.{n}", r.model, r.column)
            if r.through:
                for column in r.through[1:]:
                    target(f"{m.name}.{n}", r.through[0], column)
    return out


def _near(name: str, known: dict[str, str]) -> str:
    close = difflib.get_close_matches(name, known, 1)
    return f", did you mean {close[0]!r}?" if close else ""
