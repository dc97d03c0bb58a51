"""Predicates: what they say is kept as a function of the frames in scope, so it can be combined
with AND, OR and NOT before any frame exists, and is lowered to one Spark column."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Param:
    """The place of a value that a prepared query gets later."""

    index: int


class Scope:
    """How tokens become columns: by the alias of their model, if it has one here; and what stands for parameters."""

    def __init__(self, db: Any = None, aliases: dict[str, str] | None = None, params: tuple[Any, ...] = ()):
        self.db, self.aliases, self.params = db, aliases or {}, params

    def bound(self, value: Any) -> Any:
        if not isinstance(value, Param):
            return value
        if value.index >= len(self.params):
            raise ValueError(f"no value for parameter {value.index}; prepare the query and bind it")
        return self.params[value.index]

    def column(self, token: Any) -> Column:
        alias = self.aliases.get(token.source)
        return F.col(f"`{alias}`.`{token.name}`") if alias else F.col(f"`{token.name}`")


class Filter:
    """A predicate over one or more models. SQL's three-valued logic holds."""

    def __init__(self, sources: Iterable[str], build: Callable[[Scope], Column]):
        self.sources, self.build = frozenset(sources), build

    def __and__(self, other: Filter) -> Filter:
        return Filter(self.sources | other.sources, lambda s: self.build(s) & other.build(s))

    def __or__(self, other: Filter) -> Filter:
        return Filter(self.sources | other.sources, lambda s: self.build(s) | other.build(s))

    def __invert__(self) -> Filter:
        return Filter(self.sources, lambda s: ~self.build(s))

    def __bool__(self) -> bool:
        raise TypeError("combine filters with &, | and ~")


def all_of(filters: Iterable[Filter]) -> Filter:
    """True if every filter is; of none, true."""
    return reduce(lambda a, b: a & b, filters, Filter((), lambda s: F.lit(True)))


def any_of(filters: Iterable[Filter]) -> Filter:
    """True if one of the filters is; of none, false."""
    return reduce(lambda a, b: a | b, filters, Filter((), lambda s: F.lit(False)))


#: The filter of a query that has none.
EVERYTHING = all_of(())


def literal(value: Any) -> str:
    """A value as a Spark SQL literal; quotes and backslashes in strings are escaped."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, int | float | Decimal):
        return f"CAST('{value}' AS DOUBLE)" if isinstance(value, float) else str(value)
    if isinstance(value, datetime):
        return f"TIMESTAMP '{value.isoformat(sep=' ')}'"
    if isinstance(value, date):
        return f"DATE '{value.isoformat()}'"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def raw(text: str, *values: Any) -> Filter:
    """A Spark SQL predicate; each {} stands for a value, which goes in as a literal."""
    parts = text.split("{}")
    if len(parts) != len(values) + 1:
        raise ValueError(f"{len(parts) - 1} places for {len(values)} values")
    sql = "".join(p + v for p, v in zip(parts, [*map(literal, values), ""], strict=True))
    return Filter((), lambda s: F.expr(sql))
