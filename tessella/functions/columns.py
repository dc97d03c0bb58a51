"""Typed column tokens: comparisons, text matching, subqueries, JSON, arrays, aggregates, order."""

from __future__ import annotations

import datetime
import json
import operator
import re
from collections.abc import Iterable
from dataclasses import dataclass, replace
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.predicates import Filter, Param, Scope

#: Python types that a literal for a column may have.
ACCEPTS = {
    T.BooleanType: (bool,), T.IntegerType: (int,), T.LongType: (int,), T.ShortType: (int,), T.DoubleType: (float, int), T.FloatType: (float, int),
    T.DecimalType: (Decimal, int), T.StringType: (str,), T.BinaryType: (bytes,), T.DateType: (datetime.date,), T.TimestampType: (datetime.datetime,), T.TimestampNTZType: (datetime.datetime,),
}
INTEGERS = (T.ShortType, T.IntegerType, T.LongType)
NUMBERS = (*INTEGERS, T.DoubleType, T.FloatType)


def _like(text: str) -> str:
    return text.replace("\\", "\\\\")


@dataclass(frozen=True)
class Order:
    """A sort key. Nulls are last ascending and first descending."""

    token: Any
    descending: bool = False

    def column(self, scope: Scope) -> Column:
        c = self.token.value(scope)
        return c.desc_nulls_first() if self.descending else c.asc_nulls_last()


@dataclass(frozen=True)
class Aggregate:
    """An aggregate of a column; its name is kind_column."""

    kind: str
    token: Any

    @property
    def name(self) -> str:
        return f"{self.kind}_{self.token.name}"

    def column(self, scope: Scope) -> Column:
        c = self.token.value(scope)
        make = {"count": F.count, "count_distinct": F.count_distinct, "sum": F.sum, "min": F.min, "max": F.max, "avg": lambda x: F.avg(x.cast("double"))}
        return make[self.kind](c).alias(self.name)


class Comparable:
    """What can be compared with literals: a column or a place inside a JSON column."""

    source: str

    def value(self, scope: Scope) -> Column:
        raise NotImplementedError

    def _literal(self, value: Any) -> Any:
        return value

    def _filter(self, build: Any) -> Filter:
        return Filter((self.source,), lambda s: build(self.value(s)))

    def _compare(self, op: Any, value: Any) -> Filter:
        value = self._literal(value)
        return Filter((self.source,), lambda s: op(self.value(s), F.lit(s.bound(value))))

    def eq(self, value: Any) -> Filter:
        """Equal; eq(None) is null."""
        return self._filter(lambda c: c.isNull()) if value is None else self._compare(operator.eq, value)

    def ne(self, value: Any) -> Filter:
        """Not equal; ne(None) is not null."""
        return self._filter(lambda c: c.isNotNull()) if value is None else self._compare(operator.ne, value)

    def gt(self, value: Any) -> Filter:
        return self._compare(operator.gt, value)

    def gte(self, value: Any) -> Filter:
        return self._compare(operator.ge, value)

    def lt(self, value: Any) -> Filter:
        return self._compare(operator.lt, value)

    def lte(self, value: Any) -> Filter:
        return self._compare(operator.le, value)

    def _like(self, pattern: str, method: str) -> Filter:
        return self._filter(lambda c: getattr(c, method)(pattern))

    def contains(self, text: str) -> Filter:
        """LIKE %text%: % and _ in the text are wildcards, a backslash is itself."""
        return self._like(f"%{_like(self._text(text))}%", "like")

    def starts_with(self, text: str) -> Filter:
        return self._like(f"{_like(self._text(text))}%", "like")

    def ends_with(self, text: str) -> Filter:
        return self._like(f"%{_like(self._text(text))}", "like")

    def ilike(self, text: str) -> Filter:
        return self._like(f"%{_like(self._text(text))}%", "ilike")

    def _text(self, text: str) -> str:
        if not isinstance(text, str):
            raise TypeError("text matching takes a string")
        return text

    def asc(self) -> Order:
        return Order(self)

    def desc(self) -> Order:
        return Order(self, True)


@dataclass(frozen=True)
class Token(Comparable):
    """A column of a model."""

    source: str
    name: str
    type: T.DataType
    nullable: bool = True

    def value(self, scope: Scope) -> Column:
        return scope.column(self)

    def aliased(self, alias: str) -> Token:
        """The column of a model that was joined under ``alias``."""
        return replace(self, source=alias)

    def _literal(self, value: Any) -> Any:
        accepts = ACCEPTS.get(type(self.type))
        if isinstance(value, Param):
            return value
        if accepts and (not isinstance(value, accepts) or isinstance(value, bool) and bool not in accepts):
            raise TypeError(f"{self.source}.{self.name} is {self.type.simpleString()}, not {type(value).__name__}")
        return value

    def _text(self, text: str) -> str:
        if not isinstance(self.type, T.StringType):
            raise TypeError(f"{self.source}.{self.name} isn't text")
        return super()._text(text)

    def between(self, low: Any, high: Any) -> Filter:
        low, high = self._literal(low), self._literal(high)
        return Filter((self.source,), lambda s: self.value(s).between(F.lit(s.bound(low)), F.lit(s.bound(high))))

    def in_(self, values: Any) -> Filter:
        """In a list (of none: false) or in the one column of a query."""
        if hasattr(values, "to_df"):
            return Filter((self.source,), lambda s: self.value(s).isin(values.to_df()))
        values = [self._literal(v) for v in values]
        return self._filter(lambda c: c.isin(values))

    def not_in(self, values: Any) -> Filter:
        """Not in a list (of none: true) or not in a query's column; a null there makes it null."""
        return ~self.in_(values)

    def _needs_null(self) -> None:
        if not self.nullable:
            raise TypeError(f"{self.source}.{self.name} is never null")

    def is_null(self) -> Filter:
        self._needs_null()
        return self._filter(lambda c: c.isNull())

    def is_not_null(self) -> Filter:
        self._needs_null()
        return self._filter(lambda c: c.isNotNull())

    def compare(self, op: str, other: Token) -> Filter:
        """A comparison of two columns: = != > >= < <=."""
        ops = {"=": operator.eq, "!=": operator.ne, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}
        return Filter((self.source, other.source), lambda s: ops[op](self.value(s), other.value(s)))

    def on(self, other: Token) -> Filter:
        return self.compare("=", other)

    def outer(self, other: Token) -> Filter:
        """In a subquery: equals a column of the query around it."""
        return Filter((self.source,), lambda s: self.value(s) == F.col(f"`{other.source}`.`{other.name}`").outer())

    # aggregates

    def count(self) -> Aggregate:
        return Aggregate("count", self)

    def count_distinct(self) -> Aggregate:
        return Aggregate("count_distinct", self)

    def _number(self, kind: str) -> Aggregate:
        if not isinstance(self.type, NUMBERS):
            raise TypeError(f"{kind} of {self.type.simpleString()}")
        return Aggregate(kind, self)

    def sum(self) -> Aggregate:
        return self._number("sum")

    def avg(self) -> Aggregate:
        return self._number("avg")

    def min(self) -> Aggregate:
        return self._number("min")

    def max(self) -> Aggregate:
        return self._number("max")

    # JSON text

    def get(self, key: str) -> JsonPlace:
        return JsonPlace(self, (key,))

    def at(self, index: int) -> JsonPlace:
        return JsonPlace(self, (index,))

    def get_text(self, key: str) -> JsonPlace:
        return JsonPlace(self, (key,), True)

    def has_key(self, key: str) -> Filter:
        """The object has the key, if only for a null."""
        return self._filter(lambda c: F.coalesce(F.array_contains(F.json_object_keys(c), key), F.lit(False)))

    def json_contains(self, part: dict[str, Any]) -> Filter:
        """Containment: every leaf of ``part`` is at its place. Lists: each item occurs in the stored list."""
        return self._filter(lambda c: reduce(operator.and_, [test(c) for test in _leaves(part, ())], F.lit(True)))

    # arrays

    def _array(self, values: Iterable[Any]) -> list[Any]:
        if not isinstance(self.type, T.ArrayType):
            raise TypeError(f"{self.source}.{self.name} isn't an array")
        return list(values)

    def _values(self, values: Iterable[Any]) -> Column:
        return F.array(*[F.lit(v) for v in values]).cast(self.type)

    def contains_all(self, values: Iterable[Any]) -> Filter:
        """Has every value; true for none of them."""
        values = self._array(values)
        return self._filter(lambda c: c.isNotNull() & F.forall(self._values(values), lambda v: F.coalesce(F.array_contains(c, v), F.lit(False))))

    def contained_by(self, values: Iterable[Any]) -> Filter:
        """Has nothing but these values; for none of them only an empty array does."""
        values = self._array(values)
        return self._filter(lambda c: F.forall(c, lambda v: F.coalesce(F.array_contains(self._values(values), v), F.lit(False))))

    def overlaps(self, values: Iterable[Any]) -> Filter:
        """Has one of the values; false for none of them."""
        values = self._array(values)
        return self._filter(lambda c: F.coalesce(F.arrays_overlap(c, self._values(values)), F.lit(False)))


def json_at(column: Column, keys: Iterable[str | int]) -> Column:
    """The text of what stands at a path. Keys that aren't plain names are quoted in brackets; those that a
    path can't quote are looked up in the object as a map."""
    path, out = "$", column
    for k in keys:
        if isinstance(k, str) and re.search(r"['?]", k):
            out = F.from_json(out if path == "$" else F.get_json_object(out, path), "map<string,string>")[F.lit(k)]
            path = "$"
        else:
            path += f"[{k}]" if isinstance(k, int) else f".{k}" if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", k) else f"['{k}']"
    return out if path == "$" else F.get_json_object(out, path)


@dataclass(frozen=True)
class JsonPlace(Comparable):
    """A place inside a JSON column; a number is compared as one, anything else as text."""

    token: Token
    keys: tuple[str | int, ...]
    as_text: bool = False
    as_number: bool = False

    @property
    def source(self) -> str:
        return self.token.source

    @property
    def name(self) -> str:
        return self.token.name

    def value(self, scope: Scope) -> Column:
        c = json_at(self.token.value(scope), self.keys)
        return c.try_cast("double") if self.as_number else c

    def _literal(self, value: Any) -> Any:
        return str(value).lower() if isinstance(value, bool) else value

    def _compare(self, op: Any, value: Any) -> Filter:
        value = self._literal(value)
        if isinstance(value, int | float | Decimal):
            return self._filter(lambda c: op(c.try_cast("double"), F.lit(float(value))))
        return self._filter(lambda c: op(c, F.lit(value)))

    def get(self, key: str) -> JsonPlace:
        return replace(self, keys=(*self.keys, key))

    def at(self, index: int) -> JsonPlace:
        return replace(self, keys=(*self.keys, index))

    def get_text(self, key: str) -> JsonPlace:
        return replace(self, keys=(*self.keys, key), as_text=True)

    def number(self) -> JsonPlace:
        """Order by the number that stands here."""
        return replace(self, as_number=True)


def _leaves(part: Any, keys: tuple[str | int, ...]) -> Iterable[Any]:
    if isinstance(part, dict):
        for k, v in part.items():
            yield from _leaves(v, (*keys, k))
    elif isinstance(part, list):
        def has_all(c: Column, keys: tuple = keys, items: list = part) -> Column:
            stored = F.from_json(json_at(c, keys), "array<string>")
            return reduce(operator.and_, [F.coalesce(F.array_contains(stored, x if isinstance(x, str) else json.dumps(x)), F.lit(False)) for x in items], stored.isNotNull())

        yield has_all
    elif part is None:
        yield lambda c: F.coalesce(F.array_contains(F.json_object_keys(json_at(c, keys[:-1])), keys[-1]), F.lit(False)) & json_at(c, keys).isNull()
    else:
        text = str(part).lower() if isinstance(part, bool) else part
        if isinstance(text, str):
            yield lambda c: F.coalesce(json_at(c, keys) == F.lit(text), F.lit(False))
        else:
            yield lambda c: F.coalesce(json_at(c, keys).try_cast("double") == F.lit(float(text)), F.lit(False))


def json_set(column: Column, key: str, value: Any) -> Column:
    """JSON text with one top-level key set; other keys keep their values."""
    others = F.map_filter(F.from_json(column, "map<string,variant>"), lambda k, _: k != key)
    return F.to_json(F.map_concat(others, F.create_map(F.lit(key), F.parse_json(F.lit(json.dumps(value))))))
