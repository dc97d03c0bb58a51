"""The select builder and what it turns into: joins, aggregates, set operations, pages."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tessella.functions.columns import Aggregate, Order, Token
from tessella.functions.predicates import EVERYTHING, Filter, Scope
from tessella.operators.include import attach
from tessella.schema import Model

if TYPE_CHECKING:
    from tessella.session import Db

LOG = logging.getLogger("tessella")


@dataclass
class Metrics:
    """Fetches so far, and from how many seconds on one is logged as slow."""

    fetches: int = 0
    rows: int = 0
    seconds: float = 0.0
    slow_after: float = 10.0
    slow: int = 0

    def add(self, rows: int, seconds: float) -> None:
        self.fetches, self.rows, self.seconds = self.fetches + 1, self.rows + rows, self.seconds + seconds
        LOG.debug("%d rows in %.3f s", rows, seconds)
        if seconds > self.slow_after:
            self.slow += 1
            LOG.warning("slow: %d rows in %.3f s", rows, seconds)


METRICS = Metrics()


class NoRow(LookupError):
    """fetch_one found none."""


@dataclass(frozen=True)
class Page:
    items: list[Row]
    has_next: bool


@dataclass(frozen=True)
class JoinPart:
    model: Model
    on: Filter
    how: str
    alias: str


class Fetch:
    """Actions over ``to_df``."""

    def to_df(self) -> DataFrame:
        raise NotImplementedError

    def _collect(self, df: DataFrame) -> list[Row]:
        began = time.perf_counter()
        rows = df.collect()
        METRICS.add(len(rows), time.perf_counter() - began)
        return rows

    def fetch_all(self) -> list[Row]:
        return self._collect(self.to_df())

    def fetch_optional(self) -> Row | None:
        """The first row, if any; Spark stops at one."""
        return next(iter(self._collect(self.to_df().limit(1))), None)

    def fetch_one(self) -> Row:
        row = self.fetch_optional()
        if row is None:
            raise NoRow("no row found for query")
        return row

    def stream(self) -> Iterator[Row]:
        """All rows, fetched at once."""
        return iter(self.fetch_all())

    def stream_unbuffered(self) -> Iterator[Row]:
        """Rows by partition; the driver holds two at most."""
        return self.to_df().toLocalIterator(prefetchPartitions=True)


@dataclass(frozen=True)
class Select(Fetch):
    db: Db
    model: Model
    where_: Filter = EVERYTHING
    orders: tuple[Order, ...] = ()
    limit_: int | None = None
    offset_: int = 0
    projection: tuple[Token, ...] = ()
    distinct_: bool = False
    join_: JoinPart | None = None
    includes: tuple[Any, ...] = ()
    params: tuple[Any, ...] = ()

    # building

    def _check(self, f: Filter) -> Filter:
        known = {self.model.name} | ({self.join_.model.name, self.join_.alias} if self.join_ else set())
        if f.sources - known:
            raise TypeError(f"a filter over {sorted(f.sources - known)} in a query over {sorted(known)}")
        return f

    def filter(self, f: Filter) -> Select:
        return replace(self, where_=self.where_ & self._check(f))

    def or_filter(self, f: Filter) -> Select:
        """What was asked so far, or ``f``. On a query without a filter that is every row."""
        return replace(self, where_=self.where_ | self._check(f))

    def filter_if(self, value: Any, make: Callable[[Any], Filter]) -> Select:
        return self if value is None else self.filter(make(value))

    def or_filter_if(self, value: Any, make: Callable[[Any], Filter]) -> Select:
        return self if value is None else self.or_filter(make(value))

    def order_by(self, *orders: Order) -> Select:
        return replace(self, orders=self.orders + orders)

    def order_by_if(self, order: Order | None) -> Select:
        return self if order is None else self.order_by(order)

    def limit(self, n: int | None) -> Select:
        return replace(self, limit_=n)

    def offset(self, n: int | None) -> Select:
        return replace(self, offset_=n or 0)

    def after(self, token: Token, value: Any, n: int) -> Select:
        """The next ``n`` rows past a value, ascending."""
        return self.filter(token.gt(value)).order_by(token.asc()).limit(n)

    def before(self, token: Token, value: Any, n: int) -> Select:
        """The ``n`` rows up to a value, descending."""
        return self.filter(token.lt(value)).order_by(token.desc()).limit(n)

    def columns(self, *tokens: Token) -> Select:
        for t in tokens:
            if t.source != self.model.name:
                raise TypeError(f"{t.source}.{t.name} in a query over {self.model.name}")
        return replace(self, projection=tokens, join_=None, includes=())

    def distinct(self) -> Select:
        return replace(self, distinct_=True)

    def _join(self, model: Model, on: Filter, how: str, alias: str | None) -> Select:
        if self.join_:
            raise ValueError("one join to a query")
        if alias is None and model.name == self.model.name:
            raise ValueError("a self-join needs an alias")
        return replace(self, join_=JoinPart(model, on, how, alias or model.name))

    def inner_join(self, model: Model, on: Filter, alias: str | None = None) -> Select:
        return self._join(model, on, "inner", alias)

    def left_join(self, model: Model, on: Filter, alias: str | None = None) -> Select:
        return self._join(model, on, "left", alias)

    def right_join(self, model: Model, on: Filter, alias: str | None = None) -> Select:
        return self._join(model, on, "right", alias)

    def full_join(self, model: Model, on: Filter, alias: str | None = None) -> Select:
        return self._join(model, on, "full", alias)

    def include(self, *includes: Any) -> Select:
        return replace(self, includes=self.includes + includes)

    def aggregate(self, *aggregates: Aggregate) -> Grouped:
        return Grouped(self, (), aggregates)

    def group_by(self, *keys: Token) -> Grouped:
        return Grouped(self, keys, ())

    def union(self, other: Fetch) -> Combined:
        return Combined(self, other, "union")

    def union_all(self, other: Fetch) -> Combined:
        return Combined(self, other, "union_all")

    def intersect(self, other: Fetch) -> Combined:
        return Combined(self, other, "intersect")

    def except_(self, other: Fetch) -> Combined:
        return Combined(self, other, "except")

    # lowering

    def _scope(self) -> Scope:
        names = {self.model.name: self.model.name}
        if self.join_:
            names[self.join_.alias] = self.join_.alias
        return Scope(self.db, names, self.params)

    def filtered(self) -> DataFrame:
        """The rows that the filter and the join leave, in all columns, under their models' aliases."""
        scope = self._scope()
        rows = self.db.table(self.model).alias(self.model.name)
        if self.join_:
            rows = rows.join(self.db.table(self.join_.model).alias(self.join_.alias), self.join_.on.build(scope), self.join_.how)
        return rows.where(self.where_.build(scope))

    def _limited(self, rows: DataFrame) -> DataFrame:
        if self.orders:
            rows = rows.orderBy(*[o.column(self._scope()) for o in self.orders])
        if self.offset_:
            rows = rows.offset(self.offset_)
        return rows if self.limit_ is None else rows.limit(self.limit_)

    def _projected(self) -> list[Column]:
        scope = self._scope()
        if self.join_:
            # an outer side is null where all of its columns are
            sides = (("left", self.model, self.model.name, ("right", "full")), ("right", self.join_.model, self.join_.alias, ("left", "full")))
            out = []
            for name, model, alias, outer in sides:
                cells = [F.col(f"`{alias}`.`{c}`") for c in model.columns]
                whole = F.struct(*[c.alias(n) for c, n in zip(cells, model.columns, strict=True)])
                out.append((F.when(F.coalesce(*[F.when(c.isNotNull(), True) for c in cells], F.lit(False)), whole) if self.join_.how in outer else whole).alias(name))
            return out
        return [scope.column(t).alias(t.name) for t in self.projection] or [F.col(f"`{self.model.name}`.`{c}`") for c in self.model.columns]

    def to_df(self) -> DataFrame:
        if self.distinct_:
            if self.orders and any(o.token.name not in {t.name for t in self.projection or [getattr(self.model, c) for c in self.model.columns]} for o in self.orders):
                raise ValueError("a distinct query is ordered by columns that it returns")
            rows = self.filtered().select(*self._projected()).distinct()
            out = self._limited(rows if self.join_ else rows.alias(self.model.name))
        else:
            out = self._limited(self.filtered()).select(*self._projected())
        narrowed = self.where_ is not EVERYTHING or self.limit_ is not None or self.join_ is not None
        for relation in self.includes:
            out = attach(self.db, out, relation, narrowed)
        return out

    def prepare(self) -> PreparedSelect:
        """The query with its ``Param`` places to be bound again and again."""
        return PreparedSelect(self)

    # results

    def count(self) -> int:
        """Rows that the filter and the join leave; order, limit, offset and distinct don't count."""
        return self.filtered().count()

    def exists(self) -> bool:
        return not self.filtered().limit(1).isEmpty()

    def _keyed(self, size: int) -> Select:
        return self.order_by(*[getattr(self.model, k).asc() for k in self.model.key]).limit(size + 1)

    def page(self, size: int) -> Page:
        """The first ``size`` rows, by what was asked and then the key, and if there are more."""
        rows = self._keyed(size).fetch_all()
        return Page(rows[:size], len(rows) > size)

    def page_rows(self, size: int) -> DataFrame:
        """The rows of ``page``, not fetched, each with ``has_next``; the window is over ``size`` + 1 rows."""
        rows = self._keyed(size).to_df()
        every = Window.partitionBy(F.lit(0))
        at = rows.withColumn("__at", F.monotonically_increasing_id()).withColumn("has_next", F.count("*").over(every) > size)
        return at.withColumn("__at", F.row_number().over(every.orderBy("__at"))).where(F.col("__at") <= size).drop("__at")


class PreparedSelect(Fetch):
    """A query that is built and checked once, and lowered with the values bound to its parameters."""

    def __init__(self, query: Select):
        self.query, self.args = query, {}

    def bind(self, i: int, value: Any) -> PreparedSelect:
        self.args[i] = value
        return self

    def bind_many(self, values: Iterable[Any]) -> PreparedSelect:
        self.args.update(enumerate(values))
        return self

    def to_df(self) -> DataFrame:
        most = max(self.args, default=-1)
        return replace(self.query, params=tuple(self.args.get(i) for i in range(most + 1))).to_df()


@dataclass(frozen=True)
class Grouped(Fetch):
    """Aggregates of a query's filtered rows, by keys or as a whole. Keys aren't returned unless asked for."""

    query: Select
    keys: tuple[Token, ...]
    aggregates: tuple[Aggregate, ...]
    having_: Filter = EVERYTHING
    orders: tuple[Order, ...] = ()
    limit_: int | None = None
    offset_: int = 0
    with_keys: bool = False

    def aggregate(self, *aggregates: Aggregate) -> Grouped:
        return replace(self, aggregates=self.aggregates + aggregates)

    def include_keys(self) -> Grouped:
        return replace(self, with_keys=True)

    def filter(self, f: Filter) -> Grouped:
        return replace(self, query=self.query.filter(f))

    def or_filter(self, f: Filter) -> Grouped:
        return replace(self, query=self.query.or_filter(f))

    def filter_if(self, value: Any, make: Callable[[Any], Filter]) -> Grouped:
        return self if value is None else self.filter(make(value))

    def or_filter_if(self, value: Any, make: Callable[[Any], Filter]) -> Grouped:
        return self if value is None else self.or_filter(make(value))

    def having(self, f: Filter) -> Grouped:
        return replace(self, having_=self.having_ & f)

    def or_having(self, f: Filter) -> Grouped:
        return replace(self, having_=self.having_ | f)

    def having_if(self, value: Any, make: Callable[[Any], Filter]) -> Grouped:
        return self if value is None else self.having(make(value))

    def or_having_if(self, value: Any, make: Callable[[Any], Filter]) -> Grouped:
        return self if value is None else self.or_having(make(value))

    def order_by(self, *orders: Order) -> Grouped:
        return replace(self, orders=self.orders + orders)

    def limit(self, n: int | None) -> Grouped:
        return replace(self, limit_=n)

    def offset(self, n: int | None) -> Grouped:
        return replace(self, offset_=n or 0)

    def to_df(self) -> DataFrame:
        if not self.aggregates:
            raise ValueError("nothing to aggregate")
        names = [a.name for a in self.aggregates]
        scope = self.query._scope()
        rows = self.query.filtered()
        grouped = rows.groupBy(*[scope.column(k).alias(k.name) for k in self.keys]).agg(*[a.column(scope) for a in self.aggregates])
        grouped = grouped.where(self.having_.build(Scope()))
        orders = self.orders + self.query.orders
        if orders:
            grouped = grouped.orderBy(*[o.column(Scope()) for o in orders])
        offset, limit = self.offset_ or self.query.offset_, self.query.limit_ if self.limit_ is None else self.limit_
        if offset:
            grouped = grouped.offset(offset)
        if limit is not None:
            grouped = grouped.limit(limit)
        return grouped.select(*([k.name for k in self.keys] if self.with_keys else []), *names)


@dataclass(frozen=True)
class Combined(Fetch):
    """Two queries' rows by position; each keeps its own order and limit."""

    left: Fetch
    right: Fetch
    kind: str
    limit_: int | None = None
    offset_: int = 0

    def limit(self, n: int | None) -> Combined:
        return replace(self, limit_=n)

    def offset(self, n: int | None) -> Combined:
        return replace(self, offset_=n or 0)

    def to_df(self) -> DataFrame:
        a, b = self.left.to_df(), self.right.to_df()
        if len(a.columns) != len(b.columns):
            raise TypeError("both sides need the same columns")
        out = {"union": lambda: a.union(b).distinct(), "union_all": lambda: a.union(b), "intersect": lambda: a.intersect(b), "except": lambda: a.subtract(b)}[self.kind]()
        if self.offset_:
            out = out.offset(self.offset_)
        return out if self.limit_ is None else out.limit(self.limit_)


def columns_of(model: Model, names: Iterable[str]) -> tuple[Token, ...]:
    return tuple(getattr(model, n) for n in names)
