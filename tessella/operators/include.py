"""Relations: children loaded into their parents' rows, and parents filtered by their children.

A tree of includes is one plan: from the leaves up, children become one array for each parent key
and are joined once. A limit for each parent is a row number in a window, which Spark turns into a
group limit before the shuffle. Where the parents are filtered or limited, children meet their keys in
a semi-join first. An array is one cell: a parent with very many children makes a cell as large as they
are, so such a relation is better limited (``take``) or joined.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.columns import Order
from tessella.functions.predicates import EVERYTHING, Filter, Scope
from tessella.schema import Model, Relation

if TYPE_CHECKING:
    from tessella.session import Db


@dataclass(frozen=True)
class Include:
    """A relation to load, with a filter, an order and a limit for each parent, and includes below."""

    relation: Relation
    where_: Filter = EVERYTHING
    orders: tuple[Order, ...] = ()
    take_: int | None = None
    below: tuple[Include, ...] = ()

    def filter(self, f: Filter) -> Include:
        return replace(self, where_=self.where_ & f)

    def order_by(self, *orders: Order) -> Include:
        return replace(self, orders=self.orders + orders)

    def take(self, n: int) -> Include:
        return replace(self, take_=n)

    def include(self, *below: Include) -> Include:
        return replace(self, below=self.below + below)


def attach(db: Db, parents: DataFrame, include: Include, narrowed: bool = False, depth: int = 0) -> DataFrame:
    """``parents`` with one more column: an array of child rows, or a child row or null.

    ``narrowed``: the parents are some of their table's rows, so children are sought by their keys.
    """
    relation, parent = include.relation, f"__parent{depth}"
    model = db.models[relation.model]
    children = db.table(model).alias(model.name).where(include.where_.build(Scope(db, {model.name: model.name})))
    keys = parents.select(F.col(relation.key).alias("__wanted")) if narrowed else None
    if relation.through:
        through, to_parent, to_child = relation.through
        ties = db.table(db.models[through]).select(F.col(to_parent).alias(parent), F.col(to_child).alias("__child"))
        ties = ties if keys is None else ties.join(keys, F.col(parent) == F.col("__wanted"), "left_semi")
        children = children.join(ties, F.col(relation.column) == F.col("__child"))
    else:
        children = children.withColumn(parent, F.col(relation.column))
        children = children if keys is None else children.join(keys, F.col(parent) == F.col("__wanted"), "left_semi")
    for one in include.below:
        children = attach(db, children, one, narrowed or include.where_ is not EVERYTHING, depth + 1)
    row = F.struct(*model.columns, *(i.relation.name for i in include.below)).alias("__row")
    if not relation.many and tuple(model.key) == (relation.column,):
        only = children.select(parent, row.alias(relation.name))  # a key has one row
        return parents.join(only, F.col(relation.key) == F.col(parent), "left").drop(parent)
    by_key = [F.col(k).asc_nulls_last() for k in model.key]
    if relation.many and include.take_ is None and not any(o.descending for o in include.orders):
        # sorted in the array: nulls last, as in an ascending order
        cells = [o.token.value(Scope()) for o in include.orders] + [F.col(k) for k in model.key]
        sortable = [x for i, c in enumerate(cells) for x in (c.isNull().alias(f"n{i}"), c.alias(f"c{i}"))]
        ranked = children.select(parent, F.struct(*sortable, row).alias("__ranked"))
    else:
        window = Window.partitionBy(parent).orderBy(*[o.column(Scope()) for o in include.orders], *by_key)
        ranked = children.select(parent, F.struct(F.row_number().over(window).alias("__rank"), row).alias("__ranked"))
        most = include.take_ if relation.many else 1
        ranked = ranked if most is None else ranked.where(F.col("__ranked.__rank") <= most)
    if not relation.many:
        first = ranked.select(parent, F.col("__ranked.__row").alias(relation.name))
        return parents.join(first, F.col(relation.key) == F.col(parent), "left").drop(parent)
    lists = ranked.groupBy(parent).agg(F.transform(F.sort_array(F.collect_list("__ranked")), lambda x: x["__row"]).alias("__list"))
    joined = parents.join(lists, F.col(relation.key) == F.col(parent), "left")
    return joined.withColumn(relation.name, F.coalesce("__list", F.array())).drop(parent, "__list")


def _matching(parent: Model, relation: Relation, make: Any) -> Filter:
    """EXISTS over the children whose column equals the parent's key."""

    def build(scope: Scope):
        model = scope.db.models[relation.model]
        children = scope.db.table(model).alias("__child")
        outer = F.col(f"`{scope.aliases.get(parent.name, parent.name)}`.`{relation.key}`").outer()
        inner = Scope(scope.db, {model.name: "__child"})
        if relation.through:
            through, to_parent, to_child = relation.through
            ties = scope.db.table(scope.db.models[through]).alias("__tie")
            children = children.join(ties, F.col(f"__child.{relation.column}") == F.col(f"__tie.{to_child}"))
            same = F.col(f"__tie.{to_parent}") == outer
        else:
            same = F.col(f"__child.{relation.column}") == outer
        return children.where(same & make(inner)).exists()

    return Filter((parent.name,), build)


def some(parent: Model, relation: Relation, f: Filter) -> Filter:
    """A child meets ``f``."""
    return _matching(parent, relation, f.build)


def none(parent: Model, relation: Relation, f: Filter) -> Filter:
    """No child meets ``f``."""
    return ~some(parent, relation, f)


def every(parent: Model, relation: Relation, f: Filter) -> Filter:
    """No child fails ``f``; true without children, and a child for which ``f`` is null doesn't fail it."""
    return ~_matching(parent, relation, lambda s: ~f.build(s))


def exists(query: Any) -> Filter:
    """The query has a row; correlate it by ``token.outer(other)`` in its filter."""
    return Filter((), lambda s: query.filtered().exists())
