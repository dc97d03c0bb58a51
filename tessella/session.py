"""A Db binds models to tables of one Spark session and starts queries."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession

from tessella.plans.select import Fetch, Select
from tessella.schema import Model, Relation


class Db:
    def __init__(self, spark: SparkSession, models: Iterable[Model], root: str | None = None, tables: dict[str, DataFrame] | None = None):
        """Tables are ``root``/name.parquet unless ``tables`` holds a DataFrame of the name."""
        self.spark, self.root, self.tables = spark, root, dict(tables or {})
        self.models = {m.name: m for m in models}

    def table(self, model: Model) -> DataFrame:
        """The model's columns; Parquet reads no others."""
        found = self.tables.get(model.table)
        if found is None:
            if self.root is None:
                raise LookupError(f"no table {model.table}")
            found = self.spark.read.parquet(f"{self.root}/{model.table}.parquet")
        return found.select(*model.columns)

    def with_tables(self, **tables: DataFrame) -> Db:
        return Db(self.spark, self.models.values(), self.root, self.tables | tables)

    def select(self, model: Model | str) -> Select:
        return Select(self, self.models[model] if isinstance(model, str) else model)

    def __getattr__(self, name: str) -> Model:
        try:
            return self.__dict__["models"][name]
        except KeyError:
            raise AttributeError(name) from None

    # common table expressions: a model over a query's result

    def with_cte(self, model: Model, query: Fetch) -> Db:
        """A Db in which ``model`` stands for the query's rows."""
        out = Db(self.spark, [*self.models.values(), model], self.root, self.tables | {model.table: query.to_df()})
        return out

    def with_recursive(self, model: Model, anchor: Fetch, step: str) -> Db:
        """``model`` stands for the anchor's rows and, again and again, those of ``step``: a Spark SQL
        query over the model's name and the other tables. Spark bounds levels and rows of a recursion by
        spark.sql.cteRecursionLevelLimit and spark.sql.cteRecursionRowLimit."""
        text = f"WITH RECURSIVE {model.table}({', '.join(model.columns)}) AS (SELECT * FROM __anchor UNION ALL {step}) SELECT * FROM {model.table}"
        with self._views(step, {"__anchor": anchor.to_df()}, model.table):
            rows = self.spark.sql(text)
        return Db(self.spark, [*self.models.values(), model], self.root, self.tables | {model.table: rows})

    # relations

    def relation(self, model: Model | str, name: str) -> Relation:
        """A relation that the model declares."""
        model = self.models[model] if isinstance(model, str) else model
        return model.relation(name)

    def related(self, relation: Relation, owner: Any) -> Select:
        """The rows that a relation has for one owner, by the owner's key; to be filtered, ordered and limited like any query."""
        target = self.models[relation.model]
        column = getattr(target, relation.column)
        if not relation.through:
            return self.select(target).filter(column.eq(owner))
        tie, to_parent, to_child = self.models[relation.through[0]], *relation.through[1:]
        return self.select(target).filter(column.in_(self.select(tie).filter(getattr(tie, to_parent).eq(owner)).columns(getattr(tie, to_child))))

    # raw SQL and prepared queries

    @contextmanager
    def _views(self, text: str, more: dict[str, DataFrame] | None = None, without: str | None = None) -> Iterator[None]:
        """Temporary views of the tables that ``text`` names outside quotes, while it is analysed; the session's own come back."""
        words = set(re.findall(r"\w+", re.sub(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|--[^\n]*", " ", text).lower()))
        wanted = {m.table: self.table(m) for m in self.models.values() if m.table.lower() in words and m.table != without} | (more or {})
        held = {t.name.lower() for t in self.spark.catalog.listTables() if t.isTemporary}
        before = {name: self.spark.table(name) for name in wanted if name.lower() in held}
        try:
            for name, df in wanted.items():
                df.createOrReplaceTempView(name)
            yield
        finally:
            for name in wanted:
                self.spark.catalog.dropTempView(name)
            for name, df in before.items():
                df.createOrReplaceTempView(name)

    def sql(self, text: str, args: Sequence[Any] | dict[str, Any] | None = None) -> DataFrame:
        """Spark SQL over the models' tables; ``?`` or ``:name`` take arguments."""
        with self._views(text):
            return self.spark.sql(text, args=args) if args else self.spark.sql(text)

    def prepare(self, text: str) -> Prepared:
        return Prepared(self, text)


class Prepared:
    """SQL text whose positional arguments are bound again and again."""

    def __init__(self, db: Db, text: str):
        self.db, self.text, self.args = db, text, [None] * text.count("?")

    def bind(self, i: int, value: Any) -> Prepared:
        """Sets argument ``i``; one that the text doesn't have is ignored."""
        if 0 <= i < len(self.args):
            self.args[i] = value
        return self

    def bind_many(self, values: Sequence[Any]) -> Prepared:
        for i, v in enumerate(values):
            self.bind(i, v)
        return self

    def to_df(self) -> DataFrame:
        return self.db.sql(self.text, self.args)

    def fetch_all(self) -> list[Row]:
        return self.to_df().collect()
