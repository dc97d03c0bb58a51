"""Changes to tables: staged as DataFrames over immutable files, checked, and written as new versions.

Spark's Parquet tables can't be updated in place, so a change is a transformation from one state of
a table to the next. ``Changes`` holds the states that differ from a Db's; a savepoint is a copy of
that dict. ``commit`` writes each changed table once, checks the declared constraints on what was
written, and returns a Db over it; if a rule fails the new files go and nothing outside has changed.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.columns import json_set
from tessella.functions.predicates import EVERYTHING, Filter, Scope
from tessella.schema import ForeignKey, Model, Relation
from tessella.plans.select import NoRow
from tessella.session import Db
from tessella.sources.introspect import metadata_of

#: In place of a filter: every row is meant.
ALL_ROWS = EVERYTHING


class ConstraintError(ValueError):
    """A declared rule doesn't hold. Messages name columns, never values."""


class UniqueViolation(ConstraintError):
    pass


class NotNullViolation(ConstraintError):
    pass


class CheckViolation(ConstraintError):
    pass


class ForeignKeyViolation(ConstraintError):
    pass


@dataclass(frozen=True)
class Affected:
    """The rows that a change met, by model, as they were (of inserts: as they are); counted when asked."""

    rows: dict[str, DataFrame]

    def to_df(self) -> DataFrame:
        """One row with ``n``: how many rows, those of children included."""
        ones = [df.select(F.lit(1).alias("one")) for df in self.rows.values()]
        return reduce(DataFrame.unionAll, ones).agg(F.count("*").alias("n"))

    def count(self) -> int:
        return self.to_df().first().n


def when(value: Any, make: Callable[[Any], Filter]) -> Filter:
    """The filter made of a value, or every row where there is none: an absent value changes or deletes ALL rows."""
    return ALL_ROWS if value is None else make(value)


DEFAULTS = {
    "uuid4": lambda: F.uuid(),
    "uuid7": lambda: F.regexp_replace(F.concat(F.lpad(F.lower(F.hex(F.unix_millis(F.current_timestamp()))), 12, "0"), F.lit("7"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 14, 3), F.lit("8"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 18, 15)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"),
    "cuid2": lambda: F.concat(F.lit("c"), F.substring(F.lower(F.conv(F.replace(F.uuid(), F.lit("-"), F.lit("")), 16, 36)), 1, 12), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 11)),
    "nanoid": lambda: F.substring(F.translate(F.base64(F.sha2(F.uuid(), 256).cast("binary")), "+/=", "-_"), 1, 21),
    "now": lambda: F.current_timestamp(),
}


class Changes:
    def __init__(self, db: Db):
        self.db, self.staged = db, {}
        self.points: list[dict[str, DataFrame]] = []

    def __enter__(self) -> Changes:
        return self

    def __exit__(self, kind: Any, *_: Any) -> None:
        if kind:
            self.rollback()

    def table(self, model: Model) -> DataFrame:
        return self.staged[model.table] if model.table in self.staged else self.db.table(model)

    def _put(self, model: Model, df: DataFrame) -> None:
        self.staged[model.table] = df.select(*model.columns)

    # savepoints

    def savepoint(self) -> int:
        self.points.append(dict(self.staged))
        return len(self.points) - 1

    def rollback_to(self, point: int) -> None:
        self.staged = dict(self.points[point])
        del self.points[point:]

    def release(self, point: int) -> None:
        del self.points[point:]

    def rollback(self) -> None:
        self.staged, self.points = {}, []

    # inserts

    def _rows(self, model: Model, rows: Iterable[dict[str, Any]] | DataFrame) -> DataFrame:
        """The rows to insert with defaults filled in."""
        if isinstance(rows, DataFrame):
            given, df = rows.columns, rows
        else:
            rows = list(rows)
            given = list(rows[0]) if rows else []
            if not given or any(set(r) != set(given) for r in rows):
                raise ValueError("rows to insert need the same columns, at least one")
            unknown = [c for c in given if c not in model.columns]
            if unknown:
                raise ValueError(f"{model.name} has no columns {unknown}")
            loose = T.StructType([T.StructField(c, model.schema[c].dataType) for c in given])
            df = self.db.spark.createDataFrame([tuple(r[c] for c in given) for r in rows], loose)
        for c, kind in ((f.name, f.dataType) for f in model.schema.fields):
            if c not in given:
                df = self._numbered(model, df, c) if model.defaults.get(c) == "autoincrement" else df.withColumn(c, self._default(model, c))
                df = df.withColumn(c, F.col(c).cast(kind))
        return df.select(*model.columns)

    def _numbered(self, model: Model, df: DataFrame, column: str) -> DataFrame:
        """Numbers on from the table's greatest, without gaps: each partition starts where the one before it ends."""
        most = self.table(model).agg(F.coalesce(F.max(column), F.lit(0)).cast("long")).scalar()
        at = df.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33))
        sizes = at.groupBy("__part").agg(F.count("*").alias("__n"))  # a row for each partition
        starts = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
        numbered = at.join(F.broadcast(starts), "__part").withColumn(column, most + 1 + F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
        return numbered.drop("__at", "__part", "__start")

    def _default(self, model: Model, column: str) -> Column:
        default = model.defaults.get(column)
        if default is None:
            return F.lit(None)
        return DEFAULTS[default]() if default in DEFAULTS else F.expr(default)

    def insert(self, model: Model, rows: Iterable[dict[str, Any]] | DataFrame) -> DataFrame:
        """Adds rows; the rows as stored."""
        new = self._rows(model, rows)
        self._put(model, self.table(model).unionByName(new))
        return new

    def upsert(self, model: Model, rows: Iterable[dict[str, Any]] | DataFrame, on: Sequence[str], update: Sequence[str] = ()) -> None:
        """Adds rows whose ``on`` columns are new; of the others the columns ``update`` are taken over.

        A key that is given twice is an error where columns are to be updated; else the first row is the one
        that is added. Rows of a DataFrame have no order, so of those the least counts. A null key is new.
        """
        if not isinstance(rows, DataFrame):
            seen: dict[tuple, dict[str, Any]] = {}
            rows = list(rows)
            for i, r in enumerate(rows):
                key = tuple(r.get(c) for c in on)
                key = (*key, i) if None in key else key
                if key in seen and update:
                    raise ValueError(f"{model.name}: one key twice in an upsert that updates")
                seen.setdefault(key, r)
            new = self._rows(model, list(seen.values()))
        else:
            alone = F.coalesce(*[F.when(F.col(c).isNull(), F.monotonically_increasing_id()) for c in on])
            made = self._rows(model, rows).withColumn("__alone", alone)
            new = made.groupBy(*on, "__alone").agg(F.min(F.struct(*model.columns)).alias("__row")).select("__row.*")
        old = self.table(model)
        # the new rows are the side that Spark broadcasts where it is small; the table is never the one that moves then
        known = old.join(new.select(*on), list(on), "left_semi").select(*on)
        added = new.join(known, list(on), "left_anti").select(*model.columns)
        if update:
            fresh = new.select(*[F.col(c).alias(f"__{c}") for c in {*on, *update}], F.lit(True).alias("__met"))
            same = reduce(Column.__and__, [F.col(c) == F.col(f"__{c}") for c in on])
            old = old.join(fresh, same, "left").select(*[(F.when(F.col("__met"), F.col(f"__{c}")).otherwise(F.col(c)) if c in update else F.col(c)).alias(c) for c in model.columns])
        self._put(model, old.unionByName(added))

    def create(self, model: Model, row: dict[str, Any], children: dict[Relation, list[dict[str, Any]]] | None = None) -> DataFrame:
        """One row, and rows of related models that point to it."""
        made = self.insert(model, [row])
        for relation, rows in (children or {}).items():
            self.insert(self.db.models[relation.model], [r | {relation.column: row[relation.key]} for r in rows])
        return made

    # updates and deletes

    def _hit(self, model: Model, where: Filter) -> Column:
        if not isinstance(where, Filter):
            raise TypeError("a filter is needed, or ALL_ROWS")
        return F.coalesce(where.build(Scope(self.db.with_tables(**self.staged), {})), F.lit(False))

    def affected(self, model: Model, where: Filter) -> int:
        return self.table(model).where(self._hit(model, where)).count()

    def update(self, model: Model, where: Filter, **values: Any) -> Affected:
        """Sets columns of the rows that meet ``where``; a value may be a Spark column."""
        if not values:
            raise ValueError("nothing to set")
        hit = self._hit(model, where)
        met = Affected({model.name: self.table(model).where(hit)})
        cells = []
        for f in model.schema.fields:
            if f.name in values:
                v = values[f.name]
                cells.append(F.when(hit, (v if isinstance(v, Column) else F.lit(v)).cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name))
            else:
                cells.append(F.col(f.name))
        self._put(model, self.table(model).select(*cells))
        return met

    def update_json(self, model: Model, where: Filter, column: str, key: str, value: Any) -> Affected:
        return self.update(model, where, **{column: json_set(F.col(column), key, value)})

    def delete(self, model: Model, where: Filter) -> Affected:
        """Takes out the rows that meet ``where``; declared foreign keys say what their children do.

        Rows that go by cascade are found first, level by level, then children of all of them are checked
        (restrict) or cut loose (set_null). Children under no_action are looked at by ``check``.
        """
        hit = self._hit(model, where)
        doomed = self._doomed(model, self.table(model).where(hit))
        keys = [(child, k) for child in self.db.models.values() for k in child.foreign if k.model in doomed]
        after = {name: self._without(self.db.models[name], df) for name, df in doomed.items()}
        if len(doomed) == 1 and not self._looped(model):
            after[model.name] = self.table(model).where(~hit)
        for child, k in keys:
            rows = after.get(child.name)
            rows = self._table_or_none(child) if rows is None else rows
            if rows is None or k.on_delete not in ("restrict", "set_null"):
                continue
            gone = doomed[k.model].select(F.col(k.key).alias("__gone")).distinct()
            meets = F.col(k.column) == F.col("__gone")
            if k.on_delete == "restrict":
                if not rows.join(gone, meets, "left_semi").isEmpty():
                    raise ForeignKeyViolation(f"{child.name}.{k.column} still refers to {k.model}")
            else:
                after[child.name] = rows.join(gone, meets, "left").withColumn(k.column, F.when(F.col("__gone").isNull(), F.col(k.column))).select(*child.columns)
        for name, df in after.items():
            self._put(self.db.models[name], df)
        return Affected(doomed)

    def _cascades(self, names: Iterable[str]) -> list[tuple[Model, ForeignKey]]:
        held = set(names)
        return [(child, k) for child in self.db.models.values() for k in child.foreign if k.model in held and k.on_delete == "cascade"]

    def _looped(self, model: Model) -> bool:
        """Whether cascades can lead from the model, or from one below it, back to where they have been."""

        def back(name: str, path: tuple[str, ...]) -> bool:
            return name in path or any(back(child.name, (*path, name)) for child, _ in self._cascades([name]))

        return back(model.name, ())

    def _without(self, model: Model, gone: DataFrame) -> DataFrame:
        return self.table(model).join(gone.select(*model.key).distinct(), list(model.key), "left_anti").select(*model.columns)

    def _table_or_none(self, model: Model) -> DataFrame | None:
        """The table, if the Db has one: a Db over given tables need not have those of all models."""
        try:
            return self.table(model)
        except LookupError:
            return None

    def _doomed(self, model: Model, first: DataFrame) -> dict[str, DataFrame]:
        """The rows that go with ``first``, by model."""
        if self._looped(model):
            return self._doomed_in_loops(model, first)
        found, level = {model.name: first}, {model.name: first}
        while level:
            level = self._below(level, found)
            for name, df in level.items():
                found[name] = found[name].unionByName(df) if name in found else df
        return found

    def _below(self, level: dict[str, DataFrame], found: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """The rows that go by cascade with those of ``level``, but for those ``found`` before."""
        below: dict[str, DataFrame] = {}
        for child, k in self._cascades(level):
            rows = self._table_or_none(child)
            if rows is None:
                continue
            gone = level[k.model].select(F.col(k.key).alias("__gone")).distinct()
            lost = rows.join(gone, F.col(k.column) == F.col("__gone"), "left_semi")
            for known in (found.get(child.name), below.get(child.name)):
                if known is not None:
                    lost = lost.join(known.select(*child.key), list(child.key), "left_anti").select(*child.columns)
            below[child.name] = below[child.name].unionByName(lost) if child.name in below else lost
        return below

    def _doomed_in_loops(self, model: Model, first: DataFrame) -> dict[str, DataFrame]:
        """The same where cascades loop, as in a table that refers to itself; the search ends with a level that is empty.

        Each level is written as Parquet and read back. A checkpoint would keep what Spark infers of its columns,
        and from level to level those conditions double; files keep nothing of the plan that made them, and all
        levels of a model are one scan. The files go when the search ends; its result is checkpointed.
        """
        spark, root = self.db.spark, f"{self._checkpoint_dir()}/cascade-{uuid.uuid4().hex}"
        found: dict[str, DataFrame] = {}
        made, depth = {model.name: first}, 0
        try:
            while made:
                level = {}
                for name, df in made.items():
                    folder = f"{root}/rows-{name}"
                    df.write.parquet(f"{folder}/{depth}")
                    level[name] = spark.read.schema(df.schema).parquet(f"{folder}/{depth}")
                    found[name] = spark.read.schema(df.schema).option("recursiveFileLookup", True).parquet(folder)
                level = {name: df for name, df in level.items() if not df.isEmpty()}
                made, depth = self._below(level, found), depth + 1
            return {name: df.checkpoint() for name, df in found.items()}
        finally:
            self._remove(root)

    def _checkpoint_dir(self) -> str:
        """The folder of Spark's checkpoints, set from the session's where the context has none."""
        context = self.db.spark.sparkContext
        if not context.getCheckpointDir():
            where = self.db.spark.conf.get("spark.checkpoint.dir", None)
            if where is None:
                if not context.master.startswith("local"):
                    raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
                where = tempfile.mkdtemp(prefix="tessella-")
            context.setCheckpointDir(where)
        return context.getCheckpointDir()

    def _remove(self, path: str) -> None:
        where = self.db.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.db.spark._jsc.hadoopConfiguration()).delete(where, True)

    # relations

    def connect(self, relation: Relation, parent: Any, where: Filter) -> Affected:
        return self.update(self.db.models[relation.model], where, **{relation.column: parent})

    def disconnect(self, relation: Relation, where: Filter) -> Affected:
        return self.update(self.db.models[relation.model], where, **{relation.column: None})

    def attach(self, relation: Relation, parent: Any, children: Sequence[Any]) -> None:
        """Ties a parent to children of a many-to-many relation; ties that exist stay single."""
        tie, to_parent, to_child = relation.through
        self.upsert(self.db.models[tie], [{to_parent: parent, to_child: c} for c in children], (to_parent, to_child))

    def detach(self, relation: Relation, parent: Any, children: Sequence[Any] | None = None) -> None:
        """Unties a parent from children, or from all."""
        tie, to_parent, to_child = relation.through
        model = self.db.models[tie]
        where = getattr(model, to_parent).eq(parent)
        self.delete(model, where if children is None else where & getattr(model, to_child).in_(children))

    def set_related(self, relation: Relation, parent: Any, children: Sequence[Any]) -> None:
        """Makes ``children``, by their keys, the parent's only ones: the others are untied or cut loose."""
        if relation.through:
            self.detach(relation, parent)
            if children:
                self.attach(relation, parent, children)
            return
        model = self.db.models[relation.model]
        self.disconnect(relation, getattr(model, relation.column).eq(parent))
        if children:
            self.connect(relation, parent, getattr(model, model.key[0]).in_(children))

    # raw SQL over the staged state

    def _now(self) -> Db:
        return self.db.with_tables(**self.staged)

    def sql(self, text: str, args: Sequence[Any] | dict[str, Any] | None = None) -> DataFrame:
        """Spark SQL over the tables as they are staged."""
        return self._now().sql(text, args)

    def fetch_all(self, text: str, args: Sequence[Any] | dict[str, Any] | None = None) -> list[Row]:
        return self.sql(text, args).collect()

    def fetch_optional(self, text: str, args: Sequence[Any] | dict[str, Any] | None = None) -> Row | None:
        return next(iter(self.sql(text, args).limit(1).collect()), None)

    def fetch_one(self, text: str, args: Sequence[Any] | dict[str, Any] | None = None) -> Row:
        row = self.fetch_optional(text, args)
        if row is None:
            raise NoRow("no row found for query")
        return row

    def execute(self, model: Model, text: str, args: Sequence[Any] | dict[str, Any] | None = None) -> Affected:
        """Stages what a SELECT over the staged tables gives as the model's next state, by column name.

        The rows affected are those that the old state has and the new one has not, and the other way round.
        """
        old, kinds = self.table(model), model.schema
        new = self.sql(text, args).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in kinds.fields])
        self._put(model, new)
        return Affected({model.name: old.exceptAll(new).unionAll(new.exceptAll(old))})

    # the end

    def check(self, tables: dict[str, DataFrame] | None = None) -> None:
        """Raises for the first rule that the changed tables break, or that others break by what they changed.

        ``tables``: the changed tables as they were written; the staged ones where not told.
        """
        changed = self.staged if tables is None else tables

        def table(model: Model) -> DataFrame | None:
            return changed[model.table] if model.table in changed else self._table_or_none(model)

        for model in self.db.models.values():
            if model.table not in changed:
                continue
            df = table(model)
            rules: list[tuple[Column, ConstraintError]] = [(F.col(f.name).isNull(), NotNullViolation(f"{model.name}.{f.name}")) for f in model.schema.fields if not f.nullable]
            rules += [(~F.col(c).isin(list(values)), CheckViolation(f"{model.name}.{c}")) for c, values in model.allowed.items()]
            broken = df.agg(*[F.coalesce(F.max(c), F.lit(False)) for c, _ in rules]).first() if rules else ()
            for is_broken, (_, error) in zip(broken, rules, strict=True):
                if is_broken:
                    raise error
            for columns in (model.key, *model.unique):
                whole = reduce(Column.__and__, [F.col(c).isNotNull() for c in columns])
                if not df.where(whole).groupBy(*columns).count().where("count > 1").isEmpty():
                    raise UniqueViolation(f"{model.name}({', '.join(columns)})")
        for model in self.db.models.values():
            for k in model.foreign:
                parent = self.db.models.get(k.model)
                if parent is None or not {model.table, parent.table} & set(changed):
                    continue
                rows, parents = table(model), table(parent)
                if rows is None:
                    continue
                if parents is None:
                    raise LookupError(f"no table {parent.table} for {model.name}.{k.column}")
                loose = rows.where(F.col(k.column).isNotNull()).join(parents.select(F.col(k.key).alias("__key")), F.col(k.column) == F.col("__key"), "left_anti")
                if not loose.isEmpty():
                    raise ForeignKeyViolation(f"{model.name}.{k.column}")

    def commit(self, root: str) -> Db:
        """Writes each changed table once, to a new folder under ``root``, checks what was written, and gives a Db over it.

        The declaration goes with the files: keys and foreign keys are kept as metadata of the columns.
        """
        spark, paths = self.db.spark, {}
        try:
            for name, df in self.staged.items():
                paths[name] = f"{root}/{name}/{uuid.uuid4().hex}"
                model = next(m for m in self.db.models.values() if m.table == name)
                df.select(*[F.col(c).alias(c, metadata=metadata_of(model, c)) for c in model.columns]).write.parquet(paths[name])
            written = {name: spark.read.parquet(path) for name, path in paths.items()}
            self.check(written)
        except BaseException:
            for path in paths.values():
                self._remove(path)
            raise
        self.rollback()
        return self.db.with_tables(**written)
