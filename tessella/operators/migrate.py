"""Changes between two declarations of a model, as DataFrame transformations, and drift of stored data."""

from __future__ import annotations

import difflib
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.schema import Model


@dataclass(frozen=True)
class Change:
    """kind: add, drop, rename, retype, nullable or required; or of rules, which move no data: key, unique and
    not_unique, foreign and not_foreign, allowed, default. A rule's ``after`` (or ``before``) is its declaration."""

    kind: str
    column: str
    before: str | None = None
    after: str | None = None

    @property
    def loses_data(self) -> bool:
        return self.kind in ("drop", "retype")


class MigrationError(ValueError):
    pass


def diff(old: Model, new: Model, renamed: dict[str, str] | None = None) -> list[Change]:
    """What leads from ``old`` to ``new``, in an order that can be applied; ``renamed`` maps new names to old ones."""
    renamed = renamed or {}
    out = [Change("rename", n, o, n) for n, o in renamed.items() if o in old.columns and n in new.columns]
    back = {c.before: c.column for c in out}
    before = {back.get(c, c): t for c, t in old.columns.items()}
    out += [Change("drop", c, t) for c, t in before.items() if c not in new.columns]
    for c, t in new.columns.items():
        if c not in before:
            out.append(Change("add", c, None, t))
            continue
        was = before[c]
        if was.rstrip("?") != t.rstrip("?"):
            out.append(Change("retype", c, was, t))
        if was.endswith("?") != t.endswith("?"):
            out.append(Change("nullable" if t.endswith("?") else "required", c, was, t))
    return out + _rules(old, new, back)


def _rules(old: Model, new: Model, back: dict[str, str]) -> list[Change]:
    """Changes of rules, with old columns under their new names; rules go before others come."""
    now = lambda columns: [back.get(c, c) for c in columns]
    told = lambda f, c: f"{c} -> {f.model}.{f.key} {f.on_delete}"
    gone, come = [], []
    pairs = (
        ("unique", {", ".join(now(u)) for u in old.unique}, {", ".join(u) for u in new.unique}),
        ("foreign", {told(f, back.get(f.column, f.column)) for f in old.foreign}, {told(f, f.column) for f in new.foreign}),
    )
    for kind, before, after in pairs:
        gone += [Change(f"not_{kind}", x.split(" -> ")[0], x, None) for x in sorted(before - after)]
        come += [Change(kind, x.split(" -> ")[0], None, x) for x in sorted(after - before)]
    if now(old.key) != list(new.key):
        come.insert(0, Change("key", ", ".join(new.key), ", ".join(now(old.key)), ", ".join(new.key)))
    for kind, before, after in (("allowed", {back.get(c, c): list(v) for c, v in old.allowed.items()}, {c: list(v) for c, v in new.allowed.items()}), ("default", {back.get(c, c): v for c, v in old.defaults.items()}, dict(new.defaults))):
        come += [Change(kind, c, str(before[c]) if c in before else None, str(after[c]) if c in after else None) for c in sorted({*before, *after}) if before.get(c) != after.get(c)]
    return gone + come


def reverse(changes: list[Change]) -> list[Change]:
    """What leads back; values of dropped columns don't return."""
    flip = {"add": "drop", "drop": "add", "nullable": "required", "required": "nullable", "unique": "not_unique", "not_unique": "unique", "foreign": "not_foreign", "not_foreign": "foreign"}
    return [Change(flip.get(c.kind, c.kind), c.before if c.kind == "rename" else c.column, c.after, c.before) for c in reversed(changes)]


def apply(df: DataFrame, changes: list[Change], backfill: dict[str, Any] | None = None, accept_data_loss: bool = False) -> DataFrame:
    """The table after ``changes``. A required column needs a value in ``backfill`` for rows without one.

    Changes of rules leave the rows as they are: ``Changes.check`` says whether they hold.
    """
    backfill = backfill or {}
    if not accept_data_loss and (lost := [c for c in changes if c.loses_data]):
        raise MigrationError(f"data would be lost: {', '.join(f'{c.kind} {c.column}' for c in lost)}")
    for c in changes:
        if c.kind == "rename":
            df = df.withColumnRenamed(c.before, c.after)
        elif c.kind == "drop":
            df = df.drop(c.column)
        elif c.kind == "add":
            if not c.after.endswith("?") and c.column not in backfill:
                raise MigrationError(f"required column {c.column} needs a backfill value")
            df = df.withColumn(c.column, F.lit(backfill.get(c.column)).cast(c.after.rstrip("?")))
        elif c.kind == "retype":
            df = df.withColumn(c.column, F.col(c.column).cast(c.after.rstrip("?")))
        elif c.kind == "required" and c.column in backfill:
            df = df.withColumn(c.column, F.coalesce(F.col(c.column), F.lit(backfill[c.column]).cast(c.after.rstrip("?"))))
    return df


def rename_hints(old: Model, new: Model, cutoff: float = 0.6) -> list[tuple[str, str]]:
    """(old, new) for dropped and added columns of one type with alike names."""
    gone, come = ([c for c in a.columns if c not in b.columns] for a, b in ((old, new), (new, old)))
    out = []
    for c in gone:
        alike = [n for n in difflib.get_close_matches(c, come, 1, cutoff) if new.columns[n].rstrip("?") == old.columns[c].rstrip("?")]
        out += [(c, n) for n in alike]
    return out


def plan(old: Sequence[Model], new: Sequence[Model], renamed: dict[str, dict[str, str]] | None = None) -> list[tuple[str, Change]]:
    """(model, change) from one set of models to another: tables come with those they refer to first, and go last.

    Kinds beside those of ``diff``: create and remove, of whole tables. Models whose foreign keys form a circle
    come in the order of their names, their foreign keys after all of them.
    """
    before, after = {m.name: m for m in old}, {m.name: m for m in new}
    order: list[str] = []
    waiting = {n: {f.model for f in m.foreign if f.model != n and f.model in after} for n, m in sorted(after.items())}
    while waiting:
        free = [n for n, needs in waiting.items() if not needs & set(waiting)] or [next(iter(waiting))]
        order += free
        waiting = {n: needs for n, needs in waiting.items() if n not in free}
    changes: list[tuple[str, Change]] = []
    late: list[tuple[str, Change]] = []
    for name in order:
        model = after[name]
        if name in before:
            changes += [(name, c) for c in diff(before[name], model, (renamed or {}).get(name))]
            continue
        changes.append((name, Change("create", "")))
        for f in model.foreign:
            known = f.model == name or order.index(f.model) < order.index(name) if f.model in after else True
            (changes if known else late).append((name, Change("foreign", f.column, None, f"{f.column} -> {f.model}.{f.key} {f.on_delete}")))
    return changes + late + [(name, Change("remove", "")) for name in reversed(list(before)) if name not in after]


def drift(model: Model, df: DataFrame) -> list[str]:
    """How a stored table differs from its model: columns, types, and nulls in required columns.

    Parquet reads every column as nullable, so the rows are asked, all columns at once.
    """
    stored = {f.name: f for f in df.schema.fields}
    out = [f"missing column {c}" for c in model.columns if c not in stored] + [f"unknown column {c}" for c in stored if c not in model.columns]
    for f in model.schema.fields:
        if f.name in stored and stored[f.name].dataType != f.dataType:
            out.append(f"{f.name} is {stored[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
    required = [f.name for f in model.schema.fields if not f.nullable and f.name in stored and stored[f.name].nullable]
    nulls = df.agg(*[F.count_if(F.col(c).isNull()) for c in required]).first() if required else ()
    return out + [f"{c} is required and null in {n} rows" for c, n in zip(required, nulls, strict=True) if n]
