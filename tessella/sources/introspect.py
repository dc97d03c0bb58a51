"""Models read off stored tables, and what of a model is stored with them."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame

from tessella.schema import ForeignKey, Model


def metadata_of(model: Model, column: str) -> dict[str, Any]:
    """What the model says of a column beyond its type, as Parquet column metadata."""
    out: dict[str, Any] = {"required": not model.schema[column].nullable}
    if column in model.key:
        out["key"] = list(model.key).index(column)
    foreign = [f for f in model.foreign if f.column == column]
    if foreign:
        out["foreign"] = [foreign[0].model, foreign[0].key, foreign[0].on_delete]
    unique = [i for i, u in enumerate(model.unique) if column in u]
    if unique:
        out["unique"] = unique
    return out


def model_of(name: str, df: DataFrame, key: Sequence[str] | None = None) -> Model:
    """A model with the table's columns, and the keys, uniqueness and foreign keys that a commit stored.

    Parquet itself keeps none of them, so of other tables the key is told.
    """
    fields, told = df.schema.fields, {f.name: f.metadata for f in df.schema.fields}
    key = tuple(key or sorted((c for c, m in told.items() if "key" in m), key=lambda c: told[c]["key"]))
    unique: dict[int, list[str]] = {}
    for c, m in told.items():
        for i in m.get("unique", ()):
            unique.setdefault(i, []).append(c)
    columns = {f.name: f.dataType.simpleString() + "?" * (f.nullable and not told[f.name].get("required", False)) for f in fields}
    foreign = tuple(ForeignKey(c, *m["foreign"]) for c, m in told.items() if "foreign" in m)
    return Model(name, columns, key, tuple(unique[i] for i in sorted(unique)), foreign=foreign)
