"""Seeds: a JSON document {model or table: [rows]} whose rows are upserted by their keys."""

from __future__ import annotations

import json

from tessella.operators.changes import Changes


def apply_seed(changes: Changes, text: str) -> None:
    """Stages every row of the document; running it again changes nothing."""
    by_table = {m.table: m for m in changes.db.models.values()}
    for name, rows in json.loads(text).items():
        model = changes.db.models.get(name) or by_table.get(name)
        if model is None:
            raise ValueError(f"no model {name!r}")
        for row in rows:
            missing = [k for k in model.key if k not in row]
            if missing:
                raise ValueError(f"{name}: a row without {missing}")
        shapes: dict[tuple[str, ...], list[dict]] = {}
        for row in rows:
            shapes.setdefault(tuple(sorted(row)), []).append(row)
        for columns, alike in shapes.items():
            changes.upsert(model, alike, tuple(model.key), [c for c in columns if c not in model.key])
