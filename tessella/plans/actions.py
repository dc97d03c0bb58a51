"""Counts the actions that Spark runs, so that a test can bound them."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession


@dataclass
class Counted:
    actions: int = 0


@contextmanager
def counted(spark: SparkSession) -> Iterator[Counted]:
    """How many SQL actions (collect, count, write) run inside the block; known when it ends.

    Spark numbers them and keeps the last ``spark.sql.ui.retainedExecutions``, so how many it holds is no count.
    """
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()

    def held() -> Any:
        bus.waitUntilEmpty()
        return store.executionsList()

    out, before = Counted(), held()
    began = before.last().executionId() if before.nonEmpty() else None
    yield out
    after = held()
    out.actions = after.size() if began is None else after.last().executionId() - began
