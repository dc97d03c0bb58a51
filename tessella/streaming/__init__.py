"""The same builders over streams: filters and projections lower to columns, which streams take as well."""

from __future__ import annotations

from pyspark.sql.streaming import StreamingQuery

from tessella.plans.select import Fetch
from tessella.schema import Model
from tessella.session import Db


def streamed(db: Db, model: Model, path: str, files_per_trigger: int = 1000) -> Db:
    """A Db in which the model's table is the stream of Parquet files that arrive at ``path``."""
    rows = db.spark.readStream.schema(model.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return db.with_tables(**{model.table: rows})


def start(query: Fetch, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the query's rows to ``path``, up to what is there now, each row once."""
    return query.to_df().writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
