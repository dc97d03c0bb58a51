"""What the operators share: durable intermediate tables, row keys, names, words and word hashes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries a task's cache may hold before it is emptied; bounds memory, changes no result.
CACHE_ENTRIES = 300_000
MASK = (1 << 64) - 1


#: Each settled table that is still there, by its path.
TABLES: dict[str, DataFrame] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset and Spark is local (tests), a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    where = tempfile.mkdtemp(prefix="tessella-")
    atexit.register(shutil.rmtree, where, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", where)
    return where


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage: a lost executor costs a reread, not a recomputation.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    TABLES[path] = out
    return out


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that nothing reads any more."""
    for path in [p for p, df in TABLES.items() if any(df is t for t in tables)]:
        spark = TABLES.pop(path).sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def temporary() -> Iterator[list[DataFrame]]:
    """Deletes at its end the tables that were settled inside, but for those put on the list."""
    before, kept = set(TABLES), []
    yield kept
    discard(*[df for p, df in TABLES.items() if p not in before and not any(df is k for k in kept)])


def row_key(*columns: str) -> Column:
    """A 128-bit hash of columns as a struct of two numbers; nulls are told from values."""
    cells = [c for name in columns for c in (F.col(name).isNull(), F.col(name))]
    return F.struct(F.xxhash64(*cells).alias("a"), F.xxhash64(F.lit("second"), *cells).alias("b"))


def unused(taken: Iterable[str], *names: str) -> list[str]:
    """``names``, with underscores put before those that ``taken`` holds (in any case)."""
    held = {t.lower() for t in taken}
    out = []
    for name in names:
        while name.lower() in held:
            name = "_" + name
        out.append(name)
    return out


def held_out(id_col: str = "doc_id"):
    """True where crc32 of the id as text leaves 0 modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


class WordHashes(dict):
    """64-bit hash of a word (bytes), kept for words met before."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return hashes[:0]
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[i : i + n]
    return mixed(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """Murmur's 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x
