"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivia.operators.lineage import shared_path

#: Words, as every operator on words takes them: runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows whose results a Python worker holds at once.
SLICE = 256


_holder: list[tuple[str, Callable[[], object]]] = []


def hold_cache(owner: str, clear: Callable[[], object]) -> None:
    """Called in a Python worker before an operator fills its cache: the cache of any other operator that ran in this
    worker is emptied, so a worker that is used again holds one cache at a time."""
    if not _holder or _holder[0][0] != owner:
        for _, empty in _holder:
            empty()
        _holder[:] = [(owner, clear)]
        gc.collect()
        give_back()


def in_slices(of: Callable[[pa.Array], pa.Array], rows: int = SLICE) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    """A function of whole batches as one of a stream of them, for arrow_udf: results leave a few rows at a time, and a
    task's freed memory goes back to the system at its end, as its worker may wait long for another."""

    def sliced(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for at in range(0, len(batch), rows):
                yield of(batch.slice(at, rows))
        batch = None
        give_back()

    return sliced


def give_back() -> None:
    """Freed memory goes back to the system, where Arrow and the C library can be asked for that."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """Rows that no classifier may learn from: one in five by the checksum of the id as text."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def stash(df: DataFrame, name: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back: lineage ends here and survives lost executors."""
    path = stash_path(df.sparkSession, name)
    df.write.format(fmt).options(**options).save(path)
    return df.sparkSession.read.format(fmt).schema(df.schema).load(path)


def stashed_at(df: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """Write `df` once to `path`, which stash_path gave, and read it back."""
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stash_path(spark: SparkSession, name: str) -> str:
    return shared_path(spark, name)


def input_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
