"""What the operators of this subpackage share."""

from __future__ import annotations

import sys
import types
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

import lodestar
from lodestar.sources.shared import clear_stored, shared_dir, spread, stored  # noqa: F401

# Functions travel to the workers whole, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(lodestar)

#: Texts are handled in groups of about this many bytes, whatever a batch holds.
CHUNK_BYTES = 4 << 20
#: Most rows of an Arrow batch: texts are long, and Spark holds a batch outside its heap for each task.
BATCH_ROWS = 2000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table."""
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def shielded(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work over docs, whose columns other than doc_id, text and lang have names meanwhile that clash with nothing."""
    names = {c: c if c in ("doc_id", "text", "lang") else f"_lodestar_own_{i}" for i, c in enumerate(docs.columns)}
    out = work(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]))
    return out.select(*[F.col(n).alias(c) for c, n in names.items()])


def crc_fold(doc_id, folds: int) -> int:
    """crc32 of the id as text, modulo folds; a null id counts as empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


def map_batches(df: DataFrame, columns: list[str], schema: str, work: Callable[[Iterator[dict]], Iterator[dict]], chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Runs work over chunks of rows in Arrow batches.

    work gets dicts of lists, one per column of ``columns``, each with about chunk_bytes of text
    (a longer text comes alone), and yields dicts of columns of ``schema``. Text columns come as
    UTF-8 bytes. The session's Arrow batches are limited to BATCH_ROWS rows from here on. Only ``columns`` are read, so columns of any other name don't matter.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, BATCH_ROWS)
    out_schema = StructType.fromDDL(schema)
    arrow_schema = to_arrow_schema(out_schema)

    def run(batches):
        for out in work(_chunks(batches, chunk_bytes)):
            arrays = [v if isinstance(v := out[f.name], pa.Array) else pa.array(v, type=f.type) for f in arrow_schema]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow_schema)

    return df.select(*columns).mapInArrow(run, out_schema)


def _chunks(batches, chunk_bytes: int) -> Iterator[dict]:
    for batch in batches:
        table = {}
        sizes = np.zeros(batch.num_rows, dtype=np.int64)
        for name, column in zip(batch.schema.names, batch.columns):
            if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
                column = column.cast(pa.large_binary())
                lengths = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
                sizes += lengths.astype(np.int64)
            table[name] = column
        if not batch.num_rows:
            continue
        cut = np.cumsum(sizes) // chunk_bytes
        starts = np.flatnonzero(np.diff(cut, prepend=-1))
        for lo, hi in zip(starts, [*starts[1:], batch.num_rows]):
            yield {name: column.slice(lo, hi - lo).to_pylist() for name, column in table.items()}


def worker_cache() -> dict:
    """A dict that outlives a task in a reused Python worker, for tokenizers and the like."""
    return sys.modules.setdefault("_lodestar_worker_cache", types.ModuleType("_lodestar_worker_cache")).__dict__


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, and the sums of values by key."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1)) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], *(np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values)


class Sums:
    """Sums by key of arrays that come one by one; held is what they take before the next merge."""

    def __init__(self, values: int):
        self.parts, self.held, self.values = [], 0, values

    def add(self, keys: np.ndarray, *values: np.ndarray) -> None:
        self.parts.append((keys, *values))
        self.held += len(keys)

    def taken(self) -> tuple[np.ndarray, ...]:
        parts, self.parts, self.held = self.parts, [], 0
        if not parts:
            return (np.zeros(0, dtype=np.int64),) * (1 + self.values)
        return summed(*(np.concatenate([p[i] for p in parts]) for i in range(1 + self.values)))
