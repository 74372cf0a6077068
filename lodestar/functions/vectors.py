"""Vector expressions and the blocked similarity join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import lodestar

cloudpickle.register_pickle_by_value(lodestar)

#: Rows of a block; a task holds two blocks and their products.
BLOCK = 2048
#: A side of so many rows and numbers (32 MB) at most is broadcast; rows of the other side that are multiplied at a time.
BROADCAST_ROWS = 20_000
BROADCAST_VALUES = 4_000_000
SLICE = 256


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 where a norm is 0, null where a vector is."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def elements(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """(keys, dim, value) of a vector column."""
    return df.select(*keys, F.posexplode(vector).alias("dim", "value")).withColumn("value", F.col("value").cast("double"))


def matrix(column) -> np.ndarray:
    """The rows of an Arrow column of equally long lists, as unit vectors (a zero vector stays)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float, same: bool = False) -> DataFrame:
    """(a, b, cosine) of rows (id, vector) of left and right with cosine > threshold; a < b if same. Zero vectors match nothing.

    If right has BROADCAST_ROWS rows and BROADCAST_VALUES numbers at most, it is sent to all tasks and left isn't moved at all. Else
    blocks of both sides meet.
    """
    head = right.select("id", "vector").limit(BROADCAST_ROWS + 1).toArrow()
    column = head.column("vector").combine_chunks()
    if head.num_rows > BROADCAST_ROWS or len(column.flatten()) > BROADCAST_VALUES:
        return blocked_pairs(left, right, threshold, same)
    shipped = left.sparkSession.sparkContext.broadcast((head.column("id").to_numpy(), matrix(column)))

    def match(batches):
        ids, other = shipped.value
        for batch in batches:
            own, rows = batch.column("id").to_numpy(), matrix(batch.column("vector"))
            for lo in range(0, len(own) if len(ids) else 0, SLICE):
                product = rows[lo : lo + SLICE] @ other.T
                i, j = np.nonzero(product > threshold)
                a, b, value = own[lo + i], ids[j], product[i, j]
                if same:
                    a, b, value = a[a < b], b[a < b], value[a < b]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(value)], names=["a", "b", "cosine"])

    return left.select("id", "vector").mapInArrow(match, "a long, b long, cosine double")


def blocked_pairs(left: DataFrame, right: DataFrame, threshold: float, same: bool = False) -> DataFrame:
    """similar_pairs of sides of any size: vectors are dealt by hash into blocks and each pair of blocks is one group, multiplied as
    matrices. Every row is sent to as many groups as the other side has blocks, and a group holds two blocks whatever the sizes of the sides."""
    blocks = [max(1, -(-left.count() // BLOCK))]
    blocks.append(blocks[0] if same else max(1, -(-right.count() // BLOCK)))

    def sent(df: DataFrame, side: int) -> DataFrame:
        own = F.pmod(F.xxhash64("id"), F.lit(blocks[side])).cast("int")
        others = F.sequence(F.lit(0), F.lit(blocks[1 - side] - 1))
        pair = (lambda o: F.struct(own.alias("x"), o.alias("y"))) if side == 0 else (lambda o: F.struct(o.alias("x"), own.alias("y")))
        out = df.select("id", "vector", F.lit(side).alias("side"), F.explode(F.transform(others, pair)).alias("at")).select("id", "vector", "side", "at.x", "at.y")
        return out.where("x <= y") if same else out

    def multiply(table: pa.Table) -> pa.Table:
        side, ids, rows = table.column("side").to_numpy(), table.column("id").to_numpy(), matrix(table.column("vector"))
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        product = rows[x] @ rows[y].T
        i, j = np.nonzero(product > threshold)
        a, b, value = ids[x[i]], ids[y[j]], product[i, j]
        if same:
            keep = a < b if table.column("x")[0] == table.column("y")[0] else a != b
            a, b, value = np.minimum(a, b)[keep], np.maximum(a, b)[keep], value[keep]
        return pa.table({"a": a, "b": b, "cosine": value})

    return sent(left, 0).unionByName(sent(right, 1)).groupBy("x", "y").applyInArrow(multiply, "a long, b long, cosine double")
