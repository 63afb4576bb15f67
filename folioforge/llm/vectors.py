"""What the vector operators share: which vectors take part, and numpy views of list columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(table: DataFrame) -> DataFrame:
    """(vec_id, v): the vectors that take part, as doubles.

    Left out: null ids, null or empty vectors, null or non-finite components, zero vectors, and lengths
    other than the most frequent one (of equally frequent ones, the larger).
    """
    v = F.col("embedding")
    fine = (
        table.select("vec_id", F.transform(v, lambda x: x.cast("double")).alias("v"))
        .where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
        .where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    )
    width = fine.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return fine.where(F.size("v") == (width.d if width else 0))


#: The same in DuckDB: u(vec_id, v).
USABLE_SQL = """f AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    u AS (SELECT * FROM f WHERE len(v) = (SELECT len(v) FROM f GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1))"""


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as a 2-d array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def as_lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, d = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * d + 1, d or 1)[: n + 1], pa.int32()), pa.array(x.ravel(), kind))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
