"""The entries of vectors, in whichever form a table has them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def entries(vectors: DataFrame) -> DataFrame:
    """``row_id``, ``t`` (places) and ``w`` (values) from sparse or dense ``features``, or from ``t`` and ``w`` themselves; a row may have none."""
    if "features" not in vectors.columns:
        return vectors.select("row_id", "t", "w")
    v = F.unwrap_udt("features")
    # a dense vector names no places
    return vectors.select("row_id", F.coalesce(v["indices"], F.sequence(F.lit(0), F.size(v["values"]) - 1)).alias("t"), v["values"].alias("w"))


def parts(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batch``, whose second column is of lists, some at a time: of at most ``most`` entries together, or one row."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < len(ends):
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(low, high - low)
        low = high
