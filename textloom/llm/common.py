"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import delete_at_exit, materialize, release, shared_dir, spread  # noqa: F401  (for the operators here)

#: Limits of one Arrow batch between the JVM and Python; with the second one a few very long texts make a batch of their own.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the size of Arrow batches so that a worker's memory does not depend on the length of texts."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(str(spark.conf.get(key)))  # sizes may have a unit, such as 64m
        if now <= 0 or now > most:
            spark.conf.set(key, most)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with bounded batches."""
    bounded_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: ASCII white space, and runs of it.
SPACE, SPACE_CLASS = " \t\n\x0b\x0c\r", r"[\x20\x09-\x0D]+"


def spark_words(text: Column) -> Column:
    """Words, which are runs between ASCII white space, as an array; never null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), "")


def row_key(*cols: Column | str) -> Column:
    """A 64-bit digest of several columns that tells null from empty; equal rows share it, which is what joins back to rows need."""
    parts = []
    for c in cols:
        c = F.col(c) if isinstance(c, str) else c
        parts += [c.isNull(), c]
    return F.xxhash64(*parts)


def quote_columns(df: DataFrame, *names: str) -> list[Column]:
    """The named columns alone, so that further or clashing ones in a caller's table never reach an operator."""
    return [df[f"`{n}`"].alias(n) for n in names]


#: Salts over which a hot key is dealt, and how many keys can be hot: each holds a thousandth of the rows or more.
SALTS, MOST_HOT = 16, 1000


def salt_of(*cols: Column | str) -> Column:
    return F.pmod(F.xxhash64(F.lit("salt"), *cols), F.lit(SALTS)).cast("int")


def salted(few: DataFrame) -> DataFrame:
    """Each row once for each ``salt``, for a join to a side whose keys may be hot."""
    return few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def hot_keys(counts: DataFrame, key: str, n: str, total: int) -> list:
    """The keys that stand in a thousandth of ``total`` rows or more, from their counts; there are ``MOST_HOT`` of them at most."""
    return [r[0] for r in counts.where(F.col(n) * MOST_HOT >= total).select(key).take(MOST_HOT)]


def join_hot(rows: DataFrame, few: DataFrame, key: str, hot: list, by: list[str]) -> DataFrame:
    """``rows`` left joined to ``few``, which has a key once; rows of ``hot`` keys are dealt over salts by the columns in ``by``, and only their partners are repeated."""
    is_hot = F.col(key).isin(hot) if hot else F.lit(False)
    few = few.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    # rows without a key have no partner: they are dealt out as well
    rows = rows.withColumn("_salt", F.when(is_hot | F.col(key).isNull(), salt_of(*by)).otherwise(F.lit(0)))
    return rows.join(few, [key, "_salt"], "left").drop("_salt")
