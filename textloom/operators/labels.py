"""Canonical labels: clusters numbered by their least row, noise -1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize


def numbered(values: DataFrame, by: str, name: str) -> DataFrame:
    """``values`` with the int column ``name``: 0 for the least ``by``, and so on; ``by`` must be unique.

    Rows are sorted over ranges and written with their place in their range; what the driver adds is the number of rows in each range, so no task sees all rows.
    """
    placed = materialize(values.repartitionByRange(by).sortWithinPartitions(by).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("part")).count().orderBy("part").collect()  # one row for each range
    before, total = [], 0
    for r in counts:
        before += [F.lit(r.part), F.lit(total)]
        total += r["count"]
    start = F.element_at(F.create_map(*before), part) if before else F.lit(0)
    return placed.withColumn(name, (F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + start).cast("int")).drop("_at")


def canonical(labels: DataFrame, by: str | None = None) -> DataFrame:
    """``row_id``, ``cluster_label`` from ``row_id``, ``label``: 0 for the cluster with the least ``row_id``, and so on.

    ``by`` names a column with the rows that count (null for others).
    """
    least = labels.where("label <> -1").groupBy("label").agg(F.min(by or "row_id").alias("least"))
    number = numbered(least, "least", "n").select("label", "n")
    return labels.join(number, "label", "left").select("row_id", F.coalesce("n", F.lit(-1)).alias("cluster_label"))


def with_labels(docs: DataFrame, labels: DataFrame, row_id: str) -> DataFrame:
    """``docs`` with ``cluster_label``, one that is there already replaced; ``row_id`` must be unique in both."""
    return docs.drop("cluster_label").join(labels.withColumnRenamed("row_id", "_row"), F.col(f"`{row_id}`") == F.col("_row"), "left").drop("_row")


def all_noise(docs: DataFrame) -> DataFrame:
    return docs.withColumn("cluster_label", F.lit(-1))
