"""Connected components of an edge table, without a task or a key that a large component would fill.

Each round turns parts of a bounded number of edges into stars, one part for a task, and then takes a large-star and a small-star step between
the parts (Kiveris and others 2014), until nothing moves. If one part holds all edges, its stars are the components. State is written to the shared
folder in each round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize, release

#: Edges that one task turns into stars at once, about 100 MB, and rows of a batch of results.
EDGES_PER_PART, BATCH_ROWS = 2_000_000, 10_000


def least_nodes(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` nodes the least one that the edges lead to: roots are hooked to the least root across each edge, then paths are halved."""
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return root
        u, v = u[apart], v[apart]
        low, high = np.minimum(a[apart], b[apart]), np.maximum(a[apart], b[apart])
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]


def _contract(edges: DataFrame, parts: int) -> DataFrame:
    """The edges (u, v) of each of ``parts`` parts as stars: every node with the least node that the part's edges lead to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held) if (held := list(batches)) else None
        if t is None or not len(t):
            return
        both = pa.chunked_array([*t.column(0).chunks, *t.column(1).chunks]).combine_chunks()
        coded = both.dictionary_encode()
        order = pc.array_sort_indices(coded.dictionary)
        place = np.empty(len(order), np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        nodes, at = coded.dictionary.take(order), place[coded.indices.to_numpy()]
        root = least_nodes(at[: len(t)], at[len(t) :], len(nodes))
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        for i in range(0, len(moved), BATCH_ROWS):
            part = moved[i : i + BATCH_ROWS]
            yield pa.RecordBatch.from_arrays([nodes.take(pa.array(part)), nodes.take(pa.array(root[part]))], ["u", "v"])

    return edges.select("u", "v").repartition(parts).mapInArrow(run, edges.select("u", "v").schema)


def connected(edges: DataFrame, per_part: int = EDGES_PER_PART) -> DataFrame:
    """``node`` and ``root``, the least node of its component, for each node in ``edges`` (a, b); every node but the roots themselves has a row."""
    e = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        parts = max(1, -(-e.count() // per_part))
        before, e = e, materialize(_contract(e, parts), "edges")
        release(before)
        if parts == 1:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        # large star: neighbours above a node are joined to its least neighbour
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its neighbours below are joined to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        before, e = e, materialize(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        release(before)
        before, state = state, tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
        if state == before:  # a digest of all edges has stayed the same
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``row_id``, ``root`` (the least ``row_id`` of the component) for ``nodes`` (row_id) and undirected ``edges`` (a, b)."""
    roots = connected(edges)
    return nodes.join(roots, nodes["row_id"] == roots["node"], "left").select("row_id", F.coalesce("root", "row_id").alias("root"))
