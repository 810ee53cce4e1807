"""A Merkle manifest of a dataset: a tree over the rows of each source and a tree over the sources, with a proof for each row.

Rows become digests (leaves) once; what is shuffled from then on are digests. Leaves are sorted over ranges and numbered within their source, and blocks of 3 ** 6
of them are reduced to one digest each by the executors, round after round if there are many, until at most ``top_most`` nodes are left, whatever the sizes and the number of the
sources. The driver builds the tree above those and broadcasts what a path still needs from each of them to the root; executors put it behind the path inside each block, and fold each row's leaf along the
whole path. Nothing but these ``top_most`` nodes reaches the driver, and a task holds a few blocks.

Null and text fields differ from empty ones and from the text "-" by the leaf's format; equal rows have equal leaves and a place each; rows of one identifier are in the order of their leaves, those without
an identifier come first; rows without a source are a source of their own, the first. An empty table has no rows and no root. Further columns never reach the operator.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.labels import numbered
from .common import map_batches, materialize

#: Children of a node, and levels that a block of ARITY ** LEVELS nodes is reduced by in one round.
ARITY, LEVELS = 3, 6
#: Nodes of which the driver builds the top; a path above them has some 20 digests, so that what is broadcast stays below 10 MB.
TOP_MOST = 4000
PATH = "array<struct<left:string,right:string>>"


def digest(*texts: str) -> str:
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf_column(fields: Sequence[Column]) -> Column:
    """The digest of a row: for each field ``-`` if it is null, else the number of its UTF-8 bytes, a colon and its value."""
    parts = []
    for f in fields:
        text = f.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def levels_above(digests: list[str], height: int | None = None) -> list[list[str]]:
    """All levels from ``digests`` up: to the single node that is left, or of so many levels more, in which a lone node goes on becoming its digest."""
    out = [digests]
    while len(out[-1]) > 1 if height is None else len(out) <= height:
        last = out[-1]
        out.append([digest(*last[i : i + ARITY]) for i in range(0, len(last), ARITY)])
    return out


def path_of(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    """What stands left and right of a node's ancestors in their runs, level by level up to the last but one."""
    out = []
    for level in levels[:-1]:
        start = at - at % ARITY
        out.append(("".join(level[start:at]), "".join(level[at + 1 : start + ARITY])))
        at //= ARITY
    return out


def _height(total: int, levels: int) -> int | None:
    """Levels of a block: all up to its root if it is its tree's only one, else the same for each of the tree's blocks."""
    return None if total <= ARITY**levels else levels


def _packed(nodes: DataFrame, levels: int, *more: str) -> DataFrame:
    """``g``, ``block``, ``total`` and the block's nodes in order, as an array for each column; ``nodes`` has ``g``, ``pos``, ``total``, ``digest`` and ``more``."""
    cells = F.sort_array(F.collect_list(F.struct("pos", "digest", *more))).alias("m")
    packed = nodes.withColumn("block", F.expr(f"pos div {ARITY**levels}")).groupBy("g", "block", "total").agg(cells)
    return packed.select("g", "block", "total", *(F.col(f"m.{c}").alias(c) for c in ("digest", *more)))


def _reduced(packed: DataFrame, levels: int) -> DataFrame:
    """``g``, ``pos``, ``total`` and ``digest`` of each block's top."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            totals = b.column(2).to_pylist()
            tops = [levels_above(d, _height(t, levels))[-1][0] for d, t in zip(b.column(3).to_pylist(), totals, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([-(-t // ARITY**levels) for t in totals], pa.int64()), pa.array(tops, pa.string())], ["g", "pos", "total", "digest"])

    return map_batches(packed.select("g", "block", "total", "digest"), run, "g string, pos long, total long, digest string")


def _top(nodes: list) -> tuple[str, list[tuple]]:
    """The root, and for each of the driver's nodes (g, pos, subroot, path to the root)."""
    trees: dict[str, list] = {}
    for r in sorted(nodes, key=lambda r: (r.g.encode(), r.pos)):
        trees.setdefault(r.g, []).append(r.digest)
    built = {g: levels_above(d) for g, d in trees.items()}
    over = levels_above([t[-1][0] for t in built.values()])
    rest = {g: path_of(over, i) for i, g in enumerate(built)}
    return over[-1][0], [(r.g, r.pos, built[r.g][-1][0], path_of(built[r.g], r.pos) + rest[r.g]) for r in nodes]


def _paths(nodes: DataFrame, levels: int, top_most: int) -> tuple[str, DataFrame]:
    """The root, and ``g``, ``pos``, ``subroot``, ``path`` for each of ``nodes`` (g, pos, total, digest)."""
    spark = nodes.sparkSession
    if nodes.count() <= top_most:
        root, rows = _top(nodes.collect())
        return root, F.broadcast(spark.createDataFrame(rows, f"g string, pos long, subroot string, path {PATH}"))
    if not nodes.where("total > 1").isEmpty():
        packed = materialize(_packed(nodes, levels), "blocks")
        root, above = _paths(materialize(_reduced(packed, levels), "nodes"), levels, top_most)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for g, at, total, digests, subroot, path in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    tree, rest = levels_above(digests, _height(total, levels)), [(p["left"], p["right"]) for p in path]
                    places = range(len(digests))
                    cells = [[g] * len(places), [at * ARITY**levels + i for i in places], [subroot] * len(places), [[{"left": x, "right": y} for x, y in path_of(tree, i) + rest] for i in places]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.string(), pa.int64(), pa.string(), _PATH), strict=True)], ["g", "pos", "subroot", "path"])

        joined = packed.join(above.withColumnRenamed("pos", "block"), ["g", "block"]).select("g", "block", "total", "digest", "subroot", "path")
        return root, materialize(map_batches(joined, run, f"g string, pos long, subroot string, path {PATH}"), "paths")
    # each tree is down to its root, and there are many: their roots are the leaves of one tree
    subroots = numbered(nodes.select("g", F.col("digest").alias("subroot")), "g", "at").withColumn("at", F.col("at").cast("long"))
    root, above = _paths(subroots.select(F.lit("").alias("g"), F.col("at").alias("pos"), F.lit(subroots.count()).alias("total"), F.col("subroot").alias("digest")), levels, top_most)
    rest = above.select(F.col("pos").alias("at"), "path")
    return root, subroots.join(rest, "at").select("g", F.lit(0).cast("long").alias("pos"), "subroot", "path")


_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def merkle_manifest(
    docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", source_col: str = "source",
    found: dict[str, Column] | None = None, levels: int = LEVELS, top_most: int = TOP_MOST,
) -> DataFrame:
    """A row for each row of ``docs``: ``id_col``, ``source``, ``leaf``, ``subroot``, ``root``, ``proof`` (what stands left and right, level by level), ``folded_root`` and ``verified``.

    ``found`` gives other values for some fields, as a check of the rows may find them later: the leaf of those is what is folded along the proof, and ``verified`` says
    whether that leads to the root. Without it, a row's own leaf is folded.
    """
    cols = {c: F.col(f"`{c}`") for c in fields}
    own, other = leaf_column(list(cols.values())), leaf_column([(found or {}).get(c, v) for c, v in cols.items()])
    # null sorts first, and the order of Spark's strings is that of their bytes
    g = F.coalesce(F.concat(F.lit("s"), F.col(f"`{source_col}`").cast("string")), F.lit(""))
    leaves = materialize(docs.select(F.col(f"`{id_col}`").alias("id"), g.alias("g"), own.alias("digest"), other.alias("now")).withColumn("now", F.expr("nullif(now, digest)")).withColumn("tie", F.monotonically_increasing_id()), "leaves")
    order = ["g", "id", "digest", "tie"]
    placed = materialize(leaves.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie").withColumn("at", F.monotonically_increasing_id()), "ordered")
    # a source's windows have a row for each range that it stands in
    part, tree = F.shiftright("at", 33).alias("part"), Window.partitionBy("g")
    runs = placed.groupBy(part, "g").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    starts = runs.select("part", "g", (F.col("first") - F.sum("n").over(tree.orderBy("part")) + F.col("n")).alias("shift"), F.sum("n").over(tree).alias("total"))
    nodes = placed.withColumn("part", part).join(starts, ["part", "g"]).select("g", (F.col("at") - F.col("shift")).alias("pos"), "total", "digest", "id", "now")
    packed = materialize(_packed(nodes, levels, "id", "now"), "blocks")
    id_type = leaves.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, source string, leaf string, subroot string, root string, proof {PATH}, folded_root string, verified boolean"
    names = [id_col, *(c.split()[0] for c in schema.split(", ")[1:])]
    tops = materialize(_reduced(packed, levels), "nodes")
    if tops.isEmpty():
        return docs.sparkSession.createDataFrame([], schema).toDF(*names)
    root, above = _paths(tops, levels, top_most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, col = b.column(3), {c: b.column(b.schema.get_field_index(c)).to_pylist() for c in ("g", "total", "digest", "now", "subroot", "path")}
            for k, (g, total, digests, now, subroot, path) in enumerate(zip(*col.values(), strict=True)):
                tree, rest = levels_above(digests, _height(total, levels)), [(p["left"], p["right"]) for p in path]
                folded: dict[str, str] = {}  # from the block's top to the root
                paths, ends = [], []
                for i, leaf in enumerate(digests):
                    inner = path_of(tree, i)
                    node = now[i] or leaf
                    for left, right in inner:
                        node = digest(left, node, right)
                    if node not in folded:
                        end = node
                        for left, right in rest:
                            end = digest(left, end, right)
                        folded[node] = end
                    paths.append([{"left": x, "right": y} for x, y in inner + rest])
                    ends.append(folded[node])
                n = len(digests)
                cells = [
                    ids[k].values, pa.array([g[1:] if g else None] * n, pa.string()), pa.array(digests, pa.string()), pa.array([subroot] * n, pa.string()), pa.array([root] * n, pa.string()),
                    pa.array(paths, _PATH), pa.array(ends, pa.string()), pa.array([e == root for e in ends], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(cells, ["id", *names[1:]])

    joined = packed.withColumnRenamed("block", "pos").join(above, ["g", "pos"]).select("g", "pos", "total", "id", "digest", "now", "subroot", "path")
    return map_batches(joined, run, schema).toDF(*names)


def proof_digest(proof: Column) -> Column:
    """The digest of a proof's nodes, level by level from left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda p: F.concat(p["left"], p["right"])), ""), 256)
