"""Near-duplicate groups by MinHash in an LSH forest.

1. Documents become sets of hashed word shingles; equal sets are one class from then on, however many documents have them.
2. Each class has a MinHash signature, cut into ``TREES`` orders of ``DEPTH`` values. All classes are sorted by each order, and the first candidates of a
   class are its neighbours there with the longest common prefixes: ``NEIGHBOURS`` before it, at least ``LEAST_DEPTH`` values in common.
3. In ``BEST_ROUNDS`` rounds each class is verified against its best candidate in another group on full sets. That joins most of each group with at most
   one pair for each class and round; it only saves work, since nothing that it leaves out is taken for settled.
4. A region of a tree is a run of classes with the first ``LEAST_DEPTH`` values in common, whatever its size. In each run that still has different groups, the
   classes are found that have a candidate in another group there: one whose signature agrees in a share of ``LEAST_ESTIMATE`` or more.
5. Runs that share such classes are one region. Its classes, with their full sets, are joined exactly: rarest shingles first, so that a pair is only looked at
   if it has a rare shingle in common not too far back in either order; the depth of that prefix adapts to what is rare in the region. Regions beyond a bound are
   read in cells of two bounded parts; rows of the largest group are never held against one another.
6. Groups are connected by turning parts of bounded size into stars and by alternating large-star and small-star steps between the parts.

A link may be missed only by chance of the signatures: for a similarity of exactly 0.75 if no order has the prefix in common, (1 - 0.75 ** 2) ** 12 or 1 in 20000, or if
fewer than 36 of 72 values agree, 2 in a million; less for closer texts or those that are linked in more than one way. There is no cap on candidates or
partners, and borders of partitions play no part in steps 4 and 5. Links that are reported are exact.

Hot groups: equal sets are pre-aggregated; near copies differ in their signatures' order or tie-break, so range partitioning deals them out; joins on labels and on
classes are salted. In a region of many different groups that are all nearly similar enough, step 4 ends for a class with its first candidate and step 5
depends on how rare the differences are; only the copies of rows that cells need grow with the square of such a region's size over ``CELL_SHINGLES``.
Nothing about all documents reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected
from .bloom import Bloom, filter_of
from .common import hot_keys, join_hot, map_batches, materialize, mix, release, salt_of, salted

SHINGLE, PERCENT = 5, 75
TREES, DEPTH, LEAST_DEPTH, NEIGHBOURS = 12, 6, 2, 16
#: Candidates whose signatures agree in less than this share are left out: five standard deviations below the similarity asked for.
LEAST_ESTIMATE = 0.5
MEMO_ENTRIES = 500_000
#: Rounds of best candidates before all are taken; they only save work, what they leave is taken afterwards.
BEST_ROUNDS = 2
#: What one part holds: rows of a run, or shingles of a region's sets (8 bytes each); two parts make a cell, which one task reads. Pairs of entries looked at together.
RUN_ROWS, CELL_SHINGLES, CELL_PAIRS = 4096, 1 << 20, 1 << 20

_rng = np.random.default_rng(20240501)
MULTIPLY, ADD = (_rng.integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) << np.uint64(1)) | np.uint64(1), _rng.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)
PLACE = (_rng.integers(1, 1 << 63, SHINGLE * 8, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
del _rng


class Shingler:
    """Sets of hashed shingles of whole texts; word hashes are kept in a bounded memo."""

    def __init__(self, size: int = SHINGLE):
        self.size, self.memo = size, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode().lower().split() if text else []  # both work on ASCII letters and white space alone
        if not words:
            return np.zeros(0, np.uint64)
        memo = self.memo
        try:
            hashes = [memo[w] for w in words]
        except KeyError:
            if len(memo) > MEMO_ENTRIES:
                memo.clear()
            memo.update((w, xxhash.xxh64_intdigest(w)) for w in set(words) if w not in memo)
            hashes = [memo[w] for w in words]
        h = np.array(hashes, np.uint64)
        k = min(self.size, len(h))
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            out = mix(out) + h[i : len(h) - k + 1 + i] * PLACE[i]
        return np.unique(mix(out))


def signature(shingles: np.ndarray) -> np.ndarray:
    """``TREES * DEPTH`` MinHash values of 16 bits."""
    least = np.full(TREES * DEPTH, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):
        np.minimum(least, (shingles[i : i + 2048, None] * MULTIPLY + ADD).min(0), out=least)
    return (mix(least) >> np.uint64(48)).astype(np.uint16)


def class_of(shingles: np.ndarray) -> bytes | None:
    """A digest of a set; None if it is empty."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def same_enough(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def neighbours(orders: np.ndarray, sketches: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, earlier row, estimate) of candidates in rows sorted by order, shift by shift; ``orders`` has the tree and its values."""
    common = (orders[1:] == orders[:-1])[:, : LEAST_DEPTH + 1].all(1) if len(orders) else np.zeros(0, bool)  # prefix long enough with the row before
    rows = np.flatnonzero(common) + 1
    for shift in range(1, NEIGHBOURS + 1):
        if shift > 1:  # in sorted rows, two have the prefix in common if all between them do
            rows = rows[rows >= shift]
            rows = rows[common[rows - shift]]
        if not len(rows):
            return
        estimate = np.concatenate([(sketches[r] == sketches[r - shift]).mean(1) for r in np.array_split(rows, len(rows) // 4096 + 1)])
        ok = estimate >= least
        yield rows[ok], rows[ok] - shift, estimate[ok]


def _sorted_orders(classes: DataFrame) -> DataFrame:
    """Classes by tree and order: ``class``, ``label``, ``place`` (the tree and its values), ``sketch``; range-partitioned and sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint16).reshape(-1, TREES, DEPTH)
            n = len(sig)
            sketch = pa.array([x.tobytes() for x in sig.reshape(n, -1).astype(np.uint8)], pa.binary())
            for t in range(TREES):
                place = [bytes([t]) + x.tobytes() for x in sig[:, t].astype(">u2")]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(place, pa.binary()), sketch], ["class", "label", "place", "sketch"])

    out = map_batches(classes.select("class", "label", "sig"), run, "class binary, label binary, place binary, sketch binary")
    return out.repartitionByRange("place", "class").sortWithinPartitions("place", "class")


def _best(classes: DataFrame, least: float) -> DataFrame:
    """The best candidate pair (row, a, b, la, lb, estimate) of each class among its neighbours with another label; ``la`` and ``lb`` are the labels, ``row`` is the later one in the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None  # the last rows of the batch before
        for b in batches:
            t = pa.table({n: b.column(n) for n in b.schema.names})
            old = 0 if kept is None else len(kept)
            if old:
                t = pa.concat_tables([kept, t]).combine_chunks()
            cls, lab = (t.column(c).to_pylist() for c in ("class", "label"))
            orders = np.frombuffer(b"".join(t.column("place").to_pylist()), np.uint8).reshape(len(cls), -1)
            orders = np.column_stack([orders[:, 0].astype(np.uint16), orders[:, 1:].copy().view(">u2").astype(np.uint16)])
            sketches = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(cls), -1)
            best: dict[int, tuple[float, int]] = {}
            for rows, before, estimate in neighbours(orders, sketches, least):
                for i, j, e in zip(rows.tolist(), before.tolist(), estimate.tolist(), strict=True):
                    if i >= old and lab[i] != lab[j] and e > best.get(i, (0.0, 0))[0]:
                        best[i] = e, j
            kept = t.slice(max(0, len(cls) - NEIGHBOURS))
            found = [(i, *((i, j) if cls[i] < cls[j] else (j, i)), e) for i, (e, j) in best.items()]
            columns = [[cls[r] for r, *_ in found], [cls[i] for _, i, _, _ in found], [cls[j] for _, _, j, _ in found], [lab[i] for _, i, _, _ in found], [lab[j] for _, _, j, _ in found]]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.binary()) for c in columns), pa.array([e for *_, e in found], pa.float64())], ["row", "a", "b", "la", "lb", "estimate"])

    return map_batches(_sorted_orders(classes), run, "row binary, a binary, b binary, la binary, lb binary, estimate double")


def _cells(rows: DataFrame, key: str, weight: str, most: int) -> DataFrame:
    """``rows`` of the keys that have more than one label, dealt into cells of bounded weight: with ``part``, ``parts`` and ``cell`` of each copy of a row.

    Only rows with different labels have to meet. A key of at most ``most`` weight is one cell. Of others, the rows of the label with the most weight are dealt
    into parts of their own, which never meet each other: so a key with one large group and a few other rows is read about once. The parts of the other rows meet all.
    """
    each = rows.groupBy(key, "label").agg(F.sum(weight).alias("w"))
    keys = each.groupBy(key).agg(F.max(F.struct("w", "label")).alias("top"), F.sum("w").alias("w"), F.count("*").alias("labels")).where("labels > 1")
    small = F.col("w") <= most
    keys = keys.select(key, F.when(~small, F.col("top.label")).alias("top"), F.when(small, F.lit(1)).otherwise(F.ceil((F.col("w") - F.col("top.w")) / most)).cast("long").alias("others"), F.when(small, F.lit(0)).otherwise(F.ceil(F.col("top.w") / most)).cast("long").alias("tops"))
    at = F.pmod(F.xxhash64("class"), F.when(F.col("is_top"), F.col("tops")).otherwise(F.col("others")))
    out = rows.withColumn("salt", salt_of("class")).join(salted(keys), [key, "salt"]).drop("salt").withColumn("is_top", F.coalesce(F.col("label") == F.col("top"), F.lit(False))).withColumn("part", F.when(F.col("is_top"), F.col("others") + at).otherwise(at)).withColumn("parts", F.col("others") + F.col("tops"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("is_top"), F.col("others")).otherwise(F.col("parts")) - 1)))
    out = out.withColumn("cell", F.least("part", "other") * F.col("parts") + F.greatest("part", "other")).drop("top", "others", "tops", "is_top", "other", "parts")
    return out.repartition(key, "cell").sortWithinPartitions(key, "cell", "class")


def whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole cells, from batches sorted by their first two columns: a cell may lie in several batches."""
    waiting: list[pa.Table] = []  # rows of the last cell so far
    last = None
    for b in batches:
        if not len(b):
            continue
        t = pa.Table.from_batches([b])
        keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        cut = next((i for i in range(len(keys) - 1, -1, -1) if keys[i] != keys[-1]), -1) + 1  # where the batch's last cell begins
        if cut or keys[0] != last:
            done = [*waiting, t.slice(0, cut)]
            if sum(map(len, done)):
                yield pa.concat_tables(done).combine_chunks()
            waiting = []
        waiting.append(t.slice(cut))
        last = keys[-1]
    if waiting:
        yield pa.concat_tables(waiting).combine_chunks()


def _codes(t: pa.Table, column: str) -> np.ndarray:
    """Equal values as equal small numbers."""
    return t.column(column).combine_chunks().dictionary_encode().indices.to_numpy()


def _open(classes: DataFrame, least: float, percent: int) -> DataFrame:
    """``run`` and ``class`` of all classes with a candidate of another label in a run, which is all that have the prefix of an order in common."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint16).reshape(-1, TREES, DEPTH)
            sketch = pa.array([x.tobytes() for x in sig.reshape(len(sig), -1).astype(np.uint8)], pa.binary())
            for t in range(TREES):
                place = [bytes([t]) + x.tobytes() for x in sig[:, t, :LEAST_DEPTH]]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(place, pa.binary()), sketch], ["class", "label", "n", "run", "sketch"])

    rows = map_batches(classes.select("class", "label", "sig", "n"), prefixes, "class binary, label binary, n long, run binary, sketch binary").withColumn("one", F.lit(1))
    cells = _cells(rows, "run", "one", RUN_ROWS).select("run", "cell", "class", "label", "n", "part", "sketch")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_cells(batches):
            label, run = _codes(t, "label"), _codes(t, "run")
            cell, n, part = (t.column(c).to_numpy() for c in ("cell", "n", "part"))
            sketches = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(run), -1)
            group = np.concatenate([[0], np.cumsum((run[1:] != run[:-1]) | (cell[1:] != cell[:-1]))])
            start = np.searchsorted(group, group)
            split = np.maximum.reduceat(part, np.unique(start))[group] != np.minimum.reduceat(part, np.unique(start))[group]  # a cell of two parts
            found, shift, later = np.zeros(len(run), bool), 0, np.arange(len(run))
            while len(later := later[later - start[later] > shift]):
                shift += 1
                q = later - shift
                small, large = np.minimum(n[later], n[q]), np.maximum(n[later], n[q])
                # two that are both found already are both open, whatever they are to each other
                r = later[~(found[later] & found[q]) & (label[later] != label[q]) & (~split[later] | (part[later] != part[q])) & (100 * small >= percent * large)]
                for r in np.array_split(r, len(r) // 4096 + 1):
                    r = r[(sketches[r] == sketches[r - shift]).mean(1) >= least]
                    found[r] = found[r - shift] = True
            if found.any():
                yield t.select(["run", "class"]).filter(pa.array(found)).combine_chunks().to_batches()[0]

    return map_batches(cells, compare, "run binary, class binary").distinct()


def exact_links(sets: list[np.ndarray], label: np.ndarray, part: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (i, j) between sets of different labels, enough of them to join all labels that links join; between two parts only, if there are two.

    A set join within the cell: shingles are ordered by rarity, two sets that are similar enough have one of the rarest of each in common (prefix), not too
    far back in either (position), and their sizes are close (length). What passes is verified on the full sets, unless its labels are joined already.
    """
    size = np.array([len(x) for x in sets], np.int64)
    row = np.repeat(np.arange(len(sets)), size)
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    token, count = rank[token], np.sort(count, kind="stable")  # token numbers now ascend with their counts
    order = np.lexsort((token, row))
    token, at = token[order], np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    keep = (count[token] > 1) & (at <= size[row] - (percent * size[row] + 99) // 100)
    token, row, at = token[keep], row[keep], at[keep]
    by = np.argsort(token, kind="stable")
    token, row, at = token[by], row[by], at[by]
    if len(set(part.tolist())) > 1:
        few = part == part.min()
        many = ~few
    else:  # rows of the most common label never meet each other
        few = label != np.bincount(label).argmax()
        many = np.ones(len(sets), bool)
    a, b = few[row], many[row]
    ta, ra, pa_, tb, rb, pb = token[a], row[a], at[a], token[b], row[b], at[b]
    lo, hi = np.searchsorted(tb, ta, "left"), np.searchsorted(tb, ta, "right")
    root = np.arange(label.max() + 1)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    links, tried = [], set()
    ends = np.cumsum(hi - lo)
    begin = 0
    while begin < len(ta):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + CELL_PAIRS, "right")))
        k = hi[begin:end] - lo[begin:end]
        i = np.repeat(np.arange(begin, end), k)
        j = np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k) + lo[i]
        x, y = ra[i], rb[j]
        now = np.array([find(v) for v in range(len(root))])
        ok = (now[label[x]] != now[label[y]]) & ~(few[y] & (x >= y))
        i, j, x, y = i[ok], j[ok], x[ok], y[ok]
        need = -(-percent * (size[x] + size[y]) // (100 + percent))  # what both must have in common
        ok = np.minimum(size[x] - pa_[i], size[y] - pb[j]) >= need
        for p, q in np.unique(np.stack([x[ok], y[ok]], 1), axis=0).tolist():
            u, v = find(label[p]), find(label[q])
            if u != v and (p, q) not in tried:
                tried.add((p, q))
                if same_enough(sets[p], sets[q], percent):
                    links.append((p, q))
                    root[max(u, v)] = min(u, v)
        begin = end
    return links


def _exact(classes: DataFrame, sets: DataFrame, open_: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between labels, from all pairs of classes that runs lead to from one another; none is left out."""
    regions = connected(open_.select(F.col("class").alias("a"), F.col("run").alias("b")))
    rows = sets.join(regions, sets["class"] == regions["node"]).select("class", F.col("root").alias("region"), "set")  # the root is a run, or a class that has no row of its own
    rows = rows.unionByName(sets.join(regions.select("root").distinct(), sets["class"] == F.col("root")).select("class", F.col("class").alias("region"), "set"))
    rows = rows.join(classes.select("class", "label", "n"), "class")
    cells = _cells(rows.select("region", "class", "label", "n", "set"), "region", "n", CELL_SHINGLES).select("region", "cell", "class", "label", "part", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_cells(batches):
            keys = list(zip(_codes(t, "region").tolist(), t.column("cell").to_pylist(), strict=True))
            starts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
            for s, e in zip(starts, [*starts[1:], len(keys)], strict=True):
                cell = t.slice(s, e - s)
                sets_ = [np.frombuffer(x, np.uint64) for x in cell.column("set").to_pylist()]
                labels, parts = cell.column("label").to_pylist(), cell.column("part").to_numpy()
                found = exact_links(sets_, _codes(cell, "label"), parts, percent)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([labels[i] for i, _ in found], pa.binary()), pa.array([labels[j] for _, j in found], pa.binary())], ["a", "b"])

    return map_batches(cells, run, "a binary, b binary")


def _sets(docs: DataFrame, classes: DataFrame, needed: DataFrame, shingle: int) -> DataFrame:
    """``class`` and ``set`` of the ``needed`` classes (and of a few more), each from one document; others are left out by a filter of fixed size before the shuffle."""
    bits = filter_of(needed.select("class").distinct().join(classes.select("class", "doc"), "class").select("doc"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom, make = Bloom(bits), Shingler(shingle)
        for b in batches:
            b = b.filter(pa.array(bloom.has(b.column(0).to_numpy()))) if len(b) else b
            sets = [make(t) for t in b.column(1).to_pylist()]
            # a set names its class itself, so documents whose digests clash do no harm
            yield pa.RecordBatch.from_arrays([pa.array([class_of(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], ["class", "set"])

    near = map_batches(docs.select("doc", "text"), run, "class binary, set binary").where(F.col("class").isNotNull())
    return materialize(near.groupBy("class").agg(F.first("set").alias("set")), "shingles")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the labels ``la`` and ``lb`` of the pairs (a, b) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [same_enough(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.select("a", "b", "la", "lb").join(sets.select(F.col("class").alias("a"), F.col("set").alias("ta")), "a").join(sets.select(F.col("class").alias("b"), F.col("set").alias("tb")), "b")
    return map_batches(both.select(F.col("la").alias("a"), F.col("lb").alias("b"), "ta", "tb"), run, "a binary, b binary")


def _relabel(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``classes`` with labels joined along links between labels."""
    roots = salted(connected(links))  # a large group's label stands in very many rows
    out = classes.withColumn("at", salt_of("class"))
    out = out.join(roots, (out["label"] == roots["node"]) & (out["at"] == roots["salt"]), "left")
    new = materialize(out.select("class", "doc", "least", "sig", "n", "docs", F.coalesce("root", "label").alias("label")), "classes")
    release(classes, links)
    return new


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``id_col``, ``n_shingles``, ``component_id`` (the least identifier that links lead to) and ``kept``.

    Two documents are linked if 100 * |A & B| >= percent * |A | B| for their sets of distinct word shingles; a document of fewer
    words than a shingle is one shingle; one without words is linked with nothing, not even another such.

    Defined results: null text has no words; a null identifier takes part in links but is never a group's least unless alone; rows that repeat an
    identifier each get a row with the same result if their texts are linked; an empty table gives an empty result; further columns are ignored.
    """
    if not 60 <= percent <= 100:
        raise ValueError("the signatures' orders are laid out for similarities of 60 % and more")
    least_estimate = LEAST_ESTIMATE - (PERCENT - percent) / 100 if percent < PERCENT else LEAST_ESTIMATE
    d = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    keyed = d.select(F.xxhash64(F.col("id").isNull(), "id", "text").alias("doc"), "id", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler(shingle)
        for b in batches:
            rows = [make(t) for t in b.column(2).to_pylist()]
            cls = [class_of(x) for x in rows]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(map(len, rows), pa.int64()), pa.array(cls, pa.binary()), pa.array([signature(x).tobytes() if len(x) else None for x in rows], pa.binary())],
                ["doc", "id", "n_shingles", "class", "sig"])

    rows = materialize(map_batches(keyed, sets, f"doc long, id {kind}, n_shingles long, class binary, sig binary"), "sets")
    classes = rows.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("id").alias("least"), F.min(F.struct(F.col("id").isNull(), "id", "doc")).alias("m"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n"), F.count("*").alias("docs"))
    classes = materialize(classes.select("class", "least", F.col("m.doc").alias("doc"), "sig", "n", "docs", F.col("class").alias("label")), "classes")

    tried, pairs = None, []
    for _ in range(BEST_ROUNDS):
        best = _best(classes, least_estimate).groupBy("row").agg(F.max(F.struct("estimate", "a", "b", "la", "lb")).alias("x")).select("x.a", "x.b", "x.la", "x.lb").distinct()
        best = materialize(best if tried is None else best.join(tried, ["a", "b"], "left_anti"), "pairs")
        pairs.append(best)
        if best.isEmpty():
            break
        tried = best.select("a", "b") if tried is None else tried.unionByName(best.select("a", "b"))
        sets = _sets(keyed, classes, best.select(F.explode(F.array("a", "b")).alias("class")), shingle)
        links = materialize(_verify(best, sets, percent), "links")
        release(sets)
        if links.isEmpty():
            break
        classes = _relabel(classes, links)

    release(*pairs)
    open_ = materialize(_open(classes, least_estimate, percent), "runs")
    if not open_.isEmpty():
        sets = _sets(keyed, classes, open_, shingle)
        links = materialize(_exact(classes, sets, open_, percent), "links")
        release(sets, open_)
        if not links.isEmpty():
            classes = _relabel(classes, links)

    groups = classes.groupBy("label").agg(F.min("least").alias("component"), F.count("*").alias("many")).where("many > 1").drop("many")
    named = classes.withColumn("salt", salt_of("class")).join(salted(groups), ["label", "salt"], "left").select("class", "docs", F.coalesce("component", "least").alias("component"))
    # a class that holds a thousandth of all rows or more, and there are a thousand of those at most, is dealt over salts
    hot = [bytes(x) for x in hot_keys(classes, "class", "docs", rows.count())]
    out = join_hot(rows, named.select("class", "component"), "class", hot, ["doc", "n_shingles"]).select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
