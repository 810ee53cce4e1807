"""Whitening of embeddings along their principal components, found by block Lanczos iteration without a covariance matrix.

Vectors are turned into integers once and written. A pass multiplies a block of directions by the covariance: each task adds up ``yᵀ(yB)`` over its centred rows ``y``,
and Spark sums these few numbers. The driver holds the basis alone (dimensions x ``most_basis`` numbers at most), makes each new block orthogonal to all of it
twice, and stops once the residuals of the wanted components are at rounding. Directions that break down, because the space they span is closed, are replaced by
random ones outside the basis; a basis at its limit is restarted from its best directions. The trace that explained shares refer to comes from the rows' exact
deviations.

Rows whose vector is null or holds null, NaN or infinite entries are left out; all others take part, rows with equal or null identifiers each by itself. Vectors
of no entries, or all equal, have no components and so give no rows, like an empty table. Vectors of several lengths are an error, and so are entries of 2 ** 38 or more in size.
A component without variance (at most 1e-12 of the first one's) can't be scaled to one and is left out. Further columns of the table never reach the operator.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize, quote_columns

#: An entry c counts as floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Residuals, as a share of the largest eigenvalue, at which a component counts as found; components below FLAT of it have no variance.
TOLERANCE, FLAT = 1e-13, 1e-12
MOST_BASIS, MOST_PASSES = 512, 200
_LARGEST = float(1 << 48)


def integer_rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id``, ``d`` and ``x``, the vector's integers of eight bytes each, for the rows whose entries are all finite."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            there = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
            lengths = lists.drop_null().value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            values = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null entry becomes NaN
            finite = np.isfinite(values)
            odd = np.concatenate([[0], np.cumsum(~finite)])
            ends = np.cumsum(lengths)
            good = odd[ends] == odd[ends - lengths]
            kept = values[np.repeat(good, lengths)]
            if len(kept) and np.abs(kept).max() * SCALE >= _LARGEST:
                raise ValueError(f"entries must be below {_LARGEST / SCALE:.0f} in size")
            x = np.floor(SCALE * kept).astype(np.int64) + SHIFT
            d = lengths[good]
            offsets = np.concatenate([[0], np.cumsum(8 * d)]).astype(np.int32)
            cells = pa.Array.from_buffers(pa.binary(), len(d), [None, pa.py_buffer(offsets), pa.py_buffer(x)])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(there[good])), pa.array(d.astype(np.int32)), cells], ["id", "d", "x"])

    rows = vectors.select(*quote_columns(vectors, id_col, vector_col)).toDF("id", "vector")
    return map_batches(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, d int, x binary")


def _matrix(cells: pa.Array, d: int) -> np.ndarray:
    """The rows of a batch, as they lie in its one buffer."""
    start = np.frombuffer(cells.buffers()[1], np.int32, len(cells) + 1, 4 * cells.offset)[0] if len(cells) else 0
    return np.frombuffer(cells.buffers()[2], np.int64, len(cells) * d, start).reshape(-1, d) if len(cells) else np.empty((0, d), np.int64)


def _summed(rows: DataFrame, start: Callable[[], np.ndarray], add: Callable[[np.ndarray, np.ndarray], None], d: int) -> np.ndarray:
    """The sum over all tasks of the array that ``add`` fills from the rows of each batch; an entry is a row of the shuffle, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = start(), False
        for b in batches:
            if len(b):
                add(total, _matrix(b.column(0), d))
                seen = True
        if seen:
            flat = total.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["at", "value"])

    kind = "long" if start().dtype == np.int64 else "double"
    out = start().ravel()
    for r in map_batches(rows.select("x"), run, f"at int, value {kind}").groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[r.at] = r.value
    return out.reshape(start().shape)


def exact_deviation(off: np.ndarray, n: int, rest: list[int]) -> list[int]:
    """For each row of integers ``off`` the sum of ``(n * off - rest) ** 2`` over its entries, as Python integers of any size."""
    size = int(np.abs(off).max(initial=0))
    if size * size * off.shape[1] >= 1 << 62:
        return [int(v) for v in ((n * off.astype(object) - np.array(rest, object)) ** 2).sum(1)]
    # n² Σ off² - 2 n Σ off rest + Σ rest², with rest in pieces that keep each sum below 2 ** 63
    squares = (off * off).sum(1)
    bits = max(1, 62 - (size * off.shape[1]).bit_length())
    pieces, left, shift = [], list(rest), 0
    while any(left):
        low = np.array([v & ((1 << bits) - 1) for v in left], np.int64)
        pieces.append((shift, off @ low))
        left, shift = [v >> bits for v in left], shift + bits
    fixed = sum(v * v for v in rest)
    return [n * n * int(s) - 2 * n * sum(int(p[i]) << shift for shift, p in pieces) + fixed for i, s in enumerate(squares)]


def block_lanczos(
    multiply: Callable[[np.ndarray], np.ndarray], d: int, k: int, block: int | None = None, tolerance: float = TOLERANCE, most_basis: int = MOST_BASIS, seed: int = 7
) -> tuple[np.ndarray, np.ndarray, int]:
    """The ``k`` largest eigenvalues, falling, and their unit eigenvectors of the symmetric operator ``multiply`` on ``d`` dimensions, and the number of its calls.

    A block has at least ``k`` directions, so that a value which stands several times is found as often as it is wanted.
    """
    rng, k = np.random.default_rng(seed), min(k, d)
    block = min(d, max(k, block or 2 * k))
    most_basis = max(most_basis, k + 2 * block)
    basis, image = np.empty((d, 0)), np.empty((d, 0))
    new = np.linalg.qr(rng.normal(size=(d, block)))[0]
    for passes in range(1, MOST_PASSES + 1):
        moved = multiply(new)
        basis, image = np.hstack([basis, new]), np.hstack([image, moved])
        inner = basis.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        scale = max(abs(values[0]), abs(values[-1]), np.finfo(float).tiny)
        wanted = turn[:, :k]
        residual = np.linalg.norm(image @ wanted - basis @ wanted * values[: wanted.shape[1]], axis=0)
        if basis.shape[1] >= d or (basis.shape[1] >= k and (residual <= tolerance * scale).all()):
            return values[:k], np.linalg.qr(basis @ wanted)[0] if basis.shape[1] >= k else basis @ wanted, passes
        for _ in range(2):
            moved = moved - basis @ (basis.T @ moved)
        u, s, _ = np.linalg.svd(moved, full_matrices=False)
        new = u[:, s > 1e-14 * scale]
        if basis.shape[1] + block > most_basis:  # thick restart; ``new`` stays orthogonal to what is kept
            turn = turn[:, : k + block]
            basis, image = basis @ turn, image @ turn
        room = min(block, d - basis.shape[1])
        new = new[:, :room]
        while new.shape[1] < room:  # breakdown: other directions, from outside the basis
            new = np.hstack([new, rng.normal(size=(d, room - new.shape[1]))])
            for _ in range(2):
                new = new - basis @ (basis.T @ new)
            u, s, _ = np.linalg.svd(new, full_matrices=False)
            new = u[:, s > 1e-8 * s[0]]
        for _ in range(2):
            new = np.linalg.qr(new - basis @ (basis.T @ new))[0]
    raise RuntimeError(f"no convergence after {MOST_PASSES} passes; residuals are {residual / scale}")


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, block: int | None = None, most_basis: int = MOST_BASIS) -> DataFrame:
    """A row for each remaining row and component: ``id_col``, ``component`` (from 1, by falling variance), ``n`` (remaining rows), ``deviation`` (decimal), ``whitened``, ``explained``
    and ``identity_error``, which is the largest entry of the whitened rows' covariance less the identity.
    """
    rows = materialize(integer_rows(vectors, id_col, vector_col), "integers")
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    n, shortest, d = rows.agg(F.count("*"), F.min("d"), F.max("d")).first()
    nothing = rows.sparkSession.createDataFrame([], schema).toDF(*names)
    if not n or not d:
        return nothing
    if shortest != d:
        raise ValueError(f"vectors must have one length; there are some of {shortest} and some of {d}")

    def add_halves(total: np.ndarray, x: np.ndarray) -> None:
        total[0] += (x >> 24).sum(0)
        total[1] += (x & 0xFFFFFF).sum(0)

    high, low = _summed(rows, lambda: np.zeros((2, d), np.int64), add_halves, d)
    sums = [(int(h) << 24) + int(v) for h, v in zip(high, low, strict=True)]
    whole, rest = np.array([s // n for s in sums], np.int64), [s % n for s in sums]
    part = np.array([r / n for r in rest])

    def product(directions: np.ndarray) -> np.ndarray:
        def add(total: np.ndarray, x: np.ndarray) -> None:
            y = (x - whole).astype(float) - part
            total += y.T @ (y @ directions)

        return _summed(rows, lambda: np.zeros(directions.shape), add, d) / n

    values, axes, _ = block_lanczos(product, d, components, block, most_basis=most_basis)
    keep = values > FLAT * max(values[0], 0.0)
    values, axes = values[keep], axes[:, keep]
    k = len(values)
    if not k:
        return nothing
    scaled = axes / np.sqrt(values)

    def add_outer(total: np.ndarray, x: np.ndarray) -> None:
        off = x - whole
        w = (off.astype(float) - part) @ scaled
        total[:k] += w.T @ w
        total[k] += w.sum(0)
        total[k + 1, 0] += float(sum(exact_deviation(off, n, rest)))

    last = _summed(rows, lambda: np.zeros((k + 2, k)), add_outer, d)
    mean = last[k] / n
    error = float(np.abs(last[:k] / n - np.outer(mean, mean) - np.eye(k)).max())
    explained = values / (last[k + 1, 0] / float(n) ** 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            off = _matrix(b.column(1), d) - whole
            w = (off.astype(float) - part) @ scaled
            each = pa.array(np.repeat(np.arange(len(b)), k))
            cells = [
                b.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(b))), pa.array(np.full(len(b) * k, n)),
                pa.array(exact_deviation(off, n, rest), pa.decimal128(38, 0)).take(each), pa.array(w.ravel()), pa.array(np.tile(explained, len(b))), pa.array(np.full(len(b) * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(cells, names=["id", *names[1:]])

    return map_batches(rows.select("id", "x"), run, schema).toDF(*names)
