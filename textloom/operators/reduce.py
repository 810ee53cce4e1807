"""Projection to two dimensions: PCA, and t-SNE by landmarks; both place all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .entries import entries

#: Rows that exact t-SNE works on, and the perplexity by which the others are placed among them.
TSNE_LANDMARKS, PLACED = 2000, 5.0


def _dense_rows(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Some rows at a time as a dense matrix over the columns that they have, and these columns."""
    lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    terms, weights = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64), batch.column(2).flatten().to_numpy(zero_copy_only=False)
    ends, step = np.cumsum(lengths), 500
    for low in range(0, len(lengths), step):
        size = lengths[low : low + step]
        here = slice(ends[low] - lengths[low], ends[low] - lengths[low] + size.sum())
        columns, at = np.unique(terms[here], return_inverse=True)
        dense = np.zeros((len(size), len(columns)))
        dense[np.repeat(np.arange(len(size)), size), at] = weights[here]
        yield dense, columns


def _covariance_times(rows: DataFrame, block: np.ndarray, mean: np.ndarray, n: int) -> np.ndarray:
    """The rows' covariance times a block of directions, in one pass: tasks add up, and Spark sums as many numbers as the block has."""
    off = mean @ block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rest = np.zeros(block.shape), np.zeros(block.shape[1])
        for b in batches:
            for dense, columns in _dense_rows(b):
                z = dense @ block[columns] - off  # the centred rows' products
                total[columns] += dense.T @ z
                rest += z.sum(0)
        total -= np.outer(mean, rest)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "value"])

    out = np.zeros(block.size)
    for r in rows.mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[r["at"]] = r["value"]
    return out.reshape(block.shape) / n


def principal_axes(vectors: DataFrame, k: int = 2, more: int = 10, seed: int = 7, tolerance: float = 1e-13, most_passes: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The mean, the ``k`` largest variances and their axes (columns, largest loading positive), without a matrix of all terms by all terms.

    Randomised block Krylov iteration (Musco and Musco 2015): ``k + more`` random directions and what passes over the sparse rows make of them span a space, orthonormalised on the driver; its
    best axes are taken once their residuals are ``tolerance`` of the largest variance, or once it is the whole space. The driver holds ``k + more`` numbers for each term and pass. Directions beyond
    the rank get no variance and axes that complete the space.
    """
    rows = entries(vectors)
    n, width = rows.agg(F.count("*"), F.max(F.greatest(F.array_max("t") + 1, F.lit(k)))).first()
    if not n:
        return np.zeros(k), np.zeros(k), np.eye(k)
    width = max(width, k)
    mean = np.zeros(width)
    for r in rows.select(F.explode(F.arrays_zip("t", "w")).alias("x")).groupBy("x.t").agg(F.sum("x.w").alias("w")).collect():
        mean[r.t] = r.w / n
    rng, size = np.random.default_rng(seed), min(width, k + more)
    basis, image = np.empty((width, 0)), np.empty((width, 0))
    new = np.linalg.qr(rng.normal(size=(width, size)))[0]
    for _ in range(most_passes):
        moved = _covariance_times(rows, new, mean, n)
        basis, image = np.hstack([basis, new]), np.hstack([image, moved])
        inner = basis.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
        residual = np.linalg.norm(image @ turn - basis @ turn * values, axis=0)
        if basis.shape[1] >= width or residual.max() <= tolerance * max(values[0], np.finfo(float).tiny):
            break
        for _ in range(2):
            moved = moved - basis @ (basis.T @ moved)
        u, s, _ = np.linalg.svd(moved, full_matrices=False)
        new = u[:, s > 1e-13 * max(values[0], np.finfo(float).tiny)][:, : width - basis.shape[1]]
        if not new.shape[1]:
            break  # the space is closed: random directions of all kinds have led to nothing more
        for _ in range(2):
            new = np.linalg.qr(new - basis @ (basis.T @ new))[0]
    else:
        raise RuntimeError(f"no convergence after {most_passes} passes")
    axes = basis @ turn
    return mean, np.maximum(values, 0), axes * np.where(axes[np.abs(axes).argmax(0), np.arange(k)] >= 0, 1.0, -1.0)


def pca_projection(vectors: DataFrame) -> DataFrame:
    """``row_id``, ``x``, ``y``: centred principal components, the largest loading of each positive. Vectors stay sparse."""
    mean, _, axes = principal_axes(vectors)
    off = mean @ axes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xy = np.vstack([dense @ axes[columns] - off for dense, columns in _dense_rows(b)] or [np.empty((0, 2))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(xy[:, 0]), pa.array(xy[:, 1])], ["row_id", "x", "y"])

    return entries(vectors).mapInArrow(run, "row_id long, x double, y double")


def tsne(x: np.ndarray, perplexity: float = 30.0, seed: int = 42, iterations: int = 300) -> tuple[np.ndarray, list[float]]:
    """Exact t-SNE (van der Maaten and Hinton 2008) and its divergence every 50 steps after the exaggeration."""
    n = len(x)
    if not perplexity < n:
        raise ValueError(f"perplexity {perplexity} must be below the number of rows, {n}")
    sq = (x * x).sum(1)
    d = np.maximum(0, sq[:, None] + sq - 2 * x @ x.T)
    off = ~np.eye(n, dtype=bool)
    lo, hi, beta = np.full(n, 0.0), np.full(n, np.inf), np.ones(n)
    for _ in range(60):  # each row's precision by bisection of its entropy
        p = np.exp(-d * beta[:, None]) * off
        s = np.maximum(p.sum(1), 1e-300)
        entropy = np.log(s) + beta * (d * p).sum(1) / s
        high = entropy > np.log(perplexity)
        lo, hi = np.where(high, beta, lo), np.where(high, hi, beta)
        beta = np.where(np.isinf(hi), beta * 2, (lo + hi) / 2)
    p = np.exp(-d * beta[:, None]) * off
    p = p / np.maximum(p.sum(1, keepdims=True), 1e-300)
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    rng = np.random.default_rng(seed)
    y, move, gain, costs = rng.normal(0, 1e-4, (n, 2)), np.zeros((n, 2)), np.ones((n, 2)), []
    early = min(100, iterations // 3)
    for step in range(iterations):
        ys = (y * y).sum(1)
        q0 = off / (1 + np.maximum(0, ys[:, None] + ys - 2 * y @ y.T))
        q = np.maximum(q0 / q0.sum(), 1e-12)
        w = (p * (12 if step < early else 1) - q) * q0
        g = 4 * (w.sum(1)[:, None] * y - w @ y)
        gain = np.maximum(np.where(np.sign(g) != np.sign(move), gain + 0.2, gain * 0.8), 0.01)
        move = (0.5 if step < early else 0.8) * move - max(50.0, n / 48) * gain * g
        y = y + move - (y + move).mean(0)
        if step >= early and (step - early) % 50 == 0:
            costs.append(float((p * np.log(p / q))[off].sum()))
    return y, costs


def near_weights(d: np.ndarray, perplexity: float) -> np.ndarray:
    """For each row of squared distances weights that sum to 1, Gaussian, with the precision that gives them this perplexity (or all there is)."""
    aim = np.log(min(perplexity, max(1.0, d.shape[1] - 1e-9)))
    d = d - d.min(1, keepdims=True)
    lo, hi, beta = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
    for _ in range(60):
        p = np.exp(-d * beta[:, None])
        total = p.sum(1)
        high = np.log(total) + beta * (d * p).sum(1) / total > aim
        lo, hi = np.where(high, beta, lo), np.where(high, hi, beta)
        beta = np.where(np.isinf(hi), beta * 2, (lo + hi) / 2)
    p = np.exp(-d * np.minimum(beta, 1e12)[:, None])
    return p / p.sum(1, keepdims=True)


def tsne_projection(vectors: DataFrame, perplexity: float = 30.0, seed: int = 42, iterations: int = 300, landmarks: int = TSNE_LANDMARKS) -> DataFrame:
    """``row_id``, ``x``, ``y`` of every row: exact t-SNE of ``landmarks`` rows (all, if there are no more), by the hash of the row, and the others among them.

    Any other row stands at the mean of the landmarks, weighted by nearness in the vectors' space with a perplexity of ``PLACED``. One task works on the landmarks, whose number is a parameter; the
    rest is one pass in which each task holds its rows against them.
    """
    n = vectors.count()
    if not perplexity < n:
        raise ValueError(f"perplexity {perplexity} must be below the number of rows, {n}")
    if not perplexity < landmarks:
        raise ValueError(f"perplexity {perplexity} must be below the number of landmarks, {landmarks}")
    rows = entries(vectors)
    chosen = materialize(rows.orderBy(F.xxhash64("row_id"), "row_id").limit(landmarks), "landmarks")

    def run(group: pa.Table) -> pa.Table:
        t = group.sort_by("row_id").combine_chunks()
        y, _ = tsne(_dense_all(t), perplexity, seed, iterations)
        return pa.table({"row_id": t.column("row_id"), "x": y[:, 0], "y": y[:, 1]})

    at = materialize(chosen.groupBy(F.lit(0).alias("_g")).applyInArrow(run, "row_id long, x double, y double"), "places")
    if n <= landmarks:
        return at
    known = chosen.join(at, "row_id").orderBy("row_id").toArrow().combine_chunks()  # no more rows than landmarks
    ids, places = known.column("row_id").to_numpy(), np.stack([known.column("x").to_numpy(), known.column("y").to_numpy()], 1)
    width = 1 + max(pc.max(known.column("t").combine_chunks().flatten()).as_py() or 0, 0)
    marks = _dense_all(known, width)
    square = (marks * marks).sum(1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for dense, columns in _dense_rows(b):
                shared = columns < width
                d = (dense * dense).sum(1)[:, None] + square - 2 * (dense[:, shared] @ marks[:, columns[shared]].T)
                found.append(near_weights(np.maximum(0, d), PLACED) @ places)
            xy = np.vstack(found or [np.empty((0, 2))])
            here = b.column(0).to_numpy()
            own = np.minimum(np.searchsorted(ids, here), len(ids) - 1)
            xy = np.where((ids[own] == here)[:, None], places[own], xy)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(xy[:, 0]), pa.array(xy[:, 1])], ["row_id", "x", "y"])

    return rows.mapInArrow(place, "row_id long, x double, y double")


def _dense_all(t: pa.Table, width: int | None = None) -> np.ndarray:
    """All rows of a table of entries as one matrix."""
    lists = t.column("t").combine_chunks()
    terms, weights = lists.flatten().to_numpy(zero_copy_only=False), t.column("w").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(t), width or int(terms.max(initial=0)) + 1))
    out[np.repeat(np.arange(len(t)), lists.value_lengths().to_numpy(zero_copy_only=False)), terms] = weights
    return out


def project(vectors: DataFrame, method: str = "pca", perplexity: float = 30.0, seed: int = 42, landmarks: int = TSNE_LANDMARKS) -> DataFrame:
    if method == "pca":
        return pca_projection(vectors)
    if method == "tsne":
        return tsne_projection(vectors, perplexity, seed, landmarks=landmarks)
    raise ValueError(f"no projection is called {method!r}: there are pca and tsne")


def embedding_frame(projected: DataFrame, labels: DataFrame) -> DataFrame:
    """``row_id``, ``x``, ``y``, ``label``: what a scatter plot needs."""
    return projected.join(labels, "row_id").select("row_id", "x", "y", F.col("cluster_label").alias("label"))
