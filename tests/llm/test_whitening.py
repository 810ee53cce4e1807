"""Whitening against numpy's own eigenvectors and Python's own integers, and on odd tables."""

import math

import numpy as np
import pytest

pytest.importorskip("textloom.llm")
from textloom.llm import whitening  # noqa: E402

SCHEMA = "vec_id long, embedding array<float>, d int, x string, whitened double"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "", 0.0) for i, v in rows], SCHEMA).repartition(3)


def brute(rows):
    """n, deviations by position, eigenvalues and whitened rows."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in rows]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * c - t) ** 2 for c, t in zip(r, s, strict=True)) for r in x]
    y = np.array(x, float) - np.array(s) / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1], axes[:, ::-1]
    return n, deviation, values, y @ axes / np.sqrt(np.maximum(values, 1e-300))


def check(got, rows, k):
    n, deviation, values, white = brute(rows)
    cells = {}
    for r in got:
        cells.setdefault(r.component, []).append(r)
    assert sorted(cells) == list(range(1, k + 1))
    for c, part in cells.items():
        assert len(part) == n and {r.n for r in part} == {n}
        assert all(abs(r.explained - values[c - 1] / values.sum()) <= 1e-10 for r in part)
        assert len({r.identity_error for r in part}) == 1 and part[0].identity_error < 1e-9
        # rows that share an identifier are told apart by their values
        key = lambda p: (p[0] is None, p[0] or 0, p[1], abs(p[2]))
        have = sorted(((r.vec_id, int(r.deviation), r.whitened) for r in part), key=key)
        want = sorted(((i, d, w) for (i, _), d, w in zip(rows, deviation, white[:, c - 1], strict=True)), key=key)
        assert [h[:2] for h in have] == [w[:2] for w in want]
        a, b = np.array([h[2] for h in have]), np.array([w[2] for w in want])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8


def test_against_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(i if i % 50 else None, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(300, 12)) * np.arange(1, 13))]
    rows += [(7, rows[7][1]), (7, rows[8][1])]  # a repeated row and a repeated identifier
    odd = [(900, None), (901, [1.0, None] + [0.0] * 10), (902, [float("nan")] + [0.0] * 11), (903, [float("inf")] + [0.0] * 11), (None, None)]
    got = whitening.whiten(frame(spark, rows + odd)).collect()
    check(got, rows, 8)
    check(whitening.whiten(frame(spark, rows), block=2).collect(), rows, 8)
    few = [(i, v[:3]) for i, v in rows]  # fewer dimensions than components
    check(whitening.whiten(frame(spark, few)).collect(), few, 3)


def test_odd_tables(spark):
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(frame(spark, [])).columns == names
    for rows in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(k, [1.0, 2.0]) for k in range(5)]):
        assert whitening.whiten(frame(spark, rows)).count() == 0, rows
    flat = [(k, [float(k), 2.0 * k, 5.0]) for k in range(9)]  # one direction of variance
    check(whitening.whiten(frame(spark, flat)).collect(), flat, 1)
    with pytest.raises(ValueError, match="one length"):
        whitening.whiten(frame(spark, [(1, [1.0]), (2, [1.0, 2.0])]))
    assert whitening.whiten(frame(spark, [(1, [1.0, 3.0]), (1, [2.0, 7.0])]).withColumn("embedding", whitening.F.expr("cast(embedding as array<double>)"))).count() == 2


@pytest.mark.parametrize("values", [[9.0] * 5 + [4.0] * 20 + [1.0] * 35, [5.0, 3.0] + [0.0] * 58, list(np.linspace(1, 2, 60)), [1e6, 1e3, 1.0, 1e-3] + [1e-6] * 56], ids=["equal", "low rank", "near", "steep"])
@pytest.mark.parametrize("block,most", [(1, 60), (3, 20), (16, 512)])
def test_lanczos(values, block, most):
    """Equal values, breakdown, near ones, and restarts from a small basis."""
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.normal(size=(60, 60)))[0]
    a = (q * np.array(values)) @ q.T
    got, axes, _ = whitening.block_lanczos(lambda b: a @ b, 60, 4, block, 1e-11, most)
    assert np.allclose(got, sorted(values, reverse=True)[:4], atol=1e-9 * values[0])
    assert np.allclose(axes.T @ axes, np.eye(4), atol=1e-10) and np.abs(a @ axes - axes * got).max() < 1e-9 * max(values)


def test_exact_deviation():
    rng = np.random.default_rng(2)
    for n, size in ((10, 50), (10**9, 10**6), (10**12, 2**40), (3, 0)):
        off = rng.integers(-size, size + 1, (20, 8))
        rest = [int(v) for v in rng.integers(0, n, 8)]
        assert whitening.exact_deviation(off, n, rest) == [sum((n * int(c) - r) ** 2 for c, r in zip(row, rest, strict=True)) for row in off]
