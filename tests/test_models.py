"""Seeds and iterations of k-means, axes of PCA, a vocabulary without a limit, placing rows, and saves that are cut."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from textloom import bundle as B
from textloom.operators import kmeans as K
from textloom.operators.dbscan import fit_dbscan
from textloom.operators.reduce import near_weights, pca_projection, principal_axes, tsne_projection
from textloom.operators.vectorize import EmptyVocabularyError, Matrix
from textloom.pipeline import cluster
from textloom.scatter import save_scatter
from textloom.spec import ClusterSpec

TEXTS = ["red apple pie", "red apple tart", "apple pie tart", "blue ocean wave", "blue ocean ship", "ocean wave ship", "", "red apple pie", "lonely words here", None]


def frame(spark, x):
    return spark.createDataFrame([(i, Vectors.dense(v)) for i, v in enumerate(x)], ["row_id", "features"])


def brute_kmeans(x, k, restarts, seed=42, tol=1e-4):
    ids, best = np.arange(len(x)), None
    for r in range(restarts):
        seeds = []
        for step in range(k):
            far = np.round(np.min([((x - x[s]) ** 2).sum(1) for s in seeds], axis=0), 9) if seeds else np.ones(len(x))
            time = np.array([-np.log(u) / f if f > 0 else np.inf for u, f in zip(K.draws(ids, step, r, seed), far, strict=True)])
            if np.isfinite(time).any():
                seeds.append(int(time.argmin()))
        c = x[seeds]
        for _ in range(300):
            near = np.round(((x[:, None] - c) ** 2).sum(2), 9).argmin(1)
            new = np.array([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
            moved, c = np.sqrt(((new - c) ** 2).sum(1)).max(), new
            if moved <= tol:
                break
        d = np.round(((x[:, None] - c) ** 2).sum(2), 9)
        if best is None or round(d.min(1).sum(), 6) < best[0]:
            best = round(d.min(1).sum(), 6), c, d.argmin(1)
    return best


def test_kmeans_against_brute_force(spark):
    x = np.concatenate([np.random.default_rng(1).normal(c, 1.0, (30, 3)) for c in (0, 2, 5)])
    for parts in (5,):
        model, labels = K.kmeans(frame(spark, x).repartition(parts), 4)
        cost, centres, near = brute_kmeans(x, 4, 3)
        assert np.allclose(model.centres, centres) and model.cost == pytest.approx(cost, abs=1e-6)
        first = {}
        assert [r.cluster_label for r in labels.orderBy("row_id").collect()] == [first.setdefault(v, len(first)) for v in near.tolist()]


def test_kmeans_with_fewer_distinct_rows(spark):
    x = np.repeat(np.array([[0.0, 1.0], [1.0, 0.0]]), [5, 4], axis=0)
    model, labels = K.kmeans(frame(spark, x), 4)
    assert len(model.centres) == 2 and model.cost == 0 and [r.cluster_label for r in labels.orderBy("row_id").collect()] == [0] * 5 + [1] * 4
    many = K.fit_kmeans(frame(spark, np.random.default_rng(2).normal(size=(120, 2))), 70, restarts=1, max_iter=1)  # several seeds in a scan
    assert len(many.centres) == 70 and len({tuple(c) for c in many.centres}) == 70


@pytest.mark.parametrize("values", [[5.0, 3.0] + [1.0] * 28, [4.0] + [0.0] * 29, [2.0, 1.99] + [1.5] * 28])
def test_axes_against_svd(spark, values):
    """Clear, degenerate and near variances; more terms than directions."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 30)) * np.sqrt(values) @ np.linalg.qr(rng.normal(size=(30, 30)))[0] + 4
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    mean, variance, axes = principal_axes(frame(spark, x), more=3)
    assert np.allclose(mean, x.mean(0)) and np.allclose(variance, s[:2] ** 2 / 200, atol=1e-9) and np.allclose(axes.T @ axes, np.eye(2), atol=1e-9)
    keep = s[:2] > 1e-6
    assert np.allclose(np.abs(axes.T @ vt[:2].T)[keep][:, keep], np.eye(2)[keep][:, keep], atol=1e-6)
    got = np.array([(r.x, r.y) for r in pca_projection(frame(spark, x)).orderBy("row_id").collect()])
    assert np.allclose(np.abs(got)[:, keep], np.abs(u[:, :2] * s[:2])[:, keep], atol=1e-6)


def test_vocabulary_without_a_limit(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "row_id long, text string")
    limited, free = Matrix.of(docs, "text", "row_id", 10_000), Matrix.of(docs, "text", "row_id", None)
    rows = lambda m: sorted((r.row_id, r.term, r.term_idx, r.tf, round(r.weight, 9), round(r.unit, 9)) for r in m.long.collect())
    assert rows(limited) == rows(free) and limited.shape() == free.shape()
    vec = {r.row_id: (list(r.t), list(r.w)) for r in free.vectors.collect()}
    assert len(vec) == len(TEXTS) and vec[6] == ([], [])
    for r in limited.vectors.collect():
        assert r.features.indices.tolist() == vec[r.row_id][0] and np.allclose(r.features.values, vec[r.row_id][1])
    with pytest.raises(EmptyVocabularyError):
        Matrix.of(docs.where("row_id = 6"), "text", "row_id", None)
    for algorithm in ("dbscan",):
        spec = {"id_column": "row_id", "algorithm": algorithm, "n_clusters": 3, "eps": 0.7, "min_samples": 2}
        label = lambda s: [r.cluster_label for r in cluster(docs, ClusterSpec(**s)).output().orderBy("row_id").collect()]
        assert label(spec) == label(spec | {"max_features": None})


@pytest.mark.parametrize("features", [2000, None])
def test_placing_rows_by_core_rows(spark, tmp_path, features):
    """The rows of the fit get their own labels, noise and border rows included; a new row between two clusters gets the lower one."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(14)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words, rng.integers(0, 6)))) for i in range(80)], "id long, text string")
    result = cluster(docs, ClusterSpec(id_column="id", algorithm="dbscan", eps=0.35, min_samples=4, max_features=features))
    B.save_bundle(result, str(tmp_path / "b"))
    got = B.load_bundle(spark, str(tmp_path / "b")).assign(docs, "text", "id")
    want = {r.id: (r.cluster_label, r.cluster_name) for r in result.output().collect()}
    assert {r.id: (r.cluster_label, r.cluster_name) for r in got.collect()} == want and len({v for v, _ in want.values()}) > 2


def test_placing_with_a_wide_distance(spark):
    v = frame(spark, np.eye(3))
    for least, label in ((3, 0), (4, -1)):
        model, labels = fit_dbscan(v, 1.2, least)
        assert {r.cluster_label for r in labels.collect()} == {r.cluster_label for r in model.place(v).collect()} == {label}


def test_saves_that_are_cut(spark, tmp_path, monkeypatch):
    """Whatever table a save ends at, readers find the bundle of before, whole; the next save counts and clears up."""
    docs, path = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string"), str(tmp_path / "b")
    with pytest.raises(FileNotFoundError):
        B.load_bundle(spark, path)
    result = cluster(docs, ClusterSpec(id_column="id", n_clusters=2))
    B.save_bundle(result, path)
    names = lambda: {r.cluster_label: r.cluster_name for r in B.load_bundle(spark, path).names.collect()}
    old, new = names(), result.rename({0: "changed"})
    writer = type(docs.write)
    whole = writer.parquet
    for cut in ("vocabulary", "centres", "names", "spec"):

        def broken(self, to, *a, cut=cut, **b):
            whole(self, to, *a, **b)
            if to.endswith(f"/{cut}"):
                raise OSError("the disk is full")

        monkeypatch.setattr(writer, "parquet", broken)
        with pytest.raises(OSError):
            B.save_bundle(new, path)
        monkeypatch.setattr(writer, "parquet", whole)
        assert names() == old
    B.save_bundle(new, path)
    assert names()[0] == "changed" and len(list((tmp_path / "b" / B.VERSIONS).iterdir())) == 2
    B.save_bundle(result, path)
    assert names() == old and len(list((tmp_path / "b" / B.VERSIONS).iterdir())) == 2


def test_legend_names_all_labels(spark, tmp_path):
    points = spark.createDataFrame([(i, float(i % 30), float(i // 30), i) for i in range(300)], "row_id long, x double, y double, label int")
    save_scatter(points, str(tmp_path / "p.svg"), "many")
    text = (tmp_path / "p.svg").read_text()
    assert all(f'font-size="10">{i}</text>' in text for i in range(300))


def test_tsne_places_all_rows(spark):
    """Rows that are no landmarks stand among those of their own group; copies of a landmark stand by it."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.1, (60, 4)) for c in (0, 4, 9)])
    rows = tsne_projection(frame(spark, x), perplexity=8.0, landmarks=45, iterations=150).orderBy("row_id").collect()
    y = np.array([(r.x, r.y) for r in rows])
    assert [r.row_id for r in rows] == list(range(180)) and np.isfinite(y).all()
    centre = np.array([y[i : i + 60].mean(0) for i in (0, 60, 120)])
    assert (((y[:, None] - centre) ** 2).sum(2).argmin(1) == np.repeat(np.arange(3), 60)).all()
    assert tsne_projection(frame(spark, x[:40]), perplexity=8.0, iterations=60).count() == 40
    for bad in ({"perplexity": 180.0}, {"perplexity": 30.0, "landmarks": 20}):
        with pytest.raises(ValueError):
            tsne_projection(frame(spark, x), **bad)
    w = near_weights(rng.random((20, 50)), 5.0)
    assert np.allclose(w.sum(1), 1) and np.allclose(np.exp(-(w * np.log(np.maximum(w, 1e-300))).sum(1)), 5.0, rtol=1e-3)
    assert np.isfinite(near_weights(np.zeros((3, 4)), 5.0)).all() and np.isfinite(near_weights(np.ones((2, 1)), 5.0)).all()
