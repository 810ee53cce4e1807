"""Operators on small frames, with expectations worked out by hand or by brute force."""

import math
from xml.etree import ElementTree

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.stopwords import ENGLISH
from textloom.operators import describe
from textloom.operators.components import components, connected
from textloom.operators.dbscan import cluster_pairs, dbscan
from textloom.operators.kmeans import fit_kmeans, kmeans
from textloom.operators.labels import numbered
from textloom.operators.neighbours import neighbour_pairs
from textloom.operators.reduce import pca_projection, tsne
from textloom.operators.vectorize import EmptyVocabularyError, Matrix, word_statistics
from textloom.operators.ward import cut, ward, ward_merges
from textloom.pipeline import cluster
from textloom.scatter import grid, save_scatter
from textloom.spec import ClusterSpec, derived_path
from textloom.storage import materialize, release, spread

DOCS = [(0, "red apple apple pie"), (1, "red apple tart"), (2, "blue ocean wave"), (3, "blue ocean ship"), (4, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "row_id long, text string")


def test_stop_list():
    assert len(ENGLISH) == len(set(ENGLISH)) == 318


def test_coercion_and_normalisation(spark):
    df = spark.createDataFrame([("  　Ab\tC\x1c\x85 ",), (None,), ("\n\t",)], "text string")
    assert [r[0] for r in df.select(T.preprocess(T.coerce_text(F.col("text")))).collect()] == ["ab\tc", "", ""]
    assert [r[0] for r in df.select(T.is_blank(F.col("text"))).collect()] == [False, True, True]
    assert spark.range(1).select(T.coerce_text(F.lit(5.0))).first()[0] == "5.0"


def test_tokens_keep_accents_and_drop_single_characters(spark):
    df = spark.createDataFrame([("Élan, a b_c 42 x Ñu!",)], "text string")
    assert df.select(T.tokens(F.col("text"))).first()[0] == ["élan", "b_c", "42", "ñu"]


def test_tfidf_by_hand(docs):
    m = Matrix.of(docs, "text", "row_id")
    assert m.shape() == (5, 8)
    idf2, idf1 = math.log(6 / 3) + 1, math.log(6 / 2) + 1
    got = {r.term: r.weight for r in m.long.where("row_id = 0").collect()}
    assert got == pytest.approx({"red": idf2, "apple": 2 * idf2, "pie": idf1})
    assert m.long.where("row_id = 0").agg(F.sum(F.col("unit") ** 2)).first()[0] == pytest.approx(1)
    v = {r.row_id: r.features for r in m.vectors.collect()}
    assert v[4].numNonzeros() == 0 and v[0].norm(2) == pytest.approx(1)
    for r in m.long.collect():
        assert v[r.row_id][r.term_idx] == pytest.approx(r.unit)


def test_vocabulary_ties_go_to_the_first_term(spark):
    m = Matrix.of(spark.createDataFrame([(0, "bb cc dd dd")], "row_id long, text string"), "text", "row_id", 2)
    assert m.model.terms == ("bb", "dd")


def test_empty_vocabulary(spark):
    with pytest.raises(EmptyVocabularyError):
        Matrix.of(spark.createDataFrame([(0, "the and of"), (1, "a")], "row_id long, text string"), "text", "row_id")


def test_blocks_do_not_change_the_pairs(docs):
    m = Matrix.of(docs, "text", "row_id")
    one = sorted(map(tuple, neighbour_pairs(m.vectors, 0.7).collect()))
    assert one == sorted(map(tuple, neighbour_pairs(m.vectors, 0.7, block_rows=1).collect())) == [(0, 1), (2, 3)]


def test_border_goes_to_the_lowest_cluster(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (7, 8), (7, 9), (8, 9), (3, 5), (5, 7)], "a long, b long")
    rows = spark.createDataFrame([(i,) for i in (1, 2, 3, 5, 7, 8, 9, 10)], "row_id long")
    got = {r.row_id: r.cluster_label for r in cluster_pairs(rows, pairs, 4).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 5: 0, 7: 1, 8: 1, 9: 1, 10: -1}


def test_dbscan_edges(docs):
    m = Matrix.of(docs, "text", "row_id")
    assert {r.cluster_label for r in dbscan(m.vectors, 1.0, 5).collect()} == {0}
    assert {r.cluster_label for r in dbscan(m.vectors, 1.5, 6).collect()} == {-1}
    assert {r.row_id: r.cluster_label for r in dbscan(m.vectors, 0.7, 1).collect()} == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2}
    with pytest.raises(ValueError):
        dbscan(m.vectors, 0, 1)


def test_dbscan_against_brute_force(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(12)]
    data = [(i, " ".join(rng.choice(words, rng.integers(1, 6)))) for i in range(60)]
    m = Matrix.of(spark.createDataFrame(data, "row_id long, text string"), "text", "row_id")
    got = {r.row_id: r.cluster_label for r in dbscan(m.vectors, 0.4, 4).collect()}
    x = np.zeros((60, len(m.model.terms)))
    for r in m.long.collect():
        x[r.row_id, r.term_idx] = r.unit
    near = np.maximum(0, np.round(1 - x @ x.T, 12)) <= 0.4
    np.fill_diagonal(near, True)
    core, label, n = near.sum(1) >= 4, np.full(60, -1), 0
    for i in range(60):
        if core[i] and label[i] < 0:
            todo, n = [i], n + 1
            while todo:
                j = todo.pop()
                if label[j] < 0:
                    label[j] = n - 1
                    todo += [k for k in np.flatnonzero(near[j]) if core[k] and label[k] < 0] if core[j] else []
    for i in range(60):
        if not core[i]:
            label[i] = min((label[k] for k in np.flatnonzero(near[i]) if core[k]), default=-1)
    assert got == dict(enumerate(label.tolist()))


def vectors(spark, x):
    return spark.createDataFrame([(i, Vectors.dense(v)) for i, v in enumerate(x.tolist())], ["row_id", "features"])


def test_kmeans_is_a_fixed_point_with_canonical_labels(spark):
    x = np.concatenate([np.random.default_rng(1).normal(c, 0.1, (20, 3)) for c in (0, 3, 6)])
    model, labels = kmeans(vectors(spark, x), 3)
    got = [r.cluster_label for r in labels.orderBy("row_id").collect()]
    assert got == [0] * 20 + [1] * 20 + [2] * 20
    centres = np.array(model.clusterCenters())
    for i, v in enumerate(x):
        assert np.argmin(((centres - v) ** 2).sum(1)) == np.argmin(((centres - x[got.index(got[i])]) ** 2).sum(1))
    with pytest.raises(ValueError):
        fit_kmeans(vectors(spark, x[:2]), 3)


def naive_ward(x, k):
    groups = [[i] for i in range(len(x))]
    while len(groups) > k:
        best = min(((len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j))
        groups[best[1]] += groups.pop(best[2])
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("seed", range(5))
def test_ward_equals_greedy_merging(seed):
    x = np.random.default_rng(seed).normal(size=(40, 3))
    labels = cut(ward_merges(x, np.ones(40)), 40, 5)
    assert {frozenset(np.flatnonzero(labels == v).tolist()) for v in set(labels.tolist())} == naive_ward(x, 5)


def test_ward_in_spark(spark):
    x = np.concatenate([np.random.default_rng(1).normal(c, 0.1, (5, 2)) for c in (0, 5)])
    assert [r.cluster_label for r in ward(vectors(spark, x), 2).orderBy("row_id").collect()] == [0] * 5 + [1] * 5
    with pytest.raises(ValueError):
        ward(vectors(spark, x), 11)


def test_keywords_ties_padding_and_names(spark):
    long = spark.createDataFrame([(0, "bb", 0.5), (0, "aa", 0.5), (1, "zz z", 1.0)], "row_id long, term string, unit double")
    labels = spark.createDataFrame([(0, 0), (1, 1), (2, -1)], "row_id long, cluster_label int")
    vocab = spark.createDataFrame([("aa",), ("bb",), ("cc",), ("zz z",)], "term string")
    k = describe.cluster_keywords(describe.cluster_term_means(long, labels), vocab, labels, 3)
    got = {(r.cluster_label, r["rank"]): (r.term, r.score) for r in k.collect()}
    assert got == {(0, 1): ("aa", 0.5), (0, 2): ("bb", 0.5), (0, 3): ("cc", 0.0), (1, 1): ("zz z", 1.0), (1, 2): ("aa", 0.0), (1, 3): ("bb", 0.0)}
    names = describe.cluster_names(k, 2, "_")
    assert {tuple(r) for r in names.collect()} == {(0, "aa_bb"), (1, "zz_z_aa")}
    assert {tuple(r) for r in describe.apply_names(names, {1: " sea "}).collect()} == {(0, "aa_bb"), (1, "sea")}
    with pytest.raises(ValueError):
        describe.apply_names(names, {1: " "})
    assert {tuple(r) for r in describe.with_names(labels, names).select("row_id", "cluster_name").collect()} == {(0, "aa_bb"), (1, "zz_z_aa"), (2, "")}
    assert {tuple(r) for r in describe.cluster_stats(labels).collect()} == {(-1, 1, 33.3), (0, 1, 33.3), (1, 1, 33.3)}


def test_pca_equals_svd(spark):
    x = np.random.default_rng(2).normal(size=(50, 6)) * [5, 3, 1, 1, 1, 1] + 7
    got = np.array([[r.x, r.y] for r in pca_projection(vectors(spark, x)).orderBy("row_id").collect()])
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(u[:, :2] * s[:2]), atol=1e-6)


def test_tsne_separates_and_improves():
    x = np.concatenate([np.random.default_rng(1).normal(c, 0.1, (15, 4)) for c in (0, 9)])
    y, costs = tsne(x, 5.0, 42, 250)
    assert np.isfinite(y).all() and costs[-1] <= costs[0]
    with pytest.raises(ValueError):
        tsne(x, 30.0)


def test_specification_errors():
    for bad in ({"algorithm": "x"}, {"n_clusters": 0}, {"eps": 0}, {"min_samples": 0}, {"visualize": "umap"}, {"name_top_n": -1}):
        with pytest.raises(ValueError):
            ClusterSpec(**bad)
    assert derived_path("/a.b/data.xlsx", "_clustered.xlsx") == "/a.b/data_clustered.xlsx"


def test_blank_texts_and_missing_column(spark):
    df = spark.createDataFrame([(0, " "), (1, None), (2, "\t\n")], "id long, text string")
    r = cluster(df, ClusterSpec(id_column="id"))
    assert [tuple(x) for x in r.output().orderBy("id").select("cluster_label", "cluster_name").collect()] == [(-1, "")] * 3
    with pytest.raises(ValueError, match="no column is called"):
        cluster(df, ClusterSpec(column="nope"))


def test_counts_of_words_equal_counts_of_rows(spark):
    words = spark.createDataFrame([(0, ["aa", "bb", "aa"]), (1, ["aa"]), (2, [])], "row_id long, words array<string>")
    assert {tuple(r) for r in word_statistics(words).collect()} == {("aa", 3, 2), ("bb", 1, 1)}


def test_components_of_several_parts(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 120)] + [(200, 201), (201, 202), (202, 200)]
    want = {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 120)} | {201: 200, 202: 200}
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    for per_part in (1, 7, 1000):
        got = connected(df, per_part)
        assert {r.node: r.root for r in got.collect()} == want and got.count() == len(want)
    nodes = spark.createDataFrame([(i,) for i in [*range(41), 300]], "row_id long")
    assert {tuple(r) for r in components(nodes, df).collect()} == {(i, 0) for i in range(41)} | {(300, 300)}
    assert components(nodes, df.limit(0)).where("row_id <> root").count() == 0


def test_numbered_over_several_ranges(spark):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "v long").repartition(6)
    assert {tuple(r) for r in numbered(df, "v", "n").collect()} == {(i, i) for i in range(101)}
    assert numbered(df.limit(0), "v", "n").count() == 0


@pytest.mark.parametrize("algorithm", ["kmeans", "dbscan", "agglomerative"])
def test_identifiers_of_any_kind(spark, algorithm):
    """Repeated and null identifiers keep their rows, each with its own label; so do identifiers that are texts, and a column called like the row's number."""
    rows = [("a", "red apple pie", 1), ("a", "blue ocean wave", 2), (None, "red apple tart", 3), (None, "blue ocean ship", 4), ("b", "apple pie tart", 5), ("c", "ocean wave ship", 6)]
    df = spark.createDataFrame(rows, "id string, text string, _row_id int")
    out = cluster(df, ClusterSpec(id_column="id", algorithm=algorithm, n_clusters=2, eps=0.75, min_samples=2)).output().orderBy("_row_id").collect()
    assert [(r.id, r.text, r._row_id) for r in out] == rows
    assert [r.cluster_label for r in out] == [0, 1, 0, 1, 0, 1]


def test_names_without_terms(docs):
    spec = {"column": "text", "n_clusters": 2}
    plain = {r.cluster_label: r.cluster_name for r in cluster(docs, ClusterSpec(**spec)).names.collect()}
    assert set(plain) == {0, 1} and all(", " in v for v in plain.values())
    assert {tuple(r) for r in cluster(docs, ClusterSpec(**spec, top_n=0)).names.collect()} == {(0, "cluster_0"), (1, "cluster_1")}
    assert {tuple(r) for r in cluster(docs, ClusterSpec(**spec, name_top_n=0)).names.collect()} == {(0, ""), (1, "")}


def test_scatter(spark, tmp_path):
    points = spark.createDataFrame([(i, float(i % 10), float(i // 10), i % 3 - 1) for i in range(100)], "row_id long, x double, y double, label int")
    save_scatter(points, str(tmp_path / "p.svg"), "a <b>")
    root = ElementTree.parse(tmp_path / "p.svg").getroot()
    dots = [e for e in root if e.tag.endswith("circle")]
    assert len(dots) == 100 and len({e.get("fill") for e in dots}) == 3 and any(e.text == "a <b>" for e in root)
    save_scatter(points.limit(0), str(tmp_path / "none.svg"), "none")
    assert grid(points.withColumn("x", F.lit(1.0))).count() == 10


def test_pca_of_sparse_vectors(docs):
    m = Matrix.of(docs, "text", "row_id")
    x = np.stack([r.features.toArray() for r in m.vectors.orderBy("row_id").collect()])
    got = np.array([[r.x, r.y] for r in pca_projection(m.vectors).orderBy("row_id").collect()])
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(u[:, :2] * s[:2]), atol=1e-6)


def test_spread(spark):
    small, large = spark.range(100).coalesce(1), spark.range(0, 100, 1, 32)
    cores = spark.sparkContext.defaultParallelism
    assert spread(small).rdd.getNumPartitions() == cores and spread(small).count() == 100
    assert spread(large).rdd.getNumPartitions() == 32


def test_texts_in_even_pieces_stay(spark, tmp_path):
    """A table of as many even pieces as cores isn't shuffled; one whose rows are in one piece is."""
    cores = spark.sparkContext.defaultParallelism
    docs = spark.range(400).select(F.col("id").alias("row_id"), F.concat(F.lit("word number"), F.col("id")).alias("text"))
    shuffles = lambda df: "Exchange" in df._jdf.queryExecution().executedPlan().toString()
    for n, want in ((cores, False), (1, True)):
        docs.repartition(n).write.parquet(f"{tmp_path}/{n}")
        out = spread(spark.read.parquet(f"{tmp_path}/{n}"), 2)
        assert shuffles(out) == want and out.count() == 400
    assert spread(docs.limit(0), 2).count() == 0
    words = Matrix.of(spark.read.parquet(f"{tmp_path}/{cores}"), "text", "row_id").words
    assert words.count() == 400 and all(f.endswith(".zstd.parquet") for f in words.inputFiles())


def test_release(spark):
    t = materialize(spark.range(5))
    assert t.count() == 5
    release(t, None, spark.range(3))
    spark.catalog.clearCache()
    with pytest.raises(Exception):
        spark.read.parquet(t._stored)
