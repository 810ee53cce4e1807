"""One query for each operator, over whole tables, with the operators' defaults."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stopwords import ENGLISH
from ..operators import describe
from ..operators.dbscan import core_rows, dbscan
from ..operators.kmeans import kmeans, kmeans_fixed_init
from ..operators.labels import all_noise
from ..operators.neighbours import neighbour_pairs
from ..operators.reduce import embedding_frame, pca_projection, tsne_projection
from ..operators.vectorize import Matrix, idf, term_frequency, token_table, vocabulary, word_statistics
from ..operators.ward import ward
from ..sources.xlsx import column_list, table_profile
from ..storage import materialize, spread
from .oracle import ORACLE_SQL

V, EPS, MIN_SAMPLES, TOP_N, NAME_TOP_N, JOINER = 2000, 0.5, 5, 10, 3, ", "
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

__all__ = ["ORACLE_SQL", "QUERIES"]


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(spread(documents(spark, sf_dir)), "text", "doc_id")


def matrix(spark: SparkSession, sf_dir: str, max_features: int | None = V) -> Matrix:
    return Matrix.of(documents(spark, sf_dir), "text", "doc_id", max_features)


def labelled(spark: SparkSession, sf_dir: str, max_features: int | None = V) -> tuple[Matrix, DataFrame]:
    m = matrix(spark, sf_dir, max_features)
    return m, materialize(dbscan(m.vectors, EPS, MIN_SAMPLES), "labels")


def keywords(spark: SparkSession, sf_dir: str, max_features: int | None = V) -> DataFrame:
    m, labels = labelled(spark, sf_dir, max_features)
    return describe.cluster_keywords(describe.cluster_term_means(m.long, labels), m.model.table(spark), labels, TOP_N)


@query
def list_columns(spark, sf_dir):
    return column_list(table(spark, sf_dir, "documents"))


@query
def table_profile_documents(spark, sf_dir):
    return table_profile(table(spark, sf_dir, "documents"))


@query
def coerce_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.coerce_text(F.col("text")).alias("text"))


@query
def coerce_text_numeric(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.coerce_text(F.col("p_size")).alias("text"))


@query
def preprocess_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.preprocess(T.coerce_text(F.col("text"))).alias("text"))


@query
def blank_profile(spark, sf_dir):
    return documents(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(T.is_blank(F.col("text"))).alias("n_blank"), F.bool_and(T.is_blank(F.col("text"))).alias("all_blank"))


@query
def all_blank_labels(spark, sf_dir):
    return all_noise(documents(spark, sf_dir).select("doc_id"))


@query
def tokenize(spark, sf_dir):
    return spread(documents(spark, sf_dir)).select("doc_id", F.posexplode(T.tokens(F.col("text"))).alias("pos", "token"))


@query
def remove_stopwords(spark, sf_dir):
    return words(spark, sf_dir).select(F.col("row_id").alias("doc_id"), F.posexplode("words").alias("pos", "token"))


@query
def term_frequencies(spark, sf_dir):
    return term_frequency(words(spark, sf_dir)).withColumnRenamed("row_id", "doc_id")


@query
def vocabulary_topk(spark, sf_dir):
    return vocabulary(word_statistics(words(spark, sf_dir)), V)


@query
def document_frequency(spark, sf_dir):
    return word_statistics(words(spark, sf_dir)).select("term", "df")


@query
def inverse_document_frequency(spark, sf_dir):
    v = vocabulary(word_statistics(words(spark, sf_dir)), V)
    return idf(v, documents(spark, sf_dir).count()).select("term", F.round("idf", 9).alias("idf"))


@query
def tfidf(spark, sf_dir):
    return matrix(spark, sf_dir).long.select(F.col("row_id").alias("doc_id"), "term", F.round("weight", 6).alias("weight"))


@query
def tfidf_normalized(spark, sf_dir):
    return matrix(spark, sf_dir).long.select(F.col("row_id").alias("doc_id"), "term", F.round("unit", 6).alias("weight"))


@query
def tfidf_all_terms(spark, sf_dir):
    """Weights over a vocabulary without a limit."""
    return matrix(spark, sf_dir, None).long.select(F.col("row_id").alias("doc_id"), "term", F.round("unit", 6).alias("weight"))


@query
def dbscan_labels_all_terms(spark, sf_dir):
    return labelled(spark, sf_dir, None)[1].withColumnRenamed("row_id", "doc_id")


@query
def cluster_keywords_all_terms(spark, sf_dir):
    return keywords(spark, sf_dir, None).select("cluster_label", "rank", "term", F.round("score", 6).alias("score"))


@query
def feature_names(spark, sf_dir):
    return matrix(spark, sf_dir).model.table(spark).select("term_idx", "term")


@query
def matrix_shape(spark, sf_dir):
    n, k = matrix(spark, sf_dir).shape()
    return spark.createDataFrame([(n, k)], "n_rows long, n_features long")


@query
def neighbor_pairs(spark, sf_dir):
    m = matrix(spark, sf_dir)
    return neighbour_pairs(m.vectors, EPS)


@query
def dbscan_core_points(spark, sf_dir):
    m = matrix(spark, sf_dir)
    return core_rows(m.vectors, EPS, MIN_SAMPLES).withColumnRenamed("row_id", "doc_id")


@query
def dbscan_labels(spark, sf_dir):
    return labelled(spark, sf_dir)[1].withColumnRenamed("row_id", "doc_id")


@query
def dbscan_cluster_sizes(spark, sf_dir):
    return labelled(spark, sf_dir)[1].groupBy("cluster_label").agg(F.count("*").alias("n"))


@query
def cluster_ids(spark, sf_dir):
    return describe.cluster_ids(labelled(spark, sf_dir)[1])


@query
def cluster_stats(spark, sf_dir):
    return describe.cluster_stats(labelled(spark, sf_dir)[1])


@query
def cluster_count(spark, sf_dir):
    return describe.cluster_count(labelled(spark, sf_dir)[1])


@query
def cluster_term_means(spark, sf_dir):
    m, labels = labelled(spark, sf_dir)
    return describe.cluster_term_means(m.long, labels).select("cluster_label", "term", F.round("mean", 6).alias("mean"))


@query
def cluster_keywords(spark, sf_dir):
    return keywords(spark, sf_dir).select("cluster_label", "rank", "term", F.round("score", 6).alias("score"))


@query
def keyword_lines(spark, sf_dir):
    return describe.keyword_lines(keywords(spark, sf_dir))


@query
def cluster_names(spark, sf_dir):
    return describe.cluster_names(keywords(spark, sf_dir), NAME_TOP_N, JOINER)


@query
def clustered_with_names(spark, sf_dir):
    m, labels = labelled(spark, sf_dir)
    k = describe.cluster_keywords(describe.cluster_term_means(m.long, labels), m.model.table(spark), labels, TOP_N)
    return describe.with_names(labels, describe.cluster_names(k, NAME_TOP_N, JOINER)).withColumnRenamed("row_id", "doc_id").select("doc_id", "cluster_label", "cluster_name")


@query
def rename_clusters(spark, sf_dir):
    return describe.apply_names(describe.cluster_names(keywords(spark, sf_dir), NAME_TOP_N, JOINER), {0: "  first cluster "})


@query
def kmeans_labels(spark, sf_dir):
    return kmeans(matrix(spark, sf_dir).vectors)[1].withColumnRenamed("row_id", "doc_id")


@query
def kmeans_fixed_centres(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.posexplode("embedding").alias("pos", "value")).withColumn("value", F.col("value").cast("double"))
    return kmeans_fixed_init(v, 5, 3).select(F.col("row_id").alias("vec_id"), "cluster_label")


@query
def ward_labels(spark, sf_dir):
    return ward(matrix(spark, sf_dir).vectors).withColumnRenamed("row_id", "doc_id")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), F.col("label").alias("cluster_label"))


def rounded(points: DataFrame) -> DataFrame:
    return points.withColumns({c: F.round(c, 6) for c in ("x", "y")})


@query
def pca_embedding(spark, sf_dir):
    return rounded(pca_projection(embeddings(spark, sf_dir).select("row_id", "features"))).withColumnRenamed("row_id", "vec_id")


@query
def pca_documents(spark, sf_dir):
    """The documents' TF-IDF vectors."""
    return rounded(pca_projection(matrix(spark, sf_dir).vectors)).withColumnRenamed("row_id", "doc_id")


@query
def tsne_embedding(spark, sf_dir):
    return tsne_projection(embeddings(spark, sf_dir).select("row_id", "features")).withColumnRenamed("row_id", "vec_id")


@query
def tsne_documents(spark, sf_dir):
    """All documents' TF-IDF vectors."""
    return tsne_projection(matrix(spark, sf_dir).vectors, landmarks=1000).withColumnRenamed("row_id", "doc_id")


@query
def plot_frame(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return embedding_frame(rounded(pca_projection(e.select("row_id", "features"))), e.select("row_id", "cluster_label")).withColumnRenamed("row_id", "vec_id")


STOP_WORDS = ENGLISH
