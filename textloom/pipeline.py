"""A whole run: read, normalise, vectorise, cluster, describe, name, project, and one result that is never changed in place."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.stopwords import ENGLISH
from .functions.text import is_blank
from .operators import describe
from .operators.dbscan import fit_dbscan
from .operators.kmeans import kmeans
from .operators.labels import all_noise, with_labels
from .operators.reduce import TSNE_LANDMARKS, embedding_frame, project
from .operators.vectorize import Matrix
from .operators.ward import ward
from .sources.xlsx import require_column
from .spec import ClusterSpec
from .storage import materialize

log = logging.getLogger("textloom")


@dataclass(frozen=True)
class ClusteringResult:
    """Rows with ``cluster_label`` and ``cluster_name``, and what describes the clusters; None where all texts were blank."""

    spec: ClusterSpec
    rows: DataFrame
    labels: DataFrame
    row_column: str
    stats: DataFrame
    keywords: DataFrame | None = None
    names: DataFrame | None = None
    matrix: Matrix | None = field(default=None, repr=False)
    model: object = field(default=None, repr=False)

    def rename(self, edits: dict[int, str]) -> ClusteringResult:
        """A new result with edited names, in its rows too."""
        if self.names is None:
            raise ValueError("there are no clusters to name")
        names = describe.apply_names(self.names, edits)
        return replace(self, names=names, rows=describe.with_names(self.rows, names))

    def embedding(self, method: str | None = None, landmarks: int = TSNE_LANDMARKS) -> DataFrame:
        if self.matrix is None:
            raise ValueError("there are no vectors to project")
        return embedding_frame(project(self.matrix.vectors, method or self.spec.visualize or "pca", self.spec.perplexity, self.spec.seed, landmarks), self.labels)

    def output(self, include_names: bool = True) -> DataFrame:
        out = self.rows if include_names else self.rows.drop("cluster_name")
        return (out if self.spec.id_column else out.orderBy(self.row_column)).drop(self.row_column)


def with_row_id(df: DataFrame, name: str = "_row_id") -> DataFrame:
    """``df`` written to the shared folder with numbers in the order of the source's partitions: without a shuffle, and the same however often they are read."""
    while name in df.columns:
        name += "_"
    return materialize(df.withColumn(name, F.monotonically_increasing_id()), "rows")


def cluster(df: DataFrame, spec: ClusterSpec) -> ClusteringResult:
    """Cluster the rows of ``df`` by the text in ``spec.column``.

    Rows have numbers of their own, so identifiers in ``spec.id_column`` may repeat, be null or of any type; that column only says that the output needs no order.
    """
    require_column(df, spec.column)
    if spec.id_column:
        require_column(df, spec.id_column)
    docs = with_row_id(df)
    row = docs.columns[-1]
    log.info("%s: %d rows, %d columns", spec.column, docs.count(), len(df.columns))
    if docs.where(~is_blank(F.col(f"`{spec.column}`"))).isEmpty():
        log.warning("no text is left after normalising: every row gets the label -1")
        rows = all_noise(docs).withColumn("cluster_name", F.lit(""))
        labels = rows.select(F.col(row).alias("row_id"), "cluster_label")
        return ClusteringResult(spec, rows, labels, row, describe.cluster_stats(labels))
    matrix = Matrix.of(docs, spec.column, row, spec.max_features, spec.stop_words if spec.stop_words is not None else ENGLISH)
    log.info("TF-IDF: %d rows, %d terms", *matrix.shape())
    model = None
    if spec.algorithm == "kmeans":
        model, labels = kmeans(matrix.vectors, spec.n_clusters, spec.seed, spec.restarts)
    elif spec.algorithm == "dbscan":
        model, labels = fit_dbscan(matrix.vectors, spec.eps, spec.min_samples)
    else:
        labels = ward(matrix.vectors, spec.n_clusters, spec.seed, spec.approximate)
    labels = materialize(labels, "labels")
    clusters = labels.where("cluster_label <> -1").select("cluster_label").distinct()
    log.info("%s: %d clusters", spec.algorithm, clusters.count())
    vocab = matrix.model.table(df.sparkSession)
    keywords = materialize(describe.cluster_keywords(describe.cluster_term_means(matrix.long, labels), vocab, labels, spec.top_n), "keywords")
    names = describe.cluster_names(keywords, spec.name_top_n, spec.name_joiner, spec.name_noise, clusters)
    log.info("keywords and names are ready")
    rows = describe.with_names(with_labels(docs, labels, row), names)
    return ClusteringResult(spec, rows, labels, row, describe.cluster_stats(labels), keywords, names, matrix, model)
