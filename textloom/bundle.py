"""Saving a result's model and loading it again to place new texts."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import describe
from .operators.dbscan import DbscanModel
from .operators.kmeans import KMeansModel, predict
from .operators.labels import canonical
from .operators.vectorize import TableModel, VectorizerModel, token_table
from .pipeline import ClusteringResult
from .spec import ClusterSpec
from .storage import create_empty, delete_path, list_path, materialize

#: Folders of a bundle: one for each version, and the files that name the versions that are complete.
VERSIONS, COMMITS = "versions", "commits"


@dataclass(frozen=True)
class Bundle:
    """What is needed to place new texts: the vocabulary, a centre for each label, names and keywords; for DBSCAN its core rows."""

    spec: ClusterSpec
    vectorizer: VectorizerModel
    centres: DataFrame
    names: DataFrame
    keywords: DataFrame
    placing: DbscanModel | None = None

    def assign(self, docs: DataFrame, text: str, row_id: str) -> DataFrame:
        """``docs`` with ``cluster_label`` and ``cluster_name`` of the nearest centre.

        For DBSCAN, of the lowest-numbered cluster that has a core row near enough, or -1. For k-means the centres are its own; for Ward, which doesn't place new rows, the centroids of its
        clusters, an extension of ours. ``row_id`` must be unique.
        A row is only held against the centres that share a term with it, and against the shortest of all: any other one that shares none is farther. Spark broadcasts the
        centres if they are below its size limit.
        """
        words = token_table(docs, text, row_id, self.vectorizer.stop_words)
        if self.placing is not None:
            numbers = materialize(words.withColumn("_n", F.monotonically_increasing_id()), "words")
            found = self.placing.place(materialize(self.vectorizer.vectors(numbers.select(F.col("_n").alias("row_id"), "words")), "vectors"))
            near = numbers.select(F.col("row_id").alias("_row"), "_n").join(found, numbers["_n"] == found["row_id"]).select("_row", "cluster_label")
            placed = docs.drop("cluster_label").join(near, docs[f"`{row_id}`"].eqNullSafe(near["_row"]), "left").drop("_row")
            return describe.with_names(placed, self.names)
        sparse = self.vectorizer.long_form(words).select("row_id", "term_idx", "unit")
        table = self.centres.where("value <> 0").select(F.col("cluster_label").alias("label"), F.col("pos").alias("term_idx"), F.col("value").alias("c"))
        lengths = self.centres.groupBy(F.col("cluster_label").alias("label")).agg(F.sum(F.col("value") ** 2).alias("cc"))
        shortest = lengths.select(F.struct(F.round("cc", 12).alias("d"), "label").alias("m")).orderBy("m").first()
        dots = sparse.join(table, "term_idx").groupBy("row_id", "label").agg(F.sum(F.col("unit") * F.col("c")).alias("dot"))
        far = dots.join(lengths, "label").select("row_id", F.struct(F.round(F.col("cc") - 2 * F.col("dot"), 12).alias("d"), "label").alias("m"))
        near = far.groupBy("row_id").agg(F.min("m").alias("m")).select(F.col("row_id").alias("_row"), "m")
        least = F.struct(F.lit(shortest.m.d).alias("d"), F.lit(shortest.m.label).alias("label"))
        placed = docs.drop("cluster_label").join(near, docs[f"`{row_id}`"] == near["_row"], "left").withColumn("cluster_label", F.least("m", least)["label"]).drop("_row", "m")
        return describe.with_names(placed, self.names)


def _centres(result: ClusteringResult) -> DataFrame:
    """``cluster_label``, ``pos``, ``value``: means of the members' vectors; for k-means they are its centres once it has converged."""
    spark = result.rows.sparkSession
    if isinstance(result.model, KMeansModel):
        vectors = predict(result.model, result.matrix.vectors)
        pairs = canonical(vectors).join(vectors, "row_id").select("cluster_label", "label").distinct().collect()  # one row for each cluster
        found = result.model.clusterCenters()
        return spark.createDataFrame([(r.cluster_label, i, float(v)) for r in pairs for i, v in enumerate(found[r.label])], "cluster_label int, pos int, value double")
    means = describe.cluster_term_means(result.matrix.long, result.labels).join(result.matrix.model.table(spark).select("term", "term_idx"), "term")
    none = result.labels.where("cluster_label <> -1").select("cluster_label", F.lit(0).alias("pos"), F.lit(0.0).alias("value")).distinct()  # a cluster without terms has a centre too
    return means.select("cluster_label", F.col("term_idx").alias("pos"), F.col("mean").alias("value")).unionByName(none).groupBy("cluster_label", "pos").agg(F.sum("value").alias("value"))


def _commits(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Number and version of the saves that were completed, oldest first."""
    return sorted((int(n), version) for n, _, version in (c.partition("-") for c in list_path(spark, f"{path}/{COMMITS}")) if n.isdigit() and version)


def save_bundle(result: ClusteringResult, path: str) -> None:
    """Write the bundle as Parquet folders; an error is raised, not printed.

    A save writes a version of its own and then, in one step, an empty file whose name says that this version is the next. A save that is cut at any point leaves the
    bundle as it was; of two at a time, the later one to end counts. The version before stays, for readers that have begun with it; older ones and what cut saves have left go.
    """
    if result.matrix is None:
        raise ValueError("all texts were blank: there is no model to save")
    spark, m = result.rows.sparkSession, result.matrix.model
    version = uuid.uuid4().hex
    put = lambda df, name: df.write.parquet(f"{path}/{VERSIONS}/{version}/{name}")
    before = set(list_path(spark, f"{path}/{VERSIONS}"))
    put(m.table(spark), "vocabulary")
    put(spark.createDataFrame([(m.n_docs, list(m.stop_words))], "n_docs long, stop_words array<string>"), "vectorizer")
    if isinstance(result.model, DbscanModel):
        put(result.model.cores, "cores")
    put(_centres(result), "centres")
    put(result.names, "names")
    put(result.keywords, "keywords")
    put(spark.createDataFrame([(json.dumps(asdict(result.spec)),)], "spec string"), "spec")
    while True:
        done = _commits(spark, path)
        if create_empty(spark, f"{path}/{COMMITS}/{(done[-1][0] if done else 0) + 1:020d}-{version}"):
            break
    kept = {v for _, v in done[-1:]} | {version}
    for n, v in done[:-1]:
        delete_path(spark, f"{path}/{COMMITS}/{n:020d}-{v}")
    for v in before - kept:
        delete_path(spark, f"{path}/{VERSIONS}/{v}")


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    """The version that was saved last."""
    done = _commits(spark, path)
    if not done:
        raise FileNotFoundError(f"no bundle was saved at {path}")
    folder = f"{path}/{VERSIONS}/{done[-1][1]}"
    get = lambda name: spark.read.parquet(f"{folder}/{name}")
    conf = json.loads(get("spec").first().spec)
    conf["stop_words"] = tuple(conf["stop_words"]) if conf["stop_words"] is not None else None
    spec, about = ClusterSpec(**conf), get("vectorizer").first()
    if spec.max_features is None:  # the vocabulary stays a table
        table = get("vocabulary")
        model = TableModel(table, table.count(), about.n_docs, tuple(about.stop_words))
    else:
        v = get("vocabulary").orderBy("term_idx").collect()
        model = VectorizerModel(tuple(r.term for r in v), tuple(r.idf for r in v), tuple(r.cf for r in v), tuple(r.df for r in v), about.n_docs, tuple(about.stop_words))
    placing = DbscanModel(get("cores"), spec.eps) if spec.algorithm == "dbscan" else None
    return Bundle(spec, model, get("centres"), get("names"), get("keywords"), placing)
