"""Command line: cluster the texts of a workbook or Parquet table and write the rows back with labels and names."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from .bundle import save_bundle
from .pipeline import ClusteringResult, cluster
from .scatter import save_scatter
from .sources.xlsx import load_excel, save_excel
from .spec import ALGORITHMS, PROJECTIONS, ClusterSpec, derived_path
from .storage import materialize


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="textloom", description=__doc__)
    p.add_argument("-i", "--input", required=True, help="workbook (.xlsx) or Parquet path")
    p.add_argument("-s", "--sheet", help="sheet name, or index from 0")
    p.add_argument("-c", "--column", required=True, help="text column")
    p.add_argument("-a", "--algorithm", choices=ALGORITHMS, default="kmeans")
    p.add_argument("-k", "--n_clusters", type=int, default=5)
    p.add_argument("--eps", type=float, default=0.5)
    p.add_argument("--min_samples", type=int, default=5)
    p.add_argument("--max_features", type=lambda v: None if v.lower() == "none" else int(v), default=2000, help="terms of the vocabulary, or none for all")
    p.add_argument("-o", "--output", help="default: the input with _clustered")
    p.add_argument("-v", "--visualize", action="store_true", help="write the projected points and draw them")
    p.add_argument("--vis_method", choices=PROJECTIONS, default="pca")
    p.add_argument("--perplexity", type=float, default=30.0)
    p.add_argument("--random_state", type=int, default=42)
    p.add_argument("--top_n", type=int, default=10)
    p.add_argument("--name_top_n", type=int, default=3)
    p.add_argument("--name_joiner", default=", ")
    p.add_argument("--save_model", action="store_true")
    p.add_argument("--model_path", help="default: the output with _model")
    p.add_argument("--approximate", action="store_true", help="allow the approximate agglomerative mode for many rows")
    return p


def _write(df: DataFrame, path: str) -> None:
    if path.lower().endswith(".xlsx"):
        save_excel(df, path)
    else:
        df.write.mode("overwrite").parquet(path)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> ClusteringResult:
    a = parser().parse_args(argv)
    spec = ClusterSpec(
        column=a.column, algorithm=a.algorithm, n_clusters=a.n_clusters, eps=a.eps, min_samples=a.min_samples, max_features=a.max_features, top_n=a.top_n, name_top_n=a.name_top_n,
        name_joiner=a.name_joiner, visualize=a.vis_method if a.visualize else None, perplexity=a.perplexity, seed=a.random_state, approximate=a.approximate)
    spark = spark or SparkSession.builder.appName("textloom").getOrCreate()
    sheet = a.input.lower().endswith((".xlsx", ".xls"))
    df = load_excel(spark, a.input, a.sheet) if sheet else spark.read.parquet(a.input)
    result = cluster(df, spec)
    out = a.output or derived_path(a.input, "_clustered" + (".xlsx" if sheet else ".parquet"))
    _write(result.output(), out)
    print(f"rows and labels: {out}")
    if result.keywords is not None:
        from .operators.describe import keyword_lines

        for r in keyword_lines(result.keywords).join(result.names, "cluster_label").orderBy("cluster_label").collect():  # a row for each cluster
            print(f"{r.cluster_label}\t{r.cluster_name}\t{r.keywords}")
        if spec.visualize:
            points = materialize(result.embedding(), "points")
            points.write.mode("overwrite").parquet(derived_path(out, f"_vis_{spec.visualize}.parquet"))
            save_scatter(points, derived_path(out, f"_vis_{spec.visualize}.svg"), f"Clusters ({spec.visualize})")
        if a.save_model:
            save_bundle(result, a.model_path or derived_path(out, "_model"))
    return result


if __name__ == "__main__":
    main()
