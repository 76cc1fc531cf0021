"""Export of a graph's edges and vectors to chunk files: ``python -m loomlake.plans.export --edges ... --output_dir ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from ..sources.graph_files import read_edges, read_features, write_chunks, write_features


def parse_arguments(args: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description="Export edges and node features to Parquet chunks")
    p.add_argument("--edges", required=True, help="edge table with src and dst")
    p.add_argument("--features", help="node table with id and feature columns")
    p.add_argument("--edge_files", type=int, default=1)
    p.add_argument("--feature_files", type=int, default=1)
    p.add_argument("--output_dir", default="output_parquet")
    return p.parse_args(args)


def export(spark: SparkSession, edges: str, features: str | None, edge_files: int, feature_files: int, output_dir: str) -> tuple[list[str], list[str]]:
    """Paths of the edge chunks and of the feature chunks. Edges are in order of source, target."""
    out = write_chunks(read_edges(spark, edges), output_dir, edge_files, ["src", "dst"])
    if not features:
        return out, []
    x = read_features(spark, features)
    width = x.selectExpr("max(size(x))").first()[0] or 0
    return out, write_features(x, output_dir, width, feature_files)


def main(args: list[str] | None = None) -> None:
    a = parse_arguments(args)
    spark = SparkSession.builder.appName("export").getOrCreate()
    for path in sum(export(spark, a.edges, a.features, a.edge_files, a.feature_files, a.output_dir), []):
        print(path)


if __name__ == "__main__":
    main()
