"""Command line: ``python -m tessera cluster|config ...``.

``cluster`` weighs a table of object histograms, clusters it for one or several
numbers of clusters and writes (k, object, cluster, silhouette) as Parquet;
``config`` writes a settings file with the given changes.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import cluster, linkage, weight
from .sources.tables import Config


def clustered(hists: DataFrame, k: int, least: int, algorithm: str, rounds: int = 20) -> DataFrame:
    """(k, object, cluster, silhouette) of histograms (object, counts) with more than ``least`` counts."""
    kept = weight.enough_mass(hists, least)
    dim = kept.agg(F.max(F.size("counts"))).first()[0] or 0
    weighted = weight.tf_idf(kept, "object").checkpoint()
    if algorithm == "kmeans":
        found = cluster.kmeans(weighted, k, rounds, "object", "w", dim).select("object", F.col("cid").alias("cluster"))
        metric = "squared_euclid"
    else:
        merges = linkage.agglomerated(weighted, "w", "object", "cosine", linkage="average").checkpoint()
        # the cut below the merge that would leave fewer than k clusters
        top = [r["distance"] for r in merges.orderBy(F.desc("distance")).limit(max(1, k - 1)).collect()]
        cut = cluster.labels_of(cluster.roots(merges, merges.sparkSession.createDataFrame([(float(top[-1]) if k > 1 else float(top[0]) + 1.0,)], "threshold double")))
        found, metric = cut.select(F.col("node").alias("object"), F.col("label").alias("cluster")), "cosine"
    scored = weight.silhouettes(found.join(weighted, "object"), "object", "w", "cluster", metric)
    return scored.select(F.lit(k).alias("k"), "object", "cluster", "silhouette")


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser("tessera")
    commands = parser.add_subparsers(dest="command", required=True)
    c = commands.add_parser("cluster")
    c.add_argument("-a", "--algorithm", choices=("kmeans", "agg"), default="kmeans")
    c.add_argument("-c", "--counts", required=True, help="Parquet table (object, counts)")
    c.add_argument("-m", "--least", type=int, default=0)
    c.add_argument("-k", type=int, required=True, help="clusters, or the first number of a range")
    c.add_argument("-e", "--end", type=int, help="the last number of a range")
    c.add_argument("-s", "--step", type=int, default=1)
    c.add_argument("-x", "--output", required=True)
    w = commands.add_parser("config")
    w.add_argument("output")
    w.add_argument("options", nargs="*", metavar="key=value")
    given = parser.parse_args(args)
    spark = spark or SparkSession.builder.appName("tessera").getOrCreate()
    if given.command == "config":
        Config.read("", dict(o.split("=", 1) for o in given.options)).write(spark, given.output)
        return
    from .operators.graph import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    hists = spark.read.parquet(given.counts)
    for k in range(given.k, (given.end or given.k) + 1, given.step):
        clustered(hists, k, given.least, given.algorithm).write.mode("overwrite").parquet(f"{given.output}/k={k}")


if __name__ == "__main__":
    main()
