"""Connected components of an edge table, distributed.

Rounds of *large star* (every node hands its larger neighbours to its smallest
one) and *small star* (every node hands its smaller neighbours and itself to the
smallest) turn any graph into stars around the smallest node of each component.
The number of rounds grows with the logarithm of the longest path.  Both steps
are an aggregate by node, which combines before the shuffle, and a join, which
adaptive execution splits where a node has very many edges; no neighbourhood is
ever collected.  Each round is written with ``checkpoint``, so plans stay short
and a lost executor repeats one round at most.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses ``spark.checkpoint.dir``; where it is unset, a local master gets a folder below /tmp/checkpoints, and any other an error."""
    if spark.sparkContext.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            os.makedirs("/tmp/checkpoints", exist_ok=True)
            path = "file://" + tempfile.mkdtemp(dir="/tmp/checkpoints")
        spark.sparkContext.setCheckpointDir(path)


class Tables:
    """Parquet tables of one run in the shared folder, for loops whose plans would grow.

    ``checkpoint`` cuts the lineage too, but keeps what the optimizer has inferred of the rows,
    which grows from round to round where joins rename keys.  A table is dropped when
    ``put`` gets its name again, and the rest when the driver's Python ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        ensure_checkpoint_dir(spark)
        self.spark, self.count, self.paths = spark, 0, {}
        self.root = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._remove, self.root, True)

    def put(self, df: DataFrame, name: str | None = None) -> DataFrame:
        """Writes df, and returns the table that has been written."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        if name:
            old, self.paths[name] = self.paths.get(name), path
            if old:
                self._remove(old)
        return self.spark.read.schema(df.schema).parquet(path)

    def _remove(self, path: str, at_exit: bool = False) -> None:
        try:
            target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may have ended; leftovers lie in the checkpoint folder only
            if not at_exit:
                raise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v) with u > v; the result has the same form, without repeats."""
    if large:
        arcs = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        arcs = edges
    least = arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if large:
        made = edges.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        made = edges.join(least, "u").select("v", "m").unionAll(least.select(F.col("u").alias("v"), "m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return made.where("u > v").distinct()


def stars(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) of every node that has an edge to another one and is not its component's smallest.

    Edges may repeat, point either way, and start and end in the same node; those with a null end are no edges.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    now = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where(F.col(src).isNotNull() & F.col(dst).isNotNull()).where("u > v").distinct().checkpoint()
    before = None
    mark = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"))
    while True:
        state = now.agg(mark.alias("x")).first()["x"]
        if state == before or state["n"] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = state
        now = _star(_star(now, True), False).checkpoint()


def components(nodes: DataFrame, edges: DataFrame, node: str = "node", src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): the smallest node reachable from each node, itself included."""
    found = stars(edges, src, dst).withColumnRenamed("node", node)
    return nodes.select(node).distinct().join(found, node, "left").select(node, F.coalesce("component", node).alias("component"))
