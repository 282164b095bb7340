"""What the operators share: reading tables, shared scratch space, connected components."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where it is unset and all is one process, a new one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="sessionweave-")
        spark.sparkContext.setCheckpointDir(where)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


class Scratch:
    """Tables written as Parquet to the shared folder, so that a lost executor costs no recomputation of what precedes them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/sessionweave/{name}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def release(self, *names: str) -> None:
        """Drops tables that are no longer read, and lets Spark delete the shuffle files of finished steps: without this they stay until
        the driver happens to collect its garbage, and a chain of steps needs a multiple of the disk."""
        for n in names:
            self.drop(n)
        for _ in range(2):  # frames that Python has let go of, then what they held in the JVM
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(0.2)

    def part(self, name: str) -> Scratch:
        """A space within this one, which goes when this one goes."""
        out = Scratch.__new__(Scratch)
        out.spark, out.root = self.spark, self.path(f"{name}-{uuid.uuid4().hex}")
        return out

    def remove(self) -> None:
        """Drops all of its tables."""
        self.drop("")

    def drop(self, name: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name).rstrip("/"))
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def connected_components(scratch: Scratch, edges: DataFrame, name: str = "cc", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the least node reachable.

    Alternating large-star and small-star rounds: both keep connectivity and take O(log^2 n) rounds.  Minimum
    aggregates combine on the map side, so a hub with a third of all edges doesn't meet in one task; the joins
    with the minima are left to adaptive skew splitting.  Each round is written to the shared folder.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = scratch.keep(e, f"{name}0")
    before = None
    for i in range(most_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = scratch.keep(large.where("a <> b").distinct(), f"{name}{i}l")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        e = scratch.keep(small.where("a <> b").distinct(), f"{name}{i + 1}")
        # stable once every node points straight at a root: no b is also an a, and counts no longer move
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(f"{name}{i}l")
        scratch.drop(f"{name}{i}")
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = e.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
