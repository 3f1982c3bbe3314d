"""Graph operators over edges (u, v) with u < v."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_path(spark, name: str) -> str:
    """A fresh path in the folder that the session names for checkpoints; a temporary one only where driver and
    executors are one process. It is deleted when the driver's JVM ends."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="wayfold-"))
    path = f"{sc._jsc.sc().getCheckpointDir().get()}/wayfold-{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_path(df.sparkSession, "cut")
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder, and read from there; a checkpoint computes it twice."""
    path = shared_path(df.sparkSession, "part")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` by keys in as many partitions as the session shuffles to. Without a number of its own a shuffle of few
    bytes is put together into few tasks, however long each row takes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, root for every node of edges (u, v): the smallest node that it reaches. Labels spread over links
    and jump to the label of their label, so long chains settle in few rounds; each is a checkpoint."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    now = cut(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("root")).withColumnRenamed("u", "node"))
    both = cut(both)
    for _ in range(most):
        heard = both.join(now.select(F.col("node").alias("v"), "root"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("heard"))
        closer = now.join(heard, "node").select("node", "root", F.least("root", "heard").alias("low"))
        far = now.select(F.col("node").alias("low"), F.col("root").alias("beyond"))
        new = cut(closer.join(far, "low", "left").select("node", "root", F.least("low", F.coalesce("beyond", "low")).alias("new")))
        if not new.where("new <> root").head(1):
            return now
        now = new.select("node", F.col("new").alias("root"))
    raise RuntimeError(f"components did not settle in {most} rounds")


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("u").alias("node")).unionAll(edges.select(F.col("v").alias("node")))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def peel(edges: DataFrame, k: int = 2, rounds: int | None = None) -> DataFrame:
    """Edges left after dropping nodes of degree < k, ``rounds`` times or until none is dropped. Each round
    reads a checkpoint and counts both ends in one pass, so plans do not grow. An empty table stays empty."""
    done, before = 0, None
    while rounds is None or done < rounds:
        edges = cut(edges)
        if rounds is None:
            now = edges.count()
            if now == before:
                return edges
            before = now
        weak = edges.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") < k).select("node")
        edges = edges.join(weak, edges.u == weak.node, "left_anti").join(weak, edges.v == weak.node, "left_anti")
        done += 1
    return edges


def triangles(edges: DataFrame) -> DataFrame:
    """Cycles of three edges, each once, smallest node first. Paths of two edges start at the end of
    lower degree, so a hub makes few of them."""
    d = degrees(edges)
    both = edges.join(d.toDF("u", "du"), "u").join(d.toDF("v", "dv"), "v")
    up = (F.col("du") < F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("u") < F.col("v")))
    out = both.select(F.when(up, F.col("u")).otherwise(F.col("v")).alias("o"), F.when(up, F.col("v")).otherwise(F.col("u")).alias("w"))
    two = out.withColumnRenamed("w", "u").join(out.withColumnRenamed("w", "v"), "o").where("u < v")
    three = F.sort_array(F.array("o", "u", "v"))
    return two.join(edges, ["u", "v"]).select(three[0].alias("x"), three[1].alias("y"), three[2].alias("z"))
