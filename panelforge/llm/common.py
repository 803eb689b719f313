"""What the operators of this subpackage share: tables, written cuts of lineage, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands in for a missing id in keys, below every real id.
NO_ID = -(2**63)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's; in local runs without one a folder of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="panelforge-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def written(df: DataFrame, sort_cols: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut and sizes are known."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    schema = df.schema
    (df.sortWithinPartitions(*sort_cols) if sort_cols else df).write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._written_to = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read any more."""
    for df in tables:
        path = df.__dict__.pop("_written_to", None)
        if path:
            spark = df.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sized_hint(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """``df`` (a written table of narrow rows) marked for a join: broadcast up to ``rows`` rows, else sorted and merged."""
    return df.hint("broadcast" if df.limit(rows + 1).count() <= rows else "merge")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Label every node that has an edge with the smallest node it can reach.

    Returns ``node, component``. Each round takes the smallest label among the neighbours and then
    follows labels once more, so paths shrink by more than half a round; every round is written, so
    a lost executor costs one round at most. Edge rows with a null end and loops are ignored; an
    empty edge table gives an empty result. Nothing is collected but one count per round.
    """
    one_way = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    links = written(one_way.unionByName(one_way.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = written(links.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("component"), F.lit(True).alias("moved")))
    while labels.where("moved").limit(1).count():
        near = (
            links.join(labels.select("node", "component").hint("merge"), links.v == labels.node)
            .groupBy("u")
            .agg(F.min("component").alias("near"))
        )
        step = (
            labels.join(near.hint("merge"), labels.node == near.u, "left")
            .select("node", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("hop"))
        )
        onward = labels.select(F.col("node").alias("at"), F.col("component").alias("onward"))
        jumped = written(
            step.join(onward.hint("merge"), step.hop == onward["at"], "left")
            .select("node", F.least("hop", F.coalesce("onward", "hop")).alias("component"), (F.least("hop", F.coalesce("onward", "hop")) != F.col("old")).alias("moved"))
        )
        forget(labels)
        labels = jumped
    forget(links)
    out = labels.select("node", "component")
    out._written_to = labels._written_to
    return out


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once a session, as executors need not have its folder."""
    import os
    import zipfile

    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="panelforge-"), "panelforge.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("panelforge", os.path.relpath(full, root)))
    context.addPyFile(target)
    _shipped.add(context.applicationId)
