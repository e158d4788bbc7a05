"""What several operators of this subpackage need: tables in the shared folder, checked broadcasts, components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

#: Where nothing is configured (tests, a laptop), tables that cut a lineage go here.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"
#: A side of a join is broadcast only if its rows were measured and take at most so many bytes.
BROADCAST_BYTES = 32 << 20
#: Bytes of an Arrow batch on its way to a Python worker, while a table is written.
ARROW_BYTES = "4m"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the session names it; a local one for a local master alone."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or f"file://{LOCAL_CHECKPOINTS}").rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lodestar/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later jobs start from files that survive an executor.

    Python workers get small batches meanwhile: what they hold at once is what fills an executor.
    """
    spark, setting = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    path, before = fresh_path(spark, name), spark.conf.get(setting, None)
    spark.conf.set(setting, ARROW_BYTES)
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the stashed tables that these frames read: no returned plan may read them."""
    for df in frames:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/lodestar/" in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _bytes_of(column: Column, kind: DataType) -> Column:
    """About how much a value takes in a broadcast."""
    if isinstance(kind, StructType):
        return sum((_bytes_of(column[f.name], f.dataType) for f in kind.fields), F.lit(0))
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, (ArrayType, StructType, StringType, BinaryType)):
            return F.aggregate(F.coalesce(column, F.array().cast(kind)), F.lit(0).cast("long"), lambda n, x: n + 8 + _bytes_of(x, kind.elementType))
        return 8 * F.greatest(F.size(column), F.lit(0))
    return F.coalesce(F.octet_length(column), F.lit(0)) + 8 if isinstance(kind, (StringType, BinaryType)) else F.lit(8)


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a table for a broadcast if its measured size allows it; otherwise Spark shuffles it as any other."""
    size = sum((_bytes_of(F.col(f.name), f.dataType) for f in df.schema.fields), F.lit(16)).cast("long")
    return F.broadcast(df) if df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0] <= most else df


def _roots(hooks: DataFrame) -> DataFrame:
    """Follow hooks to the root of each tree; every pass doubles the steps, so a chain takes few passes."""
    while True:
        up = hooks.select(F.col("node").alias("hook"), F.col("hook").alias("top"))
        further = stash(hooks.join(up, "hook").select("node", F.col("top").alias("hook"), (F.col("top") != F.col("hook")).alias("moved")), "hooks")
        discard(hooks)
        hooks = further.select("node", "hook")
        if further.where("moved").isEmpty():
            return hooks


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for all ends of the edges (u, v); the component is the smallest node that links reach.

    Each round hooks every node to its smallest neighbour, follows the hooks to their roots and replaces the ends of the
    edges by these, until no edge joins two nodes; half of the nodes at least go in each round. Both sides of every join come from the shared folder, so adaptive execution can split a hub.
    Null ends and loops are left out; no edges give an empty table.
    """
    pair = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    left = stash(pair.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    labels = None
    while not left.isEmpty():
        ends = left.select(F.col("v").alias("node"), F.col("u").alias("hook")).union(left.select("u", "u"))
        hooks = _roots(stash(ends.groupBy("node").agg(F.min("hook").alias("hook")), "hooks"))
        at_u, at_v = (hooks.select(F.col("node").alias(c), F.col("hook").alias(f"{c}_hook")) for c in "uv")
        moved = left.join(at_u, "u").join(at_v, "v").select(F.least("u_hook", "v_hook").alias("u"), F.greatest("u_hook", "v_hook").alias("v")).where("u <> v").distinct()
        moved = stash(moved, "edges")
        if labels is None:
            labels = hooks.withColumnRenamed("hook", "component")
        else:
            step = hooks.select(F.col("node").alias("component"), F.col("hook").alias("next"))
            old, labels = labels, stash(labels.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component")), "labels")
            discard(old, hooks)
        discard(left)
        left = moved
    discard(left)
    return labels if labels is not None else pair.sparkSession.createDataFrame([], "node long, component long")
