"""What the operators of this subpackage share: ids, checkpoints, components, byte batches."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A null id is handled as this one, the largest, and given back as null.
NO_ID = 2**63 - 1
#: Parts over which the rows of a key are dealt out in with_facts.
SALTS = 32
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_of(name: str = "doc_id"):
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def id_back(name: str):
    return F.when(F.col(name) != NO_ID, F.col(name))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names; a temporary one only where driver and tasks are one process, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="checkpoints-")


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint into the shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def numbered(rows: DataFrame, name: str, *order) -> DataFrame:
    """rows with their place (from 1) in the order, which must be total: sorted ranges, and the sizes of those before."""
    part, mine = "_part", Window.partitionBy("_part").orderBy(*order)
    laid = cut(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    sizes = laid.groupBy(part).agg(F.count("*").alias("_size"))  # a row a partition
    before = F.sum("_size").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(part, F.coalesce(before, F.lit(0)).alias("_before"))
    return laid.join(F.broadcast(sizes), part).withColumn(name, F.row_number().over(mine) + F.col("_before")).drop(part, "_before")


def byte_rows(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The column's texts as UTF-8 bytes, null as empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, which bounds the memory of a task on long texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def with_facts(rows: DataFrame, facts: DataFrame, key: str, spread: str) -> DataFrame:
    """rows joined with facts (at most one row a key) on key, where one key may hold a great share of rows.

    Each key is dealt out over SALTS parts by the column `spread`; facts are copied only to the parts in use, which are
    found with partial aggregation, so a key has at most SALTS rows there and no task gets all rows of a key.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    used = salted.select(key, "_salt").distinct().join(facts, key)
    return salted.join(used, [key, "_salt"]).drop("_salt")


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) long pairs -> (node, root): the smallest node of each component, for nodes that have an edge.

    Smallest labels spread along edges and then along labels (pointer jumping); each round is cut by a checkpoint and
    only a count of changed labels reaches the driver. Empty edges give no rows. A component of any size is dealt out
    over SALTS keys where labels are looked up by root.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = cut(both.where("a <> b").distinct())
    labels = cut(links.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("root")))
    while True:
        heard = links.join(labels, links.b == labels.node).select(F.col("a").alias("node"), "root")
        spread = heard.union(labels).groupBy("node").agg(F.min("root").alias("root"))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = with_facts(spread, up, "root", "node").select("node", F.least("root", "above").alias("root"))  # every root is a node with a label
        old = labels.withColumnRenamed("root", "before")
        changed = cut(jumped.join(old, "node").select("node", "root", (F.col("root") < F.col("before")).alias("moved")))
        labels = changed.select("node", "root")
        if changed.where("moved").isEmpty():
            return labels
