"""What the operators of this package share: the folder all executors see, written tables, components."""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Used only where the session names no shared folder, as in tests on one machine.
LOCAL_FALLBACK = "/tmp/lodegraph-checkpoints"
#: Words of the contracts: runs of anything but the space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one only where that is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = LOCAL_FALLBACK
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/lodegraph/{tag}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: the lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodegraph_path = path  # for drop()
    return out


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop(*tables: DataFrame) -> None:
    """Removes tables of written() that no result reads any more."""
    for table in tables:
        remove(table.sparkSession, table._lodegraph_path)


@atexit.register
def _remove_all() -> None:
    for spark, path in _WRITTEN:
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # noqa: BLE001  the JVM may have ended already
            return


def fresh(docs: DataFrame, name: str) -> str:
    """name, lengthened until no column of docs has it in any case: working columns never hide those of a table."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def remainder(column: str, modulus: int):
    """crc32 of the value as text, modulo modulus: the folds of the contracts. A null id falls in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus)), F.lit(0))


def seeded_sample(rows: DataFrame, group: str, n: int, most_groups: int, seed: int, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Of each of the most_groups largest groups the n rows whose keys have the least seeded hash; rows have no text.

    keys tell the rows apart, so that rows of one id are not taken or left together.

    Counts come first, so only about 2n rows of a group, however large, go on to be ordered in one task.
    """
    rows = rows.withColumn("_u", F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) / float(1 << 53))
    counts = rows.groupBy(group).agg(F.count("*").alias("_n")).orderBy(F.col("_n").desc(), group).limit(most_groups)
    near = rows.join(F.broadcast(counts), group).where(F.col("_u") * F.col("_n") <= 2 * n + 100)
    nth = F.row_number().over(W.partitionBy(group).orderBy("_u", *keys))
    return near.withColumn("_r", nth).where(F.col("_r") <= n).drop("_u", "_n", "_r")


def components(edges: DataFrame, tag: str = "components", most_rounds: int = 200) -> DataFrame:
    """(node, component) for all nodes of edges (a, b): component is the least node that can be reached.

    Alternating large-star and small-star rounds: each node's neighbours are tied to its least neighbour, until
    every component is a star. Minima are aggregated before any shuffle and joined back, so that a hub's
    neighbours need not meet in one task; each round is a written table. Rounds end only when nothing changes; if
    most_rounds is not enough that is an error.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tag)
    before = state(e)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b")))
        new = written(small.where("a <> b").distinct(), tag)
        after = state(new)
        drop(e)
        e = new
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components are not complete after {most_rounds} rounds")
    stars = e.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return stars.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
