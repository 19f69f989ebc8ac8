"""What the corpus operators share: tables, written intermediate results, names and hashes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_local_dirs: dict[str, str] = {}
#: Paths of the spooled tables of each application.
_spooled: dict[str, set[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only where that is unset, and only in local mode, a temporary folder of our own."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _local_dirs[app] = tempfile.mkdtemp(prefix="reelquery-")
    return _local_dirs[app]


def spool(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    It cuts the lineage (a lost executor costs nothing that is written), and the planner
    sees the real size of the table, so that it broadcasts only what is under
    spark.sql.autoBroadcastJoinThreshold. The files stay until unspool or clear deletes them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _spooled.setdefault(spark.sparkContext.applicationId, set()).add(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.spooled_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def unspool(*tables: DataFrame) -> None:
    """Delete the files of spooled tables that nothing will read again."""
    for df in tables:
        _delete(df.sparkSession, df.spooled_at)
        _spooled[df.sparkSession.sparkContext.applicationId].discard(df.spooled_at)


def clear(spark: SparkSession) -> int:
    """Delete all that this application has spooled, and say how many tables it was.

    Results of the operators read spooled tables, so call it when they have been written or
    collected.
    """
    paths = _spooled.pop(spark.sparkContext.applicationId, set())
    for path in paths:
        _delete(spark, path)
    return len(paths)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def unit(key: Column) -> Column:
    """A number in [0, 1) with 52 random bits, from the MD5 of a string; the same in any engine that has MD5."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def id_text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit("null"))


def components(edges: DataFrame) -> DataFrame:
    """id, component (the smallest id) of the connected components of the edges a, b.

    Each round a node takes the smallest label around it and then that label's label, so the
    number of rounds follows the logarithm of the components' diameter. Every round is written.
    """
    both = spool(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    old = spool(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        labels = old.select("a", "label")
        around = both.join(labels.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        nearer = labels.join(around, "a").select("a", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("a").alias("label"), F.col("label").alias("further"))
        new = spool(nearer.join(jump, "label").select("a", "old", F.least("label", "further").alias("label")), "labels")
        unspool(old)
        old = new
        if new.filter("label < old").isEmpty():
            unspool(both)
            return new.select(F.col("a").alias("id"), F.col("label").alias("component"))
