"""Tables in the folder that driver and executors share; they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where none is set, on a local master."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if context.getCheckpointDir() is None:
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="linkloom-"))
    return named or context.getCheckpointDir()


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing has used before."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, *, parts: str | None = None) -> DataFrame:
    """``df`` written as a table (split into folders by ``parts``) and read back.

    Unlike a checkpoint, which keeps the planner's guess of a size, and which
    grows with every join of a loop until it fills the driver, a table tells
    its true size, so the planner broadcasts what is small.
    """
    path = fresh_path(df.sparkSession, "table")
    df.write.parquet(path, partitionBy=parts)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.cut_at = path
    return found


def cut_counting(df: DataFrame, *, sums: tuple[str, ...] = (), **conditions) -> tuple[DataFrame, dict[str, float]]:
    """``cut(df)``, and how many of its rows meet each condition and the sums of the columns ``sums``, taken while they are written."""
    seen = Observation()
    done = cut(df.observe(seen, *(F.count_if(c).alias(name) for name, c in conditions.items()), *(F.sum(c).alias(c) for c in sums)))
    return done, seen.get


def dealt(df: DataFrame, key: str, *, parts: str | None = None, placed: bool = False) -> DataFrame:
    """``df`` written as a table bucketed by ``key`` (and split into folders by ``parts``) and read back.

    Tables dealt by keys of one type join and group by them without an
    exchange. There are as many buckets as shuffle partitions, one file each.
    ``placed`` rows lie by ``key`` already and are not moved before they are written.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, "dealt")
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), path.rsplit("/", 1)[1].replace("-", "_")
    writer = (df if placed else df.repartition(n, key)).write.bucketBy(n, key).option("path", path)
    (writer.partitionBy(parts) if parts else writer).saveAsTable(name)
    found = spark.table(name).select(*df.columns)
    found.cut_at, found.table_name = path, name
    return found


def dealt_counting(df: DataFrame, key: str, *, parts: str | None = None, placed: bool = False, **conditions) -> tuple[DataFrame, dict[str, int]]:
    """``dealt(df, key)``, and how many of its rows meet each condition, counted while they are written."""
    seen = Observation()
    done = dealt(df.observe(seen, *(F.count_if(c).alias(name) for name, c in conditions.items())), key, parts=parts, placed=placed)
    return done, seen.get


def forget(*tables: DataFrame, part: str | None = None) -> None:
    """Remove the names of tables that ``dealt`` made, and the files of one ``part`` (a folder); other files stay and are read by their path."""
    for df in tables:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {df.table_name}")
        if part:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{df.cut_at}/{part}")
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def drop(*tables: DataFrame) -> None:
    """Remove the files of tables that ``cut`` made and that nothing will read any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.cut_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
