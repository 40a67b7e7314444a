"""Parquet tables under one root, append-only, and tables staged in the cluster's shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .schemas import PARTITIONS, TABLES


class Store:
    """The engine's tables as Parquet folders; state is a fold over what was appended."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def create(self) -> None:
        """Write every table's schema; tables that exist keep their rows."""
        for name in TABLES:
            self.append(name, self.spark.createDataFrame([], TABLES[name]))

    def read(self, table: str) -> DataFrame:
        return self.spark.read.schema(TABLES[table]).parquet(self.path(table))

    def append(self, table: str, rows: DataFrame) -> None:
        kinds = TABLES[table]
        out = rows.select(*[rows[f.name].cast(f.dataType).alias(f.name) for f in kinds])
        writer = out.write.mode("append")
        if by := PARTITIONS.get(table):
            writer = writer.partitionBy(*by)
        writer.parquet(self.path(table))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only where driver and executors are one machine's (a local master) may it be unset: then it is a temporary one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _place(spark: SparkSession, path: str):
    """(the file system of a path, the path) as Spark's writers see them."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a table in the shared folder, which goes when the application ends, if ``discard`` hasn't deleted it before."""
    path = f"{shared_dir(spark)}/palimpsest/{name}-{uuid.uuid4().hex}"
    files, place = _place(spark, path)
    files.mkdirs(place)
    files.deleteOnExit(place)
    return path


def stage_table(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, outlives lost executors.

    ``files``, from a count of what goes into it, spares small tables a file for every shuffle partition.
    """
    if files is not None:
        df = df.coalesce(files)
    spark = df.sparkSession
    path = f"{scratch(spark, name)}/rows"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete staged tables after their last use; nothing that is still to run may read them."""
    for df in tables:
        if path := getattr(df, "_staged", None):
            files, place = _place(df.sparkSession, path)
            files.delete(place.getParent(), True)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """The names of the folders in a folder; none where there is none."""
    files, place = _place(spark, path)
    return [f.getPath().getName() for f in files.listStatus(place) if f.isDirectory()] if files.exists(place) else []


def remove(spark: SparkSession, path: str, other: str | None = None) -> None:
    """Delete a folder, and put another one in its place if one is given."""
    files, place = _place(spark, path)
    files.delete(place, True)
    if other is not None:
        files.rename(_place(spark, other)[1], place)
