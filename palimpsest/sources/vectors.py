"""Vectors on disk: written in batches, the last word on an id counts, read back in any dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import dimension
from .store import remove, subfolders

VECTOR = "id string, vector array<float>, project string"


def aligned(vector: Column, dim: int) -> Column:
    """A vector cut, or filled up with zeros, to ``dim`` entries; null for null."""
    short = F.concat(vector, F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(0), dim - F.size(vector))))
    return F.slice(short, 1, dim)


class VectorStore:
    """Batches of (id, vector, project) under ``root``; a null vector takes an id out."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def batches(self) -> list[int]:
        return sorted(int(n.removeprefix("batch=")) for n in subfolders(self.spark, self.root) if n.startswith("batch="))

    def put(self, vectors: DataFrame) -> None:
        """New vectors, and ones in place of those stored before; an id occurs once."""
        number = max(self.batches(), default=0) + 1
        vectors.select(*[F.col(f.split()[0]).cast(f.split()[1]).alias(f.split()[0]) for f in VECTOR.split(", ")]).write.parquet(f"{self.root}/batch={number}")

    def take_out(self, ids: DataFrame) -> None:
        self.put(ids.select(F.col("id"), F.lit(None).cast("array<float>").alias("vector"), F.lit(None).cast("string").alias("project")))

    def load(self, dim: int | None = None) -> DataFrame:
        """(id, vector, project) as last stored; in ``dim`` entries, if given, whatever they were stored with."""
        if not self.batches():
            return self.spark.createDataFrame([], VECTOR)
        rows = self.spark.read.schema(f"{VECTOR}, batch int").parquet(self.root)
        last = rows.groupBy("id").agg(F.max_by(F.struct("vector", "project"), "batch").alias("v")).select("id", "v.*").filter("vector IS NOT NULL")
        return last if dim is None else last.withColumn("vector", aligned(F.col("vector"), dim))

    def resize(self, dim: int) -> int:
        """The dimension that the number of vectors asks for, if it is more than ``dim``: then all are stored anew in it, as one batch."""
        held = self.load()
        wanted = held.agg(dimension(F.count("*"))).first()[0]
        if wanted <= dim:
            return dim
        old = self.batches()
        self.put(held.withColumn("vector", aligned(F.col("vector"), wanted)))
        for number in old:  # what they held is in the new one, which counts already
            remove(self.spark, f"{self.root}/batch={number}")
        return wanted
