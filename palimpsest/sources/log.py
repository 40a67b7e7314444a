"""The event log on disk: laid out by day, compacted into few files, and cut off behind a snapshot."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import snapshots
from .store import remove, subfolders

EVENT = "id string, aggregate_id string, event_type string, ts timestamp_ntz, payload string"
TAKEN = "aggregate_id string, sequence_number long, version long, payload string, deleted_at timestamp_ntz, deleted_by string"
#: Days that events are kept, and rows of a file after a compaction.
KEPT_DAYS, FILE_ROWS = 90, 1_000_000
FIRST = date(1970, 1, 1)


class EventLog:
    """Events under ``root``/days/day=..., snapshots under ``root``/snapshots/upto=... .

    A snapshot folder holds every aggregate's state after all events of days before ``upto``. The newest one counts, and
    events of days before it are read no more; so a retention that stops half way changes nothing but what is on disk.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _named(self, folder: str) -> list[date]:
        return sorted(date.fromisoformat(name.split("=")[1]) for name in subfolders(self.spark, f"{self.root}/{folder}") if "=" in name)

    def days(self) -> list[date]:
        """The days on disk."""
        return self._named("days")

    def upto(self) -> date:
        """The first day that the newest snapshot doesn't hold."""
        return max(self._named("snapshots"), default=FIRST)

    def append(self, events: DataFrame) -> None:
        """Events by their days; those without a moment come first. What is older than the snapshot goes to the first day after it."""
        day = F.greatest(F.coalesce(F.to_date("ts"), F.lit(FIRST)), F.lit(self.upto()))
        rows = events.select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in EVENT.split(", ")]).withColumn("day", day)
        rows.repartition("day").write.mode("append").partitionBy("day").parquet(f"{self.root}/days")

    def events(self, before: date | None = None) -> DataFrame:
        """The events that the snapshot doesn't hold, or those of them before a day; other days are never opened."""
        if not self.days():
            return self.spark.createDataFrame([], EVENT)
        rows = self.spark.read.schema(f"{EVENT}, day date").parquet(f"{self.root}/days").filter(F.col("day") >= F.lit(self.upto()))
        return (rows if before is None else rows.filter(F.col("day") < F.lit(before))).drop("day")

    def snapshot(self) -> DataFrame:
        """(aggregate_id, sequence_number, version, payload, deleted_at, deleted_by) of the newest snapshot."""
        upto = self.upto()
        return self.spark.createDataFrame([], TAKEN) if upto == FIRST else self.spark.read.schema(TAKEN).parquet(f"{self.root}/snapshots/upto={upto}")

    def state(self) -> DataFrame:
        """The state of every aggregate now: the snapshot, and the events after it."""
        return snapshots.rehydrated(self.snapshot(), snapshots.numbered(self.events()))

    def retain(self, today: date, keep: int = KEPT_DAYS) -> date:
        """Fold what is older than ``keep`` days into a new snapshot and drop those days; the first day kept."""
        cut = date.fromordinal(today.toordinal() - keep)
        if cut > self.upto() and any(d < cut for d in self.days()):
            taken = snapshots.rehydrated(self.snapshot(), snapshots.numbered(self.events(before=cut)))
            taken.write.mode("overwrite").parquet(f"{self.root}/snapshots/upto={cut}")
        kept = self.upto()
        for folder, days in (("days/day", self.days()), ("snapshots/upto", self._named("snapshots"))):
            for d in days:
                if d < kept:
                    remove(self.spark, f"{self.root}/{folder}={d}")
        return kept

    def compact(self, file_rows: int = FILE_ROWS) -> None:
        """Each day in as few files as its rows ask for: written beside it, then put in its place."""
        for d in self.days():
            path = f"{self.root}/days/day={d}"
            rows = self.spark.read.schema(EVENT).parquet(path)
            files = 1 + max(0, rows.count() - 1) // file_rows
            if len(rows.inputFiles()) <= files:
                continue
            beside = f"{self.root}/compacted/day={d}"
            rows.repartition(files).sortWithinPartitions("aggregate_id", "ts", "id").write.mode("overwrite").parquet(beside)
            remove(self.spark, path, beside)
