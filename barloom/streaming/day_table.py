"""A table partitioned by day that a stream writes batch by batch, with a manifest that says what counts.

A batch writes its rows into a folder of its own and then, in one rename, its manifest: one line per day with the number
of rows and a fingerprint. Readers go through the manifest, so rows of a batch that died before its rename are never
seen, and a batch that is replayed after it is passed over. ``compact`` puts the committed batches into one folder.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(columns: list[str]):
    """A sum of row hashes: independent of order, counts repeats, merges over folders by adding."""
    return F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("string")


@dataclass
class DayTable:
    spark: SparkSession
    path: str
    day: str = "d"

    # ------------------------------------------------------------ files
    def _fs(self, name: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _names(self, name: str) -> list[str]:
        fs, at = self._fs(name)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def _publish(self, lines: DataFrame, name: str) -> None:
        """Write manifest lines aside and move them in place at once."""
        draft = f"draft/{uuid.uuid4().hex}"
        lines.coalesce(1).write.parquet(f"{self.path}/{draft}")  # a line per day of one batch
        fs, source = self._fs(draft)
        _, home = self._fs("manifest")
        fs.mkdirs(home)
        _, target = self._fs(f"manifest/{name}")
        if not fs.rename(source, target):
            raise OSError(f"could not publish {target}")

    def _committed(self) -> tuple[int, list[str]]:
        """(last batch that a compaction covers or -1, manifest folders that count)."""
        names = self._names("manifest")
        base = max((int(n[5:]) for n in names if n.startswith("upto=")), default=-1)
        return base, [n for n in names if n == f"upto={base}" or (n.startswith("batch=") and int(n[6:]) > base)]

    # ------------------------------------------------------------ writing
    def write(self, batch: DataFrame, batch_id: int) -> str | None:
        """Rows of a batch into a folder of their own; None if the batch is committed already."""
        base, names = self._committed()
        if batch_id <= base or f"batch={batch_id}" in names:
            return None
        folder = f"folder=b{batch_id}-{uuid.uuid4().hex}"
        batch.hint("rebalance", self.day).write.partitionBy(self.day).parquet(f"{self.path}/rows/{folder}")
        return folder

    def _lines(self, folder: str, columns: list[str]) -> DataFrame:
        rows = self.spark.read.option("basePath", f"{self.path}/rows").parquet(f"{self.path}/rows/{folder}")
        return rows.groupBy(F.col(self.day).cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n_rows"), fingerprint(columns).alias("fingerprint")).withColumn("folder", F.lit(folder))

    def commit(self, folder: str, batch_id: int, columns: list[str]) -> None:
        self._publish(self._lines(folder, columns), f"batch={batch_id}")

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """What ``foreachBatch`` calls. An empty batch is committed without a folder."""
        folder = self.write(batch, batch_id)
        if folder is not None and self._names(f"rows/{folder}"):
            columns = sorted(c for c in batch.columns if c != self.day)
            if any(n.startswith(f"{self.day}=") for n in self._names(f"rows/{folder}")):
                self.commit(folder, batch_id, columns)

    def start(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.foreachBatch(lambda batch, i: self.add(batch, i)).trigger(availableNow=True).option("checkpointLocation", checkpoint).start()

    # ------------------------------------------------------------ reading
    def manifest(self) -> DataFrame:
        """(day, n_rows, fingerprint, folder) of all that is committed: a line per day and folder."""
        _, names = self._committed()
        kinds = "day string, n_rows long, fingerprint string, folder string"
        if not names:
            return self.spark.createDataFrame([], kinds)
        return self.spark.read.schema(kinds).parquet(*[f"{self.path}/manifest/{n}" for n in names])

    def read(self) -> DataFrame:
        """The committed rows, pruned by day like any partitioned table."""
        folders = [r["folder"] for r in self.manifest().select("folder").distinct().collect()]  # one per batch since the last compaction
        if not folders:
            raise ValueError("nothing is committed")
        rows = self.spark.read.option("basePath", f"{self.path}/rows").parquet(*[f"{self.path}/rows/{f}" for f in sorted(folders)])
        return rows.drop("folder")

    def changed_days(self) -> DataFrame:
        """(day, kept, found): days whose rows no longer have the fingerprints of the manifest."""
        lines = self.manifest()
        columns = sorted(c for c in self.read().columns if c != self.day)
        kept = lines.groupBy("day").agg(F.sum(F.col("fingerprint").cast("decimal(38,0)")).cast("string").alias("kept"))
        found = self.read().groupBy(F.col(self.day).cast("string").alias("day")).agg(fingerprint(columns).alias("found"))
        return kept.join(found, "day", "full").where(~F.col("kept").eqNullSafe(F.col("found")))

    def compact(self) -> None:
        """One folder for all committed batches, one file group per day; then the old folders and manifests go."""
        base, names = self._committed()
        last = max([base, *[int(n[6:]) for n in names if n.startswith("batch=")]])
        if last == base:
            return
        old = [r["folder"] for r in self.manifest().select("folder").distinct().collect()]
        rows = self.read()
        folder = f"folder=c{last}-{uuid.uuid4().hex}"
        rows.hint("rebalance", self.day).write.partitionBy(self.day).parquet(f"{self.path}/rows/{folder}")
        self._publish(self._lines(folder, sorted(c for c in rows.columns if c != self.day)), f"upto={last}")
        for name in [*[f"rows/{f}" for f in old], *[f"manifest/{n}" for n in names]]:
            fs, at = self._fs(name)
            fs.delete(at, True)


def route_late(stream: DataFrame, ts: str, allowed_seconds: int, day: str, folder: str, checkpoint: str) -> tuple[DayTable, DayTable, DataFrame]:
    """Run a stream into two day tables: rows in time, and rows more than ``allowed_seconds`` older than the newest row of
    the batches before. Returns both tables and (batch, n_rows, n_late, newest) of every batch.

    The newest time per batch is published with the batch, so a replay decides as the first run did.
    """
    spark = stream.sparkSession
    in_time, late = DayTable(spark, f"{folder}/in_time", day), DayTable(spark, f"{folder}/late", day)
    kinds = "batch long, n_rows long, n_late long, newest timestamp"
    metrics = DayTable(spark, f"{folder}/metrics")

    def seen() -> DataFrame:
        names = [n for n in metrics._names("manifest") if n.startswith("batch=")]
        return spark.read.schema(kinds).parquet(*[f"{metrics.path}/manifest/{n}" for n in names]) if names else spark.createDataFrame([], kinds)

    def add(batch: DataFrame, batch_id: int) -> None:
        newest = seen().where(F.col("batch") < batch_id).agg(F.max("newest")).first()[0]
        behind = F.col(ts) < F.lit(newest) - F.expr(f"interval {allowed_seconds} seconds") if newest is not None else F.lit(False)
        marked = batch.withColumn("_late", F.coalesce(behind, F.lit(False))).persist()
        try:
            in_time.add(marked.where("NOT _late").drop("_late"), batch_id)
            late.add(marked.where("_late").drop("_late"), batch_id)
            if f"batch={batch_id}" not in metrics._names("manifest"):
                counts = marked.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("_late").alias("n_late"), F.max(ts).alias("newest"))
                metrics._publish(counts.select(F.lit(batch_id).cast("long").alias("batch"), "n_rows", "n_late", "newest"), f"batch={batch_id}")
        finally:
            marked.unpersist()

    stream.writeStream.foreachBatch(add).trigger(availableNow=True).option("checkpointLocation", checkpoint).start().awaitTermination()
    return in_time, late, seen()
