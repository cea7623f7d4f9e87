"""The daily feed as a stream: micro-batches of changed rows that replace rows by key in a versioned table."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.refresh import latest_by_key


#: Buckets of keys' hashes that a table is kept in.
BUCKETS = 64


class VersionedTable:
    """A Parquet table by buckets of its keys' hashes; each batch makes a version, in which other buckets are kept.

    Version n is a file n.json that says which batch wrote each bucket; a batch writes the buckets that it touches only,
    and its file last, so a broken write is never read and a replayed batch makes the same version. Before the first
    version the table is empty.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.buckets = spark, path.rstrip("/"), schema, buckets
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Whole versions in order."""
        if not self._fs.exists(self._path(self.path)):
            return []
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path))]
        return sorted(int(n.removesuffix(".json")) for n in found if n.endswith(".json"))

    def _layout(self, below: int | None = None) -> dict[int, int]:
        """Which batch wrote each bucket of the newest version, or of the newest before a batch."""
        own = [v for v in self.versions() if below is None or v < below]
        if not own:
            return {}
        text = "".join(r[0] for r in self.spark.read.text(f"{self.path}/{own[-1]}.json").collect())
        return {int(k): v for k, v in json.loads(text).items()}

    def bucket_of(self, keys: list[str]) -> Column:
        """The bucket of a row."""
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    def read(self, below: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The newest version, or the newest before a batch; all buckets or some."""
        layout = {b: v for b, v in self._layout(below).items() if only is None or b in only}
        if not layout:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/batch={v}/bucket={b}" for b, v in sorted(layout.items())])

    def replace(self, new: DataFrame, keys: list[str], batch: int) -> None:
        """Makes a batch's version: rows of new, which has each key once, in place of those with the same keys."""
        new = new.withColumn("bucket", self.bucket_of(keys)).persist()
        touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())
        if touched:
            kept = self.read(batch, touched).join(new.select(*keys), keys, "left_anti")
            whole = kept.withColumn("bucket", self.bucket_of(keys)).unionByName(new)
            whole.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/batch={batch}")
        out = self._fs.create(self._path(f"{self.path}/{batch}.json.new"), True)
        out.write(bytearray(json.dumps(self._layout(batch) | dict.fromkeys(touched, batch)).encode()))
        out.close()
        self._fs.delete(self._path(f"{self.path}/{batch}.json"), False)
        self._fs.rename(self._path(f"{self.path}/{batch}.json.new"), self._path(f"{self.path}/{batch}.json"))
        new.unpersist()

    def prune(self, keep: int = 2) -> None:
        """Deletes all but the newest versions, and what batches wrote that none of those has."""
        own = self.versions()
        used = {v for k in own[-keep:] for v in self._layout(k + 1).values()}
        for v in own[:-keep]:
            self._fs.delete(self._path(f"{self.path}/{v}.json"), False)
        for s in self._fs.listStatus(self._path(self.path)):
            name = s.getPath().getName()
            if name.startswith("batch=") and int(name[6:]) not in used and int(name[6:]) < (own[-1] if own else 0):
                self._fs.delete(s.getPath(), True)


def replacing_sink(table: VersionedTable, keys: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: the last row of each key of a batch replaces the table's."""

    def apply(batch: DataFrame, number: int) -> None:
        table.replace(latest_by_key(batch, keys, order), keys, number)
        table.prune()

    return apply


def start_feed(feed: DataFrame, table: VersionedTable, keys: list[str], order: list[str], checkpoint: str) -> StreamingQuery:
    """Applies what is in a stream of changes, then stops; a later start goes on from the checkpoint."""
    return feed.writeStream.foreachBatch(replacing_sink(table, keys, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_feed(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of a folder's Parquet files, oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_counts(feed: DataFrame, time: str, key: str, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """Changes per key and window of time; rows later than the watermark are left out, as the feed's window is finite."""
    return feed.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count("*").alias("changes"))
