"""Where tables that live for one run are written, and the package that executors run."""

from __future__ import annotations

import tempfile
import threading
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a new local one, which only a local master shares."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir")
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-airledger-")
    return base.rstrip("/")


def dealt(df: DataFrame, key: str, what: str) -> DataFrame:
    """df, written once in buckets of key, as many as shuffles have parts: joins and groups by key don't shuffle it.

    Every writing task puts a file into each bucket that it has rows of, so rows aren't shuffled before either: Parquet
    takes a fraction of what they take in a shuffle, and a reader takes the columns that it needs.
    """
    spark = df.sparkSession
    name = f"airledger_{what}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).option("compression", "zstd").option("path", f"{shared_dir(spark)}/airledger-{what}/{name}").saveAsTable(name)
    return spark.table(name)


_shipped: set[str] = set()
_shipping = threading.Lock()


def ship(spark: SparkSession) -> None:
    """Gives executors this package, once for each application, so that reading zips needs no installation on them."""
    context = spark.sparkContext
    with _shipping:  # zips are staged side by side
        if context.applicationId in _shipped:
            return
        root = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="spark-ship-")) / f"{root.name}-registry.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)
