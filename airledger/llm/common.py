"""What the training-data operators share: table reads, scratch tables, bounded samples, mapped texts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of text that a kernel gets at once at most, unless a single text is longer.
CHUNK_CHARS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reads one of the tables by the path that Spark's readers understand."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset, a new local one.

    A local folder is shared only by a local master; on a cluster an unset spark.checkpoint.dir raises.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir")
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = context._jvm.System.getProperty("airledger.scratch")
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="spark-airledger-")
            context._jvm.System.setProperty("airledger.scratch", base)
    return base.rstrip("/")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives executors this package, once for each application, so that a job needs no installation on them."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="spark-ship-")) / f"{root.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)


def stored(df: DataFrame, what: str) -> DataFrame:
    """Writes df as a new Parquet table in the shared folder and reads it again, which cuts its lineage."""
    path = f"{shared_dir(df.sparkSession)}/airledger-llm/{what}-{uuid.uuid4().hex}"
    # Hashes and ids hardly repeat, so dictionaries of them would be made in vain.
    df.write.option("parquet.enable.dictionary", "false").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder(column: str, divisor: int) -> Column:
    """crc32 of the column as text, modulo divisor; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def row_hash(seed: int, key: str = "doc_id", text: str = "text") -> Column:
    """A hash of a row's key, or of its text where the key is null, so that rows without a key are told apart too."""
    return F.when(F.col(key).isNull(), F.xxhash64(F.col(text), F.lit(seed))).otherwise(F.xxhash64(F.col(key), F.lit(seed)))


def sample(df: DataFrame, most: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """About `most` rows of df, chosen by row_hash, with that hash as __h: the same rows each time, however they lie."""
    rows = df.count()
    df = df.withColumn("__h", row_hash(most, key, text))
    return df if rows <= most else df.where(F.shiftrightunsigned("__h", 11) < int(min(1.0, 1.05 * most / rows) * 2**53))


def gathered(made: DataFrame, most: int) -> list:
    """At most `most` rows of what was made of a sample, by its hash and then by their other columns."""
    return made.orderBy("__h", *[F.xxhash64(c) for c in made.columns if c != "__h"]).limit(most).collect()


def _chunks(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def map_texts(
    df: DataFrame,
    make_kernel: Callable[[], Callable[[list], dict]],
    fields: str,
    text: str = "text",
    keep: tuple[str, ...] | list[str] = ("doc_id",),
    as_bytes: bool = False,
    chunk_chars: int = CHUNK_CHARS,
) -> DataFrame:
    """Keeps the columns `keep` and adds `fields` (DDL), which a kernel computes from lists of whole texts.

    make_kernel runs once in each task; its kernel maps a list of texts (str, or bytes in UTF-8; null as empty) to a
    dict of equally long lists or arrays. Only `keep` and the text reach Python, so other columns of df may have any
    names; a name of `fields` in `keep` raises ValueError.
    """
    ship(df.sparkSession)
    added = T.StructType.fromDDL(fields)
    keep = list(keep)
    if clash := sorted(set(keep) & set(added.fieldNames())):
        raise ValueError(f"columns to keep have the names of results: {', '.join(clash)}")
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    schema = T.StructType([*source.schema.fields[:-1], *added.fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make_kernel()
        for batch in batches:
            texts = batch.column(len(keep))
            if as_bytes:
                texts = texts.cast(pa.binary())
            sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
            for a, b in _chunks(sizes, chunk_chars):
                part = texts.slice(a, b - a).to_pylist()
                empty = b"" if as_bytes else ""
                made = kernel([empty if x is None else x for x in part])
                arrays = [batch.column(i).slice(a, b - a).cast(arrow.field(i).type) for i in range(len(keep))]
                arrays += [pa.array(made[f.name], type=arrow.field(len(keep) + i).type) for i, f in enumerate(added.fields)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return source.mapInArrow(run, schema)


def apart(docs: DataFrame) -> DataFrame:
    """All columns of docs as d_<name>, and text once more: what a filter keeps can then clash with nothing it adds."""
    return docs.select(*[F.col(f"`{c}`").alias(f"d_{c}") for c in docs.columns], F.col("text"))


def together(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again, of rows that apart() made."""
    return found.select(*[F.col(f"`d_{c}`").alias(c) for c in docs.columns])


class Known(dict):
    """A dict that makes missing values by a function of the key, and starts anew beyond so many keys."""

    def __init__(self, make: Callable, most: int = 300_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value
