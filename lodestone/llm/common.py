"""Helpers of the training-data operators: shared scratch tables, Arrow batches, text columns."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.session import table

#: Rows of one Arrow batch. Documents run to hundreds of kB, so batches are kept short.
BATCH_ROWS = 512

_OWN_DIR: list[str] = []
_MADE: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; our own only where it is unset (tests)."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="lodestone-"))
    return f"file://{_OWN_DIR[0]}"


def _forget() -> None:
    for spark, path in _MADE:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended: the folder's owner cleans it
            return


atexit.register(_forget)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there, so a lost
    executor costs a read and not a recomputation. Removed when the process ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _MADE.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def short_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the memory of a Python worker: few documents an Arrow batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def text_bytes(column: str = "text"):
    """UTF-8 bytes of a text column, null as empty."""
    return F.coalesce(F.col(column).cast(T.BinaryType()), F.lit(b"").cast(T.BinaryType()))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, max_bytes: int, training_only: bool = False) -> list[tuple[bytes, int]]:
    """At most ``rows`` labelled texts for the driver to fit a classifier on.

    The rows with the smallest hash of their id are taken, so the sample does not
    depend on partitioning; a label other than 0 or 1 and a text over ``max_bytes``
    do not count. ``training_only`` leaves out ids whose crc32 mod 5 is 0.
    """
    ids = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("_y"))
    if training_only:
        ids = ids.where(~held_out("doc_id"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    short = docs.select("doc_id", text_bytes().alias("_b")).where(F.length("_b") <= max_bytes)
    # The sample's ids are bounded by ``rows``, 16 bytes each; of repeated ids one text comes to the driver.
    found = short.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "_y").agg(F.min("_b").alias("_b")).collect()
    return [(bytes(r["_b"]), int(r["_y"])) for r in sorted(found, key=lambda r: r["doc_id"])]


def held_out(key: str = "doc_id"):
    """Rows kept from training: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))
