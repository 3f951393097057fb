"""Collections as laid-out tables: created once with a vector size and indexed fields, probed for what they support.

A collection is a folder: ``points``, in folders by project and source type and, within these, in files by ranges of the document id;
and ``properties``, one row that a probe reads. The indexed text fields have Bloom filters, all fields the files' own minima and
maxima, so a search by fields lists the folders that can match and skips row groups in them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The indexed fields of a point and their kinds; names of the vectors; the usual size of a vector.
INDEXED = {
    "document_id": "string", "project_id": "string", "source_type": "string", "source": "string", "title": "string", "created_at": "string", "updated_at": "string",
    "is_attachment": "boolean", "parent_document_id": "string", "original_file_type": "string", "is_converted": "boolean",
}
DENSE, SPARSE, VECTOR_SIZE = "dense", "sparse", 1024
FOLDERS = ("project_id", "source_type")
PROPERTIES = "vector_size int, metric string, dense_name string, sparse_name string, indexed array<string>"


@dataclass(frozen=True)
class Capabilities:
    has_named_dense: bool
    has_sparse: bool
    vector_size: int | None
    indexed: tuple[str, ...]

    @property
    def hybrid_ready(self) -> bool:
        return self.has_named_dense and self.has_sparse


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/properties")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def create(points: DataFrame, path: str, vector_size: int = VECTOR_SIZE, sparse: bool = True, dense_name: str = DENSE, sparse_name: str = SPARSE) -> bool:
    """Lay out ``points`` at ``path``; False, and nothing done, if there is a collection already.

    ``points`` has a column for each vector and any payload columns; missing indexed fields are null. A vector of another
    size than ``vector_size`` is an error; a null one is not.
    """
    spark = points.sparkSession
    if exists(spark, path):
        return False
    if dense_name in points.columns:
        odd = points.where(F.size(dense_name) != vector_size).select(F.size(dense_name).alias("n")).limit(1).collect()
        if odd:
            raise ValueError(f"a vector of {odd[0].n} entries; the collection's have {vector_size}")
    for name, kind in INDEXED.items():
        if name not in points.columns:
            points = points.withColumn(name, F.lit(None).cast(kind))
    if not sparse and sparse_name in points.columns:
        points = points.drop(sparse_name)
    laid = points.repartitionByRange(*FOLDERS, "document_id").sortWithinPartitions(*FOLDERS, "document_id")
    writer = laid.write.partitionBy(*FOLDERS)
    for name, kind in INDEXED.items():
        if kind == "string" and name not in FOLDERS:
            writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
    writer.parquet(f"{path.rstrip('/')}/points")
    row = (vector_size, "cosine", dense_name if dense_name in points.columns else None, sparse_name if sparse_name in points.columns else None, list(INDEXED))
    # Written last: a collection that was not finished does not exist.
    spark.createDataFrame([row], PROPERTIES).coalesce(1).write.parquet(f"{path.rstrip('/')}/properties")
    return True


def points(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/points")


def probe(spark: SparkSession, path: str, dense_name: str = DENSE, sparse_name: str = SPARSE) -> Capabilities:
    """What the collection supports under these names: of its properties what its schema bears out. None of it where there is no collection."""
    if not exists(spark, path):
        return Capabilities(False, False, None, ())
    p, have = spark.read.parquet(f"{path.rstrip('/')}/properties").first(), set(points(spark, path).columns)
    held = lambda name, own: name == own and name in have
    return Capabilities(held(dense_name, p.dense_name), held(sparse_name, p.sparse_name), p.vector_size, tuple(f for f in p.indexed if f in have))
