"""Shared plumbing: table access, the shared work folder, materialised steps."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus, read by Spark so that any store it knows will do."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The session names it in ``spark.checkpoint.dir``.  Only where that is unset
    (local runs, tests) does this set a folder of its own.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if at is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="stratagram-")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is over: nothing is left to ask
        pass


class WorkFolder:
    """A fresh folder below the shared one; it goes when the interpreter ends."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._end = weakref.finalize(self, _remove, spark, self.path)
        _folders.append(self)

    def __str__(self) -> str:
        return self.path

    def materialise(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and read it back: cuts lineage, survives lost executors."""
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self, name: str) -> None:
        _remove(self.spark, f"{self.path}/{name}")


# Results are lazy, so the folders must outlive the calls that made them.
_folders: list[WorkFolder] = []


def give_back() -> None:
    """Hand memory that earlier tasks of this worker have freed back to the system, where the C library can."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_remainder(doc_id, modulus: int):
    """crc32 of doc_id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def documents_only(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns, whatever else the table carries."""
    return docs.select(*[docs[c] for c in columns])
