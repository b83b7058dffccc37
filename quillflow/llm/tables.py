"""Reading inputs, row keys and the shared folder."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none (tests on one machine), a folder beside the
    warehouse is used.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        found = context.getCheckpointDir()
        if not found:
            context.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-shared")
            found = context.getCheckpointDir()
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The written table cuts the lineage and outlives any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Bucketed:
    """A table in the shared folder whose rows lie by the hash of a column, so that joins on it leave them where they are."""

    def __init__(self, df: DataFrame, name: str, column: str):
        spark = df.sparkSession
        self.spark, self.name, self.path = spark, f"{name.replace('-', '_')}_{uuid.uuid4().hex}", f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        width = shuffle_width(spark)
        df.repartition(width, column).write.format("parquet").bucketBy(width, column).sortBy(column).option("path", self.path).saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)


def dropped(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more, and let Spark clear the shuffles behind them."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    gc.collect()
    SparkSession.active()._jvm.System.gc()


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two columns that tell rows apart by id and text, nulls included.

    Rows that agree in both are interchangeable for every operator here, so
    they may share one key.
    """
    return [
        F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 62))).alias("key_id"),
        F.xxhash64(F.col(doc_id), F.col(text)).alias("key_text"),
    ]


def carried(docs: DataFrame) -> DataFrame:
    """Key, ``text`` and the whole ``row`` as a struct, so that no column of ``docs`` can clash with an operator's own."""
    return docs.select(*row_key(), F.col("text").cast("string").alias("text"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
