"""Helpers of the training-data operators: tables, and results kept in the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from postgrove.session import read_table, shared_folder

__all__ = ["Scratch", "numbered", "quoted", "read_table", "shared_folder", "stored"]


def quoted(name: str) -> str:
    """A column's name as ``select`` and ``col`` take it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with columns c0, c1 and so on, as functions over Arrow batches cannot be given every name."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def stored(df: DataFrame, tag: str, folder: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there, so a lost executor
    costs nothing that came before, and every later reader sees the same rows."""
    spark = df.sparkSession
    path = f"{(folder or shared_folder(spark)).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """A folder inside the shared one for the tables of one computation. It goes when the ``with`` block ends, also after a
    failure, so nothing that is read later may stand on its tables: the block's result is stored outside."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"

    def stored(self, df: DataFrame, tag: str) -> DataFrame:
        return stored(df, tag, self.folder)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
