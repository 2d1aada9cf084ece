"""What the operators of this subpackage share on the side of Spark."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: what the cluster names; a folder of this machine only where none is named, as in tests."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named is None and sc.getCheckpointDir() is None and not re.match(r"local(\[|$)", sc.master):
        raise ValueError("name a folder that all machines share in spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "tidemark-checkpoints"))
    return named or sc.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read from there: the lineage ends, and lost executors cost nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def texts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows that have both an id and a text, as (doc_id long, text string); other columns go, whatever their names."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null and text is not null and text <> ''")


def packed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(row, id, rk): the whole row as one struct, so that its columns clash with nothing, its id and its text's hash."""
    return docs.select(F.struct("*").alias("row"), F.col(doc_id).cast("long").alias("id"), F.xxhash64(F.col(text).cast("string")).alias("rk"))
