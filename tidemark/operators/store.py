"""Where lineage is cut."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; one of this machine only where none is named, as in tests."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named is None and sc.getCheckpointDir() is None and not re.match(r"local(\[|$)", sc.master):
        raise ValueError("name a folder that all machines share in spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "tidemark-checkpoints"))
    return named or sc.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read from there, so that what follows neither repeats it nor loses it with an executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
