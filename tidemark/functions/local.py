"""Small tables made on the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def small(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A table of a few rows as a local relation: joins with it need no job to read it, and the optimiser knows its size."""
    schema = StructType.fromDDL(ddl)
    cols = list(zip(*rows)) if rows else [()] * len(schema)
    return spark.createDataFrame(pa.table([pa.array(list(c), _ARROW[f.dataType.simpleString()]) for c, f in zip(cols, schema)], names=schema.names), schema)
