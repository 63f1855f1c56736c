"""Small driver-side tables as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_ARROW = {
    "string": "string",
    "binary": "binary",
    "int": "int32",
    "bigint": "int64",
    "double": "float64",
    "date": "date32",
    "timestamp": "timestamp",
}


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: StructType) -> DataFrame:
    """A handful of rows as a local relation.

    Through Arrow, Spark knows size and contents while planning: small tables need no job
    to be read, and joins with an empty one are planned away.
    """
    import pyarrow as pa

    def kind(name: str) -> pa.DataType:
        return pa.timestamp("us", "UTC") if name == "timestamp" else getattr(pa, _ARROW[name])()

    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    arrays = [
        pa.array(values, kind(field.dataType.simpleString()))
        for values, field in zip(columns, schema)
    ]
    return spark.createDataFrame(pa.table(arrays, schema.fieldNames()), schema)
