"""Document sources and sinks: JSON arrays, JSON lines, Parquet and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

SNAPSHOT = "snapshot-{}.json"


def read_json(spark: SparkSession, path: str, schema: StructType | str, array: bool = False) -> DataFrame:
    """Documents of JSON lines or, with ``array``, of files that hold one JSON array each.

    Lines are split between tasks; an array is one task's, so it suits seeds only.
    The schema is given, as inferring it would read everything once more.
    """
    return spark.read.schema(schema).json(path, multiLine=array)


def write_snapshot(docs: DataFrame, folder: str, seconds: int) -> str:
    """docs as JSON lines below folder, named by the time; the path is returned."""
    path = f"{folder.rstrip('/')}/{SNAPSHOT.format(seconds)}"
    docs.write.mode("errorifexists").json(path)
    return path
