"""CSV export and its reading back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, StringType, TimestampType

from mailtables.functions.times import iso_text
from mailtables.schema import TABLES
from mailtables.sinks.tables import read_table

FILE_ROWS = 200_000
_OPTIONS = {"header": True, "quote": '"', "escape": '"', "encoding": "UTF-8"}


def flat_columns(rows: DataFrame) -> DataFrame:
    """CSV has text only: lists joined by `;`, flags as 0/1, times as `YYYY-MM-DDTHH:MM:SSZ`, no contents."""
    flat = []
    for field in rows.schema.fields:
        value = F.col(field.name)
        if isinstance(field.dataType, ArrayType) and isinstance(field.dataType.elementType, StringType):
            value = F.when(value.isNotNull(), F.concat_ws(";", value))
        elif isinstance(field.dataType, BooleanType):
            value = value.cast("int")
        elif isinstance(field.dataType, TimestampType):
            value = iso_text(value)
        elif isinstance(field.dataType, BinaryType):
            value = F.lit(None).cast("string")
        flat.append(value.alias(field.name))
    return rows.select(*flat)


def write_csv(rows: DataFrame, path: str, null_value: str = "") -> None:
    """One folder of CSV files with a header, also when there are no rows.

    A file with line breaks within values is read back by one task, so files are bounded in rows.
    """
    options = _OPTIONS | {"maxRecordsPerFile": FILE_ROWS} | ({"nullValue": null_value} if null_value else {})
    flat_columns(rows).write.mode("overwrite").options(**options).csv(path)


def read_csv(spark: SparkSession, path: str, schema, null_value: str = "") -> DataFrame:
    """Read an export back; with the same `null_value` on both sides NULL and '' stay apart."""
    options = _OPTIONS | {"multiLine": True} | ({"nullValue": null_value} if null_value else {})
    return spark.read.options(**options).schema(schema).csv(path)


def export_tables(spark: SparkSession, store: str, out: str) -> None:
    """Each of the five tables as `<out>/<table>.csv`."""
    for table in TABLES:
        write_csv(read_table(spark, store, table), f"{out}/{table}.csv")
