"""CSV with delimiter detection, in-memory tables and a Python data source."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructType

#: The delimiters tried, in order of preference on a tie.
DELIMITERS = (",", "\t", "|", ";")


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """The delimiter most frequent in the header line; a comma if there is none.

    Only Spark opens the path, so remote stores work as well.
    """
    first = spark.read.text(path).take(1)
    line = first[0][0] if first else ""
    return max(DELIMITERS, key=line.count)


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, schema: StructType | None = None, empty_as_null: bool = True) -> DataFrame:
    """A CSV file with a header. Without ``empty_as_null`` empty text cells stay ``''``."""
    reader = spark.read.option("header", True).option("sep", delimiter or sniff_delimiter(spark, path))
    df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    if empty_as_null:
        return df
    return df.withColumns({f.name: F.coalesce(f.name, F.lit("")) for f in df.schema.fields if isinstance(f.dataType, StringType)})


def from_columns(spark: SparkSession, data: dict[str, list], schema: StructType | None = None) -> DataFrame:
    """A table from a dict of equally long columns; types come from the values or ``schema``."""
    if schema is not None:
        return spark.createDataFrame(list(zip(*(data[f.name] for f in schema.fields), strict=True)), schema)
    table = pa.table(data)
    nulls = [i for i, f in enumerate(table.schema) if pa.types.is_null(f.type)]
    for i in nulls:  # a column of nothing but nulls counts as text
        table = table.set_column(i, table.schema.field(i).name, table.column(i).cast(pa.string()))
    return spark.createDataFrame(table)


class RangeSource(DataSource):
    """An example of a custom source: the numbers from 0 to ``rows`` with their squares."""

    @classmethod
    def name(cls) -> str:
        return "marlpit_range"

    def schema(self) -> str:
        return "n bigint, square bigint"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _RangeReader(int(self.options.get("rows", "10")), int(self.options.get("parts", "2")))


class _RangeReader(DataSourceReader):
    def __init__(self, rows: int, parts: int):
        self.rows, self.parts = rows, parts

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self.parts)]

    def read(self, partition: InputPartition):
        for n in range(partition.value, self.rows, self.parts):
            yield n, n * n
