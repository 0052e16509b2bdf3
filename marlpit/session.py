"""Session factory and the user-facing ``Engine`` facade."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from marlpit.plans.result import Result
from marlpit.sources import catalog

#: Settings of sessions that this package starts itself.
DEFAULTS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, app: str = "marlpit", **conf: str) -> SparkSession:
    """A session with the pinned settings; keyword settings use ``_`` for ``.``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = DEFAULTS | {k.replace("_", "."): str(v) for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


class Engine:
    """Named tables, SQL text and ad-hoc scans over one Spark session.

    Everything stays lazy: ``sql`` and ``table`` give DataFrames, ``run``
    wraps one in a ``Result`` for export.
    """

    def __init__(self, spark: SparkSession | None = None):
        self.spark = spark or build_session()
        self._names: list[str] = []

    def _register(self, name: str, df: DataFrame) -> DataFrame:
        df.createOrReplaceTempView(name)
        if name not in self._names:
            self._names.append(name)
        return df

    def register_table(self, name: str, df: DataFrame) -> DataFrame:
        return self._register(name, df)

    def register_csv(self, name: str, path: str, delimiter: str | None = None) -> DataFrame:
        return self._register(name, self.csv(path, delimiter))

    def register_parquet(self, name: str, path: str) -> DataFrame:
        return self._register(name, self.parquet(path))

    def register_memory(self, name: str, data: dict, schema: StructType | None = None) -> DataFrame:
        return self._register(name, catalog.from_columns(self.spark, data, schema))

    def register_source(self, name: str, fmt: str, **options: str) -> DataFrame:
        """A Python data source class or any built-in format, by its name."""
        return self._register(name, self.spark.read.format(fmt).options(**options).load())

    def csv(self, path: str, delimiter: str | None = None) -> DataFrame:
        return catalog.read_csv(self.spark, path, delimiter)

    def parquet(self, path: str) -> DataFrame:
        return self.spark.read.parquet(path)

    def tables(self) -> list[str]:
        return list(self._names)

    def table(self, name: str) -> DataFrame:
        if name not in self._names:
            raise ValueError(f"Unknown table: {name}")
        return self.spark.table(name)

    def table_schema(self, name: str) -> StructType:
        return self.table(name).schema

    def sql(self, text: str) -> DataFrame:
        try:
            return self.spark.sql(text.strip().rstrip(";"))
        except AnalysisException as e:
            if e.getCondition() == "TABLE_OR_VIEW_NOT_FOUND":
                name = e.getMessageParameters()["relationName"].replace("`", "")
                raise ValueError(f"Unknown table: {name}") from e
            raise

    def run(self, query: str | DataFrame) -> Result:
        return Result(self.sql(query) if isinstance(query, str) else query)

    def set_parallelism(self, n: int) -> None:
        self.spark.conf.set("spark.sql.shuffle.partitions", str(n))
