"""Tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: What a missing doc_id counts as when ids are compared: the largest.
NO_ID = (1 << 63) - 1
#: Spark's setting by which a query's shuffle files go once it has ended.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting of the bytes in a batch that goes to Python.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Folders that ``stored`` has written and that are still there.
_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; one of our own only where none is set and driver and executors are on one machine, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="marlpit-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, path: str) -> DataFrame:
    """The rows written as Parquet to a folder and read again; the shuffles this took leave no files."""
    spark = df.sparkSession
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(TIDY)
        else:
            spark.conf.set(TIDY, before)
    return spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read again: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    out = written(df, path)
    out.stored_at = path
    _written.append(path)
    return out


def discard(spark: SparkSession, *paths: str) -> None:
    """Removes folders by way of the file system that Spark uses for them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
        if path in _written:
            _written.remove(path)


def drop(*tables: DataFrame) -> None:
    """Removes stored tables that no later step reads."""
    for df in tables:
        discard(df.sparkSession, df.stored_at)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Whatever is stored inside is removed at the end; results have to be written elsewhere by then."""
    known = set(_written)
    try:
        yield
    finally:
        discard(spark, *[p for p in _written if p not in known])


def keyed(docs: DataFrame) -> DataFrame:
    """Columns k1, k2 that name a row by id and text, and its text; repeated rows share them."""
    return docs.select(id_key().alias("k1"), F.xxhash64("text").alias("k2"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def id_key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def trim() -> None:
    """Gives memory that a worker doesn't use any more back to the system, as workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_batches(df: DataFrame, function, schema: str | StructType) -> DataFrame:
    """``function`` maps one RecordBatch to any number of dicts of columns."""
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kind)
    spark = df.sparkSession
    if spark.conf.get(BATCH_BYTES) == f"{64 << 20}b":  # the default; texts then take up to that much several times over
        spark.conf.set(BATCH_BYTES, "16m")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                for columns in function(batch):
                    yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type, from_pandas=False) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in arrow], schema=arrow)
            del batch
            trim()

    return df.mapInArrow(run, kind)
