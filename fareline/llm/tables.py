"""Reading the corpus tables and keeping intermediate results in the shared work folder."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

import fareline
from fareline.session import enable_checkpoints, work_folder

#: Texts of a record batch are handled in slices of about this many bytes.
SLICE_BYTES = 4 << 20
_SHIPPED: set[str] = set()
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Give the package to the executors, which need not have it on their path."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        package = Path(fareline.__file__).parent
        archive = Path(tempfile.mkdtemp(prefix="fareline-")) / "fareline.zip"  # handed out by the driver
        with zipfile.ZipFile(archive, "w") as z:
            for file in sorted(package.rglob("*.py")):
                z.write(file, file.relative_to(package.parent))
        sc.addPyFile(str(archive))
        _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame, purpose: str, *partition_by: str, batch_bytes: int | None = None) -> DataFrame:
    """Write ``df`` to the shared work folder and read it again.

    Cuts the lineage where every executor can read the rows, gives the planner their
    true size, and lets Spark drop the shuffle files of the step at its end.
    ``batch_bytes``: record batches go to Python tasks by about so many bytes.
    """
    spark = df.sparkSession
    enable_checkpoints(spark)
    path = work_folder(spark, purpose)
    settings = {_CLEAN_UP: "true"} | ({_BATCH: str(batch_bytes)} if batch_bytes else {})
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        df.write.partitionBy(*partition_by).parquet(path)
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about ``limit`` bytes; a longer text is a run."""
    column = batch.column(batch.schema.get_field_index(text))
    lengths = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start = size = 0
    for i, n in enumerate(lengths):
        if i > start and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8; null counts as empty."""
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary())
    return [x or b"" for x in column.to_pylist()]
