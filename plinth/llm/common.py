"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.operators.tables import scratch, shared_dir, written  # noqa: F401

#: White space that separates words in every contract of this subpackage.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows taken from an Arrow batch at a time, so that few long texts are Python strings at once.
SLICE_ROWS = 256
#: Bytes of text that reach a Python worker at a time.
BATCH_BYTES = 8 << 20


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The named columns of the ``documents`` table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of the Arrow batches that Python workers get, unless the session does already.

    A batch otherwise has thousands of rows, however long their texts are.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_texts(df: DataFrame, kernel: Callable[[list], dict[str, list]], schema: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Run ``kernel`` over slices of the texts; its lists become columns beside ``keep``.

    ``kernel`` gets a list of ``str`` or ``None`` and returns one list per column
    of ``schema``. The partitioning of ``df`` stays.
    """
    frame = df.select(*keep, text)
    names = [part.split()[0] for part in schema.split(",")]
    spark = df.sparkSession
    bounded_batches(spark)
    out = spark.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    full = StructType([*(frame.schema[c] for c in keep), *out.fields])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for i in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(i, SLICE_ROWS)
                made = kernel(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in range(len(keep))), *(pa.array(made[n], arrow.field(n).type) for n in names)],
                    names=[*keep, *names],
                )

    return frame.mapInArrow(run, full)


def row_count(df: DataFrame) -> int:
    """Number of rows, as a bounded value for the driver."""
    return df.agg(F.count(F.lit(1))).first()[0]
