"""Python work on texts inside Spark tasks, in Arrow batches, and the bounded samples that models are fitted on."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS_AT_ONCE = 256
ARROW_BYTES = 8 << 20


@contextmanager
def small_batches(spark: SparkSession, size: int = ARROW_BYTES):
    """Jobs inside hand rows to Python in Arrow batches of about ``size`` bytes; the session's own limit is 64 MB for each side of each task."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def map_texts(
    docs: DataFrame, fn: Callable[[list[str]], dict[str, Sequence]], schema: str, keep: Sequence[str] = ("doc_id",), text: str = "text"
) -> DataFrame:
    """``keep`` columns of every row and the columns ``fn`` makes of the texts; a NULL text is the empty one.

    ``fn`` gets the texts of a few hundred rows and returns a sequence of that length for each column of ``schema``.
    """
    made = T._parse_datatype_string(schema)
    fields = [docs.schema[c] for c in keep]
    out = T.StructType([*fields, *made.fields])
    kinds = [to_arrow_type(f.dataType) for f in made.fields]
    names = [f.name for f in out.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                cols = fn([t or "" for t in part.column(len(fields)).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(len(fields))), *(pa.array(cols[f.name], k) for f, k in zip(made.fields, kinds))], names=names
                )

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, out)


def with_labels(docs: DataFrame, labels: DataFrame, kept: Sequence[str] = ("doc_id", "text")) -> DataFrame:
    """Documents of a bounded sample of labels; its bound is what makes the broadcast safe."""
    return docs.select(*kept).join(F.broadcast(labels), "doc_id")
