"""Arrow helpers shared by the operators written as ``mapInArrow`` functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows handled at once inside a batch; bounds the memory that long texts take.
SLICE_ROWS = 256


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], list], schema: str) -> DataFrame:
    """Apply ``fn`` to slices of Arrow batches; it returns the columns of ``schema``."""
    struct = StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)

    def run(batches):
        for part in slices(batches):
            columns = fn(part)
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
            )

    return df.mapInArrow(run, struct)


def texts(df: DataFrame, *extra: str) -> DataFrame:
    """doc_id and the whole text, null read as empty."""
    return df.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *extra)
