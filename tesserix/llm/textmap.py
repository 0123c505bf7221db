"""Arrow-batched maps over whole texts: a bounded slice of a batch is turned to Python at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of an Arrow batch, and rows of it that are Python objects at the same time.
BATCH_ROWS, SLICE = 1000, 128
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def whole_texts(docs: DataFrame) -> DataFrame:
    """docs, with batches to Python of BATCH_ROWS rows at most, as rows are wide; a session that sets a number of its own keeps it."""
    conf = docs.sparkSession.conf
    if conf.get(_BATCH) == "10000":
        conf.set(_BATCH, str(BATCH_ROWS))
    return docs


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same map; at the end of a task its worker, which Spark keeps for later tasks, gives free memory back."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not every C library has it
                pass

    return tidied


def map_batches(docs: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    return whole_texts(docs).mapInArrow(tidy(run), schema)


def map_texts(docs: DataFrame, schema: str, make: Callable[[], Callable[..., Iterator[tuple]]], cols: tuple[str, ...] = ("doc_id", "text"), chunk: int = 4096) -> DataFrame:
    """Rows that make()(*values of cols) yields for every row; make runs once a task."""
    out = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each, arrow = make(), to_arrow_schema(out)
        types = [f.type for f in arrow]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], schema=arrow)

        rows: list[tuple] = []
        for part in slices(batches):
            for values in zip(*(part.column(k).to_pylist() for k in range(part.num_columns))):
                rows.extend(each(*values))
            if len(rows) >= chunk:
                yield made(rows)
                rows = []
        if rows:
            yield made(rows)

    return map_batches(docs.select(*cols), run, out)
