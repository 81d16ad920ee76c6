"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)
#: Bytes of one text column that a Python task works on at a time; a single longer text is still whole.
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; the built-in lower() does that on ASCII text."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def lower_az(text: str) -> str:
    """Python's counterpart of :func:`ascii_lower`."""
    return text.lower() if text.isascii() else text.translate(ASCII_LOWER)


def free_prefix(df: DataFrame) -> str:
    """A prefix that no column of ``df`` has, for names of an operator's own columns."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def lowest(df: DataFrame, chance: Column, rows: int, *order: str) -> DataFrame:
    """At most ``rows`` rows of ``df``, those with the lowest 64-bit hash ``chance`` (ties by ``order``).

    The count of all rows bounds the hash first, so that all tasks together sort little more than ``rows`` rows.
    """
    mark = free_prefix(df) + "chance"
    marked = df.withColumn(mark, chance)
    share = (1.2 * rows + 400) / max(marked.count(), 1)
    if share < 1:
        marked = marked.where(F.col(mark) <= F.lit(int(-(2**63) + share * 2**64)))
    return marked.orderBy(mark, *order).limit(rows).drop(mark)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that ``column`` has at most ``limit`` bytes a piece, or one row."""
    if batch.num_rows <= 1 or batch.column(column).nbytes <= limit:
        if batch.num_rows:
            yield batch
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)


def bounded_batches(spark: SparkSession) -> None:
    """Let Spark hand batches of at most ``SLICE_BYTES`` (or one row) to Python in this session, if it would hand larger ones."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("b")  # a user's own setting with a unit stays
    if now.isdigit() and int(now) > SLICE_BYTES:
        spark.conf.set(key, str(SLICE_BYTES))


def with_arrow(df: DataFrame, added: str, text: str, work: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]], drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the columns ``added`` (a DDL string) that a Python function gives for each batch.

    ``work()`` runs once a task and returns that function, so models and
    caches live as long as the task.  A column of ``df`` that bears an added
    name is replaced; those in ``drop`` go after use; all others pass through.
    """
    bounded_batches(df.sparkSession)
    new = StructType.fromDDL(added)
    kept = [f for f in df.schema.fields if f.name not in new.names and f.name not in drop]
    schema = StructType(kept + new.fields)
    names = [f.name for f in kept]

    def run(batches):
        each = work()
        for batch in batches:
            for piece in slices(batch, text):
                got = each(piece)
                yield pa.RecordBatch.from_arrays([piece.column(n) for n in names] + got, names + new.names)
            # Workers are used again by later stages, and do not keep what this one has freed.
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once a row, not once for every element of a lambda inside ``use``."""
    return F.get(F.transform(F.array(value), use), 0)
