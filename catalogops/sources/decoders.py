"""Plug-in points for decoders of file contents: codecs are the user's, Spark deals out the files."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from catalogops.plans.staging import bounded_batches

#: Rows whose results a task holds at a time.
ROWS = 256


def _decoded(files: DataFrame, decode: Callable[[bytes], object], convert: Callable[[object], object], column: str, kind: str, arrow: pa.DataType, content_col: str) -> DataFrame:
    bounded_batches(files.sparkSession)
    kept = [f for f in files.schema.fields if f.name not in (content_col, column)]
    names = [f.name for f in kept]

    def safe(content):
        try:
            found = None if content is None else decode(bytes(content))
            return None if found is None else convert(found)
        except Exception:  # a broken file has no result and stops nothing
            return None

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                piece = batch.slice(low, ROWS)
                found = pa.array([safe(x.as_py()) for x in piece.column(content_col)], arrow)
                yield pa.RecordBatch.from_arrays([*map(piece.column, names), found], [*names, column])
            # Workers are used again by later stages, and do not keep what this one has freed.
            pa.default_memory_pool().release_unused()

    return files.mapInArrow(run, StructType(kept + StructType.fromDDL(f"{column} {kind}").fields))


def rasters(files: DataFrame, decode: Callable[[bytes], Sequence[float]], content_col: str = "content") -> DataFrame:
    """``files`` with ``raster``, an array of numbers, in place of the content; null where there is no content or ``decode`` fails."""
    return _decoded(files, decode, lambda r: [float(x) for x in r], "raster", "array<double>", pa.list_(pa.float64()), content_col)


def raw_tags(files: DataFrame, decode: Callable[[bytes], Mapping[str, str]], content_col: str = "content") -> DataFrame:
    """``files`` with ``raw_tags``, a map of strings, in place of the content; null where there is no content or ``decode`` fails."""
    return _decoded(files, decode, lambda t: [(str(k), None if v is None else str(v)) for k, v in t.items()], "raw_tags", "map<string,string>", pa.map_(pa.string(), pa.string()), content_col)
