"""Line dedup with levelled sorted runs of line hashes.

Each batch of documents gives one run: a table of line hashes with the number
of documents that have the line, bucketed and sorted by hash.  A new batch is
merge-anti-joined with the runs of lines that are already known to be
frequent, and what is left becomes a run of level 0.  When a level is full
its runs are compacted into one run of the next level, and the lines that
have become frequent leave for a run of their own.
"""

from __future__ import annotations

import functools
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogops.llm.common import free_prefix, lower_az, slices, with_arrow
from catalogops.llm.exact_dedup import misra_gries
from catalogops.plans.staging import discard_path, scratch_path, written

#: What is stripped from both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
MIN_DOCS = 10
BATCHES = 4
FANOUT = 2
#: A key with over 2/HOT of all lines is met by a broadcast; also the most keys that are broadcast.
HOT = 1024


def line_key(line: str) -> str:
    return lower_az(line.strip(BLANKS))


class LineRuns:
    """Levelled sorted runs of ``(k, n)``: a line's 128-bit hash and its number of documents."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = FANOUT):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []
        self.frequent: list[DataFrame] = []
        self.names: list[tuple[str, str]] = []

    def _run(self, rows: DataFrame) -> DataFrame:
        name = f"line_run_{uuid.uuid4().hex}"
        rows = rows.repartition(self.buckets, "k")
        path = scratch_path(self.spark, name)
        rows.write.bucketBy(self.buckets, "k").sortBy("k").option("path", path).saveAsTable(name)
        self.names.append((name, path))
        return self.spark.table(name)

    def add(self, lines: DataFrame) -> None:
        """Take in a batch: one row ``k`` for each line hash and document of the batch."""
        fresh = lines.groupBy("k").agg(F.count("*").alias("n"))
        for run in self.frequent:
            # Not "left_anti": the optimizer moves that below the aggregate, and then a hot line's rows all meet in one task uncombined.
            fresh = fresh.join(run.select("k", F.lit(True).alias("known")).hint("merge"), "k", "left").where("known IS NULL").drop("known")
        self._push(0, self._run(fresh))

    def _push(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            self._push(level + 1, self._compact(runs))

    def _compact(self, runs: list[DataFrame]) -> DataFrame:
        both = functools.reduce(DataFrame.unionByName, runs).groupBy("k").agg(F.sum("n").alias("n"))
        merged = written(both, "line-run-merged")
        self.frequent.append(self._run(merged.where(F.col("n") >= self.min_docs)))
        return self._run(merged.where(F.col("n") < self.min_docs))

    def keys(self) -> DataFrame:
        """``k`` of every line found in at least ``min_docs`` documents of all batches."""
        runs = [run for level in self.levels for run in level]
        rest = functools.reduce(DataFrame.unionByName, runs).groupBy("k").agg(F.sum("n").alias("n")).where(F.col("n") >= self.min_docs)
        return functools.reduce(DataFrame.unionByName, [run.select("k") for run in self.frequent], rest.select("k"))


    def close(self) -> None:
        """Drop the runs' tables, whose keys have been written elsewhere."""
        for name, path in self.names:
            self.spark.sql(f"DROP TABLE {name}")
            discard_path(self.spark, path)


def _lines(rows: DataFrame, min_chars: int) -> DataFrame:
    """``(__id, __tag, at, k, first)`` for each line whose key is long enough; first: the document's first such line."""

    def run(batches):
        for batch in batches:
            for piece in slices(batch, "__text"):
                ids, tags, ats, keys, firsts = [], [], [], [], []
                for i, t, text in zip(*(piece.column(c).to_pylist() for c in ("__id", "__tag", "__text"))):
                    seen = set()
                    for at, line in enumerate((text or "").split("\n")):
                        key = line_key(line)
                        if len(key) >= min_chars:
                            digest = hashlib.md5(key.encode(), usedforsecurity=False).digest()
                            ids.append(i), tags.append(t), ats.append(at), keys.append(digest), firsts.append(digest not in seen)
                            seen.add(digest)
                yield pa.RecordBatch.from_pydict(
                    {"__id": pa.array(ids, pa.int64()), "__tag": pa.array(tags, pa.int64()), "at": pa.array(ats, pa.int32()), "k": pa.array(keys, pa.binary()), "first": pa.array(firsts, pa.bool_())}
                )

    return rows.mapInArrow(run, "__id long, __tag long, at int, k binary, first boolean")


def _drop_work(text_name: str, drop_name: str):
    def each(batch: pa.RecordBatch) -> list[pa.Array]:
        texts, counts, gone = [], [], []
        for text, drop in zip(batch.column(text_name).to_pylist(), batch.column(drop_name).to_pylist()):
            lines = (text or "").split("\n")
            drop = set(drop or ())
            texts.append("\n".join(x for i, x in enumerate(lines) if i not in drop) if drop else text)
            counts.append(len(lines))
            gone.append(len(drop))
        return [pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64())]

    return each


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = 1, batches: int = BATCHES, fanout: int = FANOUT
) -> DataFrame:
    """``docs`` without the lines found in at least ``min_docs`` documents, plus ``n_lines`` (before) and ``n_dropped``.

    A line's key is the line stripped of ASCII white space with A-Z lower-cased; keys shorter than ``min_chars`` are never
    dropped.  Every row counts as a document, also one that repeats another's
    id.  A null text has one empty line and stays null; a text that loses all
    lines becomes empty.  Columns named ``n_lines`` or ``n_dropped`` are
    replaced.  An empty table gives no rows.
    """
    own = free_prefix(docs)
    id_, tag, text, key, gone = (own + x for x in ("id", "tag", "text", "key", "drop"))
    tagged = docs.select("*", F.col(id_col).cast("long").alias(id_), F.xxhash64(text_col).alias(tag), F.col(text_col).alias(text))
    batch = F.pmod(F.xxhash64("__id"), F.lit(batches)).cast("int").alias("batch")
    rows = tagged.select(F.col(id_).alias("__id"), F.col(tag).alias("__tag"), F.col(text).alias("__text"))
    lines = written(_lines(rows, min_chars).select("*", batch), "lines", "batch")
    runs = LineRuns(docs.sparkSession, min_docs, fanout)
    for b in range(batches):
        runs.add(lines.where((F.col("batch") == b) & F.col("first")).select("k"))
    frequent = written(runs.keys(), "frequent-lines")
    runs.close()
    drop = (
        _frequent_lines(lines, frequent)
        .groupBy(F.coalesce("__id", F.lit(-(2**63))).alias(key), F.col("__tag").alias(tag))
        .agg(F.collect_set("at").alias(gone))
    )
    # Equal texts under one id give the same numbers, so a set of them serves each of those rows.
    joined = tagged.withColumn(key, F.coalesce(id_, F.lit(-(2**63)))).join(drop.hint("shuffle_hash"), [key, tag], "left").drop(key, tag, id_, text_col)
    out = with_arrow(joined, f"`{text_col}` string, n_lines long, n_dropped long", text, lambda: _drop_work(text, gone), drop=(text, gone))
    return out.select(*docs.columns, *[c for c in ("n_lines", "n_dropped") if c not in docs.columns])


def _frequent_lines(lines: DataFrame, frequent: DataFrame) -> DataFrame:
    """The rows of ``lines`` with a key of ``frequent``; keys of very many rows are met by a broadcast of at most ``HOT`` keys, the others by a shuffle."""
    total = lines.count()
    maybe = misra_gries(lines, "k", HOT).where(F.col("seen") * HOT >= total).select("k")
    hot = written(maybe.join(frequent.hint("merge"), "k", "left_semi"), "hot-lines")
    rest = lines.join(F.broadcast(hot), "k", "left_anti")
    return lines.join(F.broadcast(hot), "k", "left_semi").unionByName(rest.join(frequent.hint("merge"), "k", "left_semi"))
