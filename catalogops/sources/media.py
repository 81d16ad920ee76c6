"""A batch data source that lists media trees, and the sidecars in them.

Spark's own file listing hides names that start with ``_`` or ``.``; this one
skips only dot names (unless asked), keeps empty files, does not follow links and reports unreadable dirs as rows.
"""

from __future__ import annotations

import dataclasses
import errno
import functools
import hashlib
import itertools
import json
import os
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from catalogops.functions import scalars as S
from catalogops.operators import duplicates as D
from catalogops.operators.metadata import placed_entries
from catalogops.plans.staging import written

#: Bytes of a file that are held at a time.
PIECE = 1 << 20


class _Dir(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"].rstrip("/")
        self.dots = options.get("include_dot", "false").lower() == "true"

    def partitions(self):
        try:
            below = [e.path for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False) and (self.dots or not e.name.startswith("."))]
        except OSError:
            below = []
        return [_Dir(self.root, False), *(_Dir(p, True) for p in sorted(below))]

    def read(self, partition):
        todo = [partition.path]
        while todo:
            here = todo.pop()
            try:
                entries = sorted(os.scandir(here), key=lambda e: e.name)
            except OSError as e:
                yield (here, os.path.basename(here), None, None, "error", errno.errorcode.get(e.errno, type(e).__name__))
                continue
            for e in entries:
                if e.name.startswith(".") and not self.dots:
                    continue
                if e.is_dir(follow_symlinks=False):
                    if partition.deep:
                        todo.append(e.path)
                elif e.is_file(follow_symlinks=False):
                    try:
                        stat = e.stat(follow_symlinks=False)
                    except OSError:  # it went after the listing
                        continue
                    yield (e.path, e.name, stat.st_size, int(stat.st_mtime * 1000), "file", None)


class MediaTree(DataSource):
    """``spark.read.format("media_tree").load(root)``: one task for each directory below the root."""

    @classmethod
    def name(cls):
        return "media_tree"

    def schema(self):
        return "path string, name string, size long, mtime_ms long, status string, error string"

    def reader(self, schema):
        return _Reader(self.options)


_WALK = "path string, name string, size long, mtime_ms long, status string, error string"


def _listed(here: str, dots: bool):
    """Rows of one dir: its files, the dirs in it, or why it cannot be read; links are not followed."""
    if "://" in here:
        yield from _listed_in_store(here, dots)
        return
    try:
        entries = sorted(os.scandir(here), key=lambda e: e.name)
    except OSError as e:
        yield here, os.path.basename(here), None, None, "error", errno.errorcode.get(e.errno, type(e).__name__)
        return
    for e in entries:
        if e.name.startswith(".") and not dots:
            continue
        if e.is_dir(follow_symlinks=False):
            yield e.path, e.name, None, None, "dir", None
        elif e.is_file(follow_symlinks=False):
            try:
                stat = e.stat(follow_symlinks=False)
            except OSError:  # it went after the listing
                continue
            yield e.path, e.name, stat.st_size, int(stat.st_mtime * 1000), "file", None


def _listed_in_store(here: str, dots: bool):
    """The same for a dir that a URI names."""
    from pyarrow import fs

    try:
        store, inside = fs.FileSystem.from_uri(here)
        infos = sorted(store.get_file_info(fs.FileSelector(inside)), key=lambda i: i.base_name)
    except OSError as e:
        yield here, here.rsplit("/", 1)[-1], None, None, "error", errno.errorcode.get(e.errno, type(e).__name__)
        return
    scheme = here.removesuffix(inside)
    for i in infos:
        if i.base_name.startswith(".") and not dots:
            continue
        if i.type == fs.FileType.Directory:
            yield scheme + i.path, i.base_name, None, None, "dir", None
        elif i.type == fs.FileType.File:
            yield scheme + i.path, i.base_name, i.size, None if i.mtime_ns is None else i.mtime_ns // 1_000_000, "file", None


def scan(spark: SparkSession, root: str, include_dot: bool = False) -> DataFrame:
    """Files and unreadable dirs below a root, in the columns of :class:`MediaTree`.

    The tree is walked level by level.  The dirs of a level are dealt out anew, so one deep or wide branch is shared by
    all tasks; each level is written, and its dirs never come to the driver.
    """

    def listed(frames):
        for frame in frames:
            yield pd.DataFrame([r for d in frame["dir"] for r in _listed(d, include_dot)], columns=["path", "name", "size", "mtime_ms", "status", "error"]).astype({"size": "Int64", "mtime_ms": "Int64"})

    level = spark.createDataFrame([(root.rstrip("/") or "/",)], "dir string")
    levels = []
    while not levels or not level.isEmpty():
        levels.append(written(level.repartition("dir").mapInPandas(listed, _WALK), "walk"))
        level = levels[-1].where("status = 'dir'").select(F.col("path").alias("dir"))
    return functools.reduce(DataFrame.unionByName, levels).where("status <> 'dir'")


def catalog(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Files ``(name, path, type)`` of the catalog's formats, and errors ``(dir, code)``."""
    rows = scan(spark, root)
    files = rows.where(F.col("status") == "file").where(S.extension(F.col("name")).isin(*S.CATALOG))
    return files.select("name", "path", S.media_type(F.col("name")).alias("type")), rows.where(F.col("status") == "error").select(F.col("path").alias("dir"), F.col("error").alias("code"))


def file_info(spark: SparkSession, root: str) -> DataFrame:
    return scan(spark, root).where(F.col("status") == "file").select("path", "size", "mtime_ms")


def duplicate_candidates(spark: SparkSession, roots: list[str], kind: str = "images") -> DataFrame:
    """Paths ``(path, size)`` of the duplicate profile, case-sensitive, each once over all roots."""
    formats = S.DEDUPE_IMAGES if kind == "images" else S.DEDUPE_VIDEOS
    rows = [scan(spark, r).where(F.regexp_extract("name", r"\.([^.]+)$", 1).isin(*formats) & (F.col("status") == "file")).select("path", "size") for r in roots]
    from catalogops.operators.catalog import union_scans

    return union_scans(rows, "path")


def duplicate_files(spark: SparkSession, roots: list[str], include_videos: bool = True) -> DataFrame:
    """``(hash, path)`` of files of equal content below the roots: candidates, sizes that repeat, digests, groups.

    Only files whose size repeats are opened.
    """
    return D.duplicate_groups(digests(hash_candidates(spark, roots, include_videos).repartition("path")))


def hash_candidates(spark: SparkSession, roots: list[str], include_videos: bool = True) -> DataFrame:
    """``(path, size)`` of the files of the duplicate profile that have to be digested."""
    kinds = ["images", "videos"] if include_videos else ["images"]
    files = written(functools.reduce(DataFrame.unionByName, [duplicate_candidates(spark, roots, k) for k in kinds]), "duplicate-candidates")
    return files.where(D.may_repeat(F.col("size"), D.size_sketch(files)))


def _content(path: str):
    """A file to read, on a local disk or in any store that its URI names."""
    if "://" not in path:
        return open(path, "rb")
    from pyarrow import fs

    store, inside = fs.FileSystem.from_uri(path)
    return store.open_input_stream(inside)


def digests(files: DataFrame) -> DataFrame:
    """``(path, hash)``: SHA-256 of each file, read in pieces by the task that holds its path; unreadable files are left out."""

    def one(path):
        whole = hashlib.sha256()
        try:
            with _content(path) as f:
                while piece := f.read(PIECE):
                    whole.update(piece)
        except OSError:
            return None
        return whole.hexdigest()

    def run(frames):
        for frame in frames:
            out = frame[["path"]].assign(hash=frame["path"].map(one))
            yield out[out["hash"].notna()]

    return files.select("path").mapInPandas(run, "path string, hash string")


def sidecars(spark: SparkSession, root: str | list[str], name: str) -> DataFrame:
    """``(dir, json)`` of every file of a (dot) name below a root, or once below any of several; each task reads its own files, unreadable ones are left out."""
    found = [scan(spark, r, include_dot=True).where((F.col("name") == name) & (F.col("status") == "file")).select("path") for r in ([root] if isinstance(root, str) else root)]
    rows = found[0] if len(found) == 1 else functools.reduce(DataFrame.union, found).distinct()

    def text(path):
        try:
            with open(path, encoding="utf-8", errors="replace") as f:
                return f.read()
        except OSError:
            return None

    def read(frames):
        for frame in frames:
            frame["dir"] = frame["path"].map(os.path.dirname)
            frame["json"] = frame["path"].map(text)
            yield frame.loc[frame["json"].notna(), ["dir", "json"]]

    return rows.mapInPandas(read, "dir string, json string")


@dataclasses.dataclass
class _Files(WriterCommitMessage):
    """Files that a task has written, as (part, final path)."""

    parts: list[tuple[str, str]]


class _SidecarWriter(DataSourceWriter):
    """Streams sorted entries into one part file a dir; the parts take their final names when all tasks are done."""

    def __init__(self, options):
        self.name = options["name"]
        self.words = json.loads(options["words"])
        self.job = uuid.uuid4().hex

    def write(self, rows):
        done = []
        try:
            for dir_, entries in itertools.groupby(rows, key=lambda r: r.dir):
                part = os.path.join(dir_, f"{self.name}.{self.job}.{uuid.uuid4().hex}.part")
                done.append((part, os.path.join(dir_, self.name)))
                with open(part, "w", encoding="utf-8") as f:
                    self._put(f, entries)
        except BaseException:
            self._drop(done)
            raise
        return _Files(done)

    def _put(self, f, entries):
        """Favourites come before tags, each sorted; only the entry at hand is held."""
        quoted = lambda x: json.dumps(x, ensure_ascii=False)
        f.write('{"version":1,"favorites":[')
        state, first, last = "f", True, None
        for r in entries:
            if r.kind == "d" or (r.kind, r.rel) == last:
                continue
            last = (r.kind, r.rel)
            if r.kind != state:
                f.write('],"tags":{')
                state, first = r.kind, True
            f.write(("" if first else ",") + quoted(r.rel) + (":" + quoted(r.tags) if state == "t" else ""))
            first = False
        f.write(("" if state == "t" else '],"tags":{') + '},"tagNames":' + quoted(self.words) + "}")

    def _drop(self, parts):
        for part, _ in parts:
            if os.path.exists(part):
                os.remove(part)

    def commit(self, messages):
        for m in messages:
            for part, final in m.parts if m else ():
                os.replace(part, final)

    def abort(self, messages):
        for m in messages:
            self._drop(m.parts if m else ())


class SidecarFiles(DataSource):
    """``df.write.format("sidecar_files")``: rows ``(dir, kind, rel, tags)`` sorted by dir, kind and rel, as one JSON file a dir."""

    @classmethod
    def name(cls):
        return "sidecar_files"

    def schema(self):
        return "dir string, kind string, rel string, tags array<string>"

    def writer(self, schema, overwrite):
        return _SidecarWriter(self.options)


def save_sidecars(favorites: DataFrame, tags: DataFrame, words: DataFrame, roots: DataFrame, existing: DataFrame, name: str) -> None:
    """Write the sidecars of ``metadata.save_plan``, streamed from sorted entries, so that an owner of very many files takes no more memory than one of few.

    All files take their names when every task is done; a lost task, or a job that fails before, leaves the old ones.  The
    vocabulary is sent to each task.
    """
    spark = favorites.sparkSession
    spark.dataSource.register(SidecarFiles)
    known = sorted(r.tag for r in words.where("tag is not null").select("tag").distinct().collect())
    rows = placed_entries(favorites, tags, roots, existing).select("dir", "kind", "rel", "tags")
    # A dir's rows meet in one task, sorted: the file is written as they come.
    rows = rows.repartition("dir").sortWithinPartitions("dir", "kind", "rel")
    rows.write.format("sidecar_files").option("name", name).option("words", json.dumps(known)).mode("append").save()


def write_sidecars(plan: DataFrame, name: str) -> None:
    """Write each ``(dir, json)`` of a save plan; a file is replaced as a whole, so that a lost task leaves the old one."""

    def put(rows):
        for r in rows:
            part = os.path.join(r.dir, f"{name}.{uuid.uuid4().hex}")
            with open(part, "w", encoding="utf-8") as f:
                f.write(r.json)
            os.replace(part, os.path.join(r.dir, name))

    plan.foreachPartition(put)
