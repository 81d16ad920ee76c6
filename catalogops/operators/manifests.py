"""Plans of file actions: deletion, moves, naming, retention, latest values."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalogops.functions import scalars as S
from catalogops.operators.ranges import running_sum
from catalogops.plans.staging import written


def delete_batch(catalog: DataFrame, outcome: DataFrame) -> DataFrame:
    """The catalog without the paths whose deletion ``(path, ok)`` succeeded."""
    return catalog.join(outcome.where("ok").select("path"), "path", "left_anti")


def move_plan(selection: DataFrame, listing: DataFrame, dest: str) -> DataFrame:
    """``(path, dest_path, status)`` of moves ``(path, ord)`` into a dir: ``conflict`` where the name is taken or an earlier row of the batch has it."""
    rows = selection.withColumn("dest_path", F.concat(F.lit(dest + "/"), S.basename(F.col("path"))))
    taken = listing.select(F.col("path").alias("dest_path"), F.lit(True).alias("taken")).distinct()
    first = F.row_number().over(Window.partitionBy("dest_path").orderBy("ord", "path")) == 1
    return rows.withColumn("first", first).join(taken, "dest_path", "left").select("path", "dest_path", F.when(F.col("taken").isNull() & F.col("first"), "ok").otherwise("conflict").alias("status"))


#: A slot of a name: the stem without its number, and the number. Longer digit runs and leading zeros are no numbers that we give.
SLOT = r"^(.*)-([1-9][0-9]{0,14})$"
_SPACE = ["dir", "stem", "ext"]


def _parts(rows: DataFrame) -> DataFrame:
    """Rows ``(dir, name)`` with the space of the name's numbered forms (dir, stem, ext), and the slot ``n`` of the space ``(dir, up, ext)`` that the name is itself."""
    ext = S.extension(F.col("name"))
    rows = rows.withColumn("stem", S.stem(F.col("name"))).withColumn("ext", ext)
    numbered = F.col("stem").rlike(SLOT) & (F.endswith("name", F.concat(F.lit("."), ext)) | (ext == ""))
    tail = F.regexp_extract("stem", r"((?:-[1-9][0-9]{0,14})*)$", 1)
    rows = rows.withColumn("up", F.when(numbered, F.regexp_extract("stem", SLOT, 1))).withColumn("n", F.when(numbered, F.regexp_extract("stem", SLOT, 2).cast("long")))
    return rows.withColumn("level", F.length(tail) - F.length(F.replace(tail, F.lit("-"), F.lit(""))))


def _blocked(slots: DataFrame) -> DataFrame:
    """``(dir, stem, ext, n, free)`` of the slots that no overflow gets, from rows with ``c``: how many overflows come before the slot's own upload.

    ``free`` counts the free numbers below the slot.  An overflow would reach slot n as the (n - blocked)-th; the slot is blocked if that
    one comes too late.  One number is carried from slot to slot, so each space is one pass over sorted rows.
    """

    def run(frames):
        space, held = None, 0
        for frame in frames:
            keep, free = [], []
            for d, s, e, n, c in zip(frame["dir"], frame["stem"], frame["ext"], frame["n"], frame["c"], strict=True):
                if (d, s, e) != space:
                    space, held = (d, s, e), 0
                keep.append(n - 1 - held >= c)
                if keep[-1]:
                    free.append(n - 1 - held)
                    held += 1
            yield frame[keep].assign(free=free)[[*_SPACE, "n", "free"]]

    rows = slots.select(*_SPACE, "n", "c").repartition(*_SPACE).sortWithinPartitions(*_SPACE, "n")
    return rows.mapInPandas(run, "dir string, stem string, ext string, n long, free long")


def free_names(uploads: DataFrame, taken: DataFrame) -> DataFrame:
    """``(ord, name, stored)``, with ``dir`` if uploads have one: in order of arrival the name itself if free in its dir, else ``stem-n.ext`` with the smallest free n.

    The numbered form has its extension in lower case.  Uploads come in the order of ``ord`` (null first), then of name; none is
    dropped, and rows that are alike are uploads each.  A null name is stored as null.  ``taken`` names of other dirs do not count.

    All numbered forms of a stem are one space of slots.  The first upload of a name has it, if it is not taken; the others overflow
    into the space, and the i-th overflow gets the i-th number that is neither taken nor an earlier upload's own name: ranks and running
    sums over sorted ranges tell it.  A name that is a slot itself may be lost to an overflow, which is settled in the round before: there is one round for
    each number at the end of the longest chain of names.
    """
    has_dir = "dir" in uploads.columns
    place = lambda rows: rows.withColumn("dir", F.coalesce("dir", F.lit(""))) if "dir" in rows.columns else rows.withColumn("dir", F.lit(""))
    asked = place(uploads.select("ord", "name", *(["dir"] if has_dir else [])))
    rows = running_sum(asked.where("name is not null").withColumn("all", F.lit(0)), ["all"], ["ord", "name", "dir"], F.lit(1), "seq").drop("all")
    rows = written(running_sum(_parts(rows), ["dir", "name"], ["seq"], F.lit(1), "nth"), "uploads")
    used = written(_parts(place(taken.select("name", *(["dir"] if "dir" in taken.columns else []))).where("name is not null").distinct()), "taken-names")
    first = rows.where("nth = 1")
    out = [asked.where("name is null").withColumn("stored", F.lit(None).cast("string"))]
    lost = used.select("dir", "name")
    for level in sorted(r.level for r in first.select("level").distinct().collect()):
        mine = rows.where(F.col("level") == level)
        gone = first.where(F.col("level") == level).join(lost.distinct().hint("merge"), ["dir", "name"], "left_semi").select("seq")
        # One row a name, on either side.
        owner = mine.where("nth = 1").join(gone.hint("merge"), "seq", "left_anti")
        over = mine.where("nth > 1").unionByName(mine.where("nth = 1").join(gone.hint("merge"), "seq", "left_semi"))
        out.append(owner.withColumn("stored", F.col("name")))
        over = written(running_sum(over, _SPACE, ["seq"], F.lit(1), "i"), "overflows")
        lost = used.select("dir", "name")
        if over.isEmpty():
            continue
        moved = written(_in_slots(over, first, used), "moved")
        out.append(moved.withColumn("stored", F.concat("stem", F.lit("-"), F.col("slot").cast("string"), F.when(F.col("ext") != "", F.concat(F.lit("."), "ext")).otherwise(""))))
        lost = lost.unionByName(out[-1].select("dir", F.col("stored").alias("name")))
    columns = ["ord", "name", "stored", *(["dir"] if has_dir else [])]
    return functools.reduce(DataFrame.unionByName, [o.select(*columns) for o in out])


def _in_slots(over: DataFrame, first: DataFrame, used: DataFrame) -> DataFrame:
    """Overflows ``(dir, stem, ext, seq, i)`` of one level with the number ``slot`` that each gets."""
    spaces = over.select(*_SPACE).distinct()
    slot = lambda named, c: named.where("n is not null").select("dir", F.col("up").alias("stem"), "ext", "n", c.alias("at"))
    special = slot(used, F.lit(0).cast("long")).unionByName(slot(first, F.col("seq"))).join(spaces.hint("merge"), _SPACE, "left_semi")
    special = special.groupBy(*_SPACE, "n").agg(F.min("at").alias("at"))
    # How many overflows come before each slot's own upload; a taken one is there before all.
    events = over.select(*_SPACE, F.col("seq").alias("at"), F.lit(1).alias("one"), F.lit(None).cast("long").alias("n")).unionByName(special.select(*_SPACE, "at", F.lit(0).alias("one"), "n"))
    counted = running_sum(events, _SPACE, ["at", "one"], F.col("one"), "c").where("one = 0")
    blocked = written(_blocked(counted), "blocked-slots")
    # The i-th overflow passes the blocked slots that have fewer than i free numbers below them.
    marks = over.select(*_SPACE, F.col("i").alias("at"), F.lit(0).alias("one"), "seq").unionByName(blocked.select(*_SPACE, F.col("free").alias("at"), F.lit(1).alias("one"), F.lit(None).cast("long").alias("seq")))
    passed = running_sum(marks, _SPACE, ["at", "one"], F.col("one"), "passed").where("one = 0").select("seq", "passed")
    return over.join(passed.hint("merge"), "seq").withColumn("slot", F.col("i") + F.col("passed"))


def retention(files: DataFrame, budget: int) -> DataFrame:
    """Oldest files to drop so that at most ``budget`` bytes stay: rows ``(key, mtime, size)``; sizes are not negative.

    Sizes are summed by day first, which tells the days that go and the one day
    that is cut.  That day is sorted in ranges, and its running sum runs over the ranges, then within
    each, so no task holds a whole day.  Files without a time or size stay and take no room.
    """
    rows = files.select("key", "mtime", "size", F.col("mtime").cast("date").alias("day")).where("day is not null and size is not null")
    by_day = written(rows.groupBy("day").agg(F.sum("size").alias("bytes")), "days")
    # One row a day: summed in one task, and small enough to broadcast.
    after = F.coalesce(F.sum("bytes").over(Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = by_day.select("day", "bytes", after.alias("after"))
    gone = days.where(F.col("after") > budget)
    # More than the budget stays with this day's bytes, but not without them: the only such day.
    cut = days.where((F.col("after") <= budget) & (F.col("after") + F.col("bytes") > budget))
    whole = rows.join(F.broadcast(gone.select("day")), "day", "left_semi").select("key", "mtime", "size")
    part = rows.join(F.broadcast(cut.select("day", "after")), "day").orderBy(F.desc("mtime"), F.desc("key")).withColumn("range", F.spark_partition_id())
    part = written(part, "cut-day")
    sums = part.groupBy("range").agg(F.sum("size").alias("bytes"))
    newer = sums.select("range", F.coalesce(F.sum("bytes").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("newer"))
    within = F.sum("size").over(Window.partitionBy("range").orderBy(F.desc("mtime"), F.desc("key")).rowsBetween(Window.unboundedPreceding, 0))
    # One row a range: the broadcast is bounded by the number of tasks.
    some = part.withColumn("within", within).join(F.broadcast(newer), "range").where(F.col("after") + F.col("newer") + F.col("within") > budget)
    return whole.unionByName(some.select("key", "mtime", "size"))


def latest(rows: DataFrame, key: str = "key", value: str = "value", ts: str = "ts") -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(value, ts).alias(value))
