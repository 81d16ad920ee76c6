"""An ordered log of edits folded into new metadata: favourites, ordered tag lists and the vocabulary.

The edits of one path and tag make up a function of whether the tag was there.  Such functions are composed
within sorted ranges of the log first, whatever the tag's start, so a path or tag with very many edits is spread over tasks and
leaves one row a range.
"""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Operations of a log and what they do to a member: (kind, change).
OPS = {"favorite": ("favorite", "add"), "unfavorite": ("favorite", "remove"), "toggle_favorite": ("favorite", "toggle"), "tag": ("tag", "add"), "untag": ("tag", "remove"), "toggle_tag": ("tag", "toggle")}
_KEY = ["kind", "path", "item"]
#: Outcome where the member was absent, and where it was there; ``at`` is the edit that put it in, null if it has kept its place.
_OUTCOME = "absent_in boolean, absent_at long, present_in boolean, present_at long"


def _changed(state: tuple[bool, int | None], change: str, seq: int) -> tuple[bool, int | None]:
    there, _ = state
    if change == "remove" or (change == "toggle" and there):
        return False, None
    return state if there else (True, seq)


def _composed(frames):
    """One row for each key of a sorted range."""

    def edits():
        for frame in frames:
            yield from zip(*(frame[c] for c in (*_KEY, "seq", "change")), strict=True)

    for key, rows in itertools.groupby(edits(), key=lambda e: e[:3]):
        absent, present, first = (False, None), (True, None), None
        for *_, seq, change in rows:
            first = seq if first is None else first
            absent, present = _changed(absent, change, seq), _changed(present, change, seq)
        yield (*key, first, *absent, *present)


def _partial(frames):
    for some in itertools.batched(_composed(frames), 10_000):
        out = pd.DataFrame(some, columns=[*_KEY, "first", "absent_in", "absent_at", "present_in", "present_at"])
        yield out.astype({"absent_at": "Int64", "present_at": "Int64"})


def _after(s: Column, t: Column) -> Column:
    """Outcome of the edits ``s`` and then ``t``."""

    def then(there: str, at: str) -> tuple[Column, Column]:
        return F.when(s[there], t["present_in"]).otherwise(t["absent_in"]).alias(there), F.when(s[there], F.coalesce(t["present_at"], s[at])).otherwise(t["absent_at"]).alias(at)

    return F.struct(*then("absent_in", "absent_at"), *then("present_in", "present_at"))


def transforms(log: DataFrame) -> DataFrame:
    """``(kind, path, item, f)``: what the edits ``(seq, kind, path, item, change)`` do to each member, in their order."""
    ranged = log.repartitionByRange(*_KEY, "seq").sortWithinPartitions(*_KEY, "seq", "change")
    parts = ranged.mapInPandas(_partial, f"kind string, path string, item string, first long, {_OUTCOME}")
    # A key that is in several ranges has one row in each.
    steps = parts.groupBy(*_KEY).agg(F.sort_array(F.collect_list(F.struct("first", "absent_in", "absent_at", "present_in", "present_at"))).alias("steps"))
    none = F.struct(F.lit(False).alias("absent_in"), F.lit(None).cast("long").alias("absent_at"), F.lit(True).alias("present_in"), F.lit(None).cast("long").alias("present_at"))
    return steps.select(*_KEY, F.aggregate("steps", none, _after).alias("f"))


def fold_edits(favorites: DataFrame, tags: DataFrame, words: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Favourites ``(path)``, tags ``(path, tags)`` and vocabulary ``(tag)`` after a log ``(seq, path, op, tag, ensure)``.

    Operations are those of ``OPS``.  A tag is trimmed, and a blank one changes nothing.  A tag that is put on is appended to
    the list if it is not there; one that is taken off and put on again comes last.  ``tag`` adds its word to the vocabulary, as does ``toggle_tag`` where
    ``ensure`` is true; no word leaves it.  Paths without tags have no row.  Edits of one ``seq`` are independent, unless they share path and tag.
    Edits with a null seq or path or an unknown op change nothing, and nor does a null tag.  A tag that a base list repeats counts once, at its first place.
    """
    kind, change = (F.create_map(*[F.lit(x) for op, does in OPS.items() for x in (op, does[i])]) for i in (0, 1))
    rows = log.select(F.col("seq").cast("long").alias("seq"), "path", F.try_element_at(kind, F.col("op")).alias("kind"), F.try_element_at(change, F.col("op")).alias("change"), F.trim("tag").alias("tag"), "op", "ensure")
    rows = rows.where("seq is not null and path is not null and kind is not null and (kind = 'favorite' or tag <> '')")
    item = F.when(F.col("kind") == "favorite", F.lit("")).otherwise(F.col("tag"))
    f = transforms(rows.select("seq", "kind", "path", item.alias("item"), "change"))
    listed = tags.select("path", F.posexplode("tags").alias("place", "item")).where("item is not null").groupBy("path", "item").agg(F.min("place").alias("place"))
    base = listed.select(F.lit("tag").alias("kind"), "path", "item", F.col("place").cast("long").alias("place"))
    base = base.unionByName(favorites.select(F.lit("favorite").alias("kind"), "path", F.lit("").alias("item"), F.lit(0).cast("long").alias("place")).where("path is not null").distinct())
    both = base.join(f.hint("merge"), _KEY, "full")
    was = F.col("place").isNotNull()
    there = F.when(F.col("f").isNull(), was).when(was, F.col("f.present_in")).otherwise(F.col("f.absent_in"))
    new = F.when(was, F.col("f.present_at")).otherwise(F.col("f.absent_at"))
    kept = both.where(there).select(*_KEY, F.struct(new.isNotNull().alias("new"), F.coalesce(new, "place").alias("at"), "item").alias("e"))
    lists = kept.where("kind = 'tag'").groupBy("path").agg(F.transform(F.sort_array(F.collect_list("e")), lambda e: e["item"]).alias("tags"))
    named = rows.where("kind = 'tag' and (op = 'tag' or (op = 'toggle_tag' and ensure))").select("tag")
    return kept.where("kind = 'favorite'").select("path"), lists, words.select("tag").union(named).distinct()
