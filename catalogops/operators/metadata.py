"""Favourites and tags in hierarchical sidecar files: merge, edits and write-back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, MapType, StringType, StructField, StructType

from catalogops.functions import scalars as S
from catalogops.plans.staging import written

SIDECAR = StructType(
    [
        StructField("version", IntegerType()),
        StructField("favorites", ArrayType(StringType())),
        StructField("tags", MapType(StringType(), ArrayType(StringType()))),
        StructField("tagNames", ArrayType(StringType())),
    ]
)


def parse_sidecars(files: DataFrame) -> DataFrame:
    """``(dir, data)`` from ``(dir, json)``; what is no JSON object is left out, and in an object fields of another type are null."""
    whole = F.try_parse_json(F.col("json"))
    return files.where(F.startswith(F.schema_of_variant(whole), F.lit("OBJECT"))).select("dir", F.from_json("json", SIDECAR).alias("data")).where("data is not null")


def merged_favorites(sidecars: DataFrame) -> DataFrame:
    """Every path that any sidecar names a favourite."""
    rows = sidecars.select("dir", F.explode("data.favorites").alias("p"))
    return rows.select(S.resolve_path(F.col("dir"), F.col("p")).alias("path")).distinct()


def merged_tags(sidecars: DataFrame) -> DataFrame:
    """``(path, tags)``: the list of the sidecar with the shortest dir, whole; of equal lengths the smallest dir."""
    rows = sidecars.select("dir", F.explode("data.tags").alias("p", "tags"))
    rows = rows.select("dir", "tags", S.resolve_path(F.col("dir"), F.col("p")).alias("path"))
    return rows.groupBy("path").agg(F.min_by("tags", F.struct(F.length("dir"), "dir")).alias("tags"))


def vocabulary(sidecars: DataFrame) -> DataFrame:
    return sidecars.select(F.explode("data.tagNames").alias("tag")).distinct()


def load_metadata(sidecars: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    return merged_favorites(sidecars), merged_tags(sidecars), vocabulary(sidecars)


#: Words of a vocabulary that are put into every row by a broadcast; a larger one is joined by a shuffle.
BROADCAST_WORDS = 100_000


def _owning_dirs(roots: DataFrame, existing: DataFrame) -> DataFrame:
    """``(dir, existing, ord, last)``: roots and dirs with a sidecar below them, the root's place, and the place of the last root that holds the dir."""
    if "ord" not in roots.columns:
        roots = roots.select("root", F.col("root").alias("ord"))
    both = existing.select("dir", F.lit(True).alias("existing"), F.lit(None).cast(dict(roots.dtypes)["ord"]).alias("ord"))
    both = both.unionByName(roots.select(F.col("root").alias("dir"), F.lit(False).alias("existing"), "ord")).where("dir is not null")
    dirs = both.groupBy("dir").agg(F.max("existing").alias("existing"), F.min("ord").alias("ord"))
    above = dirs.select("*", F.explode(S.ancestors(F.col("dir"))).alias("root"))
    holds = above.join(roots.groupBy("root").agg(F.min("ord").alias("at")).hint("merge"), "root")
    return holds.groupBy("dir").agg(F.first("existing").alias("existing"), F.first("ord").alias("ord"), F.max("at").alias("last"))


def _owners(holders: Column) -> Column:
    """For the dirs that hold a place, outermost first: what each root among them makes the owner."""

    def owner(r: Column) -> Column:
        near = F.filter(holders, lambda d: (d["n"] >= r["n"]) & (d["existing"] | (d["n"] == r["n"]) | F.coalesce(d["ord"] < r["ord"], F.lit(False))))
        return F.struct(r["ord"].alias("root"), r["dir"].alias("root_dir"), F.element_at(near, -1).alias("owner"))

    return F.transform(F.filter(holders, lambda d: d["ord"].isNotNull()), owner)


def placed_entries(favorites: DataFrame, tags: DataFrame, roots: DataFrame, existing: DataFrame) -> DataFrame:
    """``(dir, kind, rel, tags)``: each favourite (``f``) and tag list (``t``) in the sidecars that it goes to, and a row ``d`` for every sidecar to write.

    Roots are saved one after another, in the order of ``ord`` or else of their paths.  Within a root an entry goes to the deepest dir
    that has a sidecar by then, else to the root itself, so one below nested roots can be in a sidecar of each; what is there in the end is what
    the last root to hold a dir has written.  A root without a sidecar gets one only if its own save has something for it.
    The owner is found once for each dir that has files, so no file's row is multiplied by its depth.
    """
    dirs = written(_owning_dirs(roots, existing), "owning-dirs")
    entries = favorites.select("path", F.lit("f").alias("kind"), F.lit(None).cast("array<string>").alias("tags"))
    entries = entries.unionByName(tags.where(F.size("tags") > 0).select("path", F.lit("t").alias("kind"), "tags")).withColumn("parent", S.dirname(F.col("path")))
    above = entries.select("parent").distinct().select("parent", F.explode(S.ancestors(F.col("parent"))).alias("dir"))
    held = above.join(dirs.hint("merge"), "dir").groupBy("parent").agg(F.sort_array(F.collect_list(F.struct(F.length("dir").alias("n"), "dir", "existing", "ord", "last"))).alias("h"))
    held = held.select("parent", _owners(F.col("h")).alias("o"))
    final = F.transform(F.filter("o", lambda o: o["root"] == o["owner"]["last"]), lambda o: o["owner"]["dir"])
    made = F.transform(F.filter("o", lambda o: o["root_dir"] == o["owner"]["dir"]), lambda o: o["root_dir"])
    held = written(held.select("parent", final.alias("final"), made.alias("made")), "owned-dirs")
    out = entries.join(held.select("parent", "final").hint("merge"), "parent").select("path", "kind", "tags", F.explode("final").alias("dir"))
    out = out.select("dir", "kind", S.relative_path(F.col("dir"), F.col("path")).alias("rel"), "tags")
    files = held.select(F.explode("made").alias("dir")).union(dirs.where("existing").select("dir")).distinct()
    return out.unionByName(files.select("dir", F.lit("d").alias("kind"), F.lit(None).cast("string").alias("rel"), F.lit(None).cast("array<string>").alias("tags")))


def save_plan(favorites: DataFrame, tags: DataFrame, words: DataFrame, roots: DataFrame, existing: DataFrame) -> DataFrame:
    """``(dir, json)``: the sidecar to write in each owner dir, as in :func:`placed_entries`.

    Entries outside the roots and empty tag lists are skipped, and so are sidecars outside them.  The sorted vocabulary is copied to every file.  A
    sidecar is one row; ``media.save_sidecars`` writes the same files from sorted entries, without such rows.
    """
    entries = placed_entries(favorites, tags, roots, existing)
    fav = F.sort_array(F.collect_set(F.when(F.col("kind") == "f", F.col("rel")))).alias("favorites")
    tag = F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("kind") == "t", F.struct("rel", "tags"))))).alias("tags")
    rows = entries.groupBy("dir").agg(fav, tag)
    names = written(words.where("tag is not null").agg(F.sort_array(F.collect_set("tag")).alias("tagNames")).select("tagNames", F.lit(0).alias("one")), "vocabulary")
    few = names.where(F.size("tagNames") <= BROADCAST_WORDS).count() > 0
    rows = rows.withColumn("one", F.lit(0)).join(names.hint("broadcast" if few else "merge"), "one")
    return rows.select("dir", F.to_json(F.struct(F.lit(1).alias("version"), "favorites", "tags", "tagNames")).alias("json"))


def toggled(favorites: DataFrame, log: DataFrame) -> DataFrame:
    """Favourites after toggles ``(path)``: an odd number flips membership."""
    flips = log.groupBy("path").agg((F.count("*") % 2).alias("odd"))
    base = favorites.select("path", F.lit(1).alias("base")).distinct()
    return base.join(flips, "path", "full").where(F.coalesce("base", F.lit(0)).bitwiseXOR(F.coalesce("odd", F.lit(0)).cast("int")) == 1).select("path")


def toggle_tag(tags: DataFrame, paths: DataFrame, tag: str) -> DataFrame:
    """Tag lists after the tag is removed where present and appended where not; empty lists go."""
    rows = tags.join(paths.select("path", F.lit(True).alias("hit")).distinct(), "path", "full")
    now = F.coalesce("tags", F.array().cast("array<string>"))
    new = F.when(F.col("hit").isNull(), now).when(F.array_contains(now, tag), F.array_remove(now, tag)).otherwise(F.array_append(now, F.lit(tag)))
    return rows.select("path", new.alias("tags")).where(F.size("tags") > 0)


def batch_tag(tags: DataFrame, paths: DataFrame, tag: str) -> DataFrame:
    """Tag lists with the trimmed tag appended where it is missing; a blank tag changes nothing."""
    tag = tag.strip()
    if not tag:
        return tags.select("path", "tags")
    rows = tags.join(paths.select("path", F.lit(True).alias("hit")).distinct(), "path", "full")
    now = F.coalesce("tags", F.array().cast("array<string>"))
    return rows.select("path", F.when(F.col("hit").isNull() | F.array_contains(now, tag), now).otherwise(F.array_append(now, F.lit(tag))).alias("tags"))


def extended_vocabulary(words: DataFrame, tag: str) -> DataFrame:
    """The vocabulary ``(tag)`` after a batch was given a tag; a blank tag changes nothing."""
    tag = tag.strip()
    return words.select("tag").union(words.sparkSession.createDataFrame([(tag,)] if tag else [], "tag string")).distinct()


def set_membership(base: DataFrame, paths: DataFrame, on: bool) -> DataFrame:
    return base.select("path").union(paths.select("path")).distinct() if on else base.select("path").distinct().join(paths.select("path"), "path", "left_anti")


def apply_edits(base: DataFrame, log: DataFrame) -> DataFrame:
    """Members ``(path, item)`` after an ordered log ``(seq, path, item, op)`` of add, remove and toggle.

    For each member the last add or remove counts, then the parity of the toggles after it.
    """
    log = log.select("seq", "path", "item", "op")
    last = log.where("op <> 'toggle'").groupBy("path", "item").agg(F.max("seq").alias("at"), F.max_by("op", "seq").alias("set"))
    flips = log.where("op = 'toggle'").join(last, ["path", "item"], "left").where(F.col("at").isNull() | (F.col("seq") > F.col("at")))
    odd = flips.groupBy("path", "item").agg((F.count("*") % 2).cast("int").alias("odd"))
    known = base.select("path", "item", F.lit(1).alias("base")).distinct()
    rows = known.join(last, ["path", "item"], "full").join(odd, ["path", "item"], "full")
    start = F.when(F.col("set") == "add", 1).when(F.col("set") == "remove", 0).otherwise(F.coalesce("base", F.lit(0)))
    return rows.where(start.bitwiseXOR(F.coalesce("odd", F.lit(0))) == 1).select("path", "item")
