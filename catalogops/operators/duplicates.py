"""Exact and near duplicates, and what to do about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalogops.functions import scalars as S
from catalogops.operators.components import connected_components
from catalogops.operators.near_hashes import near_links, packed
from catalogops.plans.staging import written

#: Most bits of a sketch of sizes: half a megabyte.
MAX_SKETCH_BITS = 1 << 22


def same_size(files: DataFrame) -> DataFrame:
    """Non-empty files whose size occurs at least twice: only these need a digest."""
    sized = files.where(F.coalesce("size", F.lit(0)) > 0)
    several = sized.groupBy("size").count().where("count > 1").select("size")
    return sized.join(several, "size", "left_semi")


def size_sketch(files: DataFrame) -> bytes | None:
    """Bits of the hashes of sizes that several paths of ``(path, size)`` have; None where so many repeat that the sketch would rule out little.

    Sixteen bits a size, from 1,024 up to ``MAX_SKETCH_BITS``: a size that does not repeat is taken for one that does at most once in sixteen times,
    or, above 262,144 such sizes, as often as the sketch is full.
    """
    sizes = files.where("size > 0").select("path", "size").dropDuplicates(["path"]).groupBy("size").count().where("count > 1").select(F.col("size").cast("long").alias("size"))
    sizes = written(sizes, "repeated-sizes")
    n = sizes.count()
    bits = min(MAX_SKETCH_BITS, max(1024, 1 << (16 * n - 1).bit_length()))
    if 2 * n > bits:
        return None
    at = F.pmod(F.xxhash64("size"), F.lit(bits))
    words = sizes.select((at / 32).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(size), {bits}) % 32 as int))").alias("bit"))
    # At most one row for every 32 bits.
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect()
    sketch = bytearray(bits // 8)
    for r in found:
        sketch[4 * r.word : 4 * r.word + 4] = r.bits.to_bytes(4, "little")
    return bytes(sketch)


def may_repeat(size: Column, sketch: bytes | None) -> Column:
    """Whether a size may be among those of a sketch; empty files never are."""
    some = F.coalesce(size, F.lit(0)) > 0
    if sketch is None:
        return some
    at = F.pmod(F.xxhash64(size.cast("long")), F.lit(8 * len(sketch))).cast("int")
    byte = F.conv(F.hex(F.substring(F.lit(bytearray(sketch)), F.floor(at / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    return some & (F.call_function("getbit", byte, at % 8) == 1)


def exact_duplicates(files: DataFrame, include_videos: bool = True) -> DataFrame:
    """``(hash, path)`` of every member of a group of equal content; files ``(path, size, content[, type])``.

    Sizes are counted first, without the content.  Only content whose size repeats, by a sketch, is digested, where it is
    read, so that only paths, sizes and digests are shuffled.
    """
    if not include_videos and "type" in files.columns:
        files = files.where("type = 'image'")
    rows = files.where(may_repeat(F.col("size"), size_sketch(files)))
    return duplicate_groups(rows.select("path", S.content_digest(F.col("content")).alias("hash")))


def duplicate_groups(digests: DataFrame) -> DataFrame:
    """``(hash, path)`` of the paths, each counted once, that share their digest; a file without a digest is in no group."""
    rows = written(digests.select("path", "hash").dropna(), "digests").dropDuplicates(["path"])
    groups = rows.groupBy("hash").count().where("count > 1").select("hash")
    return rows.join(groups.hint("merge"), "hash", "left_semi").select("hash", "path")


def _representatives(hashes: DataFrame, digits: int) -> tuple[DataFrame, DataFrame]:
    """``(hash, rep)``, the smallest path of each hash, and pairs ``(a, b)`` of it and the hash's other paths.  Raises where hashes differ in length."""
    # Written before it is filtered, so that a filter does not work the hashes out a second time.
    rows = written(hashes.select("path", "hash"), "hashes").dropna()
    wrong = rows.where(F.length("hash") != digits).limit(1).collect()
    if wrong:
        raise ValueError(f"hashes must have {digits} digits")
    reps = rows.groupBy("hash").agg(F.min("path").alias("rep"))
    return reps, rows.join(reps.hint("merge"), "hash").where("path != rep").select(F.col("rep").alias("a"), F.col("path").alias("b"))


def hash_pairs(hashes: DataFrame, threshold: int, digits: int = 64) -> DataFrame:
    """Pairs ``(a, b)`` of rows ``(path, hash)`` whose hashes differ in at most ``threshold`` digits.

    Rows of one hash are tied to its smallest path.  Of threshold + 1 bands of
    digits two near hashes share one, so bands meet by an equi-join and the
    distance decides.  Raises where hashes differ in length.
    """
    reps, same = _representatives(hashes, digits)
    words = written(reps.select("rep", "hash", S.pack_digits(F.col("hash")).alias("w")), "packed-hashes")
    bands = min(threshold + 1, digits)
    cuts = [i * digits // bands for i in range(bands + 1)]
    parts = F.array(*[F.struct(F.lit(i).alias("no"), F.substring("hash", cuts[i] + 1, cuts[i + 1] - cuts[i]).alias("v")) for i in range(bands)])
    banded = words.select("rep", "w", F.explode(parts).alias("band"))
    left = banded.select(F.col("rep").alias("a"), F.col("w").alias("x"), "band")
    right = banded.select(F.col("rep").alias("b"), F.col("w").alias("y"), "band")
    near = left.join(right.hint("merge"), "band").where((F.col("a") < F.col("b")) & (S.digit_distance(F.col("x"), F.col("y")) <= threshold)).select("a", "b").distinct()
    return same.unionByName(near)


def hash_links(hashes: DataFrame, threshold: int, digits: int = 64) -> DataFrame:
    """Pairs ``(a, b)`` that join what all pairs of :func:`hash_pairs` join, without making these; hashes are hexadecimal."""
    reps, same = _representatives(hashes, digits)
    # Written before it is used, since the numbers of the nodes are not the same a second time.
    rows = written(packed(reps.withColumn("node", F.monotonically_increasing_id()), digits), "packed-hashes")
    links = written(near_links(rows, threshold, digits), "hash-links")
    name = lambda node, path: rows.select(F.col("node").alias(node), F.col("rep").alias(path)).hint("merge")
    named = links.select(F.col("a").alias("m"), F.col("b").alias("n")).join(name("m", "a"), "m").join(name("n", "b"), "n").where("a != b")
    return same.unionByName(named.select("a", "b"))


def similar_groups(hashes: DataFrame, threshold: int, digits: int = 64) -> DataFrame:
    """``(path, group_id)`` of groups of more than one, linked through near hashes; the group is its smallest path."""
    pairs = written(hash_links(hashes, threshold, digits), "hash-pairs")
    return connected_components(pairs, "a", "b").select(F.col("node").alias("path"), F.col("component").alias("group_id"))


def keepers(members: DataFrame) -> DataFrame:
    """Members ``(group_id, path, size, area)`` ranked by area, size and path; the first is kept, the rest are candidates for deletion."""
    order = Window.partitionBy("group_id").orderBy(F.desc_nulls_last("area"), F.desc_nulls_last("size"), "path")
    return members.withColumn("rank", F.row_number().over(order)).withColumn("keep", F.col("rank") == 1)


def compared_with_keeper(members: DataFrame) -> DataFrame:
    """Each other member against its group's keeper: strictly more bytes, strictly more area; unknown is false."""
    ranked = keepers(members)
    best = ranked.where("keep").select("group_id", F.col("size").alias("keep_size"), F.col("area").alias("keep_area"))
    more = lambda a, b: F.coalesce(F.col(a) > F.col(b), F.lit(False))
    return ranked.where(~F.col("keep")).join(best, "group_id").select("group_id", "path", more("size", "keep_size").alias("bigger_bytes"), more("area", "keep_area").alias("bigger_area"))


def dedupe_plan(members: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ranked members, and the catalog without those that are not kept."""
    ranked = keepers(members)
    return ranked, catalog.join(ranked.where(~F.col("keep")).select("path"), "path", "left_anti")
