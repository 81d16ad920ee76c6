"""Filters, joins, orders and pages over a catalog of files."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalogops.functions import scalars as S

#: Events that are let in.
ACTIONS = ("next", "prev", "toggle-play", "favorite")
REACTIONS = ("🎉", "❤️", "😂", "👏", "🔥")
MAX_UPLOAD = 200 << 20


def union_scans(scans: list[DataFrame], distinct_by: str | None = None) -> DataFrame:
    """Bag union of scans; with ``distinct_by`` one row of each value stays."""
    both = functools.reduce(DataFrame.unionByName, scans)
    return both.dropDuplicates([distinct_by]) if distinct_by else both


def media_filter(catalog: DataFrame, media: str = "both") -> DataFrame:
    wanted = {"photos": "image", "videos": "video"}.get(media)
    return catalog.where(F.col("type") == wanted) if wanted else catalog


def favorites_only(catalog: DataFrame, favorites: DataFrame) -> DataFrame:
    return catalog.join(favorites, "path", "left_semi")


def with_tag(catalog: DataFrame, tag: str) -> DataFrame:
    return catalog.where(F.array_contains("tags", tag)) if tag else catalog


def mark_favorites(catalog: DataFrame, favorites: DataFrame) -> DataFrame:
    known = favorites.select("path", F.lit(True).alias("favorite")).distinct()
    return catalog.join(known, "path", "left").withColumn("favorite", F.coalesce("favorite", F.lit(False)))


def attach_tags(catalog: DataFrame, tags: DataFrame) -> DataFrame:
    return catalog.join(tags.select("path", "tags"), "path", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def attach_dates(catalog: DataFrame, dates: DataFrame) -> DataFrame:
    return catalog.join(dates.select("path", "date_ms"), "path", "left").withColumn("date_ms", F.coalesce("date_ms", F.lit(0).cast("long")))


def remove_paths(catalog: DataFrame, gone: DataFrame) -> DataFrame:
    return catalog.join(gone.select("path"), "path", "left_anti")


def append_absent(catalog: DataFrame, new: DataFrame) -> DataFrame:
    fresh = new.dropDuplicates(["path"]).join(catalog.select("path"), "path", "left_anti")
    return catalog.unionByName(fresh.select(*catalog.columns))


def under_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows whose path is one of the roots or lies below one, by an equi-join on the path's prefixes."""
    pairs = rows.select("path", F.explode(S.ancestors(F.col("path"))).alias("root")).join(roots.select("root").distinct().hint("merge"), "root", "left_semi")
    return rows.join(pairs.select("path").distinct().hint("merge"), "path", "left_semi")


def deepest_owner(rows: DataFrame, dirs: DataFrame) -> DataFrame:
    """``(path, owner)``: the deepest of the dirs that holds each path; paths in none are left out."""
    pairs = rows.select("path", F.explode(S.ancestors(S.dirname(F.col("path")))).alias("dir")).join(dirs.select("dir").distinct().hint("merge"), "dir")
    return pairs.groupBy("path").agg(F.max_by("dir", F.length("dir")).alias("owner"))


def not_yet_derived(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Variants whose key is not in the feature table."""
    return wanted.join(stored.select("key"), "key", "left_anti")


def name_sorted() -> list[Column]:
    return [S.natural_order(F.col("name")).asc(), F.col("path").asc()]


def sort_order(sort: str = "name", seed: int | None = None) -> list[Column]:
    """Order columns: by name, by date (equal dates by name, both ways) or shuffled under a seed."""
    if seed is not None:
        return [F.sha2(F.concat_ws(":", F.lit(str(seed)), "path"), 256).asc(), F.col("path").asc()]
    if sort == "date_asc":
        return [F.col("date_ms").asc(), *name_sorted()]
    if sort == "date_desc":
        return [F.col("date_ms").desc(), *name_sorted()]
    return name_sorted()


def numbered(rows: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Rows with their place 1..n in the order.

    Ranges are sorted apart and shifted by the sizes of the ranges before
    them, so no task holds the whole order; only the sizes, one a partition, are summed in one place.
    """
    from catalogops.plans.staging import written

    ordered = rows.orderBy(*order).select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__id"))
    ordered = written(ordered, "ordered")
    sizes = ordered.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    # One row a partition: the broadcast is bounded by the number of tasks.
    return ordered.join(F.broadcast(starts), "__part").withColumn(name, F.col("__before") + F.col("__id") - F.col("__first") + 1).drop("__part", "__id", "__first", "__before")


def playlist(
    catalog: DataFrame, favorites: DataFrame, tags: DataFrame, dates: DataFrame, *, media: str = "both", only_favorites: bool = False, tag: str = "", sort: str = "name", shuffle_seed: int | None = None
) -> DataFrame:
    """Filtered, ordered and numbered catalog; dates are joined only for a date sort."""
    rows = favorites_only(catalog, favorites) if only_favorites else catalog
    if tag:
        rows = with_tag(attach_tags(rows, tags), tag).drop("tags")
    rows = media_filter(rows, media)
    if sort.startswith("date"):
        rows = attach_dates(rows, dates)
    return numbered(rows, sort_order(sort, shuffle_seed))


def facets(playlist_: DataFrame, favorites: DataFrame, tags: DataFrame, *, query: str = "", only_favorites: bool = False, tag: str = "") -> DataFrame:
    """Rows of a playlist that pass all facets, with their place in it."""
    rows = playlist_.where(S.name_contains(F.col("name"), query))
    rows = favorites_only(rows, favorites) if only_favorites else rows
    return with_tag(attach_tags(rows, tags), tag).drop("tags") if tag else rows


def grid_page(playlist_: DataFrame, favorites: DataFrame, tags: DataFrame, offset: int, n: int, **facet) -> DataFrame:
    return facets(playlist_, favorites, tags, **facet).orderBy("position").offset(offset).limit(n)


def position_of(playlist_: DataFrame, path: str) -> DataFrame:
    return playlist_.where(F.col("path") == path).select("path", "position")


def store_playlist(playlist_: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Write a numbered playlist as a table that is read by place or by path.

    Files hold ranges of about ``rows_per_file`` places, whose bounds Parquet keeps, and a Bloom filter of their paths.
    """
    files = max(1, -(-playlist_.count() // rows_per_file))
    ranged = playlist_.repartitionByRange(files, "position").sortWithinPartitions("position")
    ranged.write.option("parquet.bloom.filter.enabled#path", "true").option("parquet.bloom.filter.adaptive.enabled", "true").mode("overwrite").parquet(path)


def stored_page(stored: DataFrame, offset: int, n: int) -> DataFrame:
    """Rows offset+1 to offset+n of a stored playlist without facets: only the files of these places are read."""
    return stored.where(F.col("position").between(offset + 1, offset + n)).orderBy("position")


def upload_status(events: DataFrame, allowed: tuple[str, ...] = S.UPLOADS, limit: int = MAX_UPLOAD, root_allowed: Column | None = None) -> DataFrame:
    """Uploads with ``reject_reason``, null where accepted; without an allowed root nothing is."""
    reason = F.when(~F.coalesce(root_allowed, F.lit(False)), "root") if root_allowed is not None else F
    reason = reason.when(~F.coalesce(S.extension(F.col("name")).isin(*allowed), F.lit(False)), "type").when(F.coalesce("size", F.lit(0)) <= 0, "empty").when(F.col("size") > limit, "too large")
    return events.withColumn("reject_reason", reason)


def allowed_events(events: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    return events.where(F.col(column).isin(*allowed))


def active_at(events: DataFrame, instant: Column, ttl_seconds: float = 3, newest: int = 31) -> DataFrame:
    """Events alive at an instant, the newest of them at most."""
    alive = events.where((F.col("ts") <= instant) & (instant < F.col("ts") + F.make_interval(secs=F.lit(ttl_seconds))))
    return alive.orderBy(F.desc("ts"), F.desc("event_id")).limit(newest)
