"""Registered queries: the operators over the supplied tables, each with its SQL for DuckDB.

Adapters present `documents`, `events`, `orders`, `part`, `labels` and `pages`
in the shapes of a catalog; SQL views of the same name do so for DuckDB.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogops.functions import scalars as S
from catalogops.operators import catalog as C
from catalogops.operators import duplicates as D
from catalogops.operators import edits as E
from catalogops.operators import manifests as M
from catalogops.operators import metadata as X
from catalogops.plans.staging import bounded_batches, scratch_path
from catalogops.sources import decoders
from catalogops.streaming import streams as T

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
_EXT = ("jpg", "PNG", "mp4", "heic", "webm", "gif", "txt")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _catalog(spark, sf_dir) -> DataFrame:
    d = _read(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*map(F.lit, _EXT)), (F.col("doc_id") % len(_EXT) + 1).cast("int"))
    name = F.concat("lang", F.lit("-"), F.col("doc_id").cast("string"), F.lit("."), ext)
    rows = d.select("doc_id", name.alias("name"), F.concat(F.lit("/lib/"), "source", F.lit("/"), "lang", F.lit("/"), name).alias("path"), F.col("n_chars").alias("size"), "lang", "source")
    return rows.withColumn("type", S.media_type(F.col("name")))


_WITH = f"""WITH catalog AS (
  SELECT doc_id, lang || '-' || doc_id || '.' || {list(_EXT)}[doc_id % {len(_EXT)} + 1] AS name, '/lib/' || source || '/' || lang || '/' || lang || '-' || doc_id || '.' || {list(_EXT)}[doc_id % {len(_EXT)} + 1] AS path,
    n_chars AS size, lang, source, CASE WHEN doc_id % {len(_EXT)} IN (2, 4) THEN 'video' ELSE 'image' END AS type
  FROM documents
), favorites AS (SELECT path FROM catalog JOIN labels USING (doc_id) WHERE quality = 1),
tags AS (SELECT path, CASE WHEN toxic = 1 THEN [lang, 'toxic'] ELSE [lang] END AS tags FROM catalog JOIN labels USING (doc_id)),
dates AS (SELECT path, (doc_id % 50) * 86400000 AS date_ms FROM catalog WHERE doc_id % 4 > 0)
"""


def _favorites(spark, sf_dir) -> DataFrame:
    return _catalog(spark, sf_dir).join(_read(spark, sf_dir, "labels").where("quality = 1"), "doc_id").select("path")


def _tags(spark, sf_dir) -> DataFrame:
    rows = _catalog(spark, sf_dir).join(_read(spark, sf_dir, "labels"), "doc_id")
    return rows.select("path", F.when(F.col("toxic") == 1, F.array("lang", F.lit("toxic"))).otherwise(F.array("lang")).alias("tags"))


def _dates(spark, sf_dir) -> DataFrame:
    return _catalog(spark, sf_dir).where("doc_id % 4 > 0").select("path", (F.col("doc_id") % 50 * 86400000).alias("date_ms"))


def _log(spark, sf_dir) -> DataFrame:
    op = F.element_at(F.array(*map(F.lit, ("toggle", "add", "remove", "toggle"))), (F.col("event_id") % 4 + 1).cast("int"))
    return _read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("item"), op.alias("op"))


_LOG = "WITH log AS (SELECT event_id AS seq, user_id::varchar AS path, event_type AS item, ['toggle', 'add', 'remove', 'toggle'][event_id % 4 + 1] AS op FROM events)"


def _members(spark, sf_dir) -> DataFrame:
    d = _read(spark, sf_dir, "documents")
    groups = D.exact_duplicates(d.select(F.col("doc_id").alias("path"), F.col("n_chars").alias("size"), F.col("text").alias("content")))
    attrs = d.select(F.col("doc_id").alias("path"), (F.col("n_chars") + F.col("doc_id") % 3).alias("size"), F.when(F.col("doc_id") % 5 > 0, F.col("doc_id") % 7 * 100).alias("area"))
    return groups.join(attrs, "path").select(F.col("hash").alias("group_id"), "path", "size", "area")


_GROUPS = "groups AS (SELECT sha256(text) AS hash, doc_id AS path FROM documents WHERE n_chars > 0 QUALIFY count(*) OVER (PARTITION BY text) > 1)"
_MEMBERS = f"""WITH {_GROUPS}, members AS (
  SELECT hash AS group_id, path, n_chars + doc_id % 3 AS size, CASE WHEN doc_id % 5 > 0 THEN doc_id % 7 * 100 END AS area FROM groups JOIN documents ON path = doc_id
), ranked AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY area DESC NULLS LAST, size DESC NULLS LAST, path) AS rank FROM members)"""


class _Bins(dict):
    """Word to the first byte of its digest."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        got = self[word] = hashlib.md5(word).digest()[0]
        return got


def _histograms(batches):
    """Rows ``(doc_id, words)``: how many words fall into each of 256 bins; an edge of white space has an empty word beyond it."""
    bins, space = _Bins(), b" \t\n\x0b\f\r"
    for batch in batches:
        ids, text = batch.column("doc_id"), batch.column("words")
        for low in range(0, batch.num_rows, 256):
            found = []
            for x in text.slice(low, 256):
                x = x.as_py()
                words = x.split()
                words += [b""] * ((x[:1] in space) + (x[-1:] in space) if x else 1)
                found.append(np.bincount(np.frombuffer(bytes(map(bins.__getitem__, words)), np.uint8), minlength=256).astype(np.int32))
            flat = pa.array(np.concatenate(found))
            counts = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, 256, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([ids.slice(low, 256), counts], ["doc_id", "counts"])
        # Workers are used again by later stages, and do not keep what this one has freed.
        pa.default_memory_pool().release_unused()


def _histogram_hashes(spark, sf_dir) -> DataFrame:
    d = _read(spark, sf_dir, "documents")
    bounded_batches(spark)
    words = d.where("text is not null").select("doc_id", F.trim(F.lower("text")).cast("binary").alias("words"))
    rows = words.mapInArrow(_histograms, f"doc_id {dict(words.dtypes)['doc_id']}, counts array<int>")
    # Rows that share an id are one document.
    both = F.aggregate(F.slice("all", 2, F.size("all")), F.get("all", 0), lambda s, x: F.zip_with(s, x, lambda a, b: a + b))
    counts = rows.groupBy("doc_id").agg(F.collect_list("counts").alias("all"))
    return counts.select(F.col("doc_id").alias("path"), S.block_hash(both).alias("hash"))


_HASHES = r"""WITH RECURSIVE words AS (SELECT doc_id, unnest(string_split_regex(trim(lower(text)), '\s+')) AS w FROM documents),
bins AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 2))::int AS bin, count(*) AS n FROM words GROUP BY ALL),
full_ AS (SELECT d.doc_id, b AS bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT doc_id FROM words) d, range(256) r(b) LEFT JOIN bins ON bins.doc_id = d.doc_id AND bins.bin = b),
bits AS (SELECT doc_id, bin, n > median(n) OVER (PARTITION BY doc_id, bin // 64) AS bit FROM full_),
digits AS (SELECT doc_id, bin // 4 AS d, sum(CASE WHEN bit THEN 8 >> (bin % 4)::int ELSE 0 END)::int AS v FROM bits GROUP BY ALL),
hashes AS (SELECT doc_id AS path, string_agg(substr('0123456789abcdef', v + 1, 1), '' ORDER BY d) AS hash FROM digits GROUP BY doc_id)
"""


def _query(sql: str = ""):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


# -- scans, sets and counts


def _overlapping(spark, sf_dir) -> list[DataFrame]:
    """Two scans that cover the catalog and share the rows of one language."""
    c = _catalog(spark, sf_dir).select("doc_id", "path", "type", "lang")
    return [c.where((F.col("type") == t) | (F.col("lang") == "en")).drop("type", "lang") for t in ("image", "video")]


@_query(_WITH + "SELECT doc_id, path FROM catalog WHERE type = 'image' OR lang = 'en' UNION ALL SELECT doc_id, path FROM catalog WHERE type = 'video' OR lang = 'en'")
def scan_union(spark, sf_dir):
    return C.union_scans(_overlapping(spark, sf_dir))


@_query(_WITH + "SELECT DISTINCT path FROM catalog")
def scan_union_distinct(spark, sf_dir):
    return C.union_scans(_overlapping(spark, sf_dir), "path").select("path")


@_query(_WITH + "SELECT doc_id, path FROM catalog UNION ALL SELECT doc_id, path FROM catalog WHERE type = 'video'")
def scan_union_whole(spark, sf_dir):
    c = _catalog(spark, sf_dir).select("doc_id", "path", "type")
    return C.union_scans([c, C.media_filter(c, "videos")]).drop("type")


@_query(_WITH + "SELECT DISTINCT path FROM catalog")
def scan_union_distinct_whole(spark, sf_dir):
    c = _catalog(spark, sf_dir).select("path", "type")
    return C.union_scans([c, C.media_filter(c, "videos")], "path").select("path")


@_query(_WITH + "SELECT type, count(*) AS n_files, sum(size)::bigint AS total_bytes, count(*) FILTER (size > 1000) AS n_large FROM catalog GROUP BY type")
def type_counts(spark, sf_dir):
    return _catalog(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n_files"), F.sum("size").alias("total_bytes"), F.count_if(F.col("size") > 1000).alias("n_large"))


@_query(_WITH + "SELECT path, CASE WHEN path IN (SELECT path FROM favorites) THEN true ELSE false END AS favorite FROM catalog")
def mark_favorites(spark, sf_dir):
    return C.mark_favorites(_catalog(spark, sf_dir).select("path"), _favorites(spark, sf_dir))


@_query(_WITH + "SELECT path, array_to_string(coalesce(tags, []), ',') AS tags FROM catalog LEFT JOIN tags USING (path)")
def attach_tags(spark, sf_dir):
    return C.attach_tags(_catalog(spark, sf_dir).select("path"), _tags(spark, sf_dir)).select("path", F.array_join("tags", ",").alias("tags"))


@_query(_WITH + "SELECT path, coalesce(date_ms, 0) AS date_ms FROM catalog LEFT JOIN dates USING (path)")
def attach_dates(spark, sf_dir):
    return C.attach_dates(_catalog(spark, sf_dir).select("path"), _dates(spark, sf_dir))


@_query(_WITH + "SELECT path FROM catalog WHERE path NOT IN (SELECT path FROM favorites)")
def remove_paths(spark, sf_dir):
    return C.remove_paths(_catalog(spark, sf_dir).select("path"), _favorites(spark, sf_dir))


@_query(_WITH + "SELECT doc_id, path FROM catalog")
def append_absent(spark, sf_dir):
    c = _catalog(spark, sf_dir).select("doc_id", "path")
    return C.append_absent(c.where("doc_id % 3 > 0"), c.where("doc_id % 3 = 0 or doc_id % 2 = 0"))


@_query(_WITH + "SELECT path FROM catalog WHERE source = 'src1' OR (source = 'src2' AND lang = 'en')")
def under_roots(spark, sf_dir):
    roots = spark.createDataFrame([("/lib/src1",), ("/lib/src2/en",)], "root string")
    return C.under_roots(_catalog(spark, sf_dir).select("path"), roots)


@_query(_WITH + "SELECT path, CASE WHEN lang IN ('en', 'de') THEN '/lib/' || source || '/' || lang ELSE '/lib/' || source END AS owner FROM catalog")
def deepest_owner(spark, sf_dir):
    c = _catalog(spark, sf_dir)
    dirs = c.select(F.concat(F.lit("/lib/"), "source").alias("dir")).union(c.where(F.col("lang").isin("en", "de")).select(F.concat(F.lit("/lib/"), "source", F.lit("/"), "lang"))).distinct()
    return C.deepest_owner(c.select("path"), dirs)


@_query(_WITH + "SELECT sha1(concat_ws(':', path, (doc_id * 1000)::varchar, size::varchar, 'full')) AS key FROM catalog WHERE doc_id % 3 > 0")
def new_variants(spark, sf_dir):
    c = _catalog(spark, sf_dir)
    keyed = lambda rows: rows.select(S.variant_key(F.col("path"), F.col("doc_id") * 1000, F.col("size"), F.lit(None)).alias("key"))
    return C.not_yet_derived(keyed(c), keyed(c.where("doc_id % 3 = 0")))


# -- playlists and pages


def _playlist_sql(where: str, order: str, joins: str = "") -> str:
    return _WITH + f"SELECT catalog.*, row_number() OVER (ORDER BY {order}) AS position FROM catalog {joins} WHERE {where}"


def _playlist(spark, sf_dir, **args):
    return C.playlist(_catalog(spark, sf_dir), _favorites(spark, sf_dir), _tags(spark, sf_dir), _dates(spark, sf_dir), **args)


@_query(_playlist_sql("type = 'image'", "lang, doc_id"))
def playlist_photos_by_name(spark, sf_dir):
    return _playlist(spark, sf_dir, media="photos")


@_query(_playlist_sql("true", "coalesce(date_ms, 0) DESC, lang, doc_id", "LEFT JOIN dates USING (path)"))
def playlist_newest_first(spark, sf_dir):
    return _playlist(spark, sf_dir, sort="date_desc").drop("date_ms")


@_query(_playlist_sql("type = 'video'", "coalesce(date_ms, 0), lang, doc_id", "LEFT JOIN dates USING (path)"))
def playlist_oldest_videos(spark, sf_dir):
    return _playlist(spark, sf_dir, sort="date_asc", media="videos").drop("date_ms")


@_query(_playlist_sql("path IN (SELECT path FROM favorites) AND path IN (SELECT path FROM tags WHERE list_contains(tags, 'toxic'))", "sha256('7:' || path), path"))
def playlist_shuffled_favorites(spark, sf_dir):
    return _playlist(spark, sf_dir, only_favorites=True, tag="toxic", shuffle_seed=7)


_LIST = "list AS (SELECT path, name, row_number() OVER (ORDER BY lang, doc_id) AS position FROM catalog)"


@_query(_WITH + f", {_LIST} SELECT path, name, position FROM list WHERE contains(lower(name), 'n-1') AND path IN (SELECT path FROM favorites) ORDER BY position LIMIT 20 OFFSET 5")
def grid_page(spark, sf_dir):
    rows = _playlist(spark, sf_dir).select("path", "name", "position")
    return C.grid_page(rows, _favorites(spark, sf_dir), _tags(spark, sf_dir), 5, 20, query="  N-1 ", only_favorites=True)


@_query(_WITH + f", {_LIST} SELECT path, name, position FROM list")
def playlist_positions(spark, sf_dir):
    return _playlist(spark, sf_dir).select("path", "name", "position")


@_query(_WITH + f", {_LIST} SELECT path, position FROM list")
def playlist_positions_whole(spark, sf_dir):
    return _playlist(spark, sf_dir).select("path", "position")


@_query(_WITH + f", {_LIST} SELECT path, position FROM list WHERE path = (SELECT path FROM catalog WHERE doc_id = 17)")
def playlist_position_of(spark, sf_dir):
    wanted = _catalog(spark, sf_dir).where("doc_id = 17").first()
    return C.position_of(_playlist(spark, sf_dir), wanted.path if wanted else None)


@_query(_WITH + f", {_LIST} SELECT path, name, position FROM list WHERE position > 40 AND position <= 90 UNION ALL SELECT path, name, position FROM list WHERE path = (SELECT path FROM catalog WHERE doc_id = 17)")
def stored_playlist(spark, sf_dir):
    at = scratch_path(spark, "playlist")
    C.store_playlist(_playlist(spark, sf_dir).select("path", "name", "position"), at)
    stored = spark.read.parquet(at)
    wanted = _catalog(spark, sf_dir).where("doc_id = 17").first()
    return C.stored_page(stored, 40, 50).unionByName(stored.where(F.col("path") == (wanted.path if wanted else None)))


# -- duplicates


@_query(f"WITH {_GROUPS} SELECT hash, path FROM groups")
def exact_duplicates(spark, sf_dir):
    d = _read(spark, sf_dir, "documents")
    return D.exact_duplicates(d.select(F.col("doc_id").alias("path"), F.col("n_chars").alias("size"), F.col("text").alias("content")))


@_query(_WITH + """, g AS (SELECT doc_id, sha256(text) AS hash, count(*) OVER (PARTITION BY text) AS n FROM documents JOIN catalog USING (doc_id) WHERE documents.n_chars > 0 AND type = 'image')
SELECT hash, doc_id AS path FROM g WHERE n > 1""")
def exact_duplicate_images(spark, sf_dir):
    types = F.element_at(F.array(*map(F.lit, _EXT)), (F.col("doc_id") % len(_EXT) + 1).cast("int"))
    d = _read(spark, sf_dir, "documents").withColumn("type", S.media_type(F.concat(F.lit("x."), types)))
    return D.exact_duplicates(d.select(F.col("doc_id").alias("path"), F.col("n_chars").alias("size"), F.col("text").alias("content"), "type"), include_videos=False)


@_query(_HASHES + "SELECT path, hash FROM hashes")
def block_hashes(spark, sf_dir):
    return _histogram_hashes(spark, sf_dir)


@_query("""WITH v AS (SELECT vec_id, i - 1 AS bin, embedding[i]::double AS n FROM embeddings, range(1, 65) r(i)),
bits AS (SELECT vec_id, bin, n > median(n) OVER (PARTITION BY vec_id, bin // 16) AS bit FROM v),
digits AS (SELECT vec_id, bin // 4 AS d, sum(CASE WHEN bit THEN 8 >> (bin % 4)::int ELSE 0 END)::int AS x FROM bits GROUP BY ALL)
SELECT vec_id, string_agg(substr('0123456789abcdef', x + 1, 1), '' ORDER BY d) AS hash FROM digits GROUP BY vec_id""")
def vector_hashes(spark, sf_dir):
    return _read(spark, sf_dir, "embeddings").select("vec_id", S.block_hash(F.transform("embedding", lambda x: x.cast("double"))).alias("hash"))


def _letters(content: bytes) -> list[float]:
    """A stand-in for an image decoder: how often each letter from a to p occurs."""
    return [float(content.count(bytes([97 + i]))) for i in range(16)]


@_query("""WITH v AS (SELECT doc_id, i AS bin, length(text) - length(replace(text, chr(97 + i::int), '')) AS n FROM documents, range(16) r(i) WHERE text IS NOT NULL),
bits AS (SELECT doc_id, bin, n > median(n) OVER (PARTITION BY doc_id, bin // 4) AS bit FROM v),
digits AS (SELECT doc_id, bin // 4 AS d, sum(CASE WHEN bit THEN 8 >> (bin % 4)::int ELSE 0 END)::int AS x FROM bits GROUP BY ALL)
SELECT doc_id, string_agg(substr('0123456789abcdef', x + 1, 1), '' ORDER BY d) AS hash FROM digits GROUP BY doc_id""")
def decoded_rasters(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return decoders.rasters(d, _letters).where("raster is not null").select("doc_id", S.block_hash(F.col("raster")).alias("hash"))


def _makers(content: bytes) -> dict[str, str]:
    """A stand-in for a reader of camera tags."""
    return {"Make": str(len(content)), "Model": "", "Lens": str(content.count(b"\n"))}


@_query("SELECT doc_id, octet_length(encode(text))::varchar AS make, NULL::varchar AS model, (length(text) - length(replace(text, chr(10), '')))::varchar AS lens FROM documents WHERE text IS NOT NULL")
def decoded_tags(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    records = decoders.raw_tags(d, _makers).where("raw_tags is not null").select("doc_id", S.camera_record(F.col("raw_tags")).alias("c"))
    return records.select("doc_id", "c.make", "c.model", "c.lens")


def _similar(threshold: int):
    def run(spark, sf_dir):
        return D.similar_groups(_histogram_hashes(spark, sf_dir), threshold)

    run.__name__ = f"similar_groups_t{threshold}"
    return _query(
        _HASHES
        + f""", near AS (SELECT a.path AS x, b.path AS y FROM hashes a JOIN hashes b ON a.path <> b.path AND hamming(a.hash, b.hash) <= {threshold}),
reach AS (SELECT x AS node, x AS root FROM near UNION SELECT reach.node, near.y FROM reach JOIN near ON near.x = reach.root)
SELECT node AS path, min(root) AS group_id FROM reach GROUP BY node"""
    )(run)


for _level in (1, 2, 3):
    _similar(S.LEVELS[_level])


@_query(_MEMBERS + " SELECT group_id, path, size, area, rank, rank = 1 AS keep FROM ranked")
def keepers(spark, sf_dir):
    return D.keepers(_members(spark, sf_dir))


@_query(_MEMBERS + """ SELECT a.group_id, a.path, coalesce(a.size > b.size, false) AS bigger_bytes, coalesce(a.area > b.area, false) AS bigger_area
FROM ranked a JOIN ranked b ON a.group_id = b.group_id AND b.rank = 1 WHERE a.rank > 1""")
def compared_with_keeper(spark, sf_dir):
    return D.compared_with_keeper(_members(spark, sf_dir))


@_query(_MEMBERS + " SELECT doc_id AS path FROM documents WHERE doc_id NOT IN (SELECT path FROM ranked WHERE rank > 1)")
def dedupe_plan(spark, sf_dir):
    return D.dedupe_plan(_members(spark, sf_dir), _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("path")))[1]


# -- metadata


def _sidecars(spark, sf_dir) -> DataFrame:
    c = _catalog(spark, sf_dir)
    entry = lambda rel, tag: F.struct(rel.alias("rel"), F.array(F.lit(tag), "lang").alias("tags"))
    part = F.floor(F.col("doc_id") / 500).alias("part")  # a dir's entries come in several files of bounded size
    shallow = c.where("doc_id % 3 = 0").select(F.concat(F.lit("/lib/"), "source").alias("dir"), entry(F.concat("lang", F.lit("/"), "name"), "new").alias("e"), F.col("type").alias("word"), part)
    deep = c.where("doc_id % 3 > 0 or doc_id % 2 = 0").select(F.concat(F.lit("/lib/"), "source", F.lit("/"), "lang").alias("dir"), entry(F.concat(F.lit("./"), "name"), "old").alias("e"), F.col("lang").alias("word"), part)
    rows = shallow.union(deep).groupBy("dir", "part").agg(F.map_from_entries(F.collect_list("e")).alias("tags"), F.collect_list("e.rel").alias("favorites"), F.collect_set("word").alias("tagNames"))
    return X.parse_sidecars(rows.select("dir", F.to_json(F.struct(F.lit(1).alias("version"), "favorites", "tags", "tagNames")).alias("json")))


@_query(_WITH + "SELECT path, CASE WHEN doc_id % 3 = 0 THEN 'new,' ELSE 'old,' END || lang AS tags FROM catalog")
def merged_tags(spark, sf_dir):
    return X.merged_tags(_sidecars(spark, sf_dir)).select("path", F.array_join("tags", ",").alias("tags"))


@_query(_WITH + "SELECT path FROM catalog")
def merged_favorites(spark, sf_dir):
    return X.merged_favorites(_sidecars(spark, sf_dir))


@_query(_WITH + "SELECT DISTINCT type AS tag FROM catalog WHERE doc_id % 3 = 0 UNION SELECT DISTINCT lang FROM catalog WHERE doc_id % 3 > 0 OR doc_id % 2 = 0")
def vocabulary(spark, sf_dir):
    return X.vocabulary(_sidecars(spark, sf_dir))


@_query(_WITH + """, owned AS (SELECT CASE WHEN lang = 'en' THEN '/lib/' || source || '/en' ELSE '/lib/' || source END AS dir, path FROM favorites JOIN catalog USING (path) WHERE source <> 'src0'),
dirs AS (SELECT dir FROM owned UNION SELECT CASE WHEN lang = 'en' THEN '/lib/' || source || '/en' ELSE '/lib/' || source END FROM tags JOIN catalog USING (path) WHERE source <> 'src0' UNION SELECT '/lib/' || source || '/en' FROM catalog WHERE lang = 'en' AND source <> 'src0')
SELECT dirs.dir, count(path) AS n_favorites, coalesce(string_agg(substr(path, length(dirs.dir) + 2), ',' ORDER BY path), '') AS favorites FROM dirs LEFT JOIN owned ON owned.dir = dirs.dir GROUP BY dirs.dir""")
def save_plan(spark, sf_dir):
    c = _catalog(spark, sf_dir)
    roots = c.where("source <> 'src0'").select(F.concat(F.lit("/lib/"), "source").alias("root")).distinct()
    existing = c.where("lang = 'en'").select(F.concat(F.lit("/lib/"), "source", F.lit("/en")).alias("dir")).distinct()
    plan = X.save_plan(_favorites(spark, sf_dir), _tags(spark, sf_dir), c.select(F.col("lang").alias("tag")).distinct(), roots, existing)
    fav = F.from_json("json", X.SIDECAR)["favorites"]
    return plan.select("dir", F.size(fav).cast("long").alias("n_favorites"), F.array_join(fav, ",").alias("favorites"))


@_query(_WITH + """, placed AS (SELECT CASE WHEN lang = 'en' THEN '/lib/' || source || '/en' ELSE '/lib/' || source END AS dir, path FROM catalog WHERE source <> 'src0'),
fav AS (SELECT dir, count(*) AS n, string_agg(substr(path, length(dir) + 2), ',' ORDER BY path) AS text FROM placed JOIN favorites USING (path) GROUP BY dir),
tag AS (SELECT dir, count(*) AS n, string_agg(substr(path, length(dir) + 2) || ':' || array_to_string(tags, '|'), ',' ORDER BY path) AS text FROM placed JOIN tags USING (path) GROUP BY dir),
dirs AS (SELECT dir FROM fav UNION SELECT dir FROM tag UNION SELECT '/lib/' || source || '/en' FROM catalog WHERE lang = 'en' AND source <> 'src0')
SELECT dir, coalesce(fav.n, 0) AS n_favorites, coalesce(fav.text, '') AS favorites, coalesce(tag.n, 0) AS n_tags, coalesce(tag.text, '') AS tags,
  (SELECT string_agg(DISTINCT lang, ',' ORDER BY lang) FROM catalog) AS tag_names FROM dirs LEFT JOIN fav USING (dir) LEFT JOIN tag USING (dir)""")
def save_plan_whole(spark, sf_dir):
    c = _catalog(spark, sf_dir)
    roots = c.where("source <> 'src0'").select(F.concat(F.lit("/lib/"), "source").alias("root")).distinct()
    existing = c.where("lang = 'en'").select(F.concat(F.lit("/lib/"), "source", F.lit("/en")).alias("dir")).distinct()
    plan = X.save_plan(_favorites(spark, sf_dir), _tags(spark, sf_dir), c.select(F.col("lang").alias("tag")).distinct(), roots, existing)
    data = plan.select("dir", F.from_json("json", X.SIDECAR).alias("d"))
    entries = F.transform(F.array_sort(F.map_entries("d.tags")), lambda e: F.concat(e["key"], F.lit(":"), F.array_join(e["value"], "|")))
    return data.select(
        "dir", F.size("d.favorites").cast("long").alias("n_favorites"), F.array_join("d.favorites", ",").alias("favorites"),
        F.size("d.tags").cast("long").alias("n_tags"), F.array_join(entries, ",").alias("tags"), F.array_join("d.tagNames", ",").alias("tag_names"),
    )


@_query(_WITH + """, flips AS (SELECT path FROM catalog JOIN events ON event_id % 1000 = doc_id % 1000 GROUP BY path HAVING count(*) % 2 = 1)
SELECT path FROM catalog WHERE (path IN (SELECT path FROM favorites)) <> (path IN (SELECT path FROM flips))""")
def toggled(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select((F.col("event_id") % 1000).alias("k"))
    log = _catalog(spark, sf_dir).withColumn("k", F.col("doc_id") % 1000).join(e, "k").select("path")
    return X.toggled(_favorites(spark, sf_dir), log)


@_query(_WITH + """SELECT path, array_to_string(t, ',') AS tags FROM (
  SELECT path, CASE WHEN doc_id % 2 > 0 THEN coalesce(tags, []) WHEN list_contains(coalesce(tags, []), 'toxic') THEN list_filter(tags, lambda x: x <> 'toxic') ELSE list_append(coalesce(tags, []), 'toxic') END AS t
  FROM catalog LEFT JOIN tags USING (path)) WHERE len(t) > 0""")
def toggle_tag(spark, sf_dir):
    return X.toggle_tag(_tags(spark, sf_dir), _catalog(spark, sf_dir).where("doc_id % 2 = 0"), "toxic").select("path", F.array_join("tags", ",").alias("tags"))


@_query(_WITH + """SELECT path, array_to_string(CASE WHEN doc_id % 2 = 0 AND NOT list_contains(coalesce(tags, []), 'toxic') THEN list_append(coalesce(tags, []), 'toxic') ELSE tags END, ',') AS tags
FROM catalog LEFT JOIN tags USING (path) WHERE doc_id % 2 = 0 OR tags IS NOT NULL""")
def batch_tag(spark, sf_dir):
    return X.batch_tag(_tags(spark, sf_dir), _catalog(spark, sf_dir).where("doc_id % 2 = 0"), " toxic ").select("path", F.array_join("tags", ",").alias("tags"))


@_query(_WITH + "SELECT path, 'added' AS kind FROM catalog WHERE doc_id % 5 = 0 OR path IN (SELECT path FROM favorites) UNION ALL SELECT path, 'removed' FROM favorites JOIN catalog USING (path) WHERE doc_id % 5 > 0")
def set_membership(spark, sf_dir):
    some = _catalog(spark, sf_dir).where("doc_id % 5 = 0")
    fav = _favorites(spark, sf_dir)
    return X.set_membership(fav, some, True).withColumn("kind", F.lit("added")).union(X.set_membership(fav, some, False).withColumn("kind", F.lit("removed")))


@_query(_LOG + """, last AS (SELECT path, item, max(seq) AS since, arg_max(op, seq) AS op FROM log WHERE op <> 'toggle' GROUP BY ALL),
odd AS (SELECT log.path, log.item, count(*) % 2 AS odd FROM log LEFT JOIN last USING (path, item) WHERE log.op = 'toggle' AND (since IS NULL OR seq > since) GROUP BY ALL),
base AS (SELECT DISTINCT path, item, 1 AS b FROM log WHERE path::int % 2 = 0),
every AS (SELECT DISTINCT path, item FROM log)
SELECT path, item FROM every LEFT JOIN last USING (path, item) LEFT JOIN odd USING (path, item) LEFT JOIN base USING (path, item)
WHERE xor(CASE op WHEN 'add' THEN 1 WHEN 'remove' THEN 0 ELSE coalesce(b, 0) END, coalesce(odd, 0)::int) = 1""")
def apply_edits(spark, sf_dir):
    log = _log(spark, sf_dir)
    return X.apply_edits(log.where("cast(path as int) % 2 = 0").select("path", "item").distinct(), log)


_EDIT_OPS = ("tag", "toggle_tag", "toggle_favorite", "toggle_tag", "untag", "favorite", "toggle_tag", "unfavorite", "tag")


@_query(f"""WITH e AS (SELECT event_id AS seq, '/u/' || user_id AS path, event_type AS tag, {list(_EDIT_OPS)}[event_id % 9 + 1] AS op, event_id % 2 = 0 AS ensure FROM events),
paths AS (SELECT DISTINCT path, ltrim(path, '/u')::int AS u FROM e),
base AS (SELECT path, x AS item, i AS place FROM paths, (VALUES ('view', 0), ('base', 1), ('click', 2)) b(x, i) WHERE u % 2 = 0 UNION ALL SELECT path, '*', 0 FROM paths WHERE u % 3 = 0),
change AS (SELECT seq, path, CASE WHEN contains(op, 'favorite') THEN '*' ELSE tag END AS item, CASE WHEN contains(op, 'toggle') THEN 0 WHEN op IN ('tag', 'favorite') THEN 1 ELSE 2 END AS op FROM e),
folded AS (
  SELECT path, item, list_reduce([coalesce(place, -1)] || coalesce(ops, []), lambda a, x: CASE x % 3 WHEN 0 THEN CASE WHEN a >= 0 THEN -1 ELSE 10 + x // 3 END WHEN 1 THEN CASE WHEN a >= 0 THEN a ELSE 10 + x // 3 END ELSE -1 END) AS place
  FROM (SELECT path, item, list(seq * 3 + op ORDER BY seq) AS ops FROM change GROUP BY ALL) FULL JOIN base USING (path, item)
)
SELECT 'tags' AS kind, path AS name, string_agg(item, ',' ORDER BY place) AS value FROM folded WHERE item <> '*' AND place >= 0 GROUP BY path
UNION ALL SELECT 'favorite', path, '' FROM folded WHERE item = '*' AND place >= 0
UNION ALL SELECT 'word', tag, '' FROM (SELECT 'base' AS tag UNION SELECT tag FROM e WHERE op = 'tag' OR (op = 'toggle_tag' AND ensure))""")
def edited_metadata(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    op = F.element_at(F.array(*map(F.lit, _EDIT_OPS)), (F.col("event_id") % 9 + 1).cast("int"))
    log = e.select(F.col("event_id").alias("seq"), F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("path"), op.alias("op"), F.concat(F.lit(" "), "event_type").alias("tag"), (F.col("event_id") % 2 == 0).alias("ensure"))
    users = e.select("user_id", F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("path")).distinct()
    tags = users.where("user_id % 2 = 0").select("path", F.array(*map(F.lit, ("view", "base", "click"))).alias("tags"))
    favorites, lists, words = E.fold_edits(users.where("user_id % 3 = 0").select("path"), tags, users.select(F.lit("base").alias("tag")).distinct(), log)
    rows = lists.select(F.lit("tags").alias("kind"), F.col("path").alias("name"), F.array_join("tags", ",").alias("value"))
    rows = rows.unionByName(favorites.select(F.lit("favorite").alias("kind"), F.col("path").alias("name"), F.lit("").alias("value")))
    return rows.unionByName(words.select(F.lit("word").alias("kind"), F.col("tag").alias("name"), F.lit("").alias("value")))


# -- manifests


@_query("""WITH up AS (SELECT event_id AS ord, event_type || '.JPG' AS name, event_type AS stem, '/r' || user_id % 7 || '/guests' AS dir FROM events),
taken AS (SELECT DISTINCT dir, stem, n FROM up, (VALUES (0), (3), (4), (8)) t(n) WHERE n > 0 OR dir = '/r0/guests'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY dir, name ORDER BY ord) - CASE WHEN dir = '/r0/guests' THEN 0 ELSE 1 END AS i FROM up),
free AS (SELECT dir, stem, n, row_number() OVER (PARTITION BY dir, stem ORDER BY n) AS i FROM (SELECT DISTINCT dir, stem FROM up), range(1, (SELECT count(*) + 9 FROM events)) r(n) WHERE n NOT IN (3, 4, 8))
SELECT ord, name, CASE WHEN i = 0 THEN name ELSE stem || '-' || n || '.jpg' END AS stored, dir FROM ranked LEFT JOIN free USING (dir, stem, i)""")
def upload_names(spark, sf_dir):
    where = F.concat(F.lit("/r"), (F.col("user_id") % 7).cast("string"), F.lit("/guests"))
    up = _read(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), F.concat("event_type", F.lit(".JPG")).alias("name"), where.alias("dir"), "event_type")
    places = up.select("dir", "event_type").distinct()
    numbered = places.select("dir", "event_type", F.explode(F.array(*map(F.lit, (3, 4, 8)))).alias("n")).select("dir", F.concat("event_type", F.lit("-"), F.col("n").cast("string"), F.lit(".jpg")).alias("name"))
    taken = numbered.union(places.where("dir = '/r0/guests'").select("dir", F.concat("event_type", F.lit(".JPG"))))
    return M.free_names(up, taken)


@_query("SELECT o_orderkey AS path FROM orders WHERE NOT (o_orderkey % 7 = 0 AND o_orderstatus = 'F')")
def delete_batch(spark, sf_dir):
    o = _read(spark, sf_dir, "orders")
    return M.delete_batch(o.select(F.col("o_orderkey").alias("path")), o.where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("path"), (F.col("o_orderstatus") == "F").alias("ok")))


@_query("""WITH sel AS (SELECT '/in/' || p_brand || '/' || replace(p_name, ' ', '_') AS path, p_partkey AS ord, '/out/' || replace(p_name, ' ', '_') AS dest_path FROM part),
taken AS (SELECT DISTINCT '/out/' || replace(p_name, ' ', '_') AS dest_path FROM part WHERE p_partkey % 50 = 0)
SELECT path, dest_path, CASE WHEN dest_path IN (SELECT dest_path FROM taken) OR row_number() OVER (PARTITION BY dest_path ORDER BY ord, path) > 1 THEN 'conflict' ELSE 'ok' END AS status FROM sel""")
def move_plan(spark, sf_dir):
    p = _read(spark, sf_dir, "part").withColumn("n", F.replace(F.col("p_name"), F.lit(" "), F.lit("_")))
    return M.move_plan(p.select(F.concat(F.lit("/in/"), "p_brand", F.lit("/"), "n").alias("path"), F.col("p_partkey").alias("ord")), p.where("p_partkey % 50 = 0").select(F.concat(F.lit("/out/"), "n").alias("path")), "/out")


@_query("""WITH up AS (SELECT p_partkey AS ord, replace(p_name, ' ', '_') AS stem, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS nth FROM part),
taken AS (SELECT DISTINCT replace(p_name, ' ', '_') AS stem FROM part WHERE p_partkey % 50 = 0), shifted AS (SELECT ord, stem, nth - CASE WHEN stem IN (SELECT stem FROM taken) THEN 0 ELSE 1 END AS n FROM up)
SELECT ord, stem || '.jpg' AS name, CASE WHEN n = 0 THEN stem || '.jpg' ELSE stem || '-' || n || '.jpg' END AS stored FROM shifted""")
def free_names(spark, sf_dir):
    p = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit(".jpg")).alias("name"))
    return M.free_names(p, p.where("ord % 50 = 0").select("name"))


_RETAIN = "WITH f AS (SELECT o_orderkey AS key, o_orderdate AS mtime, round(o_totalprice * 100)::bigint AS size FROM orders)"


@_query(_RETAIN + ", s AS (SELECT *, coalesce(sum(size) OVER (ORDER BY mtime, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER () AS total FROM f) SELECT key, mtime, size FROM s WHERE total - before > 200000000")
def retention(spark, sf_dir):
    o = _read(spark, sf_dir, "orders")
    return M.retention(o.select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("mtime"), F.round(F.col("o_totalprice") * 100).cast("long").alias("size")), 200000000)


@_query("SELECT user_id AS key, arg_max(event_id, ts) AS value FROM events GROUP BY user_id")
def latest_values(spark, sf_dir):
    return M.latest(_read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("value"), "ts"))


# -- events


@_query("SELECT event_id, CASE WHEN event_type IN ('click', 'error') THEN 'type' WHEN value <= 5 THEN 'empty' WHEN value > 60 THEN 'too large' END AS reject_reason FROM events")
def upload_status(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    size = F.when(F.col("value") <= 5, 0).when(F.col("value") > 60, C.MAX_UPLOAD + 1).otherwise(C.MAX_UPLOAD)
    name = F.concat("event_type", F.when(F.col("event_type").isin("click", "error"), ".exe").otherwise(".JPG"))
    return C.upload_status(e.select("event_id", name.alias("name"), size.alias("size"))).select("event_id", "reject_reason")


@_query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view')")
def allowed_events(spark, sf_dir):
    return C.allowed_events(_read(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", ("click", "view"))


@_query("SELECT event_id, ts FROM events WHERE ts <= TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-10' < ts + INTERVAL 6 HOUR ORDER BY ts DESC, event_id DESC LIMIT 31")
def active_events(spark, sf_dir):
    return C.active_at(_read(spark, sf_dir, "events").select("event_id", "ts"), F.lit("2024-01-10").cast("timestamp_ntz"), 6 * 3600)


@_query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM g)
SELECT user_id AS key, min(ts) AS start, arg_max(event_id, ts) AS value, count(*) AS n FROM s GROUP BY user_id, burst""")
def collapsed_bursts(spark, sf_dir):
    return T.collapse_bursts(_read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("value")), "6 hours")


# -- functions


@_query("""SELECT doc_id, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN CASE WHEN b / 1024 < 100 THEN printf('%.1f', floor(b / 1024 * 10 + 0.5) / 10) ELSE floor(b / 1024 + 0.5)::bigint::varchar END || ' KB'
  ELSE CASE WHEN b / 1048576 < 100 THEN printf('%.1f', floor(b / 1048576 * 10 + 0.5) / 10) ELSE floor(b / 1048576 + 0.5)::bigint::varchar END || ' MB' END AS size FROM (SELECT doc_id, n_chars * (doc_id % 90) AS b FROM documents)""")
def format_bytes(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", S.format_bytes(F.col("n_chars") * (F.col("doc_id") % 90)).alias("size"))


@_query(_WITH + "SELECT doc_id, lang || '-' || lpad(length(doc_id::varchar)::varchar, 4, '0') || doc_id || replace(regexp_extract(name, '\\.[^.]+$'), '4', '00014') AS key FROM catalog")
def natural_keys(spark, sf_dir):
    return _catalog(spark, sf_dir).select("doc_id", S.natural_key(F.col("name")).alias("key"))


_EXIF = "SELECT o_orderkey, o_orderdate, CASE o_orderkey % 5 WHEN 0 THEN 'x' WHEN 1 THEN strftime(o_orderdate, '%Y:13:%d %H:%M:%S') WHEN 2 THEN strftime(o_orderdate, '%Y:%m:%dT%H:%M:%S+01') ELSE strftime(o_orderdate, '%Y:%m:%d %H:%M:%S') END AS raw FROM orders"


@_query(f"WITH t AS ({_EXIF}) SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 1 AND o_orderkey % 3 > 0 THEN epoch_ms(o_orderdate) // 1000 * 1000 ELSE o_orderkey * 1000 END AS date_ms FROM t")
def effective_dates(spark, sf_dir):
    o, k = _read(spark, sf_dir, "orders"), F.col("o_orderkey") % 5
    d = F.col("o_orderdate")
    raw = F.when(k == 0, "x").when(k == 1, F.date_format(d, "yyyy:'13':dd HH:mm:ss")).when(k == 2, F.date_format(d, "yyyy:MM:dd'T'HH:mm:ss'+01'")).otherwise(F.date_format(d, "yyyy:MM:dd HH:mm:ss"))
    return o.select("o_orderkey", S.effective_date(raw, F.lit(None).cast("string"), F.col("o_orderkey") * 1000, F.col("o_orderkey") % 3 > 0).alias("date_ms"))


@_query("""SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE coalesce(nullif(CASE event_type WHEN 'click' THEN 'L1' WHEN 'view' THEN '' END, ''), 'L2') END AS lens,
  CASE WHEN event_type = 'error' THEN NULL ELSE props END AS model FROM events""")
def camera_records(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    lens = F.when(F.col("event_type") == "click", "L1").when(F.col("event_type") == "view", "")
    full = F.create_map(F.lit("LensModel"), lens, F.lit("Lens"), F.lit("L2"), F.lit("Model"), F.col("props"))
    tags = F.when(F.col("event_type") == "error", F.create_map(F.lit("Model"), F.lit(""))).otherwise(full)
    return e.select("event_id", S.camera_record(tags).alias("c")).select("event_id", "c.lens", "c.model")


@_query(_WITH + """SELECT doc_id, name AS base, '/lib/' || source || '/' || lang AS dir, lower(regexp_extract(name, '\\.([^.]+)$', 1)) AS ext, lang || '-' || doc_id AS stem, 'src' || doc_id || '_.jpg' AS clean,
  CASE lower(regexp_extract(name, '\\.([^.]+)$', 1)) WHEN 'jpg' THEN 'image/jpeg' WHEN 'png' THEN 'image/png' WHEN 'mp4' THEN 'video/mp4' WHEN 'webm' THEN 'video/webm' WHEN 'gif' THEN 'image/gif' ELSE 'application/octet-stream' END AS mime,
  'media://local/lib/' || source || '/a%20b%23' || doc_id || '.jpg?w=4096' AS url, '/lib/' || lang || '/x' AS resolved FROM catalog""")
def names_and_paths(spark, sf_dir):
    c = _catalog(spark, sf_dir)
    path, name = F.col("path"), F.col("name")
    return c.select(
        "doc_id", S.basename(path).alias("base"), S.dirname(path).alias("dir"), S.extension(name).alias("ext"), S.stem(name).alias("stem"),
        S.sanitise_name(F.concat(F.lit("/up/src"), F.col("doc_id").cast("string"), F.lit("!?.jpg"))).alias("clean"), S.mime_type(name).alias("mime"),
        S.display_url(F.concat(F.lit("/lib/"), "source", F.lit("/a b#"), F.col("doc_id").cast("string"), F.lit(".jpg"))).alias("url"),
        S.resolve_path(F.concat(F.lit("/lib/"), "source"), F.concat(F.lit("../"), "lang", F.lit("/./x"))).alias("resolved"),
    )


@_query("""SELECT p_partkey, floor(w * s + 0.5)::int AS width, floor(h * s + 0.5)::int AS height, w::bigint * h AS area, least(1.0, p_size / 20.0 / 2) AS instant FROM (
  SELECT *, least(1.0, 512 / greatest(w, h)) AS s FROM (SELECT p_partkey, p_size, p_size * 31 AS w, (p_partkey % 90 + 1)::int * 13 AS h FROM part))""")
def sizes_and_instants(spark, sf_dir):
    p = _read(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_size") * 31).alias("w"), ((F.col("p_partkey") % 90 + 1).cast("int") * 13).alias("h"))
    fit = S.fit_square(F.col("w"), F.col("h"), 512)
    return p.select("p_partkey", fit["width"].alias("width"), fit["height"].alias("height"), S.pixel_area(F.col("w"), F.col("h")).alias("area"), S.sample_instant(F.col("p_size") / 20.0).alias("instant"))


@_query(_WITH + "SELECT doc_id, concat_ws(' · ', CASE WHEN doc_id % 2 = 0 THEN 'January 2, 2024' ELSE name END, lang || ' · ' || type) AS caption, 'a|' || lang AS folder FROM catalog")
def captions(spark, sf_dir):
    c = _catalog(spark, sf_dir)
    date = F.when(F.col("doc_id") % 2 == 0, F.lit(1704196800000)).otherwise(F.lit(0))
    return c.select("doc_id", S.caption(date, F.col("name"), F.array("lang", "type")).alias("caption"), S.folder_key(F.array(F.lit("a"), "lang")).alias("folder"))
