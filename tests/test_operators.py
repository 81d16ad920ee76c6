import datetime
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from catalogops.functions import scalars as S
from catalogops.operators import catalog as C
from catalogops.operators import duplicates as D
from catalogops.operators import edits as E
from catalogops.operators import manifests as M
from catalogops.operators import metadata as X
from catalogops.operators.components import connected_components
from catalogops.plans import queries as Q
from catalogops.sources import decoders, media
from catalogops.streaming import streams as T


def column(df, name):
    return sorted(r[name] for r in df.select(name).collect())


def test_scan(spark, tmp_path):
    for name in ("photo.jpg", "photo.HEIC", "clip.mp4", "nested/deep.png", "notes.txt", ".hidden.jpg", ".git/sneaky.jpg", "_DSC0001.jpg"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text("x")
    (tmp_path / "empty.jpg").touch()
    files, errors = media.catalog(spark, str(tmp_path))
    assert column(files, "name") == ["_DSC0001.jpg", "clip.mp4", "deep.png", "empty.jpg", "photo.HEIC", "photo.jpg"]
    assert errors.count() == 0
    assert column(media.duplicate_candidates(spark, [str(tmp_path), str(tmp_path / "nested")]), "path") == sorted(str(tmp_path / n) for n in ("_DSC0001.jpg", "empty.jpg", "photo.jpg", "nested/deep.png"))


def test_missing_root_is_an_error_row(spark, tmp_path):
    _, errors = media.catalog(spark, str(tmp_path / "none"))
    assert column(errors, "code") == ["ENOENT"]


def test_decoders(spark):
    rows = [(1, b"ab", "clash"), (2, None, "clash"), (3, b"", "clash"), (1, b"ab", "clash")]
    files = spark.createDataFrame(rows, "path long, content binary, raster string")
    got = decoders.rasters(files, lambda c: [float(x) for x in c] if c else 1 / 0)
    assert sorted(map(str, got.collect())) == sorted(map(str, [Row(path=p, raster=[97.0, 98.0] if p == 1 else None) for p, _, _ in rows]))
    tags = decoders.raw_tags(files, lambda c: {"Make": c.decode(), "Model": ""}).select("path", "raster", S.camera_record(F.col("raw_tags")).alias("c"))
    assert sorted((r.path, r.raster, r.c and r.c.make) for r in tags.collect()) == [(1, "clash", "ab"), (1, "clash", "ab"), (2, "clash", None), (3, "clash", None)]
    assert decoders.rasters(files.where("false"), list).count() == 0


def test_described_tags(spark):
    ddl = "tags map<string, struct<description: string, values: array<string>>>"
    rows = spark.createDataFrame([({"Make": ("M", ["x"]), "Lens": ("", ["24", "70"]), "ISO": (None, None)},), (None,)], ddl)
    got = [r.c for r in rows.select(S.camera_record(S.described_tags(F.col("tags"))).alias("c")).collect()]
    assert (got[0].make, got[0].lens, got[0].iso) == ("M", "24 70", None) and got[1] is None


def test_vocabulary_grows(spark):
    words = spark.createDataFrame([("a",), ("b",)], "tag string")
    assert [column(X.extended_vocabulary(words, t), "tag") for t in (" c ", "a", " ")] == [["a", "b", "c"], ["a", "b"], ["a", "b"]]


def test_edits_are_folded_in_order(spark):
    rng = random.Random(8)
    paths, words = ["/a", "/b", "/c"], ["x", " y", "z ", "", " "]
    base = {"/a": ["y", "q", "x"], "/b": ["x"], "/d": ["x", "x"]}
    log = [(i, rng.choice(paths) if rng.random() < 0.3 else "/a", rng.choice([*E.OPS, "none"]), rng.choice([*words, None]), rng.choice([True, False, None])) for i in range(400)]
    log += [(None, "/a", "tag", "n", True), (5000, None, "tag", "n", True), (5001, "/e", "toggle_tag", "w", False)]
    fav, tags, vocabulary = {"/b", "/d"}, {p: list(dict.fromkeys(t)) for p, t in base.items()}, {"q"}
    for seq, p, op, t, ensure in log:
        if seq is None or p is None or op == "none":
            continue
        kind, change = E.OPS[op]
        if kind == "favorite":
            fav = fav ^ {p} if change == "toggle" else fav | {p} if change == "add" else fav - {p}
        elif t is not None and t.strip():
            t, now = t.strip(), tags.setdefault(p, [])
            there = t in now
            if there and change in ("remove", "toggle"):
                now.remove(t)
            elif not there and change in ("add", "toggle"):
                now.append(t)
            if op == "tag" or (op == "toggle_tag" and ensure):
                vocabulary.add(t)
    rng.shuffle(log)
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    got = E.fold_edits(frame([("/b",), ("/d",)], "path string"), frame(list(base.items()), "path string, tags array<string>"), frame([("q",)], "tag string"), frame(log, "seq long, path string, op string, tag string, ensure boolean"))
    assert column(got[0], "path") == sorted(fav) and column(got[2], "tag") == sorted(vocabulary)
    assert {r.path: r.tags for r in got[1].collect()} == {p: t for p, t in tags.items() if t}
    nothing = E.fold_edits(*[d.where("false") for d in (frame([("/b",)], "path string"), frame([("/a", ["x"])], "path string, tags array<string>"), frame([("q",)], "tag string"), frame(log, "seq long, path string, op string, tag string, ensure boolean"))])
    assert [d.count() for d in nothing] == [0, 0, 0]


@pytest.mark.parametrize("budget", [0, 1, 50, 137, 400, 10**6])
def test_retention(spark, budget):
    rng = random.Random(budget)
    files = [(f"k{i:03}", datetime.datetime(2024, 1, rng.choice([1, 2, 2, 2, 3]), rng.randrange(3)), rng.randrange(6)) for i in range(150)]
    stay, drop = 0, []
    for f in sorted(files, key=lambda f: f[1::-1], reverse=True):
        stay += f[2]
        if stay > budget:
            drop.append(f)
    rows = spark.createDataFrame([*files, ("x", None, 5), ("y", files[0][1], None)], "key string, mtime timestamp, size long")
    assert sorted(map(tuple, M.retention(rows, budget).collect())) == sorted(drop)
    assert M.retention(rows.where("false"), budget).count() == 0


def test_exact_duplicates(spark):
    rows = [("one", 15, "identical-bytes"), ("two", 15, "identical-bytes"), ("other", 15, "different-bytes"), ("e1", 0, ""), ("e2", 0, "")]
    assert column(D.exact_duplicates(spark.createDataFrame(rows, "path string, size long, content string")), "path") == ["one", "two"]


@pytest.mark.parametrize(
    "rows, threshold, groups",
    [
        ([("a", "1111"), ("b", "1111"), ("c", "0000")], 0, {"a": "a", "b": "a"}),
        ([("a", "0000"), ("b", "0001"), ("c", "0011")], 1, {"a": "a", "b": "a", "c": "a"}),
        ([("a", "0000"), ("b", "1111")], 1, {}),
        ([], 2, {}),
    ],
)
def test_similar_groups(spark, rows, threshold, groups):
    got = D.similar_groups(spark.createDataFrame(rows, "path string, hash string"), threshold, digits=4)
    assert {r.path: r.group_id for r in got.collect()} == groups


def test_hash_length_is_checked(spark):
    with pytest.raises(ValueError):
        D.hash_pairs(spark.createDataFrame([("a", "00"), ("b", "0000")], "path string, hash string"), 1, digits=4)


def test_components_of_a_chain(spark):
    got = connected_components(spark.createDataFrame([(i, i + 1) for i in range(100)], "src int, dst int"))
    assert {r.component for r in got.collect()} == {0} and got.count() == 101


def test_metadata(spark):
    rows = [("/lib/sub", '{"tags": {"c.jpg": ["old"]}, "favorites": ["b.jpg"]}'), ("/lib", '{"tags": {"sub/c.jpg": ["new"]}, "tagNames": ["x"]}'), ("/bad", "{")]
    fav, tags, words = X.load_metadata(X.parse_sidecars(spark.createDataFrame(rows, "dir string, json string")))
    assert column(fav, "path") == ["/lib/sub/b.jpg"] and column(words, "tag") == ["x"]
    assert [(r.path, r.tags) for r in tags.collect()] == [("/lib/sub/c.jpg", ["new"])]


def test_functions(spark):
    rows = spark.createDataFrame([(512,), (2048,), (5 << 20,), (250 << 20,), (3 << 30,)], "n long")
    assert [r[0] for r in rows.select(S.format_bytes(F.col("n"))).collect()] == ["512 B", "2.0 KB", "5.0 MB", "250 MB", "3.0 GB"]
    one = spark.range(1)
    assert one.select(S.sanitise_name(F.lit("guest photo!.jpg"))).first()[0] == "guest photo_.jpg"
    assert one.select(S.media_url(F.lit("/Users/me/my photos/#1 pick.jpg"))).first()[0] == "media://local/Users/me/my%20photos/%231%20pick.jpg"
    names = spark.createDataFrame([(n,) for n in ("img10", "img2", "IMG1", "a")], "name string")
    assert [r.name for r in names.orderBy(S.natural_order(F.col("name"))).collect()] == ["a", "IMG1", "img2", "img10"]


def test_positions(spark):
    rows = C.numbered(spark.range(100).withColumn("k", F.hash("id")), [F.col("k").asc()])
    got = [r.k for r in rows.orderBy("position").collect()]
    assert got == sorted(got) and column(rows, "position") == list(range(1, 101))


def matches_sql(spark, name, sf_dir="/root/testdata/sf0.001"):
    """The query's rows, once they are those of its SQL over the same tables."""
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for table in ("documents", "labels"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    df = Q.QUERIES[name](spark, sf_dir)
    got = sorted(map(tuple, df.collect()))
    assert got == sorted(db.execute(f"SELECT {', '.join(df.columns)} FROM ({Q.ORACLE_SQL[name]})").fetchall())
    return got


def test_scans_and_positions_cover_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    n = docs.count()
    union = matches_sql(spark, "scan_union_whole")
    assert {r[0] for r in union} == {r.doc_id for r in docs.select("doc_id").collect()} and len(union) > n
    assert len(matches_sql(spark, "scan_union_distinct_whole")) == n
    assert sorted(r[1] for r in matches_sql(spark, "playlist_positions_whole")) == list(range(1, n + 1))
    assert len(matches_sql(spark, "playlist_position_of")) == 1


def test_save_plan_routes_tags(spark):
    got = matches_sql(spark, "save_plan_whole")
    assert any(r[3] and r[0].endswith("/en") for r in got) and any(r[3] and not r[0].endswith("/en") for r in got)
    assert all(r[5] for r in got) and any("|toxic" in r[4] for r in got)
    rows = lambda data, ddl: spark.createDataFrame(data, ddl)
    tags = rows([("/lib/a/sub/x.jpg", ["t"]), ("/lib/a/y.jpg", ["u", "v"]), ("/lib/a/z.jpg", []), ("/out/w.jpg", ["t"])], "path string, tags array<string>")
    plan = X.save_plan(rows([], "path string"), tags, rows([("t",), ("u",)], "tag string"), rows([("/lib/a",)], "root string"), rows([("/lib/a/sub",)], "dir string"))
    data = {r.dir: r.d for r in plan.select("dir", F.from_json("json", X.SIDECAR).alias("d")).collect()}
    assert {k: (d.tags, d.tagNames) for k, d in data.items()} == {"/lib/a": ({"y.jpg": ["u", "v"]}, ["t", "u"]), "/lib/a/sub": ({"x.jpg": ["t"]}, ["t", "u"])}


def one_after_another(uploads, taken):
    """Free names by going through the uploads (ord, name, dir) one by one."""
    used, out = set(taken), []
    for o, name, d in sorted(uploads, key=lambda u: (u[0] is not None, u[0] or 0, u[1], u[2])):
        base, dot, ext = name.rpartition(".")
        free, n = name, 0
        while (d, free) in used:
            n += 1
            free = f"{base}-{n}.{ext.lower()}" if dot else f"{name}-{n}"
        used.add((d, free))
        out.append((o, name, free, d))
    return sorted(out, key=str)


def test_free_names_never_meet(spark):
    rows = [(1, "a.jpg"), (2, "a.jpg"), (3, "a-1.jpg"), (4, "B.JPG"), (5, "B.JPG"), (6, "b.png"), (7, "c.jpg"), (8, "c.jpg"), (9, "noext"), (10, "noext")]
    taken = spark.createDataFrame([("c-1.jpg",), ("b.png",), ("a-1-1.jpg",)], "name string")
    got = {r.ord: r.stored for r in M.free_names(spark.createDataFrame(rows, "ord long, name string"), taken).collect()}
    want = ["a.jpg", "a-1.jpg", "a-1-2.jpg", "B.JPG", "B-1.jpg", "b-1.png", "c.jpg", "c-2.jpg", "noext", "noext-1"]
    assert [got[i] for i in range(1, 11)] == want
    assert M.free_names(spark.createDataFrame([], "ord long, name string"), taken).count() == 0
    none = M.free_names(spark.createDataFrame([(1, None), (None, "a.jpg"), (None, "a.jpg")], "ord long, name string"), taken)
    assert sorted((r.name or "", r.stored or "") for r in none.collect()) == [("", ""), ("a.jpg", "a-1.jpg"), ("a.jpg", "a.jpg")]


@pytest.mark.parametrize("seed", [0, 3])
def test_free_names_are_those_of_a_loop(spark, seed):
    rng = random.Random(seed)
    bits = ["a.jpg", "a.JPG", "a-1.jpg", "a-2.jpg", "a-1-1.jpg", "a-1-2.jpg", "a-01.jpg", "a-3.JPG", "-1.jpg", "b", "b-1", "a-4.jpg", "a-2-1.jpg"]
    if seed == 3:
        bits = [f"a-{i}.jpg" for i in range(1, 40)] + ["a.jpg"] * 40
    uploads = [(i if rng.random() < 0.9 else None, rng.choice(bits), rng.choice(["/x", "/y"])) for i in range(150)]
    taken = {(rng.choice(["/x", "/y", "/z"]), rng.choice([*bits, "a-7.jpg", "a-9.jpg"])) for _ in range(12)}
    got = M.free_names(spark.createDataFrame(uploads, "ord long, name string, dir string"), spark.createDataFrame(list(taken), "dir string, name string"))
    assert sorted(map(tuple, got.select("ord", "name", "stored", "dir").collect()), key=str) == one_after_another(uploads, taken)


def test_camera_names_are_shared_out(spark):
    n = 200_000
    up = spark.range(n).select(F.col("id").alias("ord"), F.concat(F.lit("photo-"), (F.col("id") + 1).cast("string"), F.lit(".jpg")).alias("name"))
    up = up.unionByName(spark.createDataFrame([(n + i, "photo.jpg") for i in range(3)], "ord long, name string"))
    got = M.free_names(up, spark.createDataFrame([("photo-7.jpg",)], "name string"))
    assert got.where("ord < 200000 and stored <> name").select("stored").collect() == [Row(stored="photo-7-1.jpg")]
    assert column(got.where("ord >= 200000"), "stored") == ["photo-200001.jpg", "photo-200002.jpg", "photo.jpg"]
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 2


def test_sidecars_outside_the_roots_are_not_written(spark):
    favorites = spark.createDataFrame([("/lib/a/x.jpg",), ("/other/y.jpg",)], "path string")
    tags = spark.createDataFrame([("/lib/a/sub/z.jpg", ["beach"])], "path string, tags array<string>")
    dirs = lambda *names: spark.createDataFrame([(n,) for n in names], "dir string")
    plan = X.save_plan(favorites, tags, spark.createDataFrame([("beach",)], "tag string"), dirs("/lib").withColumnRenamed("dir", "root"), dirs("/lib/a/sub", "/other", "/lib2"))
    got = {r.dir: r.d for r in plan.select("dir", F.from_json("json", X.SIDECAR).alias("d")).collect()}
    assert set(got) == {"/lib", "/lib/a/sub"}
    assert got["/lib"].favorites == ["a/x.jpg"] and got["/lib/a/sub"].tags == {"z.jpg": ["beach"]} and got["/lib"].tagNames == ["beach"]


def test_fixed_lists(spark):
    names = spark.createDataFrame([("a.MKV",), ("a.gifv",), ("a.heic",), ("a",), ("a.jpeg",)], "name string")
    assert [r[0] for r in names.select(S.mime_type(F.col("name"))).collect()] == ["video/x-matroska", "video/mp4", "application/octet-stream", "application/octet-stream", "image/jpeg"]
    assert "toggle-play" in C.ACTIONS and "\N{PARTY POPPER}" in C.REACTIONS and len(C.REACTIONS) == 5
    up = spark.createDataFrame([("a.jpg", 5, True), ("a.exe", 5, True), ("a.jpg", 0, True), ("a.jpg", (200 << 20) + 1, True), ("a.jpg", 200 << 20, True), ("a.jpg", 5, False)], "name string, size long, ok boolean")
    assert [r.reject_reason for r in C.upload_status(up, root_allowed=F.col("ok")).collect()] == [None, "type", "empty", "too large", None, "root"]


def test_sidecars_are_written_and_read(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    plan = spark.createDataFrame([(str(tmp_path), '{"version":1}'), (str(tmp_path / "sub"), '{"version":2}')], "dir string, json string")
    media.write_sidecars(plan, ".meta.json")
    media.write_sidecars(plan.where(F.col("dir") == str(tmp_path)).withColumn("json", F.lit("{}")), ".meta.json")
    got = {r.dir: r.json for r in media.sidecars(spark, str(tmp_path), ".meta.json").collect()}
    assert got == {str(tmp_path): "{}", str(tmp_path / "sub"): '{"version":2}'} and sorted(p.name for p in tmp_path.iterdir()) == [".meta.json", "sub"]


def streamed(spark, tmp_path, rows, ddl, work, mode="append"):
    """Rows that a query gives on a stream of batches, each a file."""
    for i, batch in enumerate(rows):
        spark.createDataFrame(batch, ddl).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    schema = spark.read.parquet(f"{tmp_path}/in/0").schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    name = f"out{abs(hash(str(tmp_path)))}"
    query = work(source).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


def test_upload_stream(spark, tmp_path):
    at = "2024-01-01 00:00:0"
    rows = [[(at + "1", "/r", "guest photo!.jpg", 5), (at + "2", "/r", "evil.exe", 5), (at + "2", "/r", None, 5)], [(at + "3", "/r", "guest photo!.jpg", 9), (at + "4", "/r", "clip.mov", 1)]]
    got = streamed(spark, tmp_path, rows, "ts string, root string, name string, size long", T.accepted_uploads)
    assert sorted((r.name, r.size, r.dir) for r in got) == [("clip.mov", 1, "/r/guests"), ("guest photo_.jpg", 5, "/r/guests"), ("guest photo_.jpg", 9, "/r/guests")]


def test_uploads_go_to_their_dir(spark):
    catalog = spark.createDataFrame([("a.jpg", "/lib/guests/a.jpg", "image"), ("b.jpg", "/lib/other/b.jpg", "image")], "name string, path string, type string")
    batch = spark.createDataFrame([(1, "a.jpg"), (2, "b.jpg"), (3, "clip.mov")], "ts long, name string")
    named = sorted(map(tuple, T.name_batch(batch, catalog, "/lib/guests").collect()))
    assert named == [("a-1.jpg", "/lib/guests/a-1.jpg", "image"), ("b.jpg", "/lib/guests/b.jpg", "image"), ("clip.mov", "/lib/guests/clip.mov", "video")]
    assert C.append_absent(catalog, spark.createDataFrame(named, catalog.schema)).count() == 5


def test_no_upload_is_lost_over_batches(spark, tmp_path):
    catalog = spark.createDataFrame([("a.jpg", "/r/guests/a.jpg", "image")], "name string, path string, type string")
    sink = T.UploadSink(f"file://{tmp_path}/uploads", catalog)
    ddl = "ts long, name string, dir string"
    batches = [[(1, "a.jpg", "/r/guests"), (2, "a.jpg", "/r/guests")], [(3, "a.jpg", "/r/guests"), (4, "b.jpg", "/r/guests"), (5, "a.jpg", "/q/guests")], [(6, "a-1.jpg", "/r/guests"), (7, "b.jpg", "/r/guests")]]
    for i in (0, 1, 1, 2, 0):  # some are delivered again
        sink(spark.createDataFrame(batches[i], ddl), i)
    everything = [(o, n, d) for b in batches for o, n, d in b]
    want = sorted(f"{d}/{stored}" for _, _, stored, d in one_after_another(everything, {("/r/guests", "a.jpg")}))
    assert column(sink.stored(spark), "path") == want == sorted(set(want))


def test_burst_and_latest_streams(spark, tmp_path):
    at = "2024-01-01 00:00:0"
    rows = [[(at + "1.0", "k", "a"), (at + "1.3", "k", "b"), (at + "3.0", "k", "c")], [("2024-01-01 01:00:00", "k", "d")]]
    got = streamed(spark, tmp_path / "b", rows, "ts string, key string, value string", T.collapse_bursts)
    assert sorted((r.value, r.n) for r in got) == [("b", 2), ("c", 1)]
    last = streamed(spark, tmp_path / "l", rows, "ts string, key string, value string", T.latest_values, "complete")
    assert [(r.key, r.value) for r in last] == [("k", "d")]


def test_only_files_whose_size_repeats_are_hashed(spark, tmp_path):
    content = {"one.jpg": "identical-bytes", "two.jpg": "identical-bytes", "other.jpg": "different-bytes", "small.png": "tiny", "big.webp": "b" * 99, "e1.gif": "", "e2.gif": "", "v.mov": "clip", "w.mkv": "clip", "notes.txt": "tiny"}
    for name, text in content.items():
        p = tmp_path / "in" / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(text)
    root = str(tmp_path / "in")
    names = lambda df: [p.rsplit("/", 1)[1] for p in column(df, "path")]
    # 4 bytes: a picture and two videos; 15 bytes: three pictures.
    assert names(media.hash_candidates(spark, [root, root])) == ["one.jpg", "other.jpg", "small.png", "two.jpg", "v.mov", "w.mkv"]
    assert names(media.duplicate_files(spark, [root, root])) == ["one.jpg", "two.jpg", "v.mov", "w.mkv"]
    assert names(media.hash_candidates(spark, [root], include_videos=False)) == ["one.jpg", "other.jpg", "two.jpg"]
    assert names(media.duplicate_files(spark, [root], include_videos=False)) == ["one.jpg", "two.jpg"]
    gone = spark.createDataFrame([(str(tmp_path / "none"),), (f"file://{root}/one.jpg",)], "path string")
    assert [r.hash for r in media.digests(gone).collect()] == [__import__("hashlib").sha256(b"identical-bytes").hexdigest()]


def test_size_sketch(spark, monkeypatch):
    rows = [(i, i) for i in range(1, 3001)] + [(10_000 + i, i * 7) for i in range(1, 200)] + [(20_000, 0), (20_001, 0), (20_002, None), (1, 1)]
    files = spark.createDataFrame(rows, "path long, size long")
    several = {s for _, s in rows[3000:3199] if s <= 3000}
    got = {r.size for r in files.where(D.may_repeat(F.col("size"), D.size_sketch(files))).collect()}
    assert several <= got and len(got - several) < 400 and 0 not in got and None not in got
    monkeypatch.setattr(D, "MAX_SKETCH_BITS", 128)
    assert D.size_sketch(files) is None and files.where(D.may_repeat(F.col("size"), None)).count() == 3200
    assert D.exact_duplicates(files.where("false").withColumn("content", F.lit("x"))).count() == 0


def saved(roots, existing, favorites, tags, words):
    """What is in the sidecars after the roots are saved one after another."""
    under = lambda d, p: p == d or p.startswith(d + "/")
    files = {d: None for d in existing}
    for root in roots:
        have = {d for d in files if under(root, d)}
        dirs = sorted(have | {root}, key=len, reverse=True)
        owner = lambda p: next(d for d in dirs if under(d, p))  # noqa: B023, E731
        new = {d: (set(), {}) for d in dirs}
        for p in favorites:
            if under(root, p):
                new[owner(p)][0].add(p[len(owner(p)) + 1 :])
        for p, t in tags.items():
            if under(root, p) and t:
                new[owner(p)][1][p[len(owner(p)) + 1 :]] = t
        files |= {d: (sorted(f), t, sorted(words)) for d, (f, t) in new.items() if f or t or d in have}
    return {d: f for d, f in files.items() if f is not None}


def metadata(spark, roots, existing, favorites, tags, words):
    rows = lambda data, ddl: spark.createDataFrame(data, ddl)
    return (
        rows([(p,) for p in favorites], "path string"), rows(list(tags.items()), "path string, tags array<string>"), rows([(w,) for w in words], "tag string"),
        rows([(r, i) for i, r in enumerate(roots)], "root string, ord int"), rows([(d,) for d in existing], "dir string"),
    )


@pytest.mark.parametrize("seed", range(3))
def test_save_plan_of_nested_roots(spark, seed):
    rng = random.Random(seed)
    places = ["/l", "/l/a", "/l/a/b", "/l/a/b/c", "/l/d", "/m", "/m/x", "/l2"]
    roots = rng.sample(places[:6], 4)
    existing = rng.sample(places, 4)
    paths = [f"{rng.choice(places)}/{rng.choice('pqrst')}.jpg" for _ in range(40)]
    favorites, tags = set(paths[:20]), {p: rng.choice([["t"], ["u", "t"], []]) for p in paths[10:]}
    plan = X.save_plan(*metadata(spark, roots, existing, favorites, tags, ["u", "t"]))
    got = {r.dir: (r.d.favorites, r.d.tags, r.d.tagNames) for r in plan.select("dir", F.from_json("json", X.SIDECAR).alias("d")).collect()}
    assert got == saved(roots, existing, favorites, tags, ["u", "t"])


def test_sidecars_are_streamed_and_committed_together(spark, tmp_path):
    base = str(tmp_path)
    for d in ("a", "a/b", "c"):
        (tmp_path / d).mkdir()
    (tmp_path / "c" / ".m.json").write_text("old")
    favorites = {f"{base}/a/{i}é\".jpg" for i in range(2000)} | {f"{base}/a/b/x.jpg"}
    tags = {f"{base}/a/1é\".jpg": ["q\"", "t"], f"{base}/a/b/y.jpg": ["t"]}
    args = ([base + "/a", base + "/c"], [base + "/a/b", base + "/c"], favorites, tags, ["t", "é"])
    media.save_sidecars(*metadata(spark, *args), ".m.json")
    found = X.parse_sidecars(media.sidecars(spark, [base + "/a", base + "/c", base + "/a/b"], ".m.json"))
    got = {r.dir: (r.data.favorites, r.data.tags, r.data.tagNames) for r in found.collect()}
    assert got == saved(*args)
    # One dir of the job is missing: all files stay as they were, and no part is left.
    with pytest.raises(Exception):
        media.save_sidecars(*metadata(spark, [base + "/a", base + "/none"], [], favorites | {base + "/none/z.jpg"}, {}, []), ".m.json")
    again = X.parse_sidecars(media.sidecars(spark, [base], ".m.json"))
    assert {r.dir: (r.data.favorites, r.data.tags, r.data.tagNames) for r in again.collect()} == got
    assert not [p for p in tmp_path.rglob("*.part")]


def test_malformed_sidecars_are_left_out(spark):
    rows = [("/a", '{"favorites":["x"],"tags":{"y":["t"]}'), ("/b", '{"favorites":"oops","tags":{"y":["t"]}}'), ("/c", "[1]"), ("/d", ""), ("/e", None), ("/f", '{"version":1}')]
    got = {r.dir: r.data for r in X.parse_sidecars(spark.createDataFrame(rows, "dir string, json string")).collect()}
    assert set(got) == {"/b", "/f"} and got["/b"].tags == {"y": ["t"]}


def test_decoders_convert_or_give_nothing(spark):
    files = spark.createDataFrame([(1, b"ab")], "path long, content binary")
    assert decoders.raw_tags(files, lambda c: {"ISO": 100, "Lens": None}).first().raw_tags == {"ISO": "100", "Lens": None}
    assert decoders.rasters(files, lambda c: "text").first().raster is None and decoders.rasters(files, lambda c: [1, 2]).first().raster == [1.0, 2.0]
    assert decoders.raw_tags(files, lambda c: 5).first().raw_tags is None


def test_deep_trees_are_walked_level_by_level(spark, tmp_path):
    deep = tmp_path
    for i in range(6):
        deep = deep / f"d{i}"
        deep.mkdir()
        (deep / f"{i}.jpg").write_text("x" * i)
    (tmp_path / "d0" / ".hidden").mkdir()
    (tmp_path / "d0" / ".hidden" / "h.jpg").touch()
    (tmp_path / "d0" / "link.jpg").symlink_to(deep / "5.jpg")
    got = sorted((r.path, r.size) for r in media.scan(spark, str(tmp_path)).collect())
    assert got == [(str(p), p.stat().st_size) for p in sorted(tmp_path.rglob("[0-9].jpg"))] and len(got) == 6
    stored = media.scan(spark, f"file://{tmp_path}/d0/d1").collect()
    assert sorted((r.path, r.size) for r in stored) == [(f"file://{p}", s) for p, s in got if "/d0/d1/" in p] and all(r.mtime_ms > 0 for r in stored)
    assert [r.error for r in media.scan(spark, f"file://{tmp_path}/none").collect()] == ["ENOENT"]
    tree = spark.read.format("media_tree").load(str(tmp_path))
    assert sorted((r.path, r.size) for r in tree.where("status = 'file'").collect()) == got


@pytest.fixture(autouse=True)
def registered(spark):
    spark.dataSource.register(media.MediaTree)


def scanned_rows(df):
    """Rows that the file scans of a query have given."""
    df.collect()
    todo, rows = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        if node.nodeName().startswith("Scan parquet"):
            rows += node.metrics().apply("numOutputRows").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return rows


def test_stored_playlists_are_read_in_part(spark, tmp_path):
    n = 40_000
    rows = spark.range(1, n + 1).select(F.concat(F.lit("/lib/"), F.sha2(F.col("id").cast("string"), 256)).alias("path"), F.col("id").alias("position"))
    C.store_playlist(rows.repartition(4), str(tmp_path / "list"), 1000)
    stored = spark.read.parquet(str(tmp_path / "list"))
    page = C.stored_page(stored, 20_000, 50)
    assert [r.position for r in page.collect()] == list(range(20_001, 20_051))
    assert scanned_rows(page) <= n / 20
    path = rows.where("position = 77").first().path
    assert [tuple(r) for r in C.position_of(stored, path).collect()] == [(path, 77)]
