"""Near-duplicate classes of documents by their spot signatures.

Sets are partitioned by length, so that two similar ones lie in the same or the
next partition, and meet there by blocks of a few signatures: single ones are shared by
chance, by ever more sets as a table grows, whole blocks hardly.  Only keys that
several sets have leave the exchange.  Lengths prune
before sets are compared by Jaccard.  Members of a bucket are first compared
with its centre; only what stays in other classes is compared further, so a
large family of near copies costs one comparison a member.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalogops.llm.common import bounded_batches, slices
from catalogops.llm.jaccard_join import _NO_ID, PAIRS_PER_SALT, REMEMBERED, SMALL, Bands, _close, _components, _still_open, _stars, _tiles, _tries, _whole, bit_sketch, block_keys
from catalogops.llm.jaccard_join import _compared as _sketched
from catalogops.llm.spotsigs import _Hashes, signatures
from catalogops.plans.staging import discard, written

#: Least likeness of a link in hundredths.
PERCENT = 80
#: Counters of the summary of frequent signatures, and the most of them that are sent to all tasks.
COUNTERS = 65_536
#: Signatures of a set that weigh as much as one member of a bucket.
WEIGHT = 16_384
#: Bits of a block's key that are shuffled, and keys that a task packs at a time.
KEY_BITS = 44
CHUNK = 1 << 20
#: Most 64-bit words of the filter of rows whose sets are wanted; a fuller one lets more rows pass.
FILTER_WORDS = 1 << 20


_SKETCH = [("n", pa.int64()), ("own", pa.int32()), ("bands", pa.list_(pa.int32())), ("bits", pa.list_(pa.list_(pa.int64())))]
_SKETCH_DDL = "n long, own int, bands array<int>, bits array<array<long>>"


def _wide(sigs: np.ndarray) -> np.ndarray:
    return sigs.astype(np.uint64) << np.uint64(32)


def _node(sigs: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(sigs.tobytes()) - (1 << 63)


def packed_keys(keys: np.ndarray, places: np.ndarray, parts: int) -> Iterator[tuple[int, int, int, bytes]]:
    """``(part, count, width, packed)`` of 64-bit keys and the places (16 bits) they come from: the leading ``KEY_BITS`` of the keys, sorted.

    A part is a range of keys; its gaps and places are stored byte by byte, the gaps ``width`` bytes wide.
    """
    short = keys >> np.uint64(64 - KEY_BITS)
    order = np.argsort(short)
    short, places = short[order], places[order].astype(np.uint16)
    part = (short * np.uint64(parts)) >> np.uint64(KEY_BITS)
    edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
    codec = pa.Codec("zstd", 1)
    for low, high in zip(edges, edges[1:]):
        if low == high:
            continue
        gaps = np.diff(short[low:high], prepend=np.uint64(0))
        width = max(1, -(-int(gaps.max()).bit_length() // 8))
        planes = [x.astype(x.dtype.newbyteorder("<")).view(np.uint8).reshape(high - low, -1)[:, :n].T.tobytes() for x, n in ((gaps, width), (places[low:high], 2))]
        yield int(part[low]), high - low, width, codec.compress(b"".join(planes), asbytes=True)


def unpacked_keys(count: int, width: int, packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The sorted keys and their places that :func:`packed_keys` packed."""
    planes = np.frombuffer(pa.Codec("zstd").decompress(packed, decompressed_size=count * (width + 2), asbytes=True), np.uint8).reshape(width + 2, count)
    gaps, places = np.zeros((count, 8), np.uint8), np.ascontiguousarray(planes[width:].T)
    gaps[:, :width] = planes[:width].T
    return np.cumsum(gaps.view("<u8")[:, 0], dtype=np.uint64), places.view("<u2")[:, 0]


def shared_keys(rows: DataFrame, percent: int) -> DataFrame:
    """Two kinds of rows ``(id, tag, node, n, own, bands, bits, ref, key)`` of ``(id, tag, text)``.

    One for each row, without ``key``: ``node`` is its set's 64-bit hash; its size, bit sketches and ``ref`` come with one row that a task remembers.
    And ``(ref, key)`` for each block key that several refs have; of all other keys nothing is left.
    Keys are shuffled in their leading bits, sorted and packed for each task and range of keys, with 16 bits for the set.
    """
    bounded_batches(rows.sparkSession)
    parts = min(2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 << (63 - KEY_BITS))
    sent = pa.schema([("part", pa.int32()), ("id", pa.int64()), ("tag", pa.int64()), ("node", pa.int64()), *_SKETCH, ("ref", pa.int64()), ("chunk", pa.int64()), ("count", pa.int64()), ("width", pa.int64()), ("packed", pa.binary())])
    met = pa.schema([("id", pa.int64()), ("tag", pa.int64()), ("node", pa.int64()), *_SKETCH, ("ref", pa.int64()), ("key", pa.int64())])

    def filled(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
        made = {f.name: x if isinstance(x := columns[f.name], pa.Array) else pa.array(x, f.type) for f in schema if f.name in columns}
        n = len(next(iter(made.values())))
        return pa.RecordBatch.from_arrays([made[f.name] if f.name in made else pa.nulls(n, f.type) for f in schema], schema=schema)

    def run(batches):
        hashes, done, bands = _Hashes(), set(), Bands(percent)
        chunk, keys, sizes, held = TaskContext.get().partitionId() << 23, [], [], 0

        def flushed():
            if held:
                found = zip(*packed_keys(np.concatenate(keys), np.repeat(np.arange(len(keys)), sizes), parts))
                part, count, width, packed = map(list, found)
                yield filled(sent, {"part": part, "chunk": [chunk] * len(part), "count": count, "width": width, "packed": packed})
            keys.clear()
            sizes.clear()

        for batch in batches:
            for piece in slices(batch, "text"):
                nodes, refs, sketch = [], [], []
                for text in piece.column("text").to_pylist():
                    found = signatures(text, hashes)
                    node = _node(found)
                    nodes.append(node)
                    refs.append(None)
                    sketch.append((None,) * 4)
                    if node in done:
                        continue
                    if len(done) > REMEMBERED:
                        done.clear()
                    done.add(node)
                    if held >= CHUNK or len(keys) >= 1 << 16:
                        yield from flushed()
                        chunk, held = chunk + 1, 0
                    refs[-1] = chunk << 16 | len(keys)
                    met_in = [b for b, _, _ in bands.of(len(found))]
                    sketch[-1] = len(found), bands.own(len(found)), met_in, [bit_sketch(_wide(found), bands.top(b)) for b in met_in]
                    keys.append(block_keys(_wide(found), bands))
                    sizes.append(len(keys[-1]))
                    held += sizes[-1]
                yield filled(sent, {"part": [x % parts for x in nodes], "id": piece.column("id"), "tag": piece.column("tag"), "node": nodes, "ref": refs, **dict(zip(("n", "own", "bands", "bits"), map(list, zip(*sketch))))})
            pa.default_memory_pool().release_unused()
        yield from flushed()

    def meet(batches):
        keys, refs, now = [], [], None

        def done():
            if keys:
                key, ref = np.concatenate(keys), np.concatenate(refs)
                order = np.argsort(key)
                key, ref = key[order], ref[order]
                same = key[1:] == key[:-1]
                hit = np.concatenate([same, [False]]) | np.concatenate([[False], same])
                yield filled(met, {"ref": ref[hit], "key": key[hit].astype(np.int64)})
            keys.clear()
            refs.clear()

        for batch in batches:
            whole = pc.is_valid(batch.column("node"))
            own = batch.filter(whole)
            yield filled(met, {c: own.column(c) for c in ("id", "tag", "node", "n", "own", "bands", "bits", "ref")})
            rest = batch.filter(pc.invert(whole))
            for part, chunk, count, width, packed in zip(*(rest.column(c).to_pylist() for c in ("part", "chunk", "count", "width", "packed"))):
                if part != now:
                    yield from done()
                    now = part
                key, place = unpacked_keys(count, width, packed)
                keys.append(key)
                refs.append(place.astype(np.int64) | chunk << 16)
        yield from done()

    dealt = rows.mapInArrow(run, f"part int, id long, tag long, node long, {_SKETCH_DDL}, ref long, chunk long, count long, width long, packed binary")
    return dealt.repartition("part").sortWithinPartitions("part").mapInArrow(meet, f"id long, tag long, node long, {_SKETCH_DDL}, ref long, key long")


def _row_key() -> Column:
    return F.xxhash64(F.coalesce("id", F.lit(_NO_ID)), "tag")


def _sets(wanted: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """``(node, n, sigs)`` of the nodes in ``wanted``: their packed sets, out of another pass over ``rows``.

    A filter of one bit a row, at most ``FILTER_WORDS`` words, leaves out most other rows; a join leaves out the rest.
    """
    wanted = written(nodes.select("node", "ref.id", "ref.tag").join(wanted.distinct().hint("shuffle_hash"), "node"), "wanted")
    words = min(1 << max(4, wanted.count().bit_length()), FILTER_WORDS)
    bit = wanted.select(F.pmod(_row_key(), F.lit(64 * words)).alias("bit")).select(F.floor(F.col("bit") / 64).alias("word"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("mask"))
    found = bit.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    marks = np.zeros(words, np.int64)
    marks[found.column("word").to_numpy()] = found.column("mask").to_numpy()
    marks = marks.astype("<i8").view(np.uint8)

    def run(batches):
        hashes = _Hashes()
        for batch in batches:
            at = batch.column("bit").to_numpy()
            for piece in slices(batch.filter(pa.array((marks[at >> 3] >> (at & 7) & 1).astype(bool))), "text"):
                sets = [signatures(text, hashes) for text in piece.column("text").to_pylist()]
                columns = [piece.column("id"), piece.column("tag"), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "tag", "n", "sigs"])
            pa.default_memory_pool().release_unused()

    sets = rows.withColumn("bit", F.pmod(_row_key(), F.lit(64 * words))).mapInArrow(run, "id long, tag long, n long, sigs binary")
    both = lambda df: df.withColumn("id", F.coalesce("id", F.lit(_NO_ID)))
    out = written(both(sets).join(both(wanted).hint("shuffle_hash"), ["id", "tag"]).drop("id", "tag").dropDuplicates(["node"]), "sets")
    discard(wanted)
    return out


def frequent_signatures(sets: DataFrame, counters: int = COUNTERS) -> tuple[np.ndarray, np.ndarray]:
    """Signatures that make up more than 1/counters of all, sorted, and how often the Misra-Gries summaries of the tasks saw them.

    At most ``counters``, since what the summaries saw adds up to no more than all signatures.
    """

    def run(batches):
        held, seen = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        for batch in batches:
            for piece in slices(batch, "sigs"):
                flat = np.frombuffer(b"".join(piece.column("sigs").to_pylist()), np.uint32)
                held, at = np.unique(np.concatenate([held, flat]), return_inverse=True)
                seen = np.bincount(at, np.concatenate([seen, np.ones(len(flat), np.int64)]), len(held)).astype(np.int64)
                if len(held) > counters:
                    cut = np.partition(seen, -counters - 1)[-counters - 1]
                    stay = seen > cut
                    held, seen = held[stay], seen[stay] - cut
        often = seen > 1
        yield pa.RecordBatch.from_pydict({"sig": pa.array(held[often].astype(np.int64)), "seen": pa.array(seen[often])})

    sets = sets.where("sigs is not null")
    total = sets.agg(F.sum("n")).first()[0] or 0
    found = sets.select("sigs").mapInArrow(run, "sig long, seen long").groupBy("sig").agg(F.sum("seen").alias("seen")).where(F.col("seen") * counters >= total).collect()
    found.sort()
    return np.array([r[0] for r in found], np.uint32), np.array([r[1] for r in found], np.int64)


def bucket_keys(sigs: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], percent: int) -> np.ndarray:
    """Keys (length partition, signature) of a set; two sets that link share one.

    Signatures are ordered by how frequent they are.  The first ones of the longer set of a pair, in its own
    partition, and those of the shorter one, in its own or the next partition, have one in common.
    """
    names, times = frequent
    seen = np.zeros(len(sigs), np.int64)
    if len(names):
        at = np.minimum(np.searchsorted(names, sigs), len(names) - 1)
        seen = np.where(names[at] == sigs, times[at], 0)
    order = sigs[np.lexsort((sigs, seen))].astype(np.int64)
    n = len(order)
    longer, shorter = n + -n * percent // 100 + 1, n + -n * 2 * percent // (100 + percent) + 1
    part = math.floor(math.log(n) / math.log(100 / percent) + 1e-9)
    return np.concatenate([order[:longer] | part << 32, order[:shorter] | part + 1 << 32])


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node"))


def _on_sets(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, work) -> DataFrame:
    """``(a, b, got)`` for the written pairs ``(a, b)`` of sets for which ``work`` gives an array; b may be in very many pairs."""
    nodes = _sets(_ends(pairs), nodes, rows)
    many = pairs.groupBy("b").agg(F.ceil(F.count("*") / PAIRS_PER_SALT).cast("int").alias("salts"))
    left = pairs.join(many.hint("merge"), "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int")).drop("salts")
    left = left.join(nodes.select(F.col("node").alias("a"), F.col("sigs").alias("x")).hint("merge"), "a")
    right = nodes.select(F.col("node").alias("b"), F.col("sigs").alias("y")).join(many.hint("merge"), "b").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")

    def run(batches):
        for batch in batches:
            for piece in slices(batch, "x"):
                got = [work(np.frombuffer(x.as_py(), np.uint32), np.frombuffer(y.as_py(), np.uint32)) for x, y in zip(piece.column("x"), piece.column("y"))]
                keep = pa.array([x is not None for x in got], pa.bool_())
                yield pa.RecordBatch.from_arrays([piece.column("a"), piece.column("b"), pa.array(got, pa.list_(pa.int64()))], ["a", "b", "got"]).filter(keep)

    out = written(left.join(right.hint("merge"), ["b", "salt"]).select("a", "b", "x", "y").mapInArrow(run, "a long, b long, got array<long>"), "compared-sets")
    discard(nodes)
    return out


def _linked(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose likeness is ``percent`` or more; sizes and bit sketches prune before sets are read."""
    close = written(_close(pairs, nodes, percent).select("a", "b"), "close-pairs")
    if close.isEmpty():
        return close

    def work(x, y):
        both = len(np.intersect1d(x, y, assume_unique=True))
        return [] if 100 * both >= percent * (len(x) + len(y) - both) else None

    out = _on_sets(close, nodes, rows, work).select("a", "b")
    discard(close)
    return out


def links_of(sets: list[np.ndarray], part: np.ndarray, side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (places) that join what parts of ``sets`` are joined by links between different sides; at most one fewer than sets."""
    size = np.array([len(x) for x in sets])
    _, at = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    has = np.zeros(at.max() + 1, np.int64)
    part, out = part.copy(), []
    for k in range(len(sets) - 1):
        more = np.arange(k + 1, len(sets))
        more = more[(part[more] != part[k]) & (side[more] != side[k]) & (np.minimum(size[more], size[k]) * 100 >= np.maximum(size[more], size[k]) * percent)]
        if not len(more):
            continue
        own = at[starts[k] : starts[k] + size[k]]
        has[own] = 1
        both = np.add.reduceat(has[at], starts)[more]
        has[own] = 0
        for j in more[100 * both >= percent * (size[more] + size[k] - both)].tolist():
            if part[j] != part[k]:
                out.append((k, j))
                part[part == part[j]] = part[k]
    return out


def _compared(buckets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Links ``(a, b)`` that join the classes c within buckets ``(key, node, c, side)`` of bounded weight."""
    rows = buckets.join(nodes.select("node", "sigs").hint("merge"), "node").select("key", "node", "c", "side", "sigs")

    def run(batches):
        held: list[pa.RecordBatch] = []

        def done():
            table = pa.Table.from_batches(held)
            node, part, side = (table.column(c).to_numpy() for c in ("node", "c", "side"))
            links = links_of([np.frombuffer(x.as_py(), np.uint32) for x in table.column("sigs")], part, side, percent) if len(node) > 1 else []
            held.clear()
            at = np.array(links, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_pydict({"a": pa.array(node[at[:, 0]]), "b": pa.array(node[at[:, 1]])})

        for batch in batches:
            key = batch.column("key").to_numpy()
            edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for low, high in zip(edges, edges[1:]):
                if held and low < high and held[0].column("key")[0].as_py() != key[low]:
                    yield done()
                if low < high:
                    held.append(batch.slice(low, high - low))
        if held:
            yield done()

    return written(rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").distinct(), "links")


def _split(large: DataFrame, nodes: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Buckets ``(key, node)`` in place of large ones: members that differ from the centre in one and the same signature.

    Of two members that link, one of them not linked to the centre, the
    differences from the centre meet: else the one would be as far from the other as from the centre and
    the other together.  At most ``most - 1`` elements of a set's difference are not in the other's, so
    the first common one is among the first ``most`` of both, rarest first.
    """
    groups = written(large.where("node != centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct(), "large-buckets")
    apart = _on_sets(groups, nodes, rows, lambda x, y: np.setxor1d(x, y, assume_unique=True).astype(np.int64))
    up = F.floor(F.col("n") * 100 / percent)
    most = F.floor((F.col("n") + up) * (100 - percent) / (100 + percent)) + 1
    sizes = nodes.select(F.col("node").alias("a"), most.alias("most"))
    each = written(apart.join(sizes.hint("merge"), "a").select(F.col("b").alias("g"), "a", "most", F.explode("got").alias("e")), "differences")
    counted = each.groupBy("g", "e").agg(F.count("*").alias("times"))
    ranked = each.join(counted.hint("merge"), ["g", "e"]).withColumn("rank", F.row_number().over(Window.partitionBy("g", "a").orderBy("times", "e")))
    out = written(ranked.where("rank <= most and times > 1").select(F.xxhash64("g", "e").alias("key"), F.col("a").alias("node")), "buckets")
    for used in (groups, apart, each):
        discard(used)
    return out


def _weighed(open_: DataFrame, nodes: DataFrame) -> DataFrame:
    """Open buckets whose ``m`` counts a member of very many signatures as several."""
    size = nodes.select(F.col("node").alias("centre"), F.col("n").alias("centre_n"))
    return open_.join(size.hint("merge"), "centre").withColumn("m", F.col("m") * F.ceil(F.col("centre_n") / WEIGHT)).drop("centre_n")


def near_classes(rows: DataFrame, percent: int = PERCENT, small: int = SMALL) -> DataFrame:
    """``(id, tag, class_id, class_size)`` of those rows ``(id, tag, text)`` whose class holds several rows.

    Rows link when the likeness of their signature sets is at least
    ``percent`` hundredths; a class is what links reach, ``class_id`` its smallest id (null if it has
    none) and ``class_size`` its number of rows.  Equal sets link.  Texts
    are not null; rows that repeat an id and a tag are in one class and give one row.  An
    empty table gives no rows.  Sets are told apart by 64-bit hashes.
    """
    sets = written(shared_keys(rows, percent), "signature-keys")
    of_ref = sets.where("ref is not null and node is not null")
    keys = sets.where("key is not null").select("key", "ref").join(of_ref.select("ref", "node").hint("shuffle_hash"), "ref").select("key", "node").repartition("key").distinct()
    shared = keys.groupBy("key").agg(F.count("*").alias("times"), F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").drop("high")
    # Where only two sets meet, one of them says it all.
    buckets = written(keys.join(shared.hint("shuffle_hash"), "key").where("times > 2 or node > low"), "buckets")
    several = buckets.select(F.explode(F.array("node", "low")).alias("node")).distinct()
    nodes = of_ref.select("node", "n", "own", "bands", "bits", F.struct("id", "tag").alias("ref"))
    nodes = written(nodes.join(several.hint("shuffle_hash"), "node").dropDuplicates(["node"]), "nodes")

    stars = _stars(buckets.where("times > 2").select("key", "node"), None)
    pairs = buckets.where("times = 2").select(F.col("node").alias("a"), F.col("low").alias("b")).unionByName(_tries(stars))
    labels = _components(None, _linked(pairs.distinct(), nodes, rows, percent))
    open_ = written(_weighed(_still_open(stars, labels), nodes), "open-buckets")
    found = _linked(_sketched(_whole(open_.where(F.col("m") <= small)), nodes, percent), nodes, rows, percent)
    large = open_.where(F.col("m") > small)
    used = [buckets, stars, open_, nodes]
    if not large.isEmpty():
        parts = _split(large, nodes, rows, percent)
        stars = _stars(parts, labels)
        labels = _components(labels, found.unionByName(_linked(_tries(stars).distinct(), nodes, rows, percent)))
        open_ = written(_weighed(_still_open(stars, labels), nodes), "open-buckets")
        found = _linked(_sketched(_whole(open_.where(F.col("m") <= small)), nodes, percent), nodes, rows, percent)
        large = open_.where(F.col("m") > small)
        if not large.isEmpty():
            whole = _sets(large.select("node"), nodes, rows)
            found = found.unionByName(_compared(_tiles(large, small), whole, percent))
            used.append(whole)
        used += [parts, stars, open_]
    if not found.isEmpty():
        labels = _components(labels, found)
    of_row = sets.where("node is not null").select("id", "tag", "node").join(labels.hint("merge"), "node", "left").select("id", "tag", F.coalesce("component", "node").alias("c"))
    counted = of_row.groupBy("c", "id", "tag").agg(F.count("*").alias("rows"))
    classes = counted.groupBy("c").agg(F.min("id").alias("class_id"), F.sum("rows").alias("class_size")).where("class_size > 1")
    out = written(counted.join(classes.hint("merge"), "c").select("id", "tag", "class_id", "class_size"), "classes")
    for table in (sets, *used):
        discard(table)
    return out
