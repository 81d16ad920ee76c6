"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct word shingles.  Each shingle flips one
bit of a wide sparse bit sketch, so the Hamming distance of two sketches is at most
the symmetric difference of the sets.  Documents are compared inside size bands.
Two sets of a band that are similar enough differ in at most D shingles; a sketch cut into more than
D blocks therefore agrees in at least one block, and equal blocks meet by an equi-join.
A block is written as the XOR of its bits' hashes.  Candidates are verified on the texts.

Inside a bucket of equal blocks not all pairs are tried: all members are first
compared with one centre, the member that meets most others, and linked ones get one component.
Members of different components are compared by their bit sketches in a
small bucket.  A large one is split by the shingles in which its members
differ from the centre, and each part is a bucket of its own, with another
centre; of a part that is still large the chunks are compared two by two.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalogops.llm.common import free_prefix, slices
from catalogops.operators.components import connected_components
from catalogops.plans.staging import discard, written

#: Ratio of a size band's ends.
BAND = 1.5
#: Share of blocks beyond those that can differ, so that few sets leave too many empty.
SPARE = 0.03
#: Nodes whose keys are out already that a task remembers.
REMEMBERED = 300_000
#: Bytes of a text whose words are hashed at a time; a longer word is still whole.
PIECE = 1 << 20
#: Most rows of the map from wanted documents to nodes that is broadcast; above it the texts are shuffled.
BROADCAST_ROWS = 200_000
#: Pairs of one centre that a task verifies before the centre is dealt to more tasks.
PAIRS_PER_SALT = 100
#: Members of a bucket that one task compares by sketches; a bucket with more is split.
SMALL = 256
_NO_ID = -(2**63)

_U = np.uint64


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finalizer of multiplications and shifts."""
    x = x + _U((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_WORD = np.array([not (x == 32 or 9 <= x <= 13) for x in range(256)])
_LETTER = _mix(np.arange(256, dtype=_U), 21)


@lru_cache(maxsize=1)
def _powers(count: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, _U), np.full(count - 1, 0x9E3779B97F4A7C1D, _U)]))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hash of each word in its order; bytes.lower() changes A-Z only."""
    data = np.frombuffer(text.encode().lower(), np.uint8)
    word = np.concatenate([[False], _WORD[data], [False]])
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, stop = edge[::2], edge[1::2]
    cuts = [0, *(np.flatnonzero(np.diff(start // PIECE)) + 1).tolist(), len(start)]
    out = [np.empty(0, _U)]
    for a, b in zip(cuts, cuts[1:]):
        if a == b:
            continue
        size = stop[a:b] - start[a:b]
        first = np.cumsum(size) - size
        letters = data[start[a] : stop[b - 1]][word[start[a] + 1 : stop[b - 1] + 1]]
        place = np.arange(len(letters)) - np.repeat(first, size)
        powers = _powers(1 << int(size.max() - 1).bit_length())
        out.append(_mix(np.add.reduceat(_LETTER[letters] * powers[place], first) + size.astype(_U), 22))
    return np.concatenate(out)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of n words; of all its words if it has fewer."""
    h = word_hashes(text or "")
    if not len(h):
        return h
    n = min(n, len(h))
    count = len(h) - n + 1
    total = _mix(h[:count], 0)
    for i in range(1, n):
        total = _mix(total ^ h[i : count + i], i)
    return _distinct(total)


class Bands:
    """Size bands, and for each the blocks that a threshold in per cent asks for."""

    def __init__(self, percent: int):
        self.percent, self.starts = percent, [1]

    def _until(self, size: int) -> None:
        while self.starts[-1] * self.percent <= size * 100:
            self.starts.append(max(self.starts[-1] + 1, math.ceil(self.starts[-1] * BAND)))

    def most(self, size: int, partner: int) -> int:
        """Largest symmetric difference of two linked sets of these sizes."""
        return (size + partner) * (100 - self.percent) // (100 + self.percent)

    def reach(self, size: int) -> int:
        """Largest symmetric difference of a set of this size and any set it can link with."""
        return self.most(size, size * 100 // self.percent)

    def own(self, size: int) -> int:
        self._until(size)
        return int(np.searchsorted(self.starts, size, "right")) - 1

    def top(self, band: int) -> int:
        return self.starts[band + 1] - 1

    def of(self, size: int) -> list[tuple[int, int, int]]:
        """(band, largest difference, blocks) of each band in which a set of this size can meet a partner other than its equal.

        Two sets meet in the band of the larger one.
        """
        band, out = self.own(size), []
        while self.starts[band] * self.percent <= size * 100:
            top = self.top(band)
            most, d = self.most(size, min(top, size * 100 // self.percent)), self.most(top, top)
            if most:
                out.append((band, most, d + 1 + math.ceil(SPARE * (d + 1))))
            band += 1
        return out


def block_keys(sets: np.ndarray, bands: Bands) -> np.ndarray:
    """Keys of a set's sketch blocks; two linked sets share at least one.

    Two linked sets differ in at most ``most`` blocks, so among the first blocks
    of which ``most + 1`` hold shingles at least one is equal and not empty.
    Only a set that has fewer such blocks in all gives keys of empty ones too, since all sets would meet in those.
    """
    out = []
    for band, most, blocks in bands.of(len(sets)):
        block = ((sets >> _U(32)) * _U(blocks)) >> _U(32)
        first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        parity = np.bitwise_xor.reduceat(_mix(sets, 7), first)
        salt = band * 1_000_003
        out.append(_mix(parity[: most + 1] + _mix(block[first[: most + 1]], 3), salt))
        if len(first) <= most:
            empty = np.setdiff1d(np.arange(blocks, dtype=_U), block[first])
            out.append(_mix(_mix(empty, 3), salt))
    return np.concatenate(out) if out else np.empty(0, _U)


def bit_sketch(sets: np.ndarray, largest: int) -> np.ndarray:
    """Parity bits of a set, about as many as the band's largest set has elements, as 64-bit words."""
    words = -(-largest // 64)
    bit = np.bincount((_mix(sets, 9) % _U(words * 64)).astype(np.int64), minlength=words * 64).astype(np.uint8) & 1
    return np.packbits(bit).view(np.int64)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sketches(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """``(id, tag, n, node, keys, own, bands, bits)`` of each row ``(id, tag, text)``; equal sets have equal nodes.

    A task gives a node's keys and sketches once while it remembers the node, so that copies add no keys.
    """

    def run(batches):
        bands, done = Bands(percent), set()
        for batch in batches:
            for piece in slices(batch, "text"):
                sizes, nodes, keys, own, met, bits = [], [], [], [], [], []
                for text in piece.column("text").to_pylist():
                    found = shingles(text, n)
                    node = int(_signed(_mix(_mix(found, 11).sum(keepdims=True) + _U(len(found)), 12))[0]) if len(found) else None
                    fresh = node is not None and node not in done
                    if fresh:
                        if len(done) >= REMEMBERED:
                            done.clear()
                        done.add(node)
                    sizes.append(len(found))
                    nodes.append(node)
                    keys.append(_signed(block_keys(found, bands)) if fresh else [])
                    own.append(bands.own(len(found)) if fresh else None)
                    met.append([b for b, _, _ in bands.of(len(found))] if fresh else [])
                    bits.append([bit_sketch(found, bands.top(b)) for b in met[-1]])
                yield pa.RecordBatch.from_pydict(
                    {"id": piece.column("id"), "tag": piece.column("tag"), "n": pa.array(sizes, pa.int64()), "node": pa.array(nodes, pa.int64()), "keys": pa.array(keys, pa.list_(pa.int64())),
                     "own": pa.array(own, pa.int32()), "bands": pa.array(met, pa.list_(pa.int32())), "bits": pa.array(bits, pa.list_(pa.list_(pa.int64())))}
                )

    return rows.mapInArrow(run, "id long, tag long, n long, node long, keys array<long>, own int, bands array<int>, bits array<array<long>>")


def _on_pairs(pairs: DataFrame, n: int, result: str, work) -> DataFrame:
    """``work(set_a, set_b)`` of each row ``(a, b, text_a, text_b)`` whose result is not None, as ``(a, b, result)``."""

    def run(batches):
        sets = OrderedDict()

        def of(node, text):
            if node not in sets:
                if len(sets) >= 32:
                    sets.popitem(last=False)
                sets[node] = shingles(text, n)
            return sets[node]

        for batch in batches:
            for piece in slices(batch, "text_a"):
                a, b = piece.column("a").to_pylist(), piece.column("b").to_pylist()
                ta, tb = piece.column("text_a"), piece.column("text_b")
                got = [work(shingles(ta[i].as_py(), n), of(b[i], tb[i].as_py())) for i in range(len(a))]
                keep = pa.array([x is not None for x in got], pa.bool_())
                made = pa.array(got, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([piece.column("a"), piece.column("b"), made], ["a", "b", "got"]).filter(keep)

    return pairs.mapInArrow(run, "a long, b long, got array<long>").withColumnRenamed("got", result)


def _links(pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """Those pairs that link, as ``(a, b)``."""

    def work(x, y):
        both = len(np.intersect1d(x, y, assume_unique=True))
        return [] if 100 * both >= percent * (len(x) + len(y) - both) else None

    return _on_pairs(pairs, n, "link", work).select("a", "b")


def _differences(pairs: DataFrame, n: int) -> DataFrame:
    """``(a, b, differing)``: the shingles that only one of the two has."""
    return _on_pairs(pairs, n, "differing", lambda x, y: _signed(np.setxor1d(x, y, assume_unique=True)))


def _close(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """``(a, b, ref_a, ref_b)`` of pairs whose bit sketches differ in no more bits than the sets of a linked pair can."""
    side = lambda x: nodes.select(*[F.col(c).alias(c if c == "node" else f"{c}_{x}") for c in nodes.columns]).withColumnRenamed("node", x).hint("merge")
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    band = F.greatest("own_a", "own_b")
    bits = lambda x: F.try_element_at(f"bits_{x}", F.array_position(f"bands_{x}", band).cast("int"))
    known = F.array_contains("bands_a", band) & F.array_contains("bands_b", band)
    differing = F.aggregate(F.zip_with(bits("a"), bits("b"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return both.where(F.when(known, differing * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent))).select("a", "b", "ref_a", "ref_b")


def _with_texts(pairs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(a, b, text_a, text_b)`` of the written pairs ``(a, b, ref_a, ref_b)``, and the written texts to discard; b may be in very many pairs."""
    end = lambda x: F.struct(F.col(x).alias("node"), F.col(f"ref_{x}").alias("ref"))
    wanted = pairs.select(F.explode(F.array(end("a"), end("b"))).alias("e")).select("e.node", F.coalesce("e.ref.id", F.lit(_NO_ID)).alias("id"), "e.ref.tag").dropDuplicates(["node"])
    right = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted.hint("shuffle_hash")
    found = rows.select(F.coalesce("id", F.lit(_NO_ID)).alias("id"), "tag", "text").join(right, ["id", "tag"])
    texts = written(found.select("node", "text").dropDuplicates(["node"]), "texts")
    many = pairs.groupBy("b").agg(F.ceil(F.count("*") / PAIRS_PER_SALT).cast("int").alias("salts"))
    left = (
        pairs.select("a", "b")
        .join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a")
        .join(many.hint("merge"), "b")
        .withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int"))
    )
    right = (
        texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        .join(many.hint("merge"), "b")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        .drop("salts")
    )
    return left.join(right.hint("merge"), ["b", "salt"]).select("a", "b", "text_a", "text_b"), texts


def _linked(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, n: int, percent: int) -> DataFrame:
    """The linked ones of the pairs ``(a, b)``."""
    close = written(_close(pairs, nodes, percent), "close-pairs")
    both, texts = _with_texts(close, rows)
    links = written(_links(both, n, percent), "links")
    discard(close)
    discard(texts)
    return links


def _components(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """``(node, component)`` after more links; earlier components are single nodes of the new graph."""
    if labels is None:
        return written(connected_components(links, "a", "b"), "components")
    label = lambda name: labels.select(F.col("node").alias(name), F.col("component").alias(f"c_{name}")).hint("merge")
    ends = links.join(label("a"), "a", "left").join(label("b"), "b", "left").select("a", "b", F.coalesce("c_a", "a").alias("c_a"), F.coalesce("c_b", "b").alias("c_b"))
    merged = connected_components(ends, "c_a", "c_b").select(F.col("node").alias("c"), "component")
    new = ends.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("c_a").alias("c")), F.struct(F.col("b").alias("node"), F.col("c_b").alias("c")))).alias("e")).select("e.*")
    known = labels.select("node", F.col("component").alias("c")).unionByName(new).distinct()
    return written(known.join(merged.hint("merge"), "c", "left").select("node", F.coalesce("component", "c").alias("component")), "components")


def _stars(buckets: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``(key, node, c, m, centre, d)`` of buckets ``(key, node)`` with several components: size, centre and its component.

    The centre is the member that meets most others over all buckets, the likely
    original of edited copies, so that few pairs find most links.
    """
    rows = buckets.join(labels.select("node", F.col("component").alias("c")).hint("merge"), "node", "left") if labels is not None else buckets.withColumn("c", F.lit(None).cast("long"))
    rows = written(rows.select("key", "node", F.coalesce("c", "node").alias("c")).repartition("key").distinct(), "members")
    sizes = rows.groupBy("key").agg(F.count("*").alias("m"), F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key", "m")
    rows_ = rows.join(sizes.hint("merge"), "key")
    weight = rows_.groupBy("node").agg(F.sum("m").alias("w"))
    centre = rows_.join(weight.hint("merge"), "node").groupBy("key").agg(F.max(F.struct("w", "node", "c")).alias("o"))
    stars = rows_.join(centre.select("key", F.col("o.node").alias("centre"), F.col("o.c").alias("d")).hint("merge"), "key")
    out = written(stars.select("key", "node", "c", "m", "centre", "d"), "stars")
    discard(rows)
    return out


def _still_open(stars: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of stars, under new labels, of buckets that still have several components."""
    label = lambda name, c: labels.select(F.col("node").alias(name), F.col("component").alias(c)).hint("merge")
    now = stars.where("m > 2").drop("c", "d").join(label("node", "c"), "node", "left").withColumn("c", F.coalesce("c", "node"))
    several = now.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.max(F.when(F.col("node") == F.col("centre"), F.col("c"))).alias("d")).where("low < high").select("key", "d")
    return written(now.join(several.hint("merge"), "key"), "open-buckets")


def _tries(stars: DataFrame) -> DataFrame:
    """Each member with its bucket's centre, as ``(a, b)``."""
    return stars.where("node != centre and c != d").select(F.col("node").alias("a"), F.col("centre").alias("b"))


def _whole(small: DataFrame) -> DataFrame:
    """Buckets in which all members are compared; those with the centre have been tried."""
    return small.where("node != centre").select("key", "node", "c", F.col("node").alias("side"))


def _tiles(large: DataFrame, small: int) -> DataFrame:
    """Buckets of about ``small`` members for each pair of a large one's chunks, which are its sides; members of a pair of equal chunks each have their own."""
    chunks = F.ceil(F.col("m") * 2 / small).cast("long")
    each = large.where("node != centre").withColumn("chunk", F.pmod(F.xxhash64("node"), chunks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
    key = F.xxhash64("key", F.least("chunk", "other"), F.greatest("chunk", "other"))
    return each.select(key.alias("key"), "node", "c", F.when(F.col("chunk") == F.col("other"), F.col("node")).otherwise(F.col("chunk")).alias("side"))


def _compared(buckets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` of different components and sides within buckets ``(key, node, c, side)`` whose bit sketches are close."""
    rows = buckets.join(nodes.select("node", "n", "own", "bands", "bits").hint("merge"), "node")

    def settle(table: pa.Table):
        node, part, side, size, own = (table.column(c).to_numpy() for c in ("node", "c", "side", "n", "own"))
        bands, bits = table.column("bands").to_pylist(), table.column("bits")
        for band in set(own.tolist()):
            has = [i for i, b in enumerate(bands) if band in b]
            if len(has) < 2:
                continue
            sketch = np.stack([bits[i].values[bands[i].index(band)].values.to_numpy() for i in has]).view(_U)
            has = np.array(has)
            for k in range(len(has) - 1):
                i, others = has[k], has[k + 1 :]
                apart = np.bitwise_count(sketch[k] ^ sketch[k + 1 :]).sum(axis=1, dtype=np.int64)
                near = (apart * (100 + percent) <= (size[i] + size[others]) * (100 - percent)) & (part[others] != part[i]) & (side[others] != side[i]) & (np.maximum(own[others], own[i]) == band)
                if near.any():
                    yield np.full(near.sum(), node[i]), node[others[near]]

    def run(batches):
        held: list[pa.RecordBatch] = []

        def done():
            pairs = list(settle(pa.Table.from_batches(held).combine_chunks()))
            a, b = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
            return pa.RecordBatch.from_pydict({"a": pa.array(np.maximum(a, b)), "b": pa.array(np.minimum(a, b))})

        for batch in batches:
            key = batch.column("key").to_numpy()
            edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for low, high in zip(edges, edges[1:]):
                if held and low < high and held[0].column("key")[0].as_py() != key[low]:
                    yield done()
                    held.clear()
                if low < high:
                    held.append(batch.slice(low, high - low))
        if held:
            yield done()

    found = rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")
    return written(found.distinct(), "pairs")


def _split(large: DataFrame, nodes: DataFrame, rows: DataFrame, n: int, percent: int) -> DataFrame:
    """Buckets ``(key, node)`` that take the place of large ones: members that differ from the centre in one and the same shingle.

    Let x be a member not linked to the centre and y another member.  If x and y
    link, the sets in which they differ from the centre meet: were they disjoint,
    x would be as far from y as from the centre and y together, which is
    too far.  At most ``reach`` elements of either set are not in the other, so the first common
    element is among the first ``reach + 1`` of both, in any order that both share.
    Elements are ordered by how few members have them, so the new buckets are small.
    """
    bands = Bands(percent)
    groups = large.where("node != centre").select(F.xxhash64("centre").alias("g"), F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    groups = written(groups, "large-buckets")
    ref = lambda x: nodes.select(F.col("node").alias(x), F.col("ref").alias(f"ref_{x}"), *([F.col("n").alias("n")] if x == "a" else [])).hint("merge")
    pairs = written(groups.select("a", "b").distinct().join(ref("a"), "a").join(ref("b"), "b"), "large-pairs")
    both, texts = _with_texts(pairs, rows)
    apart = written(_differences(both, n), "differences")
    up = F.floor(F.col("n") * 100 / bands.percent)
    reach = F.floor((F.col("n") + up) * (100 - bands.percent) / (100 + bands.percent)) + 1
    each = groups.join(apart.hint("merge"), ["a", "b"]).join(pairs.select("a", "b", reach.alias("most")).hint("merge"), ["a", "b"]).select("g", "a", "most", F.explode("differing").alias("e"))
    counted = each.groupBy("g", "e").agg(F.count("*").alias("times"))
    ranked = each.join(counted.hint("merge"), ["g", "e"]).withColumn("rank", F.row_number().over(Window.partitionBy("g", "a").orderBy("times", "e")))
    out = written(ranked.where("rank <= most and times > 1").select(F.xxhash64("g", "e").alias("key"), F.col("a").alias("node")), "buckets")
    for used in (groups, pairs, texts, apart):
        discard(used)
    return out


def similarity_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85, small: int = SMALL) -> DataFrame:
    """One row per row of ``docs``: ``id_col, n_shingles, component_id`` (the smallest id reachable by links).

    Words are runs without ASCII white space, A-Z lower-cased; two rows link
    when 100 * intersection >= percent * union of their shingle sets.  Equal
    sets link.  A null, empty or wordless text has no shingles and is its own
    component, as is a null id's if it links to no other.  Rows that repeat an id share what their id
    reaches only through their texts.  An empty table gives no rows; other
    columns are not used.  Sets are told apart by 64-bit hashes.
    """
    found = _members(docs, id_col, text_col, n, percent, small)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("r.id")).alias("component_id"))


def _members(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int, small: int = SMALL) -> DataFrame:
    """``(id, tag, n, node, r)`` of each row; r is the ``(id, tag)`` of its component's first row, null ids last, and null without shingles."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("tag"), F.col(text_col).alias("text"))
    sketched = written(sketches(rows, n, percent), "sketches")
    all_sets = written(sketched.select("id", "tag", "n", "node"), "sets")
    known = all_sets.where("node is not null").groupBy("node").agg(F.min(F.struct(F.col("id").isNull(), "id", "tag")).alias("r")).select("node", "r.id", "r.tag")

    keys = sketched.select("node", F.explode("keys").alias("key")).repartition("key")
    shared = keys.groupBy("key").agg(F.count("*").alias("times"), F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").drop("high")
    # Where only two rows meet, one of them says it all.
    buckets = written(keys.join(shared.hint("shuffle_hash"), "key").where("times > 2 or node > low"), "buckets")
    met = buckets.select(F.explode(F.array("node", "low")).alias("node")).distinct()
    nodes = sketched.where(F.col("own").isNotNull()).select("node", "n", "own", "bands", "bits").join(met.hint("shuffle_hash"), "node").dropDuplicates(["node"])
    nodes = written(nodes.join(known.select("node", F.struct("id", "tag").alias("ref")).hint("merge"), "node"), "nodes")
    discard(sketched)

    stars = _stars(buckets.where("times > 2").select("key", "node"), None)
    pairs = buckets.where("times = 2").select(F.col("node").alias("a"), F.col("low").alias("b")).unionByName(_tries(stars))
    labels = _components(None, _linked(pairs.distinct(), nodes, rows, n, percent))
    open_ = _still_open(stars, labels)
    pairs = _compared(_whole(open_.where(F.col("m") <= small)), nodes, percent)
    large = open_.where(F.col("m") > small)
    used = [buckets, stars, open_, pairs]
    if not large.isEmpty():
        parts = _split(large, nodes, rows, n, percent)
        stars = _stars(parts, labels)
        labels = _components(labels, _linked(pairs.unionByName(_tries(stars)).distinct(), nodes, rows, n, percent))
        open_ = _still_open(stars, labels)
        pairs = _compared(_whole(open_.where(F.col("m") <= small)).unionByName(_tiles(open_.where(F.col("m") > small), small)), nodes, percent)
        used += [parts, stars, open_, pairs]
    if not pairs.isEmpty():
        labels = _components(labels, _linked(pairs, nodes, rows, n, percent))
    for table in (nodes, *used):
        discard(table)
    ids = known.join(labels.hint("merge"), "node", "left").select("node", "id", "tag", F.coalesce("component", "node").alias("c"))
    lowest = ids.groupBy("c").agg(F.min(F.struct(F.col("id").isNull(), "id", "tag")).alias("r"))
    of_node = ids.select("node", "c").join(lowest.hint("merge"), "c").select("node", F.struct("r.id", "r.tag").alias("r"))
    return all_sets.select("id", "tag", "n", "node").join(of_node.hint("merge"), "node", "left")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: that with its smallest id, and of that id's texts the one with the smallest hash.

    Rows without shingles stay, and so does a row whose id is null unless it links to one with an id.
    Of rows that repeat the id and text of the one that stays, one stays.
    """
    first = F.col("id").eqNullSafe(F.col("r.id")) & ((F.col("tag") == F.col("r.tag")) | F.col("id").isNull())
    found = _members(docs, id_col, text_col, n, percent).where(F.col("node").isNotNull() & first)
    own = free_prefix(docs)
    id_, tag, times, self_, hash_, row = (own + x for x in ("id", "tag", "times", "own", "hash", "row"))
    stay = written(found.groupBy(F.col("id").alias(id_), F.col("tag").alias(tag)).agg(F.count("*").alias(times)), "first-rows")
    wordless = ~F.coalesce(F.col(text_col), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    keys = [F.col(id_col).cast("long").alias(self_), F.xxhash64(text_col).alias(hash_)]
    same = F.col(self_).eqNullSafe(F.col(id_)) & (F.col(hash_) == F.col(tag))
    rows = docs.where(~wordless).select("*", *keys)
    out = docs.where(wordless).unionByName(rows.join(stay.where(F.col(times) == 1).hint("shuffle_hash"), same).select(*docs.columns))
    again = stay.where(F.col(times) > 1)
    if again.isEmpty():
        return out
    # Copies are combined map-side, before they meet what stays.
    packed = rows.groupBy(self_, hash_).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias(row))
    return out.unionByName(packed.join(again.hint("shuffle_hash"), same).select(f"{row}.*"))


#: Sets, links and components of `documents` under the defaults, for DuckDB; all pairs that share a shingle are compared.
ORACLE_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS sh FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 85 * (a.n + b.n - i)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT r.node, e.y FROM r JOIN e ON e.x = r.root)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.root AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(root) AS root FROM r GROUP BY node) c ON c.node = d.doc_id
"""
