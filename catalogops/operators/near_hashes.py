"""Links between near hashes: bands of digits meet, and what meets is compared in blocks.

Digits are kept as four bit planes, so that one pass of a few word operations
tells how many digits differ.  Rows of one bucket are never paired as rows of a join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a bucket that a task compares with each other; a larger bucket is cut, and its parts meet two by two.
PART = 16_384
#: Buckets up to this size are compared all at once, many in one step.
SMALL = 64
#: Comparisons of one step, so that its words stay in a core's cache.
STEP = 131_072
_DIGIT = np.zeros(256, np.uint8)
for _i, _c in enumerate("0123456789abcdef"):
    _DIGIT[ord(_c)] = _DIGIT[ord(_c.upper())] = _i


def planes(text: list[str], digits: int) -> np.ndarray:
    """Bit planes of hashes: a row for each, four groups of 64-bit words."""
    each = _DIGIT[np.frombuffer("".join(text).encode(), np.uint8).reshape(len(text), digits)]
    each = np.pad(each, ((0, 0), (0, -digits % 64)))
    return np.concatenate([np.packbits(each >> k & 1, axis=1) for k in range(4)], axis=1).view(np.uint64)


def _near(x: list[np.ndarray], y: list[np.ndarray], threshold: int) -> np.ndarray:
    """Whether at most ``threshold`` digits differ; planes that broadcast against each other."""
    words = len(x) // 4
    total = 0
    for w in range(words):
        d = x[w] ^ y[w]
        for k in range(1, 4):
            d |= x[k * words + w] ^ y[k * words + w]
        total = total + (np.bitwise_count(d) if words == 1 else np.bitwise_count(d).astype(np.int32))
    return total <= threshold


def _joined(label: np.ndarray, row: int, hits: np.ndarray, out: list[tuple[int, int]]) -> np.ndarray:
    """Labels after ``row`` is linked with ``hits`` of other labels; one link for each of these."""
    names, first = np.unique(label[hits], return_index=True)
    out += [(row, int(i)) for i in hits[first]]
    if len(names) == 1:
        label[label == names[0]] = label[row]
        return label
    to = np.arange(len(label))
    to[names] = label[row]
    return to[label]


def bucket_links(bits: np.ndarray, side: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links (places) that join what the near rows of one bucket join.

    Two rows of one side other than 0 have met in a bucket of their own, which links them.
    Rows near one of them, the centre, are not compared with each other.
    """
    n = len(bits)
    columns = [np.ascontiguousarray(c) for c in bits.T]
    label, out = np.arange(n), []
    two = side.all()
    tried = np.unique(np.linspace(0, n - 1, 8).astype(np.int64))
    near = _near([c[tried, None] for c in columns], [c[None] for c in columns], threshold)
    best = int(near.sum(1).argmax())
    centre, hit = int(tried[best]), near[best]
    hits = np.flatnonzero(hit)
    if two:
        # The other side's rows near its first hit are linked with that one elsewhere.
        other = hits[side[hits] != side[centre]]
        if len(other):
            told = _near([c[other[:1]] for c in columns], [c[other[1:]] for c in columns], threshold)
            out += [(centre, int(i)) for i in [other[0], *other[1:][~told]]]
    else:
        out += [(centre, int(i)) for i in hits if i != centre]
    label[hits] = centre
    rest = np.flatnonzero(~hit)
    if two:
        one = side[rest] == side[centre]
        linked = hits[side[hits] != side[centre]]
        work = [(rest[one], np.concatenate([rest[~one], linked]), False), (rest[~one], hits[side[hits] == side[centre]], False)]
    else:
        work = [(rest, np.concatenate([rest, hits]), True)]
    for rows, against, later in work:
        each = max(1, STEP // max(len(against), 1))
        met = [c[against] for c in columns]
        for low in range(0, len(rows) if len(against) else 0, each):
            block = rows[low : low + each]
            skip = low + 1 if later else 0
            near = _near([c[block, None] for c in columns], [c[None, skip:] for c in met], threshold)
            for k in np.flatnonzero(near.any(1)).tolist():
                found = against[skip:][near[k]]
                found = found[label[found] != label[block[k]]]
                if len(found):
                    label = _joined(label, int(block[k]), found, out)
    return out


def small_links(key: np.ndarray, bits: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (places) between near rows of the same key; rows come sorted by key, few to each."""
    columns = list(bits.T)
    at, a, b = np.arange(len(key)), [], []
    for d in range(1, len(key)):
        at = at[: np.searchsorted(at, len(key) - d)]
        at = at[key[at] == key[at + d]]
        if not len(at):
            break
        near = at[_near([c[at] for c in columns], [c[at + d] for c in columns], threshold)]
        a.append(near)
        b.append(near + d)
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(a), np.concatenate(b)
    label = np.arange(len(key))
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    rows = np.flatnonzero(label != np.arange(len(key)))
    return rows, label[rows]


def _compared(batches, threshold: int, words: int):
    """Rows ``(key, side, node, bits)`` come sorted by key; yields links ``(a, b)`` of nodes."""

    def links(key, side, node, bits):
        starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        sizes = np.diff(starts)
        few = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
        rows, to = small_links(key[few], bits[few], threshold)
        a, b = [node[few][rows]], [node[few][to]]
        for low, size in zip(starts[:-1][sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
            found = np.array(bucket_links(bits[low : low + size], side[low : low + size], threshold), np.int64).reshape(-1, 2) + low
            a.append(node[found[:, 0]])
            b.append(node[found[:, 1]])
        return pa.RecordBatch.from_pydict({"a": pa.array(np.concatenate(a)), "b": pa.array(np.concatenate(b))})

    held: list[tuple] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key, side, node = (batch.column(c).to_numpy() for c in ("key", "side", "node"))
        bits = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint64).reshape(-1, words)
        # The last key's rows wait for those of the next batch; a bucket has two parts at most.
        if held and key[-1] == held[-1][0][-1]:
            held.append((key, side, node, bits))
            continue
        last = int(np.searchsorted(key == key[-1], True))
        held.append((key[:last], side[:last], node[:last], bits[:last]))
        yield links(*(np.concatenate(c) for c in zip(*held)))
        held = [(key[last:].copy(), side[last:].copy(), node[last:].copy(), bits[last:].copy())]
    if held:
        yield links(*(np.concatenate(c) for c in zip(*held)))


def packed(reps: DataFrame, digits: int) -> DataFrame:
    """``reps`` with ``bits``, the bit planes of ``hash``."""
    names = reps.columns

    def run(batches):
        for batch in batches:
            rows = planes(batch.column("hash").to_pylist(), digits)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in rows], pa.binary())], [*names, "bits"])

    return reps.mapInArrow(run, reps.withColumn("bits", F.lit(b"")).schema)


def near_links(rows: DataFrame, threshold: int, digits: int, part: int = PART) -> DataFrame:
    """Links ``(a, b)`` of nodes that join what all pairs of rows ``(node, hash, bits)`` join whose hashes differ in at most ``threshold`` digits.

    Of threshold + 1 bands of digits two near hashes share one, so each band is a bucket.  Keys are hashes of
    bands: where two collide, more is compared.  A bucket above ``part`` rows is cut by a hash of the nodes.
    """
    bands = min(threshold + 1, digits)
    cuts = [i * digits // bands for i in range(bands + 1)]
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("hash", cuts[i] + 1, cuts[i + 1] - cuts[i])) for i in range(bands)])
    banded = rows.select("node", "bits", F.explode(keys).alias("key"))
    # At most bands / part times as many keys as there are rows.
    large = rows.select(F.explode(keys).alias("key")).groupBy("key").agg(F.count("*").alias("times")).where(F.col("times") > part)
    parts = large.select("key", F.ceil(F.col("times") / part).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.coalesce("parts", F.lit(1))).cast("int")
    cut = banded.join(F.broadcast(parts), "key", "left").withColumn("own", own)
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    key = F.when(F.col("parts").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
    placed = met.select(key.alias("key"), side.alias("side"), "node", "bits")
    words = 4 * -(-digits // 64)
    # As many tasks as the session has partitions: what a task does is not told by its bytes.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.repartition(tasks, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(lambda batches: _compared(batches, threshold, words), "a long, b long").distinct()
