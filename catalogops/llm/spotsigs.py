"""Document fingerprints from spot signatures.

A spot is a common word; its signature is the spot with the chain of content
words that follow it.  The set of a text's signatures is its fingerprint, kept
whole as sorted 32-bit hashes in hexadecimal.  Fingerprints are compared by Jaccard likeness; the lengths of
two sets bound it, which prunes most comparisons.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogops.llm.common import bounded_batches, slices, with_arrow
from catalogops.plans.staging import written

#: Common words of English, German, French and Spanish.
SPOTS = frozenset(
    """a an and are as at be by for from has have in is it of on or that the this to was were will with
    auf das dem den der des die ein eine für im ist mit nicht sich und von zu
    au avec dans de des du en est et la le les par pas pour que qui sur un une
    con del el las los no para por se su y""".split()
)
CHAIN = 2
_U = np.uint64
_words = re.compile(r"[^\W_]+").findall
_LOWEST = -(2**63)


class _Hashes(dict):
    """Word to 63-bit hash with the last bit telling common words."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode()) & ~1 | (word in SPOTS)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(29))


def _chains(spots: np.ndarray, at: np.ndarray, content: np.ndarray) -> np.ndarray:
    """Signatures of the spots whose chain, from place ``at`` of the content words on, is complete."""
    whole = at + CHAIN <= len(content)
    total, at = _mix(spots[whole]), at[whole]
    for i in range(CHAIN):
        total = _mix(total * _U(0x9E3779B97F4A7C15) + content[at + i])
    return total


def signatures(text: str, hashes: dict) -> np.ndarray:
    """Sorted distinct 32-bit signatures of a whole text.

    Where no spot has a chain every word is a spot, and where there are too few words for that the text as a whole is the signature.
    """
    words = _words(text.lower())
    h = np.fromiter(map(hashes.__getitem__, words), _U, len(words))
    common = (h & _U(1)).astype(bool)
    content = h[~common]
    found = _chains(h[common], np.cumsum(~common)[common], content)
    if not len(found):
        found = _chains(h, np.arange(1, len(h) + 1), h)
    if not len(found):
        found = np.array([xxhash.xxh64_intdigest(text.encode())], _U)
    return np.unique((found >> _U(32)).astype(np.uint32))


def fingerprint(found: np.ndarray) -> str:
    return found.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, at_least: float = 0.0) -> float:
    """Jaccard likeness of two signature sets; 0 as soon as their lengths show it to be below ``at_least``."""
    short, long = sorted((len(a), len(b)))
    if short < at_least * long:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint``; a null text is empty, equal texts have equal fingerprints."""
    def work():
        hashes = _Hashes()
        return lambda batch: [pa.array([fingerprint(signatures(t or "", hashes)) for t in batch.column(text_col).to_pylist()], pa.string())]

    return with_arrow(docs, "fingerprint string", text_col, work)


def near_pairs(prints: DataFrame, id_col: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Pairs ``(a, b, likeness)`` of representatives with likeness of at least ``threshold``, and membership ``(id, representative)``.

    Equal fingerprints are one representative, the smallest id.  Sets are
    partitioned by length so that similar ones lie in the same or the next partition; within them sets meet by
    their first signatures, one of which two similar sets share, and lengths
    prune before the sets are compared.
    """
    members = prints.select(F.col(id_col).alias("id"), "fingerprint").where("id is not null")
    reps = members.groupBy("fingerprint").agg(F.min("id").alias("representative"))
    membership = members.join(reps.hint("merge"), "fingerprint").select("id", "representative")
    size = F.octet_length("fingerprint") / 8
    sets = reps.select(
        F.col("representative").alias("r"),
        size.cast("int").alias("n"),
        F.transform(F.sequence(F.lit(0), (size - 1).cast("int")), lambda i: F.col("fingerprint").substr(i * 8 + 1, F.lit(8))).alias("sigs"),
    )
    part = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / threshold) + 1e-9)
    prefix = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    sets = written(sets.withColumn("part", part).withColumn("prefix", F.slice("sigs", 1, prefix.cast("int"))), "signature-sets")
    left = sets.select(F.col("r").alias("a"), F.col("n").alias("na"), F.explode(F.array("part", F.col("part") + 1)).alias("part"), F.col("prefix")).select("a", "na", "part", F.explode("prefix").alias("sig"))
    right = sets.select(F.col("r").alias("b"), F.col("n").alias("nb"), "part", F.explode("prefix").alias("sig"))
    smaller = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    pairs = left.join(right.hint("merge"), ["part", "sig"]).where(smaller & (F.col("na") >= F.col("nb") * threshold - 1e-9)).select("a", "b").distinct()
    both = pairs.join(sets.select(F.col("r").alias("a"), F.col("sigs").alias("x")).hint("merge"), "a").join(sets.select(F.col("r").alias("b"), F.col("sigs").alias("y")).hint("merge"), "b")
    common = F.size(F.array_intersect("x", "y"))
    like = common / (F.size("x") + F.size("y") - common)
    return both.select("a", "b", like.alias("likeness")).where(F.col("likeness") >= threshold - 1e-12), membership


def packed_text(text: str) -> bytes:
    """A text in UTF-8 as zstd, after its length in bytes."""
    data = text.encode()
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(data, asbytes=True)


def unpacked_text(packed: bytes) -> str:
    return pa.Codec("zstd").decompress(packed[8:], decompressed_size=int.from_bytes(packed[:8], "little"), asbytes=True).decode()


def _compare(batches):
    """Rows come sorted by bucket and descending id; each is joined with the one after it.

    A row without text comes ahead of the rows whose id and tag it bears and tells their class.
    """
    hashes = _Hashes()
    held = None  # bucket, and of the row that waits for its next: id, class, text, signatures
    told = None  # id, tag, class of the last row without text
    names = ("bucket", "carry", "id", "tag", "packed", "class_id", "class_size")
    for batch in batches:
        for piece in slices(batch, "packed"):
            out = []
            for bucket, carry, doc, tag, packed, class_id, class_size in zip(*(piece.column(c).to_pylist() for c in names)):
                if packed is None:
                    told = doc, tag, (class_id, class_size)
                    continue
                if carry and (held is None or held[0] != bucket):
                    continue  # another row of the same id has served as the next one
                text = unpacked_text(packed)
                own = signatures(text, hashes)
                if held and held[0] == bucket:
                    out.append(_edited(*held[1:], text, own, hashes))
                known = told[2] if told and told[:2] == (doc, tag) else (None if doc == _LOWEST else doc, 1)
                held = None if carry else (bucket, doc, known, text, own)
            yield pa.RecordBatch.from_pylist(out, _RESULT)


_RESULT = pa.schema(
    [("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
     ("class_id", pa.int64()), ("class_size", pa.int64())]
)


def _edited(doc: int, known: tuple, text: str, own: np.ndarray, after: str, next_own: np.ndarray, hashes: dict) -> dict:
    half = len(text) // 2
    edited = text[: len(text) - half] + after[:half]
    changed = signatures(edited, hashes)
    return {
        "id": doc,
        "n_chars": len(text),
        "edited_sha256": hashlib.sha256(edited.encode()).hexdigest(),
        "fingerprint": fingerprint(own),
        "edited_fingerprint": fingerprint(changed),
        "near_edited": likeness(own, changed),
        "near_next": likeness(own, next_own),
        "class_id": known[0],
        "class_size": known[1],
    }


def neighbour_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs``: its fingerprint, that of its text with the second half from the next row, likenesses and its class.

    The next row is that with the next smaller id, after the last the first; equal ids are in the order of their texts' hashes and a
    null id is the last.  A null text is empty.  Ranges of ids are dealt out by
    quantiles, each with the row that follows it, so every text is shuffled once, packed by zstd, and no task sees the whole order.
    ``classes`` are those of ``signature_classes.near_classes`` on :func:`rows_of`; they are dealt out with the texts.
    A row without one is its own class of size 1.
    An empty table gives no rows; other columns are not used.
    """
    spark = docs.sparkSession
    rows = rows_of(docs, id_col, text_col).withColumn("id", F.coalesce("id", F.lit(_LOWEST)))
    ranges = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = rows.select("id", F.col("id").cast("double").alias("x"))
    cuts = sorted(set(ids.approxQuantile("x", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges))))
    cut = Bucketizer(splits=[-math.inf, *(cuts or [0.0]), math.inf], inputCol="x", outputCol="range")
    # One row for each range: its first id, which also follows the range above it.
    firsts = cut.transform(ids).groupBy("range").agg(F.max("id").alias("first")).orderBy(F.desc("range")).collect()
    follows = [(b["first"], int(a["range"])) for a, b in zip(firsts, firsts[1:] + firsts[:1])]
    carried = spark.createDataFrame(follows, "id long, before int")
    put = lambda df: cut.transform(df.withColumn("x", F.col("id").cast("double"))).withColumn("bucket", F.col("range").cast("int"))
    pack = lambda: lambda batch: [pa.array(map(packed_text, batch.column("text").to_pylist()), pa.binary())]
    placed = put(with_arrow(rows, "packed binary", "text", pack, drop=("text",))).join(F.broadcast(carried), "id", "left")
    own = F.struct("bucket", F.lit(0).alias("carry"))
    also = F.struct(F.col("before").alias("bucket"), F.lit(1).alias("carry"))
    dealt = placed.select("id", "tag", "packed", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, also))).alias("p")).select("p.bucket", "p.carry", "id", "tag", "packed")
    none = F.lit(None).cast("long")
    dealt = dealt.select("*", none.alias("class_id"), none.alias("class_size"))
    if classes is not None:
        told = put(classes.withColumn("id", F.coalesce("id", F.lit(_LOWEST))))
        dealt = dealt.unionByName(told.select("bucket", F.lit(0).alias("carry"), "id", "tag", F.lit(None).cast("binary").alias("packed"), "class_id", "class_size"))
    ordered = dealt.repartition("bucket").sortWithinPartitions("bucket", "carry", F.desc("id"), "tag", "packed")
    bounded_batches(spark)
    out = ordered.mapInArrow(_compare, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, class_id long, class_size long")
    return out.select(F.when(F.col("id") != _LOWEST, F.col("id")).alias(id_col), *out.columns[1:])


def rows_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, tag, text)`` of ``docs``, null texts empty; the tag is a 64-bit hash of the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("tag"), text.alias("text"))
