"""Exact dedup by heavy-hitter split.

Misra-Gries summaries of the digests, one a partition and merged by digest,
name the few digests that may be frequent.  Their groups are counted exactly,
and those truly frequent are broadcast, so that their copies are settled
map-side.  All other digests are settled by an ordinary shuffle in which no group is large.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogops.llm.common import ascii_lower
from catalogops.plans.staging import written

#: Counters of a summary; a digest with over 2/COUNTERS of all rows is always found. Also the most rows that are broadcast.
COUNTERS = 256


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, rid, digest)``: the SHA-256 of the text with A-Z lower-cased; rid tells rows apart."""
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("rid"), F.unhex(F.sha2(norm, 256)).alias("digest"))


def misra_gries(rows: DataFrame, key: str, counters: int = COUNTERS) -> DataFrame:
    """``(key, seen)`` from a Misra-Gries summary of each partition, merged by key.

    ``seen`` is at most the true count and short of it by at most rows/counters.
    Each task holds ``counters`` keys and those of one batch.
    """

    def summary(frames):
        held: dict[bytes, int] = {}
        for frame in frames:
            for k, n in frame[key].value_counts().items():
                held[k] = held.get(k, 0) + n
            if len(held) > counters:
                cut = sorted(held.values(), reverse=True)[counters]
                held = {k: n - cut for k, n in held.items() if n > cut}
        yield pd.DataFrame({key: list(held), "seen": list(held.values())})

    part = rows.select(key).mapInPandas(summary, f"{key} binary, seen long")
    return part.groupBy(key).agg(F.sum("seen").alias("seen"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per row of ``docs``: ``id_col, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.  The row with the largest
    id stays; of rows that also share that id, one stays; a null id is smaller
    than any other.  An empty table gives no rows; other columns are not used.
    """
    rows = written(digests(docs, id_col, text_col), "digests")
    total = rows.count()
    last = F.max(F.struct("id", "rid")).alias("last")
    maybe = misra_gries(rows, "digest", counters).where(F.col("seen") * counters >= total).select("digest")
    # At most `counters` rows: what the summaries saw adds up to no more than all rows.
    frequent = (
        rows.join(F.broadcast(maybe), "digest").groupBy("digest").agg(F.count("*").alias("group_size"), last).where(F.col("group_size") * counters >= total)
    )
    frequent = written(frequent, "frequent-digests")
    hot = rows.join(F.broadcast(frequent), "digest")
    cold = rows.join(F.broadcast(frequent.select("digest")), "digest", "left_anti")
    groups = cold.groupBy("digest").agg(F.count("*").alias("group_size"), last)
    cold = cold.join(groups.hint("merge"), "digest")
    return hot.unionByName(cold).select(
        F.col("id").alias(id_col),
        F.col("last.id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("last.rid")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
