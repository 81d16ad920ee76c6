"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

Every document of a source is repeated k times, where k inverts the
Poisson distribution, whose mean is the source's repetition rate, at a uniform
number hashed from the document and a seed.  The copies are dealt out by a hash and sorted by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogops.llm.common import free_prefix
from catalogops.plans.staging import written

#: Most sources whose rates are broadcast; above it both sides are shuffled, the sources spread by SALTS.
BROADCAST_SOURCES = 50_000
SALTS = 64
#: Rates above this are split into equal parts, whose counts are added, so that a distribution's table stays short.
PART_RATE = 32.0
#: Weight of a source by default: its number of documents to this power.
POWER = 0.5
SEED = 17


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) of 52 bits, hashed from the parts, the same in every engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_table(rate: Column) -> Column:
    """Cumulative probabilities of 0, 1, 2, ... under a mean of at most PART_RATE, up to where they round to 1."""
    steps = F.sequence(F.lit(1), F.lit(int(PART_RATE * 2.5) + 50))
    zero = F.exp(-rate)
    start = F.struct(zero.alias("p"), F.array(zero).alias("sums"))
    return F.aggregate(
        steps,
        start,
        lambda a, k: F.struct((a.p * rate / k).alias("p"), F.concat(a.sums, F.array(F.element_at(a.sums, -1) + a.p * rate / k)).alias("sums")),
        lambda a: a.sums,
    )


def rates(docs: DataFrame, source_col: str = "source", weights: dict[str | None, float] | None = None, rows: int | None = None, power: float = POWER) -> DataFrame:
    """``(source, n_docs, rate)``: repetition rate of each source, so that the expected mix has ``rows`` rows (default: as many as now).

    ``weights`` are the target weights; a source without one goes.  By default
    a source weighs its number of documents to the given power.
    """
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n_docs"))
    if weights is None:
        weight = F.pow(F.col("n_docs").cast("double"), F.lit(power))
    else:
        table = F.create_map(*[x for k, w in weights.items() if k is not None for x in (F.lit(k), F.lit(float(w)))]) if any(k is not None for k in weights) else F.lit(None)
        known = F.coalesce(F.try_element_at(table, F.col("source")), F.lit(0.0)) if any(k is not None for k in weights) else F.lit(0.0)
        weight = F.when(F.col("source").isNull(), F.lit(float(weights.get(None, 0.0)))).otherwise(known)
    sizes = written(sizes.withColumn("weight", weight), "source-sizes")
    total = sizes.agg(F.sum("weight").alias("w"), F.sum("n_docs").alias("n")).first()
    share = F.col("weight") / F.lit(float(total.w or 1.0) or 1.0)
    return sizes.select("source", "n_docs", (share * F.lit(float(rows if rows is not None else total.n or 0)) / F.col("n_docs")).alias("rate"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: dict[str | None, float] | None = None,
    rows: int | None = None,
    power: float = POWER,
    seed: int = SEED,
    broadcast_sources: int = BROADCAST_SOURCES,
) -> DataFrame:
    """``docs`` with each row repeated by its count, plus ``copy`` (1, 2, ...) and ``shuffle_key``, in shuffled order.

    The count of a row depends on its id, its source's rate and the seed alone,
    so rows that repeat an id are repeated alike.  A null id or source is a
    value like any other.  The rows are dealt to partitions by ``shuffle_key`` and sorted by it within each:
    read one after another, the partitions are one random order.  Columns named
    ``copy`` or ``shuffle_key``, in either case, are replaced; others keep their names and values.  An empty table gives no rows.
    """
    own = free_prefix(docs)
    source, n_parts, sums, salt, of, n = (own + x for x in ("source", "parts", "sums", "salt", "of", "n"))
    per_source = rates(docs, source_col, weights, rows, power)
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / PART_RATE)).cast("int")
    table = per_source.select(F.col("source").alias(source), parts.alias(n_parts), poisson_table(F.col("rate") / parts).alias(sums)).where("rate > 0")
    table = written(table, "poisson-tables")
    kept = [c for c in docs.columns if c.lower() not in ("copy", "shuffle_key")]
    rows_ = docs.select(*kept)
    if table.count() <= broadcast_sources:
        joined = rows_.join(F.broadcast(table), F.col(source_col).eqNullSafe(F.col(source)))
    else:
        salted = rows_.withColumn(salt, F.pmod(F.xxhash64(id_col), F.lit(SALTS)))
        spread = table.withColumn(of, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = salted.join(spread.hint("merge"), F.col(source_col).eqNullSafe(F.col(source)) & (F.col(salt) == F.col(of)))
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    count = F.aggregate(
        F.sequence(F.lit(1), F.col(n_parts)),
        F.lit(0),
        lambda total, j: total + F.size(F.filter(sums, lambda s: s <= uniform(name, F.lit(str(seed)), j.cast("string")))),
    )
    counted = joined.withColumn(n, count).where(F.col(n) > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(n))))
    keyed = counted.select(*kept, "copy", F.md5(F.concat_ws(":", F.lit(f"order{seed}"), name, F.col("copy").cast("string"))).alias("shuffle_key"))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


#: The mix of `documents` by default parameters, for DuckDB.
ORACLE_SQL = f"""
WITH RECURSIVE sizes AS (
  SELECT source, count(*) AS n_docs, sqrt(count(*)::double) AS weight FROM documents GROUP BY source
), total AS (SELECT sum(weight) AS w, sum(n_docs) AS n FROM sizes),
rates AS (
  SELECT source, weight / w * n / n_docs AS rate, greatest(1, ceil(weight / w * n / n_docs / {PART_RATE}))::int AS parts FROM sizes, total
), steps AS (
  SELECT source, 0 AS k, exp(-rate / parts) AS p, exp(-rate / parts) AS s, rate / parts AS r, parts FROM rates
  UNION ALL
  SELECT source, k + 1, p * r / (k + 1), s + p * r / (k + 1), r, parts FROM steps WHERE k < {int(PART_RATE * 2.5) + 50}
), draws AS (
  SELECT d.doc_id, d.source, j, ('0x' || substr(md5(concat_ws(':', coalesce(d.doc_id::varchar, 'null'), '{SEED}', j::varchar)), 1, 13))::bigint / {float(1 << 52)} AS u
  FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source, range(1, 1 + r.parts) t(j)
), counts AS (
  SELECT doc_id, count(*) AS n FROM draws JOIN steps ON draws.source IS NOT DISTINCT FROM steps.source AND steps.s <= draws.u GROUP BY doc_id
)
SELECT d.*, i::int AS copy, md5(concat_ws(':', 'order{SEED}', coalesce(d.doc_id::varchar, 'null'), i::varchar)) AS shuffle_key
FROM documents d JOIN counts c ON d.doc_id = c.doc_id, range(1, 1 + c.n) t(i)
"""
