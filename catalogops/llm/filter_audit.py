"""Interaction audit of filters by relations of failing ids.

Every filter has one table of the rows that fail it.  The survivors of each set of filters come by a
left-anti join with the last one's table, removals by a left-semi join, and only ids, parts
and label flags take part in these joins, never texts.  What a filter removes
depends on the set of filters before it and not on their order, so 32 sets stand for all 120 orders.
"""

from __future__ import annotations

import functools
import itertools
import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogops.plans.staging import discard, written

#: Limits of the filters.
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, SIGNS = 200, 50, 2, r"[#$%&*|]"
FILTERS = "ABCDE"
#: A text that makes up at least one in so many rows is hot: its copies are told by a broadcast of at most as many digests.
HOT_SHARE = 1000


def conditions(text: Column) -> dict[str, Column]:
    """Whether a text fails each filter that looks at one text alone; ``text`` is not null."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    upper = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    few = F.get(F.transform(F.array(words), lambda w: F.struct((F.size(w) < MIN_WORDS).alias("A"), (100 * F.size(F.array_distinct(w)) < DISTINCT_PERCENT * F.size(w)).alias("B"))), 0)
    return {"A": few["A"], "B": few["B"], "C": 100 * upper.cast("long") > UPPER_PERCENT * F.char_length(text).cast("long"), "D": text.rlike(SIGNS)}


def repeats(rows: DataFrame) -> DataFrame:
    """``row`` of every row ``(row, id, digest)`` whose digest also has a smaller id.

    Hot digests, fewer than ``HOT_SHARE`` or as many, are told by a broadcast, the others by a shuffle of digests.
    """
    groups = rows.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n"))
    groups = written(groups.where("n > 1 and first < last").select("digest", "first", "n"), "audit-copies")
    hot = F.col("n") * HOT_SHARE >= rows.count()
    few = F.broadcast(groups.where(hot).select("digest", "first"))
    marked = rows.join(few, "digest", "left")
    cold = marked.where("first is null").drop("first").join(groups.where(~hot).select("digest", "first").hint("merge"), "digest")
    return marked.where("id > first").select("row").unionByName(cold.where("id > first").select("row"))


def _sum(name: str) -> Column:
    return F.sum(F.col(name).cast("long")).alias(name)


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, order of filters and step: ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.

    ``labels`` has ``(doc_id, quality, toxic)``; of several labels of an id one is enough.  A null text or part is
    empty; a null id has no label, and its text is no repeat and makes none.  Rows that share an id and a text are no repeats of each
    other.  An empty table gives no rows; other columns are not used.  The result has 600 rows a part.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = conditions(text)
    facts = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"),
        F.array(*[F.when(own[f], f) for f in own]).alias("fails"),
    )
    facts = written(facts, "audit-facts")
    failing = {f: written(facts.where(F.array_contains("fails", f)).select("row"), f"failing-{f}") for f in own}
    failing["E"] = written(repeats(facts.select("row", "id", "digest")), "failing-E")
    flags = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).where("id is not null")
    flag = lambda name: F.coalesce(name, F.lit(False)).alias(name)
    start = facts.select("row", "id", "part").join(flags.hint("merge"), "id", "left").select("row", "part", flag("good"), flag("toxic"), F.lit(0).alias("prefix"))
    survivors = written(start, "survivors")
    # Each filter doubles the sets: a set of the filters so far, with and without it.
    for i, f in enumerate(FILTERS):
        kept = survivors.join(failing[f].hint("merge"), "row", "left_anti").withColumn("prefix", F.col("prefix").bitwiseOR(1 << i))
        after = written(survivors.unionByName(kept), "survivors")
        discard(survivors)
        survivors = after
    tally = [F.count("*").alias("n"), _sum("good"), _sum("toxic")]
    stay = survivors.groupBy("part", "prefix").agg(*tally).withColumn("filter", F.lit(-1))
    gone = []
    for i, f in enumerate(FILTERS):
        open_ = survivors.where(F.col("prefix").bitwiseAND(1 << i) == 0)
        gone.append(open_.join(failing[f].hint("merge"), "row", "left_semi").groupBy("part", "prefix").agg(*tally).withColumn("filter", F.lit(i)))
    counts = written(functools.reduce(DataFrame.unionByName, [stay, *gone]), "audit-counts")
    return _by_order(counts)


def _by_order(counts: DataFrame) -> DataFrame:
    """All orders and steps of each part from its counts ``(part, prefix, filter, n, good, toxic)``; filter -1 counts survivors."""
    place = lambda prefix, i: F.lit(prefix * 8 + i + 1)
    entry = F.struct((F.col("prefix") * 8 + F.col("filter") + 1).alias("at"), F.struct("n", "good", "toxic").alias("c"))
    # At most 32 + 80 entries a part.
    parts = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(entry)).alias("c"))
    none = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("n", "good", "toxic")])
    at = lambda key: F.coalesce(F.try_element_at("c", key), none)
    full, n = (1 << len(FILTERS)) - 1, len(FILTERS)

    def shapley(i: int) -> Column:
        sets = [s for s in range(full + 1) if not s >> i & 1]
        weight = lambda s: math.factorial(s.bit_count()) * math.factorial(n - 1 - s.bit_count())
        return functools.reduce(lambda a, b: a + b, [at(place(s, i))["n"] * weight(s) for s in sets])

    facts = F.array(*[F.struct(at(place(0, i))["n"].alias("fails"), at(place(full ^ 1 << i, i))["n"].alias("unique"), shapley(i).alias("shapley")) for i in range(n)])
    parts = written(parts.select("part", "c", facts.alias("f")), "audit-parts")
    bits = lambda some: sum(1 << FILTERS.index(x) for x in some)
    steps = [("".join(order), i + 1, bits(order[:i]), FILTERS.index(order[i]), bits(order[: i + 1])) for order in itertools.permutations(FILTERS) for i in range(n)]
    plan = [dict(zip(("filter_order", "step", "before", "filter", "after"), s, strict=True)) for s in steps]
    rows = parts.select("part", "c", "f", F.explode(F.from_json(F.lit(json.dumps(plan)), "array<struct<filter_order:string,step:int,before:int,filter:int,after:int>>")).alias("s"))
    gone, kept, mine = at(F.col("s.before") * 8 + F.col("s.filter") + 1), at(F.col("s.after") * 8)["n"], F.get("f", F.col("s.filter"))
    return rows.select(
        "part", "s.filter_order", "s.step", kept.alias("kept"), gone["n"].alias("removed"), (mine["fails"] - gone["n"]).alias("redundant"), mine["unique"].alias("unique_fails"),
        gone["good"].alias("good_lost"), gone["toxic"].alias("toxic_lost"), mine["shapley"].alias("shapley"),
    )


_BIT = " + ".join(f"CASE WHEN {f.lower()} THEN {1 << i} ELSE 0 END" for i, f in enumerate(FILTERS))

ORACLE_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM t),
flagged AS (
  SELECT part, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic,
    len(words) < {MIN_WORDS} AS a, 100 * len(list_distinct(words)) < {DISTINCT_PERCENT} * len(words) AS b,
    100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > {UPPER_PERCENT} * length(text) AS c, regexp_matches(text, '{SIGNS}') AS d,
    doc_id > min(doc_id) OVER (PARTITION BY text) AS e FROM w
), cells AS (SELECT part, {_BIT} AS fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM flagged GROUP BY ALL),
letters AS (SELECT i, substr('{FILTERS}', i, 1) AS x FROM range(1, 6) r(i)),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, s AS step, 1 << (instr('{FILTERS}', substr(filter_order, s, 1)) - 1) AS bit,
    list_sum(list_transform(range(1, s), lambda j: 1 << (instr('{FILTERS}', substr(filter_order, j, 1)) - 1)))::int AS before_ FROM orders, range(1, 6) r(s)
), counted AS (
  SELECT part, filter_order, step, bit, sum(n) FILTER (fails & (coalesce(before_, 0) | bit) = 0) AS kept, sum(n) FILTER (fails & coalesce(before_, 0) = 0 AND fails & bit > 0) AS removed,
    sum(n) FILTER (fails & coalesce(before_, 0) > 0 AND fails & bit > 0) AS redundant, sum(n) FILTER (fails = bit) AS unique_fails,
    sum(good) FILTER (fails & coalesce(before_, 0) = 0 AND fails & bit > 0) AS good_lost, sum(toxic) FILTER (fails & coalesce(before_, 0) = 0 AND fails & bit > 0) AS toxic_lost
  FROM cells, steps GROUP BY ALL
)
SELECT part, filter_order, step::int AS step, coalesce(kept, 0)::bigint AS kept, coalesce(removed, 0)::bigint AS removed, coalesce(redundant, 0)::bigint AS redundant, coalesce(unique_fails, 0)::bigint AS unique_fails,
  coalesce(good_lost, 0)::bigint AS good_lost, coalesce(toxic_lost, 0)::bigint AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::bigint AS shapley FROM counted
"""
