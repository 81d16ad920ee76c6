"""Secret scans with corpus-wide ownership frequency, with DataFrame functions only.

Candidates are found by patterns.  Their hashes are then counted over the
corpus by distinct owners and repositories: a value that many owners share is
a copied example, one that stays with few is likely to be a live credential.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogops.plans.staging import written

#: Kind, pattern, group that holds the value, least length of the value.
BASE = (
    ("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Long mixed strings; they count as secrets only where their owners are few.
OWNED = ("owned", r"[A-Za-z0-9_]{28,}", 0, 28)
KINDS = [k[0] for k in (*BASE, OWNED)]
#: Most distinct owners and repositories of a value that still looks live.
MAX_OWNERS = 1
MAX_REPOS = 2
#: Matches of a text whose lengths are summed in one piece.
PIECE = 64
#: A value with more than one in this many of all spans is hot; so there are fewer hot values than this.
HOT_SHARE = 1000


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def _running(lengths: Column) -> Column:
    """Running sums of an array: within pieces, then over the pieces, so that the work grows with the length and not its square."""
    grow = lambda sums, x: F.array_append(sums, F.coalesce(F.try_element_at(sums, F.lit(-1)), F.lit(0)) + x)
    none = F.array().cast("array<int>")
    pieces = lambda n: F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / PIECE).cast("int")), lambda i: F.aggregate(F.slice(n, i * PIECE + 1, PIECE), none, grow))
    before = lambda sums: F.aggregate(F.transform(sums, lambda s: F.element_at(s, -1)), F.array(F.lit(0)), grow)
    shifted = lambda sums: _bound(before(sums), lambda b: F.flatten(F.transform(sums, lambda s, i: F.transform(s, lambda x: x + F.get(b, i)))))
    return _bound(_bound(lengths, pieces), shifted)


def find(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Array of (kind, start, end, value) of the pattern's matches, leftmost and non-overlapping, in code points.

    The lengths of the texts between matches and of the matches themselves add up to the offsets.
    """
    lit = F.lit(pattern)
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, lit, F.lit(0))
    values = F.regexp_extract_all(text, lit, F.lit(group)) if group else found
    span = lambda x, end: F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), (end - F.length(x.hit)).alias("start"), end.alias("end"), x.value.alias("value")
    )
    ends = lambda z: _running(F.transform(z, lambda x: F.length(x.gap) + F.coalesce(F.length(x.hit), F.lit(0))))
    every = _bound(F.arrays_zip(gaps.alias("gap"), found.alias("hit"), values.alias("value")), lambda z: F.zip_with(z, ends(z), span))
    # What follows the last match has no match of its own.
    spans = F.filter(every, lambda s: F.length(s.value) >= least)
    empty = F.array().cast("array<struct<kind:int,start:int,end:int,value:string>>")
    return F.when(text.rlike(pattern), spans).otherwise(empty)


def _owned_only(spans: Column) -> Column:
    """Of long mixed strings, those with both letters and digits."""
    return F.filter(spans, lambda s: s.value.rlike("[0-9]") & s.value.rlike("[A-Za-z]"))


def candidates(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str) -> DataFrame:
    """``(id, rid, owner, repo, base, owned)``: spans of each text with the hash of their value in place of the value."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashed = lambda spans: F.transform(
        spans, lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end"), F.sha2(s.value, 256).alias("value"))
    )
    base = F.array_sort(F.concat(*[find(text, *rule) for rule in BASE]), lambda a, b: _order(a, b))
    covered = lambda s: F.exists("base", lambda b: (b.start < s.end) & (s.start < b.end))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.monotonically_increasing_id().alias("rid"),
        F.col(owner_col).alias("owner"),
        F.col(repo_col).alias("repo"),
        hashed(base).alias("base"),
        hashed(_owned_only(find(text, *OWNED))).alias("owned"),
    )
    return rows.withColumn("owned", F.filter("owned", lambda s: ~covered(s)))


def _order(a: Column, b: Column) -> Column:
    """By start, then kind as listed."""
    at = lambda x: x.start.cast("long") * 8 + x.kind
    return F.when(at(a) < at(b), -1).when(at(a) > at(b), 1).otherwise(0)


def ownership(spans: DataFrame) -> DataFrame:
    """``(value, n_owners, n_repos, n_spans)`` from rows ``(value, owner, repo)``; repositories are an owner's own.

    Three grouped counts, each combined map-side, so a value that a third of all documents hold meets in no one task.
    """
    repos = spans.groupBy("value", "owner", "repo").agg(F.count("*").alias("m"))
    owners = repos.groupBy("value", "owner").agg(F.count("*").alias("n"), F.sum("m").alias("m"))
    return owners.groupBy("value").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repos"), F.sum("m").alias("n_spans"))


def _judged(spans: DataFrame, live: DataFrame) -> DataFrame:
    """``spans`` with ``live`` of their value, from rows ``(value, live, n_spans)``.

    Spans of hot values are judged where they are: fewer than ``HOT_SHARE`` values are broadcast. The others meet by a shuffle.
    """
    total = live.agg(F.sum("n_spans")).first()[0] or 0
    is_hot = F.col("n_spans") * HOT_SHARE > total
    hot = live.where(is_hot).select("value", F.col("live").alias("hot_live"))
    marked = spans.join(F.broadcast(hot), "value", "left")
    rest = marked.where("hot_live is null").drop("hot_live").join(live.where(~is_hot).select("value", "live").hint("merge"), "value")
    return marked.where("hot_live is not null").withColumnRenamed("hot_live", "live").unionByName(rest)


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "lang", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS
) -> DataFrame:
    """One row per row of ``docs``: ``id_col, base, spans, n_live, n_copied``.

    ``base`` holds the spans of the fixed patterns, sorted by start and kind, whatever their frequency;
    ``spans`` adds long mixed strings that look live; each span has kind, start, end (code points, exclusive), the value's
    hash and whether it looks live: it is held by at most ``max_owners`` owners and
    ``max_repos`` repositories.  n_live and n_copied count spans.  A null text
    is empty; a null owner or repository is one of its own.  Rows that repeat an id are scanned each.  An
    empty table gives no rows; other columns are not used.
    """
    rows = written(candidates(docs, id_col, text_col, owner_col, repo_col), "secret-candidates")
    some = rows.where((F.size("base") > 0) | (F.size("owned") > 0)).select("rid", "owner", "repo", F.explode(F.concat("base", "owned")).alias("s"))
    counts = ownership(some.select("s.value", "owner", "repo"))
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)
    judged = _judged(some.select("rid", "s", F.col("s.value").alias("value")), written(counts.select("value", live.alias("live"), "n_spans"), "secret-values"))
    by_row = judged.groupBy("rid").agg(F.collect_list(F.struct("s.kind", "s.start", "s.end", "s.value", "live")).alias("all"))
    out = rows.select("id", "rid").join(by_row.hint("shuffle_hash"), "rid", "left")
    every = F.array_sort(F.coalesce("all", F.array().cast(by_row.schema["all"].dataType)), lambda a, b: _order(a, b))
    owned = len(BASE)
    return (
        out.select("id", every.alias("every"))
        .select(
            F.col("id").alias(id_col),
            F.filter("every", lambda s: s.kind < owned).alias("base"),
            F.filter("every", lambda s: (s.kind < owned) | s.live).alias("spans"),
        )
        .withColumns({"n_live": F.size(F.filter("spans", lambda s: s.live)), "n_copied": F.size(F.filter("spans", lambda s: ~s.live))})
    )


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start.cast("string"), s.end.cast("string"))), ",")
