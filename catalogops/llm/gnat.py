"""Hard-negative mining with a GNAT-style tree of hyperplanes.

Vectors of different lengths are lifted by one more component onto a sphere, where an inner product with
an anchor decides the distance to it.  A node of the tree has several split points; a
row belongs to the nearest, so hyperplanes part the subtrees.  Each split point stores the range
of its distances to the rows of every sibling subtree.  What an anchor looks for lies in an annulus
about it, given by a window of scores; a subtree goes when, for some split point, its
range does not meet the range that the annulus allows.  The leaves that are left are searched exactly.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalogops.plans.staging import written

#: Most rows that split points are chosen from; all rows are indexed.
SAMPLE_ROWS = 16384
#: Split points of a node, and sample rows of a node that is not split any more.
FANOUT, LEAF_ROWS = 8, 48
#: Anchors that are searched for together; with their windows they are the only thing that is broadcast.
BLOCK_ANCHORS = 8192
#: Rows whose scores with a block of anchors are held at a time.
CHUNK_CELLS = 1 << 22
#: Components are cut to steps of 1/SCALE; an anchor has so many positives and negatives each; the window's lower end in percent.
SCALE, POSITIVES, NEGATIVES, LEAST_PERCENT = 256, 5, 5, 80
#: Distances are compared with so much room for rounding, relative to the sphere.
SLACK = 1e-9

ROW = "row long, vec_id long, label long, v array<long>"


@dataclasses.dataclass
class Node:
    """A node of the tree: its split points, and the subtree or the leaf's number below each."""

    points: np.ndarray
    below: list
    #: Number of the first leaf of each subtree; leaves are numbered in order.
    firsts: list
    #: (split point, subtree) to the least and greatest distance.
    low: np.ndarray | None = None
    high: np.ndarray | None = None


@dataclasses.dataclass
class Tree:
    root: Node | int
    nodes: list[Node]
    n_leaves: int
    dim: int
    top: float  # squared radius of the sphere

    def lift(self, v: np.ndarray) -> np.ndarray:
        return np.concatenate([v, np.sqrt(np.maximum(self.top - (v * v).sum(1), 0))[:, None]], axis=1)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Rows ``(row, vec_id, label, v)`` that take part: whole steps in place of components, and the wrong labels that the job plants."""
    wrong = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()).where(~wrong)
    label = F.when(F.col(id_col) % 7 == 0, (F.col(label_col) + 1) % 10).otherwise(F.col(label_col))
    steps = F.transform(vector_col, lambda x: F.floor(x.cast("double") * SCALE))
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), steps.alias("v"))


def _matrix(v: pa.Array | list, dim: int) -> np.ndarray:
    """Vectors as rows of doubles; shorter ones end in zeros."""
    v = v if isinstance(v, pa.Array) else pa.array(v, pa.list_(pa.int64()))
    lengths = np.asarray(v.value_lengths().fill_null(0))
    out = np.zeros((len(lengths), dim))
    out[np.arange(dim) < lengths[:, None]] = np.asarray(v.flatten(), dtype=np.float64)
    return out


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0))


def grow(sample: np.ndarray, dim: int, top: float, fanout: int = FANOUT, leaf_rows: int = LEAF_ROWS) -> Tree:
    """Tree over a sample of vectors: a node's split points are rows far apart from each other."""
    tree = Tree(0, [], 0, dim, top)
    lifted = tree.lift(sample)

    def split(at: np.ndarray):
        some = lifted[at[:: max(1, len(at) // (fanout * 64))]]
        chosen = [0]
        if len(at) > leaf_rows:
            away = _distances(some, some[:1])[:, 0]
            while len(chosen) < fanout and away.max() > SLACK * np.sqrt(top):
                chosen.append(int(away.argmax()))
                away = np.minimum(away, _distances(some, some[chosen[-1:]])[:, 0])
        if len(chosen) < 2:
            tree.n_leaves += 1
            return tree.n_leaves - 1
        node = Node(some[chosen], [], [])
        tree.nodes.append(node)
        nearest = _distances(lifted[at], node.points).argmin(1)
        for j in range(len(chosen)):
            node.firsts.append(tree.n_leaves)
            node.below.append(split(at[nearest == j]))
        return node

    tree.root = split(np.arange(len(sample)))
    return tree


def leaves(tree: Tree, v: np.ndarray) -> np.ndarray:
    """Number of the leaf of each vector."""
    out = np.zeros(len(v), dtype=np.int64)
    lifted = tree.lift(v)

    def go(node, at):
        if isinstance(node, int):
            out[at] = node
        elif len(at):
            nearest = _distances(lifted[at], node.points).argmin(1)
            for j, below in enumerate(node.below):
                go(below, at[nearest == j])

    go(tree.root, np.arange(len(v)))
    return out


def ranges(tree: Tree, v: np.ndarray, leaf: np.ndarray) -> Iterator[tuple[int, int, int, float, float]]:
    """(node, split point, subtree, least, greatest) of the distances of vectors to the split points above their leaves."""
    lifted = tree.lift(v)
    number = {id(n): i for i, n in enumerate(tree.nodes)}

    def go(node, at):
        if isinstance(node, int) or not len(at):
            return
        d = _distances(lifted[at], node.points)
        # By the leaf that the row was put in: rounding may not tell it otherwise here.
        where = np.searchsorted(node.firsts, leaf[at], side="right") - 1
        for j in np.unique(where):
            mine = where == j
            for i, (lo, hi) in enumerate(zip(d[mine].min(0), d[mine].max(0), strict=True)):
                yield number[id(node)], i, int(j), float(lo), float(hi)
            yield from go(node.below[j], at[mine])

    yield from go(tree.root, np.arange(len(v)))


@dataclasses.dataclass
class Windows:
    """What a block of anchors looks for: scores from ``least`` to ``most`` with rows of the anchor's label (or of another)."""

    anchors: np.ndarray  # vectors, one a window
    row: np.ndarray  # the anchor's own row
    label: np.ndarray
    least: np.ndarray
    most: np.ndarray
    same: bool
    keep: int


def reachable(tree: Tree, w: Windows, wanted: np.ndarray) -> np.ndarray:
    """(leaf of ``wanted``, window): whether the leaf can hold a row in the window."""
    out = np.zeros((tree.n_leaves, len(w.row)), dtype=bool)
    norm = (w.anchors * w.anchors).sum(1)
    query = np.concatenate([w.anchors, np.zeros((len(w.row), 1))], axis=1)
    slack = SLACK * max(tree.top, float(norm.max(initial=0)), 1.0)
    outer = np.sqrt(np.maximum(norm + tree.top - 2 * w.least + slack, 0))
    inner = np.sqrt(np.maximum(norm + tree.top - 2 * w.most - slack, 0))
    room = np.sqrt(slack)
    need = np.zeros(tree.n_leaves, dtype=bool)
    need[wanted] = True

    def below(node) -> bool:
        return bool(need[node]) if isinstance(node, int) else any(below(b) for b in node.below)

    def go(node, at):
        if not len(at) or not below(node):
            return
        if isinstance(node, int):
            out[node, at] = True
            return
        d = _distances(query[at], node.points)
        lo = np.maximum(d - outer[at, None], inner[at, None] - d) - room
        hi = d + outer[at, None] + room
        for j, child in enumerate(node.below):
            go(child, at[((lo <= node.high[:, j]) & (hi >= node.low[:, j])).all(1)])

    go(tree.root, np.flatnonzero(w.least <= w.most))
    return out[wanted]


def _best(found: pd.DataFrame, keep: int) -> pd.DataFrame:
    found = found.sort_values(["window", "score", "vec_id", "row"], ascending=[True, False, True, True], kind="stable")
    return found[found.groupby("window").cumcount() < keep]


def search(tree: Tree, w: Windows, row: np.ndarray, ids: np.ndarray, label: np.ndarray, leaf: np.ndarray, v: np.ndarray) -> pd.DataFrame:
    """The first rows of each window among the given ones: ``window, score, vec_id, row``."""
    present = np.unique(leaf)
    open_ = reachable(tree, w, present)
    parts = []
    for k, here in enumerate(present):
        at, wins = np.flatnonzero(leaf == here), np.flatnonzero(open_[k])
        if not len(wins):
            continue
        # Windows of one anchor share its vector, and so their scores.
        own, which = np.unique(w.row[wins], return_index=True)
        anchor = np.searchsorted(own, w.row[wins])
        vectors = w.anchors[wins[which]]
        for some in np.array_split(at, max(1, -(-len(at) * len(wins) // CHUNK_CELLS))):
            score = (v[some] @ vectors.T)[:, anchor]
            fits = (score >= w.least[wins]) & (score <= w.most[wins]) & ((label[some][:, None] == w.label[wins]) == w.same) & (row[some][:, None] != w.row[wins])
            r, c = np.nonzero(fits)
            if len(r):
                parts.append(pd.DataFrame({"window": wins[c], "score": score[r, c].astype(np.int64), "vec_id": ids[some][r], "row": row[some][r]}))
                parts = [_best(pd.concat(parts), w.keep)]
                # Once a window is full, only scores as good as its last one count.
                full = parts[0].groupby("window")["score"].agg(["size", "min"]).query("size == @w.keep")
                w.least[full.index] = np.maximum(w.least[full.index], full["min"])
    return parts[0] if parts else pd.DataFrame({"window": [], "score": [], "vec_id": [], "row": []}, dtype=np.int64)


def _lowest(tree_sample: pd.DataFrame, sample: np.ndarray, w: Windows) -> None:
    """Raise the windows' lower ends to scores that enough rows of the sample reach."""
    rows = tree_sample
    for some in np.array_split(np.arange(len(w.row)), max(1, -(-len(w.row) * len(rows) // CHUNK_CELLS))):
        if not len(some) or len(rows) < w.keep:
            continue
        score = w.anchors[some] @ sample.T
        fits = ((rows["label"].to_numpy() == w.label[some][:, None]) == w.same) & (rows["row"].to_numpy() != w.row[some][:, None]) & (score <= w.most[some][:, None]) & (score >= w.least[some][:, None])
        score[~fits] = -np.inf
        w.least[some] = np.maximum(w.least[some], -np.partition(-score, w.keep - 1, axis=1)[:, w.keep - 1])


class Index:
    """All rows by leaf, in a written table, with the tree that leads to them."""

    def __init__(self, rows: DataFrame, sample_rows: int = SAMPLE_ROWS, fanout: int = FANOUT, leaf_rows: int = LEAF_ROWS):
        spark = rows.sparkSession
        rows = written(rows, "vectors")
        # Scores are exact in doubles while no sum of products passes 2^53.
        square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
        count, dim, top = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(square), F.lit(0.0))).first()
        if top > 2.0**52:
            raise ValueError("vectors are too long for exact scores")
        share = (1.1 * sample_rows + 200) / max(count, 1)
        some = rows.where(F.xxhash64("row") <= int(-(2**63) + share * 2**64)) if share < 1 else rows
        self.sample = some.orderBy(F.xxhash64("row")).limit(sample_rows).toPandas()
        self.sample_vectors = _matrix(self.sample["v"].tolist(), dim)
        tree = grow(self.sample_vectors, dim, top, fanout, leaf_rows)
        shared = spark.sparkContext.broadcast(tree)

        def placed(batches):
            for b in batches:
                at = leaves(shared.value, _matrix(b.column("v"), dim))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at)], [*b.schema.names, "leaf"])

        table = rows.mapInArrow(placed, ROW + ", leaf long")
        # A leaf that many rows share is cut by the row.
        self.rows = written(table.repartitionByRange("leaf", "row").sortWithinPartitions("leaf"), "leaves")

        def measured(batches):
            for b in batches:
                found = list(zip(*ranges(shared.value, _matrix(b.column("v"), dim), np.asarray(b.column("leaf"))), strict=True))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["node", "point", "below", "lo", "hi"])

        spans = self.rows.mapInArrow(measured, "node long, point long, below long, lo double, hi double")
        spans = spans.groupBy("node", "point", "below").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        for node in tree.nodes:
            shape = (len(node.points), len(node.below))
            node.low, node.high = np.full(shape, np.inf), np.full(shape, -np.inf)
        # As many rows as the tree has pairs of split points: bounded by the sample.
        for r in spans.collect():
            tree.nodes[r.node].low[r.point, r.below], tree.nodes[r.node].high[r.point, r.below] = r.lo, r.hi
        self.tree = tree

    def first(self, w: Windows) -> DataFrame:
        """``(window, rank, score, vec_id, row)``: the first rows of each window, by score, then id, over the whole index."""
        _lowest(self.sample, self.sample_vectors, w)
        spark, dim, keep = self.rows.sparkSession, self.tree.dim, w.keep
        shared = spark.sparkContext.broadcast((self.tree, w))

        def run(batches):
            tree, windows = shared.value
            windows = dataclasses.replace(windows, least=windows.least.copy())
            held = None
            for b in batches:
                col = lambda name: np.asarray(b.column(name))  # noqa: B023, E731
                found = search(tree, windows, col("row"), col("vec_id"), col("label"), col("leaf"), _matrix(b.column("v"), dim))
                held = found if held is None else _best(pd.concat([held, found]), keep)
            if held is not None and len(held):
                yield pa.RecordBatch.from_pandas(held.astype(np.int64), preserve_index=False)

        each = self.rows.mapInArrow(run, "window long, score long, vec_id long, row long")
        rank = F.row_number().over(Window.partitionBy("window").orderBy(F.desc("score"), "vec_id", "row"))
        return each.withColumn("rank", rank).where(F.col("rank") <= keep)


def hard_negatives(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block_anchors: int = BLOCK_ANCHORS, **index) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` for anchors whose id is divisible by 100.

    An anchor's positives are its first rows of the same label; its negatives, for each positive, the first rows
    of other labels with 80 to 100 % of the positive's score.  A score is the inner product of whole steps of 1/256; shorter
    vectors end in zeros.  Rows with a null id, label or vector, or a component that is null or not finite, take no part.  Rows that
    repeat an id, or all of a row, are rows of their own; equal scores go by id, then in the order of the
    table as it was read.  An empty table, or one without anchors, gives no rows; other columns are not used.
    Anchors are taken in blocks of ``block_anchors`` rows; each block is held by the driver, broadcast, and meets all rows.
    """
    rows = usable(vectors, id_col, vector_col, label_col)
    spark = rows.sparkSession
    at = Index(rows, **index)
    anchors = written(at.rows.where("vec_id % 100 = 0").select("row", "vec_id", "label", "v").repartitionByRange("row").sortWithinPartitions("row"), "anchors")
    n_blocks = max(1, -(-anchors.count() // block_anchors))
    anchors = anchors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n_blocks)))
    done = []
    for b in range(n_blocks):
        block = anchors.where(F.col("block") == b).toPandas()
        if len(block):
            done.append(written(_mined(at, block), "hard-negatives"))
    if not done:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _mined(at: Index, block: pd.DataFrame) -> DataFrame:
    spark = at.rows.sparkSession
    vectors = _matrix(block["v"].tolist(), at.tree.dim)
    col = lambda name: block[name].to_numpy()
    ends = lambda x: np.full(len(block), x)
    # At most five rows an anchor of the block.
    positives = at.first(Windows(vectors, col("row"), col("label"), ends(-np.inf), ends(np.inf), True, POSITIVES)).toPandas()
    mine = positives["window"].to_numpy()
    score = positives["score"].to_numpy()
    # Python's integers: 80 times a score may pass 64 bits.
    least = np.array([-(-LEAST_PERCENT * int(s) // 100) for s in score], dtype=np.float64)
    windows = Windows(vectors[mine], col("row")[mine], col("label")[mine], least, score.astype(np.float64), False, NEGATIVES)
    pairs = pd.DataFrame({"window": np.arange(len(mine)), "anchor_id": col("vec_id")[mine], "positive_id": positives["vec_id"], "positive_score": score})
    named = spark.createDataFrame(pairs, "window long, anchor_id long, positive_id long, positive_score long")
    # Five rows an anchor of one block at most.
    found = at.first(windows).join(F.broadcast(named), "window")
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


ORACLE_SQL = f"""
WITH rows_ AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::double)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_dot_product(a.v, b.v)::bigint AS score FROM rows_ a JOIN rows_ b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::int AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id) WHERE NOT same AND {LEAST_PERCENT} * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= {NEGATIVES}
"""
