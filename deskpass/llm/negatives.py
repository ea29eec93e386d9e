"""Hard-negative mining with anchor spanning-tree bounds.

An anchor is scored against all rows by an integer inner product. Anchors of like direction
are gathered into trees of at most ``TREE`` (in order of label and of a projection, cut as they
come: a label with any number of anchors becomes many trees), and a minimum spanning tree is
built in each. The tree's root is scored against a block of rows exactly. For a child,
|score(child, c) - score(parent, c)| <= |child - parent| * |c|, so the parent's scores, or the
bounds that stand for them, plus or minus edge length times the row's norm bound the child's.
Only rows whose bounds reach a window that can still change the answer are scored anew, and
exact scores replace their bounds for the nodes below.

Two rounds run over the same cells of (trees, block of rows): the first looks for an anchor's
positives (window: from its fifth best so far up; rows of its label), the second for the negatives
of each (window: ``low`` to ``high`` of the positive's score, from the fifth best so far up;
rows of other labels). Every cell gives at most ``positives`` rows an anchor, or ``negatives``
rows a positive, and ranked windows keep the best of all cells. Cells are of bounded size on both
sides: rows are dealt to blocks by their place, so no label, id or vector makes a large one. Rows
of an anchor set against all rows are quadratic by the task; what is shuffled is rows x anchor
groups plus anchors x blocks.

Scores are exact: products of doubles where all sums stay under 2^53, of 64-bit integers (without
the bounds, whose rounding would then matter) where they do not; scores must fit 64 bits.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component take
no part; equal rows (id, label and vector) count once; rows with an anchor's id are not its
positives or negatives; vectors of different lengths are compared as if filled up with zeros; ties
go to the smaller id; an anchor with fewer positives or negatives has fewer rows, one without any
has none; a positive with a score under zero has no negatives (its window is empty); an empty
table gives no rows; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskpass.llm.common import col, need, stage

TREE = 128             # anchors of a tree
BLOCK_ROWS = 1 << 16   # rows of a block, at most
CELL_TREES = 128       # trees of a cell, at most
SUB_ROWS = 8192        # rows scored at once
POSITIVES, NEGATIVES = 5, 5
LOW, HIGH = 80, 100    # per cent of the positive's score
EXACT = 1 << 53


def whole_vector(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, as doubles (whole numbers)."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))


def usable_rows(rows: DataFrame, id_col: str, label: str, vector: str, scale: int) -> DataFrame:
    """(id, label, v): the rows that take part, equal ones once."""
    need(rows, id_col, label, vector)
    x = rows.select(col(id_col).cast("long").alias("id"), col(label).cast("long").alias("label"), col(vector).alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")) & ~F.isnan(c.cast("double")))
    x = x.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())
    return x.where(finite).select("id", "label", whole_vector(F.col("v"), scale).alias("v")).distinct()


def matrix(vectors: pd.Series, width: int = 0) -> np.ndarray:
    """Rows of whole numbers, shorter ones filled up with zeros."""
    width = max([width, *map(len, vectors)])
    if all(len(v) == width for v in vectors):
        return np.stack(vectors.to_numpy()).astype(np.float64) if len(vectors) else np.zeros((0, width))
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge): rows in an order in which parents come first, each one's parent (-1: root) and
    distance to it, by Prim's method from the row nearest to the mean."""
    n = len(x)
    todo = np.ones(n, bool)
    at = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    order, parent, near = [at], np.full(n, at), ((x - x[at]) ** 2).sum(axis=1)
    parent[at], todo[at] = -1, False
    while len(order) < n:
        at = int(np.flatnonzero(todo)[near[todo].argmin()])
        order.append(at)
        todo[at] = False
        far = ((x - x[at]) ** 2).sum(axis=1)
        closer = todo & (far < near)
        near[closer], parent[closer] = far[closer], at
    return np.array(order), parent, np.where(parent < 0, 0.0, np.sqrt(((x - x[parent]) ** 2).sum(axis=1)))


def plant(anchors: DataFrame, tree_rows: int = TREE) -> DataFrame:
    """(tree, node, parent, edge, id, label, v): anchors in spanning trees; node 0 is the root."""
    turn = F.transform("v", lambda x, i: F.when(F.xxhash64(i) % 2 == 0, x).otherwise(-x))
    across = F.aggregate(turn, F.lit(0.0), lambda a, x: a + x)
    n = anchors.count()
    parts = max(1, math.ceil(n / (8 * tree_rows)))
    dealt = (anchors.withColumn("across", across).repartitionByRange(parts, "label", "across", "id")
             .sortWithinPartitions("label", "across", "id").select("id", "label", "v", F.spark_partition_id().alias("part")))

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, number = None, 0
        for f in frames:
            rest = f if rest is None else pd.concat([rest, f], ignore_index=True)
            while len(rest) >= tree_rows:
                yield tree_of(rest[:tree_rows], number)
                rest, number = rest[tree_rows:].reset_index(drop=True), number + 1
        if rest is not None and len(rest):
            yield tree_of(rest, number)

    def tree_of(f: pd.DataFrame, number: int) -> pd.DataFrame:
        order, parent, edge = spanning_tree(matrix(f["v"]))
        node = np.empty(len(order), np.int64)
        node[order] = np.arange(len(order))
        up = np.where(parent[order] < 0, -1, node[parent[order]])
        own = f.iloc[order].reset_index(drop=True)
        return pd.DataFrame({"tree": own["part"].astype("int64") * (1 << 32) + number, "node": np.arange(len(own), dtype=np.int32),
                             "parent": up.astype(np.int32), "edge": edge[order], "id": own["id"], "label": own["label"], "v": own["v"]})

    return dealt.mapInPandas(build, "tree long, node int, parent int, edge double, id long, label long, v array<double>")


class Rows:
    """A block's rows with all that scores and bounds need."""

    def __init__(self, f: pd.DataFrame, width: int):
        order = np.argsort(f["id"].to_numpy(), kind="stable")
        self.x = matrix(f["v"], width)[order]
        self.ids, self.labels = f["id"].to_numpy(np.int64)[order], f["label"].to_numpy(np.int64)[order]
        self.norms = np.sqrt((self.x * self.x).sum(axis=1)) * (1 + 1e-9)
        self.most = float(np.abs(self.x).max(initial=0))

    def scores(self, rows: np.ndarray | slice, anchor: np.ndarray) -> np.ndarray:
        if self.exact(anchor):
            return (self.x[rows] @ anchor).astype(np.int64)
        return self.x[rows].astype(np.int64) @ anchor.astype(np.int64)

    def exact(self, anchor: np.ndarray) -> bool:
        return len(anchor) * self.most * float(np.abs(anchor).max(initial=0)) < EXACT


class Best:
    """The first ``k`` (score, id) seen, higher scores first, then smaller ids."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.empty(0, np.int64), np.empty(0, np.int64)

    def least(self) -> float:
        """The score that a row must reach to be of interest."""
        return float(self.scores[-1]) if len(self.scores) == self.k else -math.inf

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > self.k:  # all that tie with the k-th stay for the order by id
            keep = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[keep], ids[keep]
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[:self.k]
        self.scores, self.ids = scores[order], ids[order]


def descend(tree: pd.DataFrame, rows: Rows, wanted) -> int:
    """Walk a tree over a block's rows. ``wanted(node, part, lo, hi)`` gives (mask of the rows to score, function for
    their places and scores), or None if the node wants no row. Returns the number of scores computed.

    A row's bounds at a node are its parent's, wider by edge length times norm; a scored row's are its score."""
    x = matrix(tree["v"], rows.x.shape[1])
    parents, edges = tree["parent"].to_numpy(), tree["edge"].to_numpy() * (1 + 1e-9)
    last = np.full(len(tree), -1)
    for node, p in enumerate(parents):
        if p >= 0:
            last[p] = node
    scored = 0
    for s in range(0, len(rows.ids), SUB_ROWS):
        part = slice(s, min(s + SUB_ROWS, len(rows.ids)))
        norms = rows.norms[part]
        bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for node, p in enumerate(parents):
            if p < 0 or not rows.exact(x[node]):
                got = rows.scores(part, x[node])
                lo = hi = got.astype(np.float64)
                scored += len(got)
                if (found := wanted(node, part, lo, hi)) is not None:
                    places = np.flatnonzero(found[0])
                    found[1](places + s, got[places])
            else:
                wide = edges[node] * norms + 1e-3
                lo, hi = bounds[p][0] - wide, bounds[p][1] + wide
                if (found := wanted(node, part, lo, hi)) is not None:
                    places = np.flatnonzero(found[0])
                    got = rows.scores(places + s, x[node])
                    lo[places] = hi[places] = got
                    scored += len(got)
                    found[1](places + s, got)
            if last[node] >= 0:
                bounds[node] = lo, hi
            if p >= 0 and last[p] == node:
                del bounds[p]  # no child is left
    return scored


def find_positives(trees: pd.DataFrame, block: pd.DataFrame, k: int) -> pd.DataFrame:
    """(tree, node, pid, score, scored): every anchor's best rows of its label within the block."""
    rows = Rows(block, max(map(len, trees["v"])))
    out = []
    for number, tree in trees.sort_values(["tree", "node"]).groupby("tree"):
        tree = tree.reset_index(drop=True)
        best = [Best(k) for _ in range(len(tree))]
        ids, labels = tree["id"].to_numpy(), tree["label"].to_numpy()

        def wanted(node, part, lo, hi):
            mask = (rows.labels[part] == labels[node]) & (rows.ids[part] != ids[node]) & (hi >= best[node].least())
            return (mask, lambda places, scores: best[node].add(scores, rows.ids[places])) if mask.any() else None

        scored = descend(tree, rows, wanted)
        out += [(number, node, i, s, scored) for node, b in enumerate(best) for i, s in zip(b.ids.tolist(), b.scores.tolist())]
    return pd.DataFrame(out, columns=["tree", "node", "pid", "score", "scored"])


def find_negatives(trees: pd.DataFrame, block: pd.DataFrame, k: int, low: int, high: int) -> pd.DataFrame:
    """(tree, node, pid, pscore, nid, nscore): for every anchor's positive, the best rows of other labels in its window."""
    rows = Rows(block, max(map(len, trees["v"])))
    out = []
    for number, tree in trees.sort_values(["tree", "node"]).groupby("tree"):
        tree = tree.reset_index(drop=True)
        ids, labels = tree["id"].to_numpy(), tree["label"].to_numpy()
        windows = [[(p["pid"], p["score"], -(-low * p["score"] // 100), high * p["score"] // 100, Best(k)) for p in own]
                   for own in tree["positives"]]

        def wanted(node, part, lo, hi):
            reach = np.zeros(len(lo), bool)
            for _, _, least, most, best in windows[node]:
                if least <= most:
                    reach |= (hi >= max(least, best.least())) & (lo <= most)
            mask = reach & (rows.labels[part] != labels[node]) & (rows.ids[part] != ids[node])

            def take(places, scores):
                for _, _, least, most, best in windows[node]:
                    inside = (scores >= least) & (scores <= most)
                    best.add(scores[inside], rows.ids[places[inside]])

            return (mask, take) if mask.any() else None

        descend(tree, rows, wanted)
        out += [(number, node, pid, score, i, s) for node, own in enumerate(windows) for pid, score, _, _, b in own
                for i, s in zip(b.ids.tolist(), b.scores.tolist())]
    return pd.DataFrame(out, columns=["tree", "node", "pid", "pscore", "nid", "nscore"])


def _cells(trees: DataFrame, rows: DataFrame, n_groups: int, n_blocks: int):
    """Trees and rows dealt to cells: every tree meets every row in one cell."""
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    t = trees.withColumn("g", F.pmod(F.xxhash64("tree"), F.lit(n_groups)).cast("int")).withColumn("b", upto(n_blocks))
    r = rows.withColumn("b", F.pmod(F.xxhash64("place"), F.lit(n_blocks)).cast("int")).withColumn("g", upto(n_groups))
    return t.groupBy("g", "b").cogroup(r.groupBy("g", "b"))


def hard_negatives(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", label: str = "label", vector: str = "embedding",
                   scale: int = 256, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, for the anchors among ``rows``
    (``is_anchor`` is a condition on the columns id and label)."""
    index = stage(usable_rows(rows, id_col, label, vector, scale).withColumn("place", F.monotonically_increasing_id()), "negatives-rows")
    trees = stage(plant(index.where(is_anchor).select("id", "label", "v")), "negatives-trees")
    n, n_trees = index.count(), trees.where("parent < 0").count()
    spread = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    n_groups = max(1, math.ceil(n_trees / CELL_TREES))
    n_blocks = max(1, math.ceil(n / BLOCK_ROWS), min(spread, math.ceil(n / SUB_ROWS)))
    cells = lambda t: _cells(t, index, n_groups, n_blocks)
    empty = lambda *frames: any(f.empty for f in frames)

    p_schema = "tree long, node int, pid long, score long, scored long"
    p_columns = {"tree": "int64", "node": "int32", "pid": "int64", "score": "int64", "scored": "int64"}

    def first(t: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        found = pd.DataFrame(columns=list(p_columns)) if empty(t, r) else find_positives(t, r, positives)
        return found.astype(p_columns)

    w = Window.partitionBy("tree", "node").orderBy(F.col("score").desc(), "pid")
    best = cells(trees).applyInPandas(first, p_schema).drop("scored").withColumn("r", F.row_number().over(w)).where(F.col("r") <= positives)
    chosen = best.groupBy("tree", "node").agg(F.collect_list(F.struct("pid", "score")).alias("positives"))
    chosen = stage(chosen, "negatives-positives").withColumnsRenamed({"tree": "c_tree", "node": "c_node"})
    # whole trees go on, as bounds come from parents, those without positives too
    asked = trees.join(chosen, (F.col("tree") == F.col("c_tree")) & (F.col("node") == F.col("c_node")), "left").select(
        *trees.columns, F.coalesce("positives", F.array().cast("array<struct<pid:bigint,score:bigint>>")).alias("positives"))

    n_schema = "tree long, node int, pid long, pscore long, nid long, nscore long"
    n_columns = {"tree": "int64", "node": "int32", "pid": "int64", "pscore": "int64", "nid": "int64", "nscore": "int64"}

    def second(t: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        found = pd.DataFrame(columns=list(n_columns)) if empty(t, r) else find_negatives(t, r, negatives, low, high)
        return found.astype(n_columns)

    w = Window.partitionBy("tree", "node", "pid", "pscore").orderBy(F.col("nscore").desc(), "nid")
    found = cells(asked).applyInPandas(second, n_schema).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= negatives)
    names = trees.select(F.col("tree").alias("a_tree"), F.col("node").alias("a_node"), F.col("id").alias("anchor_id"))
    return found.join(names, (F.col("tree") == F.col("a_tree")) & (F.col("node") == F.col("a_node"))).select(
        "anchor_id", F.col("pid").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("nid").alias("negative_id"),
        F.col("pscore").alias("positive_score"), F.col("nscore").alias("negative_score"))
