"""Embedding near-duplicates: exact threshold pairs by dual traversal of cover trees.

Equal vectors of a label are one point with a multiplicity. Points are dealt to cells around pivots; a point also visits
every cell that may hold a partner by the cell's covering radius. For two cells at a time a task builds a cover tree of
each (nested levels, radii halving) and walks both at once: a pair of nodes is dropped when their balls are too far
apart for the threshold, counted whole when no pair in it can miss the threshold, and split otherwise. Links are counted
for each point and united within the task, so that a dense group is never written out pair by pair.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, rows, small_batches, written

THRESHOLD = 0.93
#: Points of a cell, about; pivots of a label at most (denser cells are dealt on by a hash); leaves of a tree.
CELL, PIVOTS, LEAF = 1500, 256, 48
#: Nodes of so few points are kept together in one leaf.
FEW = 3
#: Points drawn for each pivot, about.
SAMPLE = 8
#: Room for rounding: distances come from products of unit vectors and are off by up to 2e-8 where they are small. Bounds
#: within it of the threshold decide nothing; the pairs are then computed one by one.
SLACK = 1e-6
#: Bytes of vectors that may be broadcast.
SMALL = 13_000_000


def distance(cosine: float) -> float:
    """Of unit vectors with that cosine."""
    return math.sqrt(max(0.0, 2 - 2 * cosine))


class CoverTree:
    """Nodes (centre, covering radius, points) in nested levels: a node of radius r has children of radius r/2 at most,
    whose centres lie more than r/2 apart; a node of few points, or of equal ones, is a leaf. Points of a node that have
    next to no company within r/2 stay on its level, together in one leaf, which the node's own radius covers."""

    __slots__ = ("centre", "children", "points", "radius")

    def __init__(self, x: np.ndarray, points: np.ndarray, centre: int, radius: float):
        self.centre, self.points, self.children = centre, points, []
        apart = np.sqrt(np.maximum(0, 2 - 2 * (x[points] @ x[centre])))
        self.radius = float(apart.max())
        if len(points) <= LEAF or self.radius < 1e-6:
            return
        half = min(radius, self.radius) / 2
        rest, near, own, loose = points, apart, centre, []
        while len(rest):
            inside = near <= half
            inside[rest == own] = True
            if inside.sum() > FEW:
                self.children.append(CoverTree(x, rest[inside], own, half))
            else:
                loose.append(rest[inside])
            rest = rest[~inside]
            if len(rest):
                own = int(rest[0])
                near = np.sqrt(np.maximum(0, 2 - 2 * (x[rest] @ x[own])))
        if loose and not self.children:
            return  # nothing to divide: a leaf
        if loose:
            self.children.append(CoverTree.leaf(x, np.concatenate(loose), centre))

    @classmethod
    def leaf(cls, x: np.ndarray, points: np.ndarray, centre: int) -> CoverTree:
        """Points that are far from each other: nodes for each would only cost time."""
        node = cls.__new__(cls)
        node.centre, node.points, node.children = centre, points, []
        node.radius = float(np.sqrt(np.maximum(0, 2 - 2 * (x[points] @ x[centre]))).max())
        return node


class Links:
    """Counts of links and components of the points of one task."""

    def __init__(self, x: np.ndarray, weight: np.ndarray, cosine: float):
        self.x, self.weight, self.cosine, self.limit = x, weight, cosine, distance(cosine)
        self.n, self.parent = np.zeros(len(x), np.int64), np.arange(len(x))

    def root(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return int(i)

    def unite(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def leaves(self, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        linked = self.x[a] @ self.x[b].T >= self.cosine
        if same:
            np.fill_diagonal(linked, False)
        if not linked.any():
            return
        self.n[a] += linked @ self.weight[b]
        if not same:
            self.n[b] += self.weight[a] @ linked
        # each row's first partner, and rows that share a partner: enough to join what is linked
        for i, row in zip(a, linked, strict=True):
            if row.any():
                partners = b[row]
                roots = np.unique(self.parent[partners])
                for r in roots:
                    self.unite(int(i), int(r))

    def whole(self, a: CoverTree, b: CoverTree) -> None:
        """Every point of a is linked with every point of b."""
        p, q = a.points, b.points
        self.n[p] += self.weight[q].sum() - (self.weight[p] if a is b else 0)
        if a is not b:
            self.n[q] += self.weight[p].sum()
        first = self.root(int(p[0]))
        for r in np.unique(self.parent[np.concatenate([p, q])]):
            self.unite(first, int(r))

    def walk(self, a: CoverTree, b: CoverTree) -> None:
        """All links between points of a and of b; within a where they are one."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            apart = 0.0 if a is b else float(np.sqrt(max(0.0, 2 - 2 * float(self.x[a.centre] @ self.x[b.centre]))))
            if apart - a.radius - b.radius > self.limit + SLACK:
                continue
            if (2 * a.radius if a is b else apart + a.radius + b.radius) < self.limit - SLACK:
                self.whole(a, b)
            elif not a.children and not b.children:
                self.leaves(a.points, b.points, a is b)
            elif a is b:
                todo += [(c, d) for i, c in enumerate(a.children) for d in a.children[i:]]
            elif not b.children or a.children and a.radius >= b.radius:
                todo += [(c, b) for c in a.children]
            else:
                todo += [(a, c) for c in b.children]


def _tree(x: np.ndarray, points: np.ndarray) -> CoverTree:
    return CoverTree(x, points, int(points[0]), 2.0)


def _unit(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, float) for v in vectors], float)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(df: DataFrame) -> DataFrame:
    """Rows that can be linked: a label, and a vector that is not null, empty or zero and has finite components only."""
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    return df.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)


def points(df: DataFrame) -> DataFrame:
    """(label, embedding) of usable rows once each: id, the smallest vec_id, and weight, how many rows there are."""
    return usable(df).groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"))


def _pivots(pts: DataFrame) -> dict:
    """Of each label: unit pivots chosen from a sample, farthest first, one for about CELL points."""
    counts = {r["label"]: r["count"] for r in pts.groupBy("label").count().collect()}
    large = {k: n for k, n in counts.items() if n > CELL}
    out = dict.fromkeys(counts)
    if large:
        share = F.create_map(*[F.lit(v) for k, n in large.items() for v in (k, min(1.0, SAMPLE * max(8, min(PIVOTS, -(-n // CELL))) / n))])
        drawn = pts.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.coalesce(share[F.col("label")], F.lit(0.0)) * 1_000_000).select("label", "id", "embedding").toPandas()
        for label, rows in drawn.groupby("label"):
            x = _unit(rows.sort_values("id")["embedding"])
            chosen, near = [0], 2 - 2 * (x @ x[0])
            for _ in range(min(PIVOTS, -(-large[label] // CELL), len(x)) - 1):
                chosen.append(int(near.argmax()))
                near = np.minimum(near, 2 - 2 * (x @ x[chosen[-1]]))
            out[label] = x[chosen]
    return out


def near_vectors(df: DataFrame, cosine: float = THRESHOLD) -> DataFrame:
    """One row per row of df (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Only rows with equal labels, of any type, are compared. Rows that lack a vec_id, label or usable vector link with nothing. Rows
    with equal vectors link with each other and count one by one; rows that repeat a vec_id count as vectors of their
    own. Vectors of different length in one label raise an error. An empty table gives an empty result; extra columns
    are not read.
    """
    spark = df.sparkSession
    small_batches(spark, 2000)
    df = df.select("vec_id", "embedding", "label")
    label_type = df.schema["label"].dataType.simpleString()
    pts = written(points(df), "near-points")
    pivots = spark.sparkContext.broadcast(_pivots(pts))  # PIVOTS vectors for each label with more than CELL points
    limit = distance(cosine) + SLACK

    def home(batches):
        for x in batches:
            cell, apart = np.zeros(len(x), np.int64), np.zeros(len(x))
            for label, rows in x.groupby("label").indices.items():
                centres = pivots.value.get(label)
                if centres is not None:
                    d = np.sqrt(np.maximum(0, 2 - 2 * (_unit(x["embedding"].iloc[rows]) @ centres.T)))
                    cell[rows], apart[rows] = d.argmin(1), d.min(1)
                else:
                    apart[rows] = 2
            yield pd.DataFrame({"label": x["label"], "id": x["id"], "cell": cell, "apart": apart})

    homes = pts.select("label", "embedding", "id").mapInPandas(home, f"label {label_type}, id long, cell long, apart double")
    cells = homes.groupBy("label", "cell").agg(F.max("apart").alias("radius"), F.count("*").alias("n")).collect()  # bounded like the pivots
    known: dict = {}
    for r in cells:
        known.setdefault(r["label"], {})[r["cell"]] = (r["radius"], max(1, -(-r["n"] // (2 * CELL))))
    known = spark.sparkContext.broadcast(known)

    def deal(batches):
        """Each point for every pair of units (cell, part) in which it may find a partner."""
        for x in batches:
            found = []
            for label, rows in x.groupby("label").indices.items():
                centres, of = pivots.value.get(label), known.value[label]
                own = x.iloc[rows]
                unit = _unit(own["embedding"])
                d = np.sqrt(np.maximum(0, 2 - 2 * (unit @ centres.T))) if centres is not None else np.full((len(rows), 1), 2.0)
                at = d.argmin(1)
                spread = (own["id"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                cells = np.array(sorted(of), np.int64)
                radius, parts = np.array([of[c][0] for c in cells]), np.array([of[c][1] for c in cells], np.int64)
                i, j = np.nonzero(d[:, cells] <= radius + limit)
                count = parts[j]
                part = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                i, c = np.repeat(i, count), np.repeat(cells[j], count)
                own_cell, own_part = at[i], (spread % parts[np.searchsorted(cells, at)].astype(np.uint64)).astype(np.int64)[i]
                first = (own_cell < c) | ((own_cell == c) & (own_part <= part))
                pick = lambda mine, other, first=first: (np.where(first, mine, other), np.where(first, other, mine))
                (a, b), (pa, pb) = pick(own_cell, c), pick(own_part, part)
                found.append(x.iloc[rows[i]].assign(a=a, pa=pa, b=b, pb=pb, first=first))
            if found:
                yield pd.concat(found)[["label", "a", "pa", "b", "pb", "first", "id", "weight", "embedding"]]

    dealt = pts.mapInPandas(deal, f"label {label_type}, a long, pa long, b long, pb long, first boolean, id long, weight long, embedding {df.schema['embedding'].dataType.simpleString()}")

    def pair(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        _, a, pa, b, pb = key
        x = x.sort_values("id", ignore_index=True)
        links = Links(_unit(x["embedding"]), x["weight"].to_numpy(), cosine)
        if (a, pa) == (b, pb):
            tree = _tree(links.x, np.arange(len(x)))
            links.walk(tree, tree)
        else:
            first = x["first"].to_numpy()
            if first.all() or not first.any():
                return x.iloc[:0][["id"]].assign(n=0, root=0)
            links.walk(_tree(links.x, np.flatnonzero(first)), _tree(links.x, np.flatnonzero(~first)))
        ids, some = x["id"].to_numpy(), links.n > 0
        roots = np.array([links.root(i) for i in range(len(x))], np.int64)
        return pd.DataFrame({"id": ids[some], "n": links.n[some], "root": ids[roots[some]]})

    found = written(dealt.groupBy("label", "a", "pa", "b", "pb").applyInPandas(pair, "id long, n long, root long"), "near-links")
    component = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    classes = pts.select("label", "embedding", "id", "weight").join(counts, "id", "left").join(component.withColumnRenamed("node", "id"), "id", "left")
    classes = written(classes.select("label", "embedding", "id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")), "near-classes")
    longest = classes.agg(F.max(F.size("embedding"))).first()[0] or 0
    # equal vectors are a class by themselves, so that the longest join is by the vectors; they are broadcast by their bytes
    out = df.join(F.broadcast(classes) if rows(classes) * (8 * longest + 64) <= SMALL else classes, ["label", "embedding"], "left")
    none = F.col("id").isNull() | F.col("vec_id").isNull()
    component_id = F.when(none, F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.when(none, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"), component_id.alias("component_id"), (F.col("vec_id") == component_id).alias("kept"))
