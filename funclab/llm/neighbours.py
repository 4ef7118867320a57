"""Approximate nearest neighbours by cosine: a forest of random-projection trees.

Trees are fitted on a bounded sample. Every row is put into one leaf of each tree; where the table
is larger than the sample, leaves are cut further by random planes through their centre, so that a
leaf holds about as many rows at every size. The leaves of all trees are in one order,
in which a branch counts as the smallest distance to a plane that was crossed on the way, and the
rows of the leaves it meets first are ranked by their exact cosine. The number of these leaves grows
with the number of leaves, so that recall does not fall with the size of the table.

Rows of one vector are indexed once, with their smallest ids, so a common vector costs one row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from funclab.plans.settle import settle_table

#: Vectors that trees are fitted on, at most.
FIT_ROWS = 60_000
LEAF = 64
TREES = 32
#: Leaves that a query ranks for each that the sample alone would have; levels below it double them.
PROBES = 600
#: Index rows of one group of leaves, about, and queries that one task ranks in it.
CELL_ROWS, CELL_QUERIES = 40_000, 20_000
_HIT = "query long, rep long, score double, members array<long>"


class Forest:
    """Random-projection trees over unit vectors. ``extra``: levels below the fitted leaves."""

    def __init__(self, trees, extra, planes):
        self.trees, self.extra, self.planes, self.levels = trees, extra, planes, None

    @classmethod
    def fit(cls, sample: np.ndarray, n_trees, leaf, extra, seed=3) -> Forest:
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        trees = []
        for _ in range(n_trees):
            normals, offsets, children, centres = [], [], [], []
            todo = [(np.arange(len(sample)), -1, 0)]
            while todo:
                rows, parent, side = todo.pop()
                if len(rows) > leaf:
                    a, b = sample[rng.choice(rows, 2, replace=False)]
                    normal = a - b if (a != b).any() else rng.standard_normal(dim)
                    normal = normal / np.linalg.norm(normal)
                    along = sample[rows] @ normal
                    offset = float(np.median(along))
                    left = along < offset
                    if left.any() and not left.all():
                        node = len(normals)
                        normals.append(normal)
                        offsets.append(offset)
                        children.append([0, 0])
                        todo += [(rows[left], node, 0), (rows[~left], node, 1)]
                        if parent >= 0:
                            children[parent][side] = node
                        continue
                centres.append(sample[rows].mean(axis=0) if len(rows) else np.zeros(dim))
                if parent >= 0:
                    children[parent][side] = -len(centres)  # a leaf k is -(k + 1)
            f = np.float32
            trees.append((np.array(normals, f).reshape(-1, dim), np.array(offsets, f), np.array(children, int).reshape(-1, 2), np.array(centres, f)))
        planes = rng.standard_normal((n_trees, extra, dim)).astype(np.float32)
        return cls(trees, extra, planes / np.maximum(np.linalg.norm(planes, axis=2, keepdims=True), 1e-12))

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of each vector in each tree."""
        out = np.empty((len(self.trees), len(vectors)), np.int64)
        for t, (normals, offsets, children, centres) in enumerate(self.trees):
            node = np.full(len(vectors), 0 if len(normals) else -1)
            while (inner := np.flatnonzero(node >= 0)).size:
                at = node[inner]
                right = np.einsum("ij,ij->i", vectors[inner], normals[at]) >= offsets[at]
                node[inner] = children[at, right.astype(int)]
            leaf = -node - 1
            out[t] = leaf
            for level in range(self.extra):
                bit = (vectors - centres[leaf]) @ self.planes[t, level] >= 0
                out[t] = out[t] * 2 + bit
        return out

    def _levels(self, t):
        """Inner nodes of a tree, by their depth."""
        children, out, now = self.trees[t][2], [], np.arange(min(1, len(self.trees[t][2])))
        while len(now):
            out.append(now)
            below = children[now].ravel()
            now = below[below > 0]
        return out

    def costs(self, vectors: np.ndarray) -> list[np.ndarray]:
        """For each tree, the smallest distance to a plane that is crossed from a query (a row) to a leaf (a column)."""
        if self.levels is None:
            self.levels = [self._levels(t) for t in range(len(self.trees))]
        out = []
        for t, (normals, offsets, children, centres) in enumerate(self.trees):
            cost = np.full((len(centres), len(vectors)), -np.inf, np.float32)
            inner, margin = np.full((len(normals), len(vectors)), -np.inf, np.float32), normals @ vectors.T - offsets[:, None]
            for nodes in self.levels[t]:
                for side in (0, 1):
                    child = children[nodes, side]
                    below = np.maximum(inner[nodes], -margin[nodes] if side else margin[nodes])
                    cost[-child[child < 0] - 1], inner[child[child > 0]] = below[child < 0], below[child > 0]
            cost = cost.T[:, :, None]
            for plane in self.planes[t]:
                margin = ((vectors @ plane)[:, None] - centres @ plane)[:, :, None]
                cost = np.stack([np.maximum(cost, margin), np.maximum(cost, -margin)], axis=3).reshape(*cost.shape[:2], -1)
            out.append(cost.reshape(len(vectors), -1))
        return out

    def search_all(self, vectors: np.ndarray, probes: int):
        """For each query, the trees and the leaves that it meets first, over all trees."""
        sizes = [len(tree[3]) << self.extra for tree in self.trees]
        starts = np.cumsum([0, *sizes])
        step = max(1, (1 << 22) // int(starts[-1]))
        for i in range(0, len(vectors), step):
            cost = np.concatenate(self.costs(vectors[i : i + step]), axis=1)
            for row in cost:
                at = np.argpartition(row, probes)[:probes] if probes < len(row) else np.arange(len(row))
                tree = np.searchsorted(starts, at, side="right") - 1
                yield tree, at - starts[tree]

    def search(self, vector: np.ndarray, probes: int) -> list[tuple[int, int]]:
        """The first (tree, leaf) pairs that a query meets, over all trees."""
        tree, leaf = next(self.search_all(vector[None], probes))
        return list(zip(tree.tolist(), leaf.tolist()))


def _unit(rows, dim):
    out = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def vectors_of(table: DataFrame) -> DataFrame:
    """vec_id and vec of the rows that take part: an id, and a vector of finite numbers that is not zero."""
    vec = F.col("embedding").cast("array<double>")
    rows = table.select(F.col("vec_id").cast("long"), vec.alias("vec")).filter("vec_id is not null and vec is not null")
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter(fine & F.exists("vec", lambda x: x != 0)).distinct()


def _index_rows(forest, dim, cells, slices):
    def run(batches):
        import pyarrow as pa

        f = forest.value
        for b in batches:
            if not b.num_rows:
                continue
            at = f.leaves(_unit(b.column("vec").to_pylist(), dim).astype(np.float32))
            for t in range(len(at)):
                cell = (at[t] * 1_000_003 + t) % cells * slices
                for k in range(slices):
                    yield pa.RecordBatch.from_arrays([pa.array(cell + k), pa.array(at[t] * 1024 + t), *b.columns], names=["cell", "leaf", *b.schema.names])

    return run


def _probe_rows(forest, dim, cells, slices, probes):
    """A row for each query and group of leaves that it asks, with all leaves of the group that it asks for."""

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.float64())]
        for b in batches:
            if not b.num_rows:
                continue
            met = forest.value.search_all(_unit(b.column(1).to_pylist(), dim).astype(np.float32), probes)
            for i, (tree, leaf) in enumerate(met):
                query = b.column(0)[i].as_py()
                cell = (leaf * 1_000_003 + tree) % cells * slices + (query * 0x9E3779B1 >> 16) % slices
                order = np.argsort(cell, kind="stable")
                at, starts = np.unique(cell[order], return_index=True)
                asked = np.split((leaf * 1024 + tree)[order], starts[1:])
                columns = [at, asked, np.full(len(at), query), [b.column(1)[i].as_py()] * len(at)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["cell", "leaves", "query", "vec"])

    return run


def _rank(dim, best):
    def run(queries, rows):
        import pandas as pd

        out = []
        held = rows.groupby("leaf").indices
        known, reps = _unit(rows["vec"].tolist(), dim) if len(rows) else None, rows["rep"].to_numpy()
        for query, leaves, vec in zip(queries["query"], queries["leaves"], queries["vec"]):
            # A group holds several leaves, of which a query may ask for any, of any tree.
            mine = [held[leaf] for leaf in leaves if leaf in held]
            if not mine:
                continue
            mine = np.concatenate(mine)
            mine = mine[np.unique(reps[mine], return_index=True)[1]]
            score = known[mine] @ _unit([vec], dim)[0]
            for i in np.lexsort((reps[mine], -score))[:best]:
                out.append((query, reps[mine[i]], score[i], rows["members"].iloc[mine[i]]))
        return pd.DataFrame(out, columns=["query", "rep", "score", "members"])

    return run


def nearest(table: DataFrame, k=5, every=50, n_trees=TREES, probes=PROBES, fit_rows=FIT_ROWS, leaf=LEAF) -> DataFrame:
    """query_id, rank, vec_id and score of the nearest rows found for ids divisible by ``every``.

    Vectors of fewer numbers than the longest are continued with zeros. Repeated rows count once; an
    id with several vectors is a candidate with each, and its queries are answered for each. A row's
    own id is no candidate. Other columns are not read.
    """
    spark = table.sparkSession
    rows = settle_table(vectors_of(table), "vectors")
    # The k + 1 smallest ids of each vector: more are never among the k nearest of a query.
    few = rows.withColumn("_n", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))).filter(F.col("_n") <= k + 1)
    classes = few.groupBy("vec").agg(F.min("vec_id").alias("rep"), F.array_sort(F.collect_list("vec_id")).alias("members"))
    classes = settle_table(classes.select("rep", "vec", "members"), "classes")
    n, dim = classes.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    sample = classes.select("vec").orderBy(F.xxhash64("vec")).limit(fit_rows).toArrow()["vec"]  # bounded by fit_rows
    extra = max(0, int(np.ceil(np.log2(n / fit_rows))))
    forest = spark.sparkContext.broadcast(Forest.fit(_unit(sample.to_pylist(), dim), n_trees, leaf, extra))
    cells = max(1, n * n_trees // CELL_ROWS)
    queries = rows.filter(F.col("vec_id") % every == 0)
    asked = settle_table(queries.groupBy("vec").agg(F.min("vec_id").alias("query")), "asked")
    slices = asked.count() // CELL_QUERIES + 1
    index = classes.mapInArrow(_index_rows(forest, dim, cells, slices), "cell long, leaf long, rep long, vec array<double>, members array<long>")
    # As many more leaves as the table has for those of the sample, so that the share that is ranked stays the same.
    probed = asked.select("query", "vec").mapInArrow(_probe_rows(forest, dim, cells, slices, probes << extra), "cell long, leaves array<long>, query long, vec array<double>")
    hits = probed.groupBy("cell").cogroup(index.groupBy("cell")).applyInPandas(_rank(dim, k + 1), _HIT)
    hits = hits.groupBy("query", "rep").agg(F.max("score").alias("score"), F.first("members").alias("members"))
    near = hits.select("query", "score", F.explode("members").alias("vec_id"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    near = near.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k + 1)
    # A query's list of k + 1 is one row, so that a vector asked for by many ids is one row to meet.
    near = near.groupBy("query").agg(F.collect_list(F.struct("_n", "vec_id", "score")).alias("near"))
    lists = near.join(asked, "query").select("vec", "near")
    each = queries.join(lists, "vec").select(F.col("vec_id").alias("query_id"), F.explode(F.array_sort("near")).alias("_hit"))
    each = each.select("query_id", "_hit.*").filter("vec_id <> query_id")
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "_n")
    out = each.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")
