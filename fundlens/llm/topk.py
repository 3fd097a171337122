"""Exact top-k by inner product with M-trees.

An inner product is no metric, so each vector x of a tree gets one more coordinate,
sqrt(M * M - |x| * |x|) with M the tree's largest norm, and a query gets 0.  Then
distance ** 2 = |q| ** 2 + M * M - 2 * (q, x): nearer means a larger product.

Every task loads its rows into trees of at most ``TREE_ROWS``.  An inner node's entries hold
a routing vector, a covering radius and the distance to the node's own routing vector; a
leaf's entries hold the vector and that distance.  A search opens nodes by their least
possible distance and passes over an entry without computing its distance when the stored
distances and the triangle inequality already rule it out.  Bounds are widened a little
against rounding and scores are whole numbers, so results are exact, ties included.
Vectors so large that a product might not fit a long stand apart from the trees; they are
compared with every other one in whole numbers of any size.
"""

from __future__ import annotations

import heapq
import math
import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import top_per_key
from ..storage import materialize
from .columns import trim

SCALE = 256
TREE_ROWS = 8192
PAGE = 128
FAN = 16
QUERY_BLOCK = 4096  # queries that are broadcast at a time
LARGEST = 1 << 26  # of a component after scaling in a tree; larger vectors stand apart
SEED_ROWS = 2048  # rows that give each search its first bound
SLACK = 1e-6
BELOW = -(1 << 63)  # stands for every score that is too small for a long


@dataclass
class Node:
    pivots: np.ndarray  # inner: routing vectors; leaf: the vectors
    to_parent: np.ndarray  # distance of each entry to this node's routing vector
    radii: np.ndarray | None = None  # inner: covering radius of each entry
    children: list[int] = field(default_factory=list)
    ids: np.ndarray | None = None  # leaf: vec_id of each entry


class Tree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        norms = np.einsum("ij,ij->i", vectors, vectors)
        self.top = float(norms.max())
        self.vectors, self.ids = vectors, ids
        self.extra = np.sqrt(np.maximum(self.top - norms, 0))
        self.pages: list[Node] = []
        self.rng = np.random.default_rng(len(ids))
        everything = np.arange(len(ids))
        self.root = self._load(everything, self._distances(everything, 0))

    def _distances(self, rows: np.ndarray, pivot: int) -> np.ndarray:
        apart = self.vectors[rows] - self.vectors[pivot]
        return np.sqrt(np.einsum("ij,ij->i", apart, apart) + (self.extra[rows] - self.extra[pivot]) ** 2)

    def _load(self, rows: np.ndarray, to_parent: np.ndarray) -> int:
        """A node for ``rows``, given their distances to the routing vector above."""
        if len(rows) <= PAGE:
            self.pages.append(Node(self.vectors[rows], to_parent, ids=self.ids[rows]))
            return len(self.pages) - 1
        chosen = rows[self.rng.permutation(len(rows))[:FAN]]
        apart = np.stack([self._distances(rows, c) for c in chosen])
        nearest = apart.argmin(0)
        groups = [(int(c), np.flatnonzero(nearest == i)) for i, c in enumerate(chosen)]
        groups = [(i, c, g) for i, (c, g) in enumerate(groups) if len(g)]
        if len(groups) == 1:  # equal vectors: cut them anyhow
            i, c, g = groups[0]
            groups = [(i, c, part) for part in np.array_split(g, min(FAN, -(-len(g) // PAGE)))]
        children = [self._load(rows[g], apart[i, g]) for i, _, g in groups]
        place = {int(r): k for k, r in enumerate(rows)}
        self.pages.append(Node(
            self.vectors[[c for _, c, _ in groups]], to_parent[[place[c] for _, c, _ in groups]],
            np.array([apart[i, g].max() for i, _, g in groups]), children,
        ))
        return len(self.pages) - 1

    def packed(self) -> bytes:
        slim = [(p.pivots.astype(np.int32), p.to_parent, p.radii, p.children, p.ids) for p in self.pages]
        return pickle.dumps((self.top, self.root, self.extra, self.vectors[0].astype(np.int32), slim), 5)


class Search:
    """A stored tree that is ready for queries."""

    def __init__(self, blob: bytes) -> None:
        self.top, self.root, _, self.first, pages = pickle.loads(blob)
        self.first = self.first.astype(np.float64)
        self.pages = [Node(v.astype(np.float64), d, r, c, i) for v, d, r, c, i in pages]
        self.widest = max((float(np.abs(p.pivots).max(initial=0)) for p in self.pages), default=0.0)
        self.computed = 0

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """vec_ids and vectors of the whole tree."""
        leaves = [p for p in self.pages if p.ids is not None]
        return np.concatenate([p.ids for p in leaves]), np.concatenate([p.pivots for p in leaves])

    def _far(self, score, base: float):
        return np.sqrt(np.maximum(base - 2.0 * score, 0.0))

    def best_of(
        self, queries: np.ndarray, own: np.ndarray, k: int, floors: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best of each query, as (place of the query, vec_id, score).

        ``floors`` has a whole score per query that k vectors are known to reach, or ``BELOW``.
        A node is visited once for all queries that it is still open to: bounds are compared
        for all of them at once, and what is left is one product of matrices.
        """
        base = np.einsum("ij,ij->i", queries, queries) + self.top
        # Rounding of a squared distance grows with the numbers it is the difference of.
        slack = SLACK * (1 + np.sqrt(base))
        floors = floors.copy()
        bound = np.where(floors == BELOW, np.inf, self._far(floors.astype(np.float64), base))
        top_score, top_id = np.full((len(queries), k), BELOW), np.full((len(queries), k), np.iinfo(np.int64).max)
        exact = float(np.abs(queries).max(initial=0)) * self.widest * max(queries.shape[1], 1) < 2**53
        everyone = np.arange(len(queries))
        queue = [(0.0, 0, self.root, everyone, self._far(queries @ self.first, base), np.zeros(len(queries)))]
        entered = 0
        while queue:
            _, _, page, at, to_pivot, least = heapq.heappop(queue)
            limit = bound[at] * (1 + SLACK) + slack[at]
            live = least <= limit
            at, to_pivot, least, limit = at[live], to_pivot[live], least[live], limit[live]
            node = self.pages[page]
            near = np.abs(to_pivot[:, None] - node.to_parent[None, :])
            if node.radii is not None:
                near -= node.radii[None, :]
            open_ = near <= limit[:, None]
            rows, entries = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
            if not len(rows):
                continue
            open_ = open_[np.ix_(rows, entries)]
            at, least = at[rows], least[rows]
            self.computed += int(open_.sum())
            if node.radii is not None:
                far = self._far(queries[at] @ node.pivots[entries].T, base[at][:, None])
                low = np.maximum(far - node.radii[entries], least[:, None])
                for j, entry in enumerate(entries):
                    mine = np.flatnonzero(open_[:, j])
                    entered += 1
                    heapq.heappush(queue, (float(low[mine, j].min()), entered, node.children[entry], at[mine], far[mine, j], low[mine, j]))
                continue
            if exact:
                scores = (queries[at] @ node.pivots[entries].T).astype(np.int64)
            else:
                scores = queries[at].astype(np.int64) @ node.pivots[entries].T.astype(np.int64)
            ids = node.ids[entries]
            row, column = np.nonzero(open_ & (scores >= floors[at][:, None]) & (ids[None, :] != own[at][:, None]))
            if not len(row):
                continue
            changed = np.unique(at[row])
            who = np.concatenate([np.repeat(changed, k), at[row]])
            score = np.concatenate([top_score[changed].ravel(), scores[row, column]])
            name = np.concatenate([top_id[changed].ravel(), ids[column]])
            order = np.lexsort((name, ~score, who))
            starts = np.searchsorted(who[order], changed)
            kept = order[(starts[:, None] + np.arange(k)).ravel()]
            top_score[changed], top_id[changed] = score[kept].reshape(-1, k), name[kept].reshape(-1, k)
            floors[changed] = np.maximum(floors[changed], top_score[changed, k - 1])
            known = changed[floors[changed] != BELOW]
            bound[known] = self._far(floors[known].astype(np.float64), base[known])
        place, rank = np.nonzero(top_score != BELOW)
        return place, top_id[place, rank], top_score[place, rank]


def is_large(vector: np.ndarray) -> bool:
    """Whether its product with a vector of its kind might not fit a long."""
    return bool(np.abs(vector).max(initial=0) > min(LARGEST, math.isqrt((1 << 62) // max(len(vector), 1))))


def whole(x: np.ndarray) -> np.ndarray:
    """Whole numbers of any size."""
    return np.frompyfunc(int, 1, 1)(x)


def best_of_all(vectors: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
    """The k best (score, vec_id) by products of whole numbers of any size.

    A score below what a long holds is given as ``BELOW``.
    """
    scored = ((int(s), int(i)) for s, i in zip(vectors @ query, ids) if i != own)
    best = heapq.nsmallest(k, scored, key=lambda x: (-x[0], x[1]))
    if best and best[0][0] >= 1 << 63:
        raise OverflowError(f"the score of query {own} and vector {best[0][1]} does not fit a long: {best[0][0]}")
    return [(max(s, BELOW), i) for s, i in best]


def scaled(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """floor(256 * x) of each usable vector, and which rows those are."""
    rows, out = [], []
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
    given = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        flat = np.floor(SCALE * given)
    at = 0
    for row, n in enumerate(lengths):
        vector = flat[at : at + n]
        if n and not np.isfinite(vector).all() and np.isfinite(given[at : at + n]).all():
            # Numbers that are infinite once scaled have no fraction.
            pairs = zip(vector.tolist(), given[at : at + n].tolist())
            vector = np.array([int(v) if math.isfinite(v) else int(x) * SCALE for v, x in pairs], object)
        at += n
        if n and (vector.dtype == object or np.isfinite(vector).all()):
            rows.append(row)
            out.append(vector)
    return np.array(rows, np.int64), out


def build(vectors: DataFrame) -> DataFrame:
    """M-trees over ``vectors`` (vec_id, embedding), one row (dims, large, n, tree) each.

    ``large`` rows hold vectors that stand apart, as (vec_ids, vectors).
    """

    def run(batches):
        for batch in batches:
            ids = np.asarray(batch.column(0).cast(pa.int64()))
            rows, found = scaled(batch.column(1))
            by_size: dict[tuple[int, bool], list[int]] = {}
            for i, v in enumerate(found):
                by_size.setdefault((len(v), is_large(v)), []).append(i)
            for (dims, large), members in by_size.items():
                for lo in range(0, len(members), TREE_ROWS):
                    part = members[lo : lo + TREE_ROWS]
                    of, held = ids[rows[part]], np.stack([found[i] for i in part])
                    tree = pickle.dumps((of, held), 5) if large else Tree(of, held.astype(np.float64)).packed()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([dims], pa.int32()), pa.array([large]), pa.array([len(part)], pa.int64()), pa.array([tree], pa.binary())],
                        names=["dims", "large", "n", "tree"],
                    )

    usable = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("bigint"), "embedding")
    return usable.mapInArrow(run, "dims int, large boolean, n bigint, tree binary")


def top_k(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k largest integer inner products.

    ``vectors`` has vec_id and embedding; ``is_query`` is a condition on it.  Candidates are
    all rows of the query's length but those with its vec_id; ties go to the smaller vec_id.
    Rows that are null, empty or hold a null or non-finite component take no part, nor does a
    null vec_id.  Products are exact at any size; a score in the result that does not fit a
    long is an error.  A repeated row is a candidate each time; of repeated query ids the
    least vector is searched.  Fewer than k candidates give fewer rows, an empty table none.
    Other columns are not looked at.

    Trees are written once.  Queries are collected and broadcast ``QUERY_BLOCK`` at a time,
    and every tree answers each block; only k rows per query and tree are shuffled.
    """
    spark = vectors.sparkSession
    trees = materialize(build(vectors), "trees")
    chosen = (
        vectors.where(is_query).where("vec_id is not null and embedding is not null")
        .groupBy(F.col("vec_id").cast("bigint").alias("query_id")).agg(F.min("embedding").alias("embedding"))
    )
    queries = materialize(chosen, "queries")
    n = max(1, -(-queries.count() // QUERY_BLOCK))
    found = None
    seed = [pickle.loads(r.tree) for r in trees.where("not large").orderBy("n", F.xxhash64("tree")).limit(1).collect()]
    for block in range(n):
        part = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == block).toArrow()
        rows, usable = scaled(part.column(1).combine_chunks() if part.num_rows else pa.array([], pa.list_(pa.float32())))
        ids = np.asarray(part.column(0))[rows] if part.num_rows else np.array([], np.int64)
        floors = _first_bounds(ids, usable, seed, k)
        shared = spark.sparkContext.broadcast((ids, usable, floors))
        answers = trees.mapInArrow(_answers(shared, k), "query_id bigint, vec_id bigint, score bigint")
        found = answers if found is None else found.unionByName(answers)
    order = [F.desc("score"), F.asc("vec_id")]
    ranked = top_per_key(found, "query_id", order, k, name="rank")
    small = F.raise_error(F.concat(F.lit("a score does not fit a long, of query "), F.col("query_id").cast("string")))
    score = F.when(F.col("score") == F.lit(BELOW), small).otherwise(F.col("score"))
    return ranked.select("query_id", "rank", "vec_id", score.alias("score"))


def _first_bounds(ids: np.ndarray, vectors: list[np.ndarray], seed: list, k: int) -> np.ndarray:
    """The k-th best score of each query among a few rows, in whole numbers: no result can be worse."""
    floors = np.full(len(ids), BELOW)
    for _, _, _, _, pages in seed:
        leaves = [(v, i) for v, _, _, _, i in pages if i is not None]
        rows = np.concatenate([v for v, _ in leaves])[:SEED_ROWS].astype(np.int64)
        names = np.concatenate([i for _, i in leaves])[:SEED_ROWS]
        mine = np.array([i for i, v in enumerate(vectors) if len(v) == rows.shape[1] and not is_large(v)], np.int64)
        for part in np.array_split(mine, -(-len(mine) // 256) or 1):
            if len(part) and len(rows) > k:
                queries = np.stack([vectors[i] for i in part]).astype(np.float64)
                fits = float(np.abs(queries).max()) * float(np.abs(rows).max(initial=0)) * rows.shape[1] < 2**53
                scores = (queries @ rows.T.astype(np.float64)).astype(np.int64) if fits else queries.astype(np.int64) @ rows.T
                scores[names[None, :] == ids[part][:, None]] = BELOW
                floors[part] = np.partition(scores, len(rows) - k, axis=1)[:, len(rows) - k]
    return floors


def _answers(shared, k: int):
    def run(batches):
        ids, vectors, floors = shared.value
        large_queries = [i for i, v in enumerate(vectors) if is_large(v)]
        small: dict[int, list[int]] = {}
        for i, v in enumerate(vectors):
            if not is_large(v):
                small.setdefault(len(v), []).append(i)
        for batch in batches:
            for dims, large, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)):
                tree = None if large else Search(blob.as_py())
                one_by_one = [i for i in large_queries if len(vectors[i]) == dims]
                if large:
                    one_by_one += small.get(dims, [])
                elif dims in small:
                    at = np.array(small[dims])
                    place, found, score = tree.best_of(np.stack([vectors[i] for i in at]), ids[at], k, floors[at])
                    yield _found(ids[at][place], found, score)
                if one_by_one:
                    of, held = pickle.loads(blob.as_py()) if large else tree.rows()
                    held = whole(held)
                    rows = [(int(ids[i]), vec, score) for i in one_by_one for score, vec in best_of_all(held, of, whole(vectors[i]), int(ids[i]), k)]
                    if rows:
                        yield _found(*zip(*rows))
        batch = blob = tree = held = rows = None
        trim()

    return run


def _found(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])
