"""Exact top-k search by integer inner product: best-first search in M-trees.

Inner products become distances: every vector v gets one more coordinate,
sqrt(M^2 - |v|^2) with M the largest norm of its tree, and a query gets 0, so
|q - v|^2 = |q|^2 + M^2 - 2 q.v. The vectors are dealt into parts by their nearest pivot,
popular ones over several parts; each part is bulk-loaded into an M-tree of paged nodes
that store covering radii and distances to their parents. A query's best scores in a
small sample are a floor that its answer cannot fall below; it goes only to parts whose
pivot and radius allow a score of that, and walks their nodes in the order of their least
possible distance; what |d(q, parent) - d(parent, child)| already rules out is never
computed. Queries and parts meet in blocks of bounded size, and only k results a query
and part go on.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorequery.llm.common import durable

#: Entries of a leaf page, routing entries of an inner one.
PAGE, FANOUT = 512, 16
#: Least and most vectors of a tree (between them a 64th of all), most bytes of one, most queries in a block.
LEAST_TREE, MOST_TREE, MOST_BYTES, BLOCK = 8_192, 131_072, 128 << 20, 65_536
#: Vectors of the sample that floors and pivots come from, its bytes, and pivots, at most.
SAMPLE, SAMPLE_BYTES, PIVOTS = 1_024, 8 << 20, 256


class MTree:
    """An M-tree over integer vectors, for largest inner products with ties to smaller ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors.astype(np.float64)
        squares = (self.vectors**2).sum(axis=1)
        self.top = float(squares.max()) if len(ids) else 0.0
        self.points = np.hstack([self.vectors, np.sqrt(np.maximum(self.top - squares, 0))[:, None]])
        #: rounding of distances is far below this; a bound must fail by more to rule anything out
        self.slack = 1e-6 * (1 + np.sqrt(self.top))
        self.computed = 0
        self.root = self._node(np.arange(len(ids)), 0) if len(ids) else None

    def _distances(self, rows: np.ndarray, to: int) -> np.ndarray:
        return np.sqrt(((self.points[rows] - self.points[to]) ** 2).sum(axis=1))

    def _node(self, rows: np.ndarray, pivot: int) -> dict:
        """A page over rows with its routing object, a row; children know their distances to it."""
        away = self._distances(rows, pivot)
        node = {"pivot": pivot, "radius": float(away.max())}
        if len(rows) <= PAGE:
            return node | {"rows": rows, "away": away}
        fan = min(FANOUT, -(-len(rows) // PAGE))
        picks = [int(rows[away.argmax()])]
        nearest = self._distances(rows, picks[0])
        for _ in range(fan - 1):  # the row farthest from all picks
            far = int(nearest.argmax())
            if nearest[far] == 0:
                break
            picks.append(int(rows[far]))
            nearest = np.minimum(nearest, self._distances(rows, picks[-1]))
        cell = np.argmin(np.stack([self._distances(rows, p) for p in picks]), axis=0)
        parts = [(p, rows[cell == i]) for i, p in enumerate(picks)]
        if len(picks) == 1 or max(len(r) for _, r in parts) > 0.9 * len(rows):  # equal or nearly equal rows: cut evenly
            order = rows[np.argsort(away, kind="stable")]
            parts = [(int(r[0]), r) for r in np.array_split(order, fan)]
        children = [self._node(r, p) for p, r in parts if len(r)]
        pivots = np.array([c["pivot"] for c in children])
        return node | {
            "children": children,
            "pivots": pivots,
            "away": self._distances(pivots, pivot),
            "radii": np.array([c["radius"] for c in children]),
        }

    def search(self, query: np.ndarray, k: int, own: int | None = None, floor: float = -np.inf) -> list[tuple[int, int]]:
        """The k (score, id) of largest score, ties to smaller ids, without rows whose id is own; scores below floor may be left out."""
        if self.root is None or k < 1:
            return []
        q = query.astype(np.float64)
        shift = float((q**2).sum()) + self.top
        point = np.append(q, 0.0)
        best: list[tuple[float, int]] = []  # (score, -id), least first
        reach = np.inf if floor == -np.inf else float(np.sqrt(max(0.0, shift - 2 * floor)))  # distance of the k-th best so far, or of the floor

        def distances(rows):
            self.computed += len(rows)
            return np.sqrt(((self.points[rows] - point) ** 2).sum(axis=1))

        start = float(distances(np.array([self.root["pivot"]]))[0])
        queue = [(max(0.0, start - self.root["radius"]), 0, start, self.root)]
        number = 1
        while queue:
            bound, _, to_pivot, node = heapq.heappop(queue)
            if bound > reach + self.slack:
                break
            if "rows" in node:
                rows = node["rows"][np.abs(to_pivot - node["away"]) <= reach + self.slack]
                self.computed += len(rows)
                scores = self.vectors[rows] @ q
                if len(best) == k:
                    fit = scores >= best[0][0]
                    rows, scores = rows[fit], scores[fit]
                ids = self.ids[rows]
                if own is not None:
                    other = ids != own
                    ids, scores = ids[other], scores[other]
                if len(ids) > k:
                    # at least k by score, with all that tie with the k-th
                    level = np.partition(scores, len(scores) - k)[len(scores) - k]
                    ids, scores = ids[scores >= level], scores[scores >= level]
                    order = np.lexsort((ids, -scores))[:k]
                    ids, scores = ids[order], scores[order]
                for score, i in zip(scores.tolist(), ids.tolist()):
                    if len(best) < k:
                        heapq.heappush(best, (score, -i))
                    elif (score, -i) > best[0]:
                        heapq.heapreplace(best, (score, -i))
                if len(best) == k and best[0][0] > floor:
                    reach = float(np.sqrt(max(0.0, shift - 2 * best[0][0])))
                continue
            near = np.nonzero(np.abs(to_pivot - node["away"]) - node["radii"] <= reach + self.slack)[0]
            for i, d in zip(near.tolist(), distances(node["pivots"][near]).tolist()):
                bound = max(0.0, d - node["radii"][i])
                if bound <= reach + self.slack:
                    heapq.heappush(queue, (bound, number, d, node["children"][i]))
                    number += 1
        return [(int(s), -i) for s, i in sorted(best, reverse=True)]


def integers(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * component) as integers, for vectors without null or non-finite components."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return vectors.filter(F.col(id_col).isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True))).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))


def top_k(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k vectors of largest integer inner product.

    queries: a condition that picks the query rows of vectors; the candidates are all
    rows but those with the query's id. Ties go to smaller ids. Vectors null or with
    null or non-finite components and rows without id take no part; shorter vectors
    count as filled up with zeros; rows with equal id and vector count once each.
    Integer scores are exact below 2**53. Empty input gives no rows.
    """
    whole = integers(vectors, id_col, vector_col, scale)
    asked = integers(vectors.filter(queries), id_col, vector_col, scale).dropDuplicates(["id", "v"])
    total, width = whole.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    n_asked = asked.count()
    salt = F.xxhash64("id", "v")
    bytes_each = 8 * (2 * width + 4)
    most = max(1, min(MOST_TREE, max(LEAST_TREE, total // 64), MOST_BYTES // bytes_each))

    def grid(rows):
        out = np.zeros((len(rows), width), dtype=np.int64)
        for i, v in enumerate(rows):
            out[i, : len(v)] = v
        return out

    few = whole.orderBy(salt, "id").limit(max(1, min(SAMPLE, SAMPLE_BYTES // max(1, 8 * width)))).collect()  # some megabytes
    sample, sample_ids = grid([r["v"] for r in few]).astype(np.float64), np.array([r["id"] for r in few], dtype=np.int64)
    centres = sample[_far_apart(sample, min(PIVOTS, -(-total // most)))] if few else sample

    def nearest(batches):
        for batch in batches:
            rows = grid(batch["v"]).astype(np.float64)
            away = np.stack([((rows - c) ** 2).sum(axis=1) for c in centres])
            cell = away.argmin(axis=0)
            yield batch.assign(cell=cell.astype(np.int32), away=np.sqrt(away.min(axis=0)))

    dealt = durable(whole.mapInPandas(nearest, "id long, v array<long>, cell int, away double"))
    cells = {r["cell"]: (r["n"], r["radius"]) for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()}  # PIVOTS rows at most
    parts = np.array([-(-cells[c][0] // most) if c in cells else 0 for c in range(len(centres))], dtype=np.int64)
    radius = np.array([cells[c][1] if c in cells else 0.0 for c in range(len(centres))])

    def aim(batches):
        """Each query with its floor, once for each part that may hold a score of that."""
        for batch in batches:
            out = []
            for number, v, q in zip(batch["id"].tolist(), batch["v"], grid(batch["v"]).astype(np.float64)):
                scores = np.sort((sample @ q)[sample_ids != number])[::-1]
                floor = float(scores[k - 1]) if len(scores) >= k else -np.inf
                norm = float(np.sqrt((q**2).sum()))
                allowed = centres @ q + norm * radius
                for c in np.nonzero((parts > 0) & (allowed * (1 + 1e-9) + 1e-6 * (1 + norm) >= floor - 1e-9 * abs(floor)))[0].tolist():
                    out += [(number, v, floor, c, p) for p in range(int(parts[c]))]
            yield pd.DataFrame(out, columns=["id", "v", "floor", "cell", "part"]).astype({"id": "int64", "floor": "float64", "cell": "int32", "part": "int32"})

    blocks = max(1, -(-n_asked // BLOCK))
    spread = F.create_map(*[F.lit(x) for c in range(len(centres)) for x in (c, int(max(1, parts[c])))]) if len(centres) else F.create_map(F.lit(0), F.lit(1))
    right = dealt.withColumn("part", F.pmod(salt, F.try_element_at(spread, F.col("cell"))).cast("int"))
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    left = asked.mapInPandas(aim, "id long, v array<long>, floor double, cell int, part int").withColumn("block", F.pmod(salt, F.lit(blocks)).cast("int"))

    def search(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(held):
            tree = MTree(held["id"].to_numpy(), grid(held["v"]))
            for number, floor, query in zip(asked["id"].tolist(), asked["floor"].tolist(), grid(asked["v"])):
                out += [(number, i, s) for s, i in tree.search(query, k, number, floor)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    keys = ["cell", "part", "block"]
    found = left.groupBy(*keys).cogroup(right.select("id", "v", *keys).groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score long")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return found.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _far_apart(rows: np.ndarray, n: int) -> list[int]:
    """Up to n of the rows, each the farthest from those before it."""
    picks, nearest = [0], ((rows - rows[0]) ** 2).sum(axis=1)
    while len(picks) < n and nearest.max() > 0:
        picks.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((rows - rows[picks[-1]]) ** 2).sum(axis=1))
    return picks
