"""Exact top-k search by best-first traversal of a distributed M-tree.

The tree's upper level is one table of regions: pivots are a bounded sample of the vectors (REGIONS at most, by hash), every
vector lies in the region of its nearest pivot, and a region's covering radius is the largest distance found there. Below
each region hang trees of TREE_ROWS vectors at most: vectors are paged into leaves of PAGE_ROWS under routing objects, and
those under routing objects of a higher level; a node stores its covering radius, and every entry its distance to the
parent's routing object.

A query goes to a tree of its nearest region first, which gives it k + 1 scores and so a limit. It then goes only to the
trees of those regions whose pivot distance less covering radius is within that limit. In a tree, a block of queries visits
nodes in order of the least bound (best first); queries drop out of a node whose bound is worse than their k-th best, and
distances to entries and child nodes that the stored parent distance rules out by the triangle inequality are not computed.

Largest inner product is nearest neighbour after adding one coordinate that gives all stored vectors the same norm, so
the Euclidean metric and its triangle inequality hold. Scores are integers: each component x becomes floor(256 x), and
products are summed exactly: in floats while every sum is below 2**46, else in 64-bit or longer integers. Bounds are floats
over vectors scaled to the largest component, with a slack that only makes the search visit more.

Equal vectors are one class. A class keeps its k + 1 smallest ids, as no more of them can be among a query's k best; equal
query vectors are searched once. So a vector that a third of all rows share is one stored vector with k + 1 ids.

Vectors that are null or hold a null or non-finite component take no part, nor do rows with null id. A score that no 64-bit
integer holds is null in the result, while its rank is exact. Vectors of different length are padded with zeros; very long
ones only cost memory for a tree. A repeated row (equal id and vector) counts once; rows with one id and different vectors
are rows of their own, each a query and a candidate for the other. Ties go to the smaller id. An empty table gives an empty
result. Only the id and the vector column are read, so further columns of any name do no harm.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dupstrata.llm.common import cut

TREE_ROWS, PAGE_ROWS, FANOUT = 16_384, 64, 16
REGIONS, QUERY_ROWS, BLOCK = 4096, 4096, 512
SCALE, LARGEST, WHOLE = 256, 1 << 63, 2.0**45
SALTS = 8


@dataclass(frozen=True)
class Space:
    """The metric: components scaled by `peak`, and norms filled up to `top`."""

    peak: float
    top: float
    width: int

    def flat(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.where(np.abs(x) < WHOLE, np.floor(x * SCALE) / SCALE, x) / self.peak

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Stored vectors in the metric space."""
        f = self.flat(x)
        return np.hstack([f, np.sqrt(np.maximum(0.0, self.top - (f * f).sum(1)))[:, None]])

    def asked(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([self.flat(x), np.zeros((len(x), 1))])

    def slack(self, q: np.ndarray) -> np.ndarray:
        return max(1e-6, 8 * math.sqrt(self.width * np.finfo(float).eps)) * (1 + np.sqrt((q * q).sum(1) + self.top))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T))


def exact(x: np.ndarray) -> np.ndarray:
    """floor(256 x) as 64-bit integers, or as Python's where they are larger."""
    if not x.size or np.abs(x).max() < WHOLE:
        return np.floor(x * SCALE).astype(np.int64)
    out = np.empty(x.shape, object)
    out.flat = [math.floor(v * SCALE) if abs(v) < 2.0**900 else int(v) * SCALE for v in x.ravel().tolist()]
    return out


def peak(rows: np.ndarray) -> int:
    """The largest magnitude."""
    return max(int(rows.max()), -int(rows.min())) if rows.size else 0


class MTree:
    """Nodes as flat lists; leaves hold slices of rows that were put in their order."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, space: Space):
        self.space = space
        self._lifted = space.lifted(x)
        self.order = np.arange(len(x))
        self.children: list[list[int]] = []  # empty for leaves
        self.centre: list[np.ndarray] = []
        self.radius: list[float] = []
        self.to_parent: list[float] = []
        self.span: list[tuple[int, int]] = []
        self.root = self._build(0, len(x), None)
        self.ids, self.rows = ids[self.order], exact(x)[self.order]
        self.peak = peak(self.rows)
        self.floats = self.rows.astype(np.float64) if self.peak < 1 << 46 else None
        lifted = self._lifted[self.order]
        self.entry = np.zeros(len(x))  # distance of each row to its leaf's routing object
        for node, (a, b) in enumerate(self.span):
            if not self.children[node] and b > a:
                self.entry[a:b] = np.sqrt(((lifted[a:b] - self.centre[node]) ** 2).sum(1))
        self.bits = max(1, len(x).bit_length())
        place = np.empty(len(x), np.int64)
        place[np.argsort(self.ids, kind="stable")] = np.arange(len(x))
        self.places = ((1 << self.bits) - 1) - place  # larger for smaller ids
        self.row_at = np.argsort(place)
        self.computed = 0  # products of a query and a row
        del self._lifted

    def _build(self, a: int, b: int, parent: np.ndarray | None) -> int:
        at = self._lifted[self.order[a:b]]
        mean = at.mean(0) if b > a else np.zeros(self._lifted.shape[1])
        routing = at[((at - mean) ** 2).sum(1).argmin()] if b > a else mean
        me = len(self.span)
        self.span.append((a, b)), self.children.append([]), self.centre.append(routing)
        away = np.sqrt(((at - routing) ** 2).sum(1))
        self.radius.append(float(away.max()) if b > a else 0.0)
        self.to_parent.append(float(np.sqrt(((routing - parent) ** 2).sum())) if parent is not None else 0.0)
        if b - a > PAGE_ROWS:
            want = min(FANOUT, -(-(b - a) // PAGE_ROWS))
            chosen = [0]
            far = ((at - at[0]) ** 2).sum(1)
            while len(chosen) < want and far.max() > 0:
                chosen.append(int(far.argmax()))
                far = np.minimum(far, ((at - at[chosen[-1]]) ** 2).sum(1))
            home = distances(at, at[chosen]).argmin(1)
            if np.bincount(home).max() > 0.9 * (b - a):  # else a few far rows at a time would make a deep tree
                home = np.empty(b - a, np.int64)
                home[np.argsort(away, kind="stable")] = np.arange(b - a) * want // (b - a)
            by = np.argsort(home, kind="stable")
            self.order[a:b] = self.order[a:b][by]
            at_ends = np.concatenate([[0], np.cumsum(np.bincount(home, minlength=want))])
            self.children[me] = [self._build(a + int(x), a + int(y), routing) for x, y in zip(at_ends[:-1], at_ends[1:], strict=True) if y > x]
        return me

    def search(self, x: np.ndarray, k: int, limits: np.ndarray) -> list[list[tuple[int, int]]]:
        """For each query vector the k best (row, score): highest score first, ties to the smaller id; none beyond its limit."""
        if not len(self.rows) or not len(x):
            return [[] for _ in x]
        q, whole = self.space.asked(x), exact(x)
        qq, slack = (q * q).sum(1), self.space.slack(q)
        most = self.space.width * self.peak * peak(whole)  # no sum of products is larger
        quick = most < 1 << 62 - self.bits and most < 1 << 53 and self.floats is not None and whole.dtype != object
        asked = whole.astype(np.float64) if quick else whole if most < LARGEST else whole.astype(object)
        none = -(1 << 62) if quick else -(1 << 8 * key_bytes(self.space.peak, self.space.width) + self.bits)
        best = np.full((len(x), k), none, np.int64 if quick else object)
        limit = limits + slack
        unit = (self.space.peak * SCALE) if self.space.peak < 1e300 else None

        def tighten(at: np.ndarray) -> None:
            """Limits from the k-th scores of these queries."""
            kth = best[at, 0]
            full = np.flatnonzero(kth != none)
            if len(full):
                s = np.array([int(v) >> self.bits for v in kth[full].tolist()], object) if not quick else kth[full] >> self.bits
                share = s.astype(np.float64) / unit / unit if quick else np.array([scaled(v, self.space.peak) for v in s])
                to = at[full]
                limit[to] = np.minimum(limit[to], np.sqrt(np.maximum(0.0, qq[to] + self.space.top - 2 * share)) + slack[to])

        everyone = np.arange(len(x))
        reach = distances(q, self.centre[self.root][None, :])[:, 0]
        bound = np.maximum(0.0, reach - self.radius[self.root])
        queue = [(float(bound.min()), self.root, everyone, bound, reach)]
        while queue:
            least, node, at, bound, reach = heapq.heappop(queue)
            if least > limit.max():
                break
            able = bound <= limit[at]
            at, bound, reach = at[able], bound[able], reach[able]
            if not len(at):
                continue
            if self.children[node]:
                kids = self.children[node]
                gap = np.abs(reach[:, None] - np.array([self.to_parent[c] for c in kids])[None, :]) - np.array([self.radius[c] for c in kids])[None, :]
                open_ = gap <= limit[at][:, None]
                for j, c in enumerate(kids):
                    rows = np.flatnonzero(open_[:, j])
                    if len(rows):
                        to = distances(q[at[rows]], self.centre[c][None, :])[:, 0]
                        low = np.maximum(bound[rows], to - self.radius[c])
                        heapq.heappush(queue, (float(low.min()), c, at[rows], low, to))
                continue
            a, b = self.span[node]
            near = np.abs(self.entry[None, a:b] - reach[:, None]) <= limit[at][:, None]
            cols, rows = np.flatnonzero(near.any(0)), np.flatnonzero(near.any(1))
            if not len(cols):
                continue
            at, pick = at[rows], a + cols
            self.computed += len(at) * len(pick)
            if quick:
                found = ((asked[at] @ self.floats[pick].T).astype(np.int64) << self.bits) | self.places[pick][None, :]
            else:
                found = ((asked[at] @ self.rows[pick].astype(asked.dtype).T).astype(object) << self.bits) | self.places[pick].astype(object)[None, :]
            better = np.flatnonzero(found.max(1) > best[at, 0])
            if len(better):
                at = at[better]
                both = np.concatenate([best[at], found[better]], 1)
                best[at] = np.sort(np.partition(both, -k, 1)[:, -k:] if quick else both, 1)[:, -k:]
                tighten(at)
        out = []
        mask = (1 << self.bits) - 1
        for row in best[:, ::-1].tolist():
            out.append([(int(self.row_at[mask - (v & mask)]), v >> self.bits) for v in row if v != none])
        return out


def scaled(score: int, peak: float) -> float:
    """An inner product of integers in the units of the scaled space."""
    m, e = math.frexp(peak * 1.0)
    whole = int(m * (1 << 53)) ** 2 * SCALE * SCALE
    shift = 2 * (e - 53)
    return score / (whole << shift) if shift >= 0 else (score << -shift) / whole


def key_bytes(peak: float, width: int) -> int:
    """Bytes that hold any score and its sign."""
    return (2 * (max(0, math.frexp(peak)[1]) + 8) + max(1, width).bit_length() + 2 + 7) // 8


def matrix(column: pa.Array, width: int) -> np.ndarray:
    if pa.types.is_large_list(column.type):
        column = column.cast(pa.list_(column.type.value_type))
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    inside = np.arange(width)[None, :] < sizes[:, None]
    out[inside] = flat
    return out


def admitted(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v, h1, h2): vectors that take part, and a digest of each; equal digests, equal vectors."""
    kind = dict(vectors.dtypes)[vector_col]
    x = F.col(f"`{vector_col}`").cast(kind if kind in ("array<float>", "array<double>") else "array<double>")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    rows = vectors.where(F.col(f"`{id_col}`").isNotNull() & x.isNotNull() & finite).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), x.alias("v"))
    return rows.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit("second"), "v"))


def classes(rows: DataFrame, is_query: Column, k: int) -> DataFrame:
    """h1, h2, v, asked, ids: each distinct vector with its k + 1 smallest ids, and whether a query has it."""
    smallest = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    ids = rows.select("vec_id", "h1", "h2").distinct().withColumn("_place", smallest).where(F.col("_place") <= k + 1).groupBy("h1", "h2").agg(F.collect_list("vec_id").alias("ids"))
    bodies = rows.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.max(F.coalesce(is_query, F.lit(False))).alias("asked"))
    return bodies.join(ids, ["h1", "h2"]).select("h1", "h2", "v", "asked", "ids")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", tree_rows: int = TREE_ROWS, query_rows: int = QUERY_ROWS, regions: int = REGIONS) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of every row that is_query (of vec_id) admits."""
    rows = admitted(vectors, id_col, vector_col)
    kind = dict(rows.dtypes)["v"]
    held = cut(classes(rows, is_query, k), "vector-classes")
    square = F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))
    size = F.aggregate("v", F.lit(0.0), lambda s, e: F.greatest(s, F.abs(e.cast("double"))))
    about = held.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"), F.max(size).alias("peak"), F.max(square).alias("square")).first()
    n, width, peak_ = about["n"], about["width"] or 0, (about["peak"] or 0.0) + 1 / SCALE
    most = (math.sqrt(about["square"] or 0.0) + math.sqrt(width) / SCALE) / peak_
    space = Space(peak_, min(most * most, float(width)) if math.isfinite(most) else float(width), width)

    want = max(1, min(regions, -(-n // tree_rows)))
    share = min(1.0, (want + 4 * math.sqrt(want) + 4) / max(1, n))
    sample = held.where(F.pmod("h1", F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("h1", "h2", "v").orderBy("h1", "h2").limit(want).collect() if n else []
    pivots = np.zeros((max(1, len(sample)), width))
    for i, r in enumerate(sample):
        pivots[i, : len(r["v"])] = r["v"]
    placed = cut(_place(held, space, pivots, kind), "vector-regions")
    found = {r["region"]: r for r in placed.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).collect()}  # a row a pivot
    pieces = np.array([-(-found[i]["n"] // tree_rows) if i in found else 0 for i in range(len(pivots))])
    radius = np.array([found[i]["radius"] if i in found else 0.0 for i in range(len(pivots))])
    first = np.concatenate([[0], np.cumsum(pieces)])  # a region's first tree
    starts = F.array(*[F.lit(int(v)) for v in first[:-1]]) if len(pivots) <= 64 else F.lit([int(v) for v in first[:-1]])
    many = F.array(*[F.lit(int(max(1, v))) for v in pieces]) if len(pivots) <= 64 else F.lit([int(max(1, v)) for v in pieces])
    at = F.col("region") + 1
    stored = placed.select("h1", "h2", "v", "ids", (F.element_at(starts, at) + F.pmod("h2", F.element_at(many, at))).cast("long").alias("tree"))

    asked = placed.where("asked").select("h1", "h2", "v")
    once = cut(_search(stored, _route(asked, space, pivots, radius, pieces, first, kind, None), space, k + 1, query_rows, kind), "vector-first-trees")
    others = _route(once.select("h1", "h2", "v", "tree", "limit"), space, pivots, radius, pieces, first, kind, True)
    every = once.unionByName(_search(stored, cut(others, "vector-routes"), space, k + 1, query_rows, kind))
    one = every.select("h1", "h2", F.inline("found"))
    best = F.row_number().over(Window.partitionBy("h1", "h2").orderBy(F.desc("key"), "vec_id"))
    top = one.withColumn("_best", best).where(F.col("_best") <= k + 1).groupBy("h1", "h2").agg(F.collect_list(F.struct("vec_id", "score", "key", "same")).alias("found"))
    queries = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "h1", "h2").distinct().withColumn("salt", F.pmod(F.xxhash64("query_id"), F.lit(SALTS)).cast("int"))
    salted = top.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # many queries may have one vector
    both = queries.join(salted, ["h1", "h2", "salt"]).select("query_id", "h1", "h2", F.inline("found")).where(~(F.col("same") & (F.col("vec_id") == F.col("query_id"))))
    rank = F.row_number().over(Window.partitionBy("query_id", "h1", "h2").orderBy(F.desc("key"), "vec_id"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _place(held: DataFrame, space: Space, pivots: np.ndarray, kind: str) -> DataFrame:
    """Adds region, the nearest pivot, and away, the distance from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = space.lifted(pivots)
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK):
                part = batch.slice(begin, BLOCK)
                x = space.lifted(matrix(part.column("v"), space.width))
                home = distances(x, centre).argmin(1)
                away = np.sqrt(((x - centre[home]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(home.astype(np.int32)), pa.array(away)], names=["h1", "h2", "v", "asked", "ids", "region", "away"])

    return held.mapInArrow(run, f"h1 long, h2 long, v {kind}, asked boolean, ids array<long>, region int, away double")


def _route(asked: DataFrame, space: Space, pivots: np.ndarray, radius: np.ndarray, pieces: np.ndarray, first: np.ndarray, kind: str, again: bool | None) -> DataFrame:
    """(h1, h2, v, limit, tree): for each query one tree of its nearest region; or, again, all others that its limit admits."""
    able = np.flatnonzero(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = space.lifted(pivots[able])
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK):
                part = batch.slice(begin, BLOCK)
                q = space.asked(matrix(part.column("v"), space.width))
                reach = distances(q, centre) if len(able) else np.zeros((len(q), 0))
                h1 = part.column("h1").to_numpy()
                if again is None:
                    near = able[reach.argmin(1)] if len(able) else np.zeros(len(q), np.int64)
                    row, tree, limit = np.arange(len(q)), first[near] + h1 % np.maximum(1, pieces[near]), np.full(len(q), np.inf)
                else:
                    limit, told = part.column("limit").to_numpy(), part.column("tree").to_numpy()
                    row, region = np.nonzero(reach - radius[able][None, :] <= (limit + space.slack(q))[:, None])
                    many = pieces[able[region]]
                    row = np.repeat(row, many)
                    tree = np.repeat(first[able[region]], many) + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                    other = tree != told[row]
                    row, tree = row[other], tree[other]
                    limit = limit[row]
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([*[part.column(c).take(at) for c in ("h1", "h2", "v")], pa.array(limit), pa.array(tree.astype(np.int64))], names=["h1", "h2", "v", "limit", "tree"])

    return asked.mapInArrow(run, f"h1 long, h2 long, v {kind}, limit double, tree long")


def _search(stored: DataFrame, routed: DataFrame, space: Space, k: int, query_rows: int, kind: str) -> DataFrame:
    """(h1, h2, v, tree, limit, found): each routed query with its k best in that tree, and the limit that follows from them.

    A tree moves once for every query_rows of its queries; trees without a query don't move.
    """
    groups = routed.groupBy("tree").agg(F.ceil(F.count(F.lit(1)) / query_rows).cast("int").alias("groups"))
    rows = stored.join(groups, "tree").select("tree", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("grp"), F.lit(0).alias("kind"), "h1", "h2", "v", "ids", F.lit(0.0).alias("limit"))
    none = F.lit(None).cast("array<long>")
    asked = routed.join(groups, "tree").select("tree", F.pmod("h2", F.col("groups")).cast("int").alias("grp"), F.lit(1).alias("kind"), "h1", "h2", "v", none.alias("ids"), "limit")
    dealt = rows.unionByName(asked).repartition("tree", "grp").sortWithinPartitions("tree", "grp", "kind")
    size = key_bytes(space.peak, space.width)
    item = pa.struct([("vec_id", pa.int64()), ("score", pa.int64()), ("key", pa.binary()), ("same", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a (tree, grp) follow each other, the stored ones first; queries stream past the tree."""
        key, held, tree, marks = None, [], None, None
        for batch in batches:
            t, g, kinds = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("tree", "grp", "kind"))
            ends = np.flatnonzero((np.diff(t) != 0) | (np.diff(g) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip(np.concatenate([[0], ends]), np.concatenate([ends, [len(t)]]), strict=True):
                if a == b:
                    continue
                if (t[a], g[a]) != key:
                    key, held, tree = (t[a], g[a]), [], None
                part = batch.slice(a, b - a)
                if kinds[a] == 0:
                    held.append((part.column("ids").to_pylist(), part.column("h1").to_numpy(), part.column("h2").to_numpy(), matrix(part.column("v"), space.width)))
                    continue
                if tree is None:
                    each = [len(ids) for part_ids, *_ in held for ids in part_ids]
                    ids = np.array([i for part_ids, *_ in held for own in part_ids for i in own], np.int64)
                    x, h1, h2 = (np.repeat(np.concatenate([h[j] for h in held]), each, 0) if held else np.zeros((0, space.width)[: 1 + (j == 3)]) for j in (3, 1, 2))
                    held, tree = [], MTree(ids, x, space)
                    marks = h1[tree.order], h2[tree.order]
                for begin in range(0, b - a, BLOCK):
                    some = part.slice(begin, BLOCK)
                    x, limits = matrix(some.column("v"), space.width), some.column("limit").to_numpy()
                    got = tree.search(x, k, limits)
                    q = space.asked(x)
                    full, h1, h2 = (q * q).sum(1) + space.top, some.column("h1").to_numpy(), some.column("h2").to_numpy()
                    out = [[{"vec_id": int(tree.ids[r]), "score": s if -LARGEST <= s < LARGEST else None, "key": (s + (1 << 8 * size - 1)).to_bytes(size, "big"), "same": bool(marks[0][r] == h1[i] and marks[1][r] == h2[i])} for r, s in one] for i, one in enumerate(got)]
                    limit = [min(limits[i], math.sqrt(max(0.0, full[i] - 2 * scaled(one[-1][1], space.peak)))) if len(one) == k else limits[i] for i, one in enumerate(got)]
                    yield pa.RecordBatch.from_arrays([*[some.column(c) for c in ("h1", "h2", "v", "tree")], pa.array(limit, pa.float64()), pa.array(out, pa.list_(item))], names=["h1", "h2", "v", "tree", "limit", "found"])

    return dealt.mapInArrow(run, f"h1 long, h2 long, v {kind}, tree long, limit double, found array<struct<vec_id:long,score:long,key:binary,same:boolean>>")


ORACLE = """
with v as (
  select distinct vec_id, list_transform(embedding, lambda x: floor(x::double * 256)::bigint) as v, embedding from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
  select q.vec_id as query_id, q.embedding as own, c.vec_id as vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id or q.embedding <> c.embedding where q.vec_id % 50 = 0)
select query_id, rank::int as rank, vec_id, score from (
  select *, row_number() over (partition by query_id, own order by score desc, vec_id) as rank from pairs) where rank <= 5
"""
