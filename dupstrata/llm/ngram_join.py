"""N-gram Jaccard join in metric space, exact.

A document is the set of its distinct word shingles. Two documents link when their Jaccard similarity reaches num/den, that
is, when their Jaccard distance d, a metric, is at most r = 1 - num/den.

First an exact filter finds documents that can link at all. Sizes of linking sets differ by a factor den/num at most; sizes
are cut into levels wider than that, and a set whose window passes its level's end is replicated into the next. In a level
the shingle universe is cut by a hash into more classes than linking sets can differ in, so on one class at least they
agree. A document has a key for the content of each class, in order, up to as many as its own bound asks for (small sets:
of two or three classes), and documents that share a key are a cell. Inside a cell, pairs stay possible unless their sizes or the digests of their classes
(each that differs adds one to the symmetric difference) rule them out. What possible pairs connect is a bundle, found by
star steps over ids alone; all links lie inside bundles, and documents in none link with nothing.

A bundle is a metric space to join. A set moves once, into its bundle, however many cells its document is in.

1. A bundle of more than CELL_BYTES of sets is cut into Voronoi regions: PIVOTS of its members are pivots, every member is
   measured against them, and lies in the region of its nearest one. Members within r of a pivot are links. A member x is
   replicated into the region of a pivot q if d(x, q) <= d(x, p) + 2 r, p being its nearest: by the triangle inequality no
   link is lost. Members farther than 1 - 2 r from all pivots make a far region, into which members farther than 1 - 3 r
   are replicated. Regions whose members are connected by now are done; of those with equal members, one goes on; larger
   ones than CELL_BYTES are cut again.
2. A region that holds more than half of what it was cut from (a ball of texts alike, or texts all unlike) is cut by the
   filter's cells instead, and a cell that is too large itself becomes one for every two of its blocks.
3. What is smaller is joined in one task, in memory, by the same recursion down to regions of LEAF members; there, pairs are
   passed over that are connected, that differ too much in size, in distance from a pivot (triangle inequality), or in
   digests of their classes; the others are compared exactly.

Equal sets collapse first (their digests are compared, not their texts), so a text that a third of all rows share is one
member. For all documents only ids, digests and keys are shuffled; sets move only for documents that share a cell. Links
become components by star steps. Nothing is capped or sampled. Shingles are compared by 64-bit hashes.

Documents with fewer words than a shingle have their whole word sequence as the only shingle. Null or wordless texts
have the empty set and link with nothing. Rows with one id count as one document in links; a row with null id links with
nothing. An empty table gives an empty result. Very long texts are sets like others; one alone may exceed CELL_BYTES. Only
the id and the text column are read, so further columns of any name do no harm.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dupstrata.llm.common import LOWER, cut, drop, map_texts, texts
from dupstrata.llm.components import components

CELL_BYTES, PIVOTS, LEAF = 16 << 20, 8, 32
#: Members that stream past one copy of a pivot's set.
STREAM = 2048
#: Most ids that are sent to every task: 8 bytes each.
BROADCAST_IDS = 1_000_000
LEAST_CONTENT = 6.0


class WordHashes(dict):
    """Hashes of words; kept for MEMORY words at most."""

    MEMORY = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MEMORY:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def scramble(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective mix of 64-bit numbers."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(raw: bytes | None, n: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of n-word shingles."""
    words = (raw or b"").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(n, len(words))
    h = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        h = scramble(h + w[k : len(words) - size + 1 + k], k + 1)
    return np.unique(h)


def links(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if den * min(len(a), len(b)) < num * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and den * both >= num * (len(a) + len(b) - both)


@dataclass(frozen=True)
class Level:
    low: int
    high: int
    classes: int
    group: int  # classes to a region


@dataclass(frozen=True)
class Geometry:
    """What a similarity of num/den means for sizes, differences and classes."""

    num: int
    den: int

    def bound(self, sizes: int) -> int:
        """Most shingles in which two linking sets of that many shingles together can differ."""
        return sizes * (self.den - self.num) // (self.den + self.num)

    def level(self, low: int) -> Level:
        steps = max(1, round(math.log(1.5) / math.log(self.den / self.num)))
        high = max(low, math.ceil(low * (self.den / self.num) ** steps) - 1)
        most = self.bound(2 * high)
        for g in (1, 2, 3):
            if low * g / (most + g) >= LEAST_CONTENT and math.comb(most + g, g) <= 4 * (most + 1) + 8:
                break
        else:
            g = max(g for g in (1, 2, 3) if math.comb(most + g, g) <= 4 * (most + 1) + 8)
        return Level(low, high, most + g if g > 1 else (most + 1) * 115 // 100 + 2 if most else 1, g)

    def levels(self, size: int) -> list[Level]:
        """The level of a set of this size, and the next one if the set's window reaches into it."""
        at = level_of(self, size)
        above = self.den * size // self.num
        return [at, level_of(self, at.high + 1)] if above > at.high else [at]


#: Plain tables and not cached functions, as they travel to executors by value together with the functions that use them.
_LEVELS: dict[Geometry, list[Level]] = {}
_SUBSETS: dict[tuple[int, int], np.ndarray] = {}


def level_of(g: Geometry, size: int) -> Level:
    known = _LEVELS.setdefault(g, [g.level(1)])
    while known[-1].high < size:
        known.append(g.level(known[-1].high + 1))
    return known[bisect_left(known, size, key=lambda level: level.high)]


def subsets(n: int, k: int) -> np.ndarray:
    if (n, k) not in _SUBSETS:
        _SUBSETS[n, k] = np.array(list(combinations(range(n), k)))
    return _SUBSETS[n, k]


def region_keys(h: np.ndarray, g: Geometry, salt: int = 0) -> np.ndarray:
    """The keys of a set, over its levels."""
    out = []
    for at in g.levels(len(h)) if len(h) else []:
        most = g.bound(len(h) + min(at.high, g.den * len(h) // g.num))  # with the largest set of the level that can link
        if not most:
            continue  # only equal sets link
        of = scramble(h, 2 * salt + 101) % np.uint64(at.classes)
        mixed = scramble(h, 2 * salt + 102)
        order = np.argsort(of, kind="stable")
        starts = np.flatnonzero(np.diff(of[order], prepend=np.uint64(2**64 - 1)))
        held = of[order][starts].astype(np.int64)
        sums = np.zeros(at.classes, np.uint64)
        sums[held] = np.add.reduceat(mixed[order], starts)
        named = scramble(sums ^ scramble(np.arange(at.classes, dtype=np.uint64), at.low), salt)
        if at.group > 1:
            out.append(scramble(named[subsets(at.classes, at.group)].sum(1, dtype=np.uint64), at.low + 7))
        elif len(held) > most:
            out.append(named[held[: most + 1]])
        else:
            out.append(named)
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def set_digest(h: np.ndarray) -> tuple[int, int]:
    return int(signed(scramble(h, 11).sum(keepdims=True, dtype=np.uint64))[0]), int(signed(scramble(h, 12).sum(keepdims=True, dtype=np.uint64))[0])


def sets(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, s1, s2 for every row: the size of its set and its digest."""

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        known = run.__dict__.setdefault("known", WordHashes())
        got = [shingle_set(raw, n, known) for raw in batch.column("text").to_pylist()]
        marks = [set_digest(h) for h in got]
        return {"doc_id": batch.column("doc_id"), "n_shingles": [len(h) for h in got], "s1": [m[0] for m in marks], "s2": [m[1] for m in marks]}

    return map_texts(docs, run, "doc_id long, n_shingles long, s1 long, s2 long")


def keys(docs: DataFrame, n: int, g: Geometry) -> DataFrame:
    """(key, s1): every key of every document; equal sets of one slice give one row."""

    def run(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        known = run.__dict__.setdefault("known", WordHashes())
        named, marks = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        seen = set()
        for raw in batch.column("text").to_pylist():
            h = shingle_set(raw, n, known)
            s1 = set_digest(h)[0]
            if s1 not in seen:
                seen.add(s1)
                named.append(region_keys(h, g))
                marks.append(np.full(len(named[-1]), s1, np.int64))
        return {"key": signed(np.concatenate(named)), "s1": np.concatenate(marks)}

    return map_texts(docs, run, "key long, s1 long")


def shared(entries: DataFrame, node: str) -> DataFrame:
    """The distinct rows (key, node) whose key has more than one node: one shuffle by key, then a stream over sorted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, value, told = np.zeros(0, np.int64), np.zeros(0, np.int64), True
        for batch in batches:
            k = np.concatenate([key, batch.column(0).to_numpy()])
            v = np.concatenate([value, batch.column(1).to_numpy()])
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (v[1:] != v[:-1])
            held = len(key)
            k, v = k[new], v[new]
            same = k[1:] == k[:-1]
            out = np.zeros(len(k), bool)
            out[1:] |= same
            out[:-1] |= same
            last = bool(out[-1]) if len(k) else True
            if held and told:
                last = last or len(k) == 1
                out[0] = False
            key, value, told = k[-1:], v[-1:], last
            yield pa.RecordBatch.from_arrays([pa.array(k[out]), pa.array(v[out])], names=["key", node])

    dealt = entries.select("key", node).repartition("key").sortWithinPartitions("key", node)
    return dealt.mapInArrow(run, f"key long, {node} long")


def sketch(h: np.ndarray) -> bytes:
    """One byte for each class of a power of two of classes, about two shingles to a class."""
    k = 1 << max(3, (len(h) // 2).bit_length())
    at = (scramble(h, 21) & np.uint64(k - 1)).astype(np.int64)
    out = np.zeros(k, np.uint8)
    np.bitwise_xor.at(out, at, (scramble(h, 22) & np.uint64(255)).astype(np.uint8))
    return out.tobytes()


def fold(mark: np.ndarray, k: int) -> np.ndarray:
    while len(mark) > k:
        mark = mark[: len(mark) // 2] ^ mark[len(mark) // 2 :]
    return mark


class Cell:
    """Sets of one cell or of pivots, as one flat array; lab tells which are connected."""

    def __init__(self, nodes: list[int], comps: list[int], sets: list[np.ndarray], g: Geometry):
        self.g, self.nodes, self.lab, self.sets = g, np.array(nodes, np.int64), np.array(comps, np.int64), sets
        self.sizes = np.array([len(h) for h in sets], np.int64)
        self.links: list[tuple[int, int]] = []
        self.r = 1 - g.num / g.den
        self.marks: dict[int, np.ndarray] = {}

    def common(self, h: np.ndarray, idx: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of h with these members."""
        if not len(h) or not len(idx):
            return np.zeros(len(idx), np.int64)
        flat = np.concatenate([self.sets[i] for i in idx])
        at = np.minimum(np.searchsorted(h, flat), len(h) - 1)
        ends = np.cumsum(self.sizes[idx])
        total = np.concatenate([[0], np.cumsum(h[at] == flat)])
        return total[ends] - total[ends - self.sizes[idx]]

    def distance(self, h: np.ndarray, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Jaccard distances of these members from h, and which link."""
        both = self.common(h, idx)
        union = self.sizes[idx] + len(h) - both
        return 1 - both / np.maximum(1, union), (both > 0) & (self.g.den * both >= self.g.num * union)

    def connect(self, i: int, idx: np.ndarray) -> None:
        for j in idx.tolist():
            if self.lab[i] != self.lab[j]:
                self.links.append((int(self.nodes[i]), int(self.nodes[j])))
                self.lab[self.lab == self.lab[j]] = self.lab[i]

    def join(self, idx: np.ndarray) -> None:
        """Connects all members of idx that link, over others of idx or not."""
        if len(idx) < 2 or (self.lab[idx] == self.lab[idx[0]]).all():
            return
        if len(idx) <= LEAF:
            self.compare(idx, np.zeros((len(idx), 0)))
            return
        away = np.zeros((len(idx), 0))
        at = 0
        while away.shape[1] < PIVOTS:
            d, near = self.distance(self.sets[idx[at]], idx)
            away = np.hstack([away, d[:, None]])
            self.connect(idx[at], idx[near])
            at = int(away.min(1).argmax())
            if away[at].min() == 0:
                break
        for region in regions(away, self.r):
            if 2 * len(region) > len(idx):
                self.compare(idx[region], away[region])
            else:
                self.join(idx[region])

    def compare(self, idx: np.ndarray, away: np.ndarray) -> None:
        """Pairs of idx that no bound rules out, exactly."""
        g, table = self.g, None
        if len(idx) > 2 * LEAF:
            least = min(len(self.mark(i)) for i in idx)
            table = np.stack([fold(self.mark(i), least) for i in idx])
        sizes = self.sizes[idx]
        for k in range(len(idx) - 1):
            rest = slice(k + 1, None)
            able = (self.lab[idx[rest]] != self.lab[idx[k]]) & (g.den * np.minimum(sizes[rest], sizes[k]) >= g.num * np.maximum(sizes[rest], sizes[k]))
            if away.shape[1]:
                able &= (np.abs(away[rest] - away[k]) <= self.r + 1e-9).all(1)
            at = np.flatnonzero(able) + k + 1
            if table is not None and len(at):
                at = at[(table[at] != table[k]).sum(1) <= (sizes[at] + sizes[k]) * (g.den - g.num) // (g.den + g.num)]
            if len(at):
                _, near = self.distance(self.sets[idx[k]], idx[at])
                self.connect(idx[k], idx[at[near]])

    def mark(self, i: int) -> np.ndarray:
        if i not in self.marks:
            self.marks[i] = np.frombuffer(sketch(self.sets[i]), np.uint8)
        return self.marks[i]


def regions(away: np.ndarray, r: float) -> list[np.ndarray]:
    """Members of each Voronoi region, from their distances (a column a pivot), with the boundary members that may link into it; the far region last."""
    least, slack = away.min(1), 1e-9
    near = least <= 1 - 2 * r + slack
    return [*(np.flatnonzero(near & (away[:, j] <= least + 2 * r + slack)) for j in range(away.shape[1])), np.flatnonzero(least > 1 - 3 * r - slack)]


def shared_sets(batch: pa.RecordBatch, column: str = "shingles") -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(column)]


def join_cells(members: DataFrame, g: Geometry) -> DataFrame:
    """(a, b): links that connect what links inside each cell. members: key, node, comp, shingles; a cell is CELL_BYTES at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []

        def close() -> None:
            if len(rows) > 1:
                cell = Cell([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], g)
                cell.join(np.arange(len(rows)))
                out.extend(cell.links)

        def flush() -> pa.RecordBatch:
            cols = [pa.array([x[i] for x in out], pa.int64()) for i in range(2)]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, names=["a", "b"])

        for batch in batches:
            for k, node, comp, h in zip(*(batch.column(c).to_pylist() for c in ("key", "node", "comp")), shared_sets(batch), strict=True):
                if k != key:
                    close()
                    key, rows = k, []
                rows.append((node, comp, h.copy()))
            yield flush()
        close()
        yield flush()

    dealt = members.select("key", "node", "comp", "shingles").repartition("key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(run, "a long, b long")


def past_pivots(pivots: DataFrame, members: DataFrame, bodies: DataFrame, g: Geometry) -> DataFrame:
    """Streams the members of each cell past its pivots' sets. (a, b) are links with a pivot, (key, node) rows of Voronoi regions.

    pivots: key, node (few a cell); members: key, node. A cell's members are dealt over one task for each STREAM of them.
    """
    groups = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / STREAM).cast("int").alias("groups"))
    first = pivots.join(groups, "key").select("key", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("grp"), F.lit(0).alias("kind"), "node")
    rest = members.join(groups, "key").select("key", F.pmod(F.xxhash64("node"), F.col("groups")).cast("int").alias("grp"), F.lit(1).alias("kind"), "node")
    dealt = first.unionByName(rest).join(bodies.select("node", "shingles"), "node").repartition("key", "grp").sortWithinPartitions("key", "grp", "kind", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            keys_, grps, kinds, nodes = (batch.column(c).to_pylist() for c in ("key", "grp", "kind", "node"))
            out: list[tuple] = []
            begin = 0
            some = shared_sets(batch)
            while begin < batch.num_rows:
                end = begin
                while end < batch.num_rows and keys_[end] == keys_[begin] and grps[end] == grps[begin] and kinds[end] == kinds[begin]:
                    end += 1
                if at != (keys_[begin], grps[begin]):
                    at, held = (keys_[begin], grps[begin]), []
                if kinds[begin] == 0:
                    held += [(nodes[i], some[i].copy()) for i in range(begin, end)]
                else:
                    part = Cell(nodes[begin:end], nodes[begin:end], some[begin:end], g)
                    every = np.arange(end - begin)
                    away = []
                    for pivot, h in held:
                        d, near = part.distance(h, every)
                        away.append(d)
                        out += [(None, None, pivot, int(x)) for x in part.nodes[near] if x != pivot]
                    for name, region in zip([*region_names(keys_[begin], PIVOTS)[: len(held)], region_names(keys_[begin], PIVOTS)[-1]], regions(np.stack(away, 1), part.r), strict=True):
                        out += [(name, int(x), None, None) for x in part.nodes[region]]
                begin = end
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(4)], names=["key", "node", "a", "b"])

    return dealt.mapInArrow(run, "key long, node long, a long, b long")


def region_names(cell: int, many: int) -> list[int]:
    """Keys of a cell's regions, the far one's last."""
    return signed(scramble(np.arange(many + 1, dtype=np.uint64) + np.uint64(cell & (2**64 - 1)), 77)).tolist()


def join(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs. Two documents link when den * intersection >= num * union."""
    g = Geometry(num, den)
    body = texts(docs, id_col, text_col)
    base = cut(sets(body, n), "shingle-sets")
    held = base.where("doc_id is not null and n_shingles > 0")
    reps = cut(held.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("node")), "distinct-sets")  # read again, so that joins with it can split a text that very many rows share
    members = cut(shared(keys(body.where("doc_id is not null"), n, g), "s1").join(reps, "s1").select("key", "node"), "cells")
    out = reps.join(_connected(members, reps, body, n, g), "node", "left").select("s1", "s2", F.col("n_shingles").alias("n"), F.coalesce("component", "node").alias("component_id"))
    drop(members)
    same = (base["s1"] == out["s1"]) & (base["s2"] == out["s2"]) & (base["n_shingles"] == out["n"]) & (base["n_shingles"] > 0) & base["doc_id"].isNotNull()
    return base.join(out, same, "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _connected(members: DataFrame, reps: DataFrame, body: DataFrame, n: int, g: Geometry) -> DataFrame:
    """(node, component) of what links in any cell connect."""
    spark = members.sparkSession
    able = cut(members.select("node").distinct().join(reps, "node"), "members")
    marks = cut(_bodies(body, able, n, False), "marks")
    possible = cut(possible_links(_distinct_cells(members).join(marks, "node"), g), "possible")
    drop(marks)
    bundles = cut(components(possible), "bundles")
    drop(possible)
    bodies = cut(_bodies(body, bundles.select("node").join(able, "node"), n, True), "bodies")
    cells = cut(bundles.select(F.col("component").alias("key"), "node", F.lit(None).cast("long").alias("parent")), "bundles")
    found = cut(spark.createDataFrame([], "a long, b long"), "links")
    comp = spark.createDataFrame([], "node long, component long")
    while True:
        going = cut(_open(cells, comp, bodies), "open-cells")
        if going.isEmpty():
            drop(able, bodies, bundles, found, going, cells)
            return comp
        fits, half = F.col("bytes") <= CELL_BYTES, 2 * F.col("m") > F.col("parent")
        fallen, dense = going.where(~fits & (F.col("parent") == 0)), going.where(~fits & (F.col("parent") > 0) & half)
        large = going.where(~fits & (F.col("parent").isNull() | (F.col("parent") > 0) & ~half))
        whole = going.where(fits).select("key", "node", "comp").unionAll(_blocks(fallen))
        linked = join_cells(whole.join(bodies.select("node", "shingles"), "node"), g)
        place = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("node"), "node"))
        pivots = large.withColumn("_place", place).where(F.col("_place") <= PIVOTS).select("key", "node")
        told = cut(past_pivots(pivots, large.select("key", "node"), bodies, g), "regions")
        names = large.groupBy("key").agg(F.max("m").alias("parent")).mapInArrow(_names, "key long, parent long")
        parts = told.where("node is not null").select("key", "node").join(names, "key").select("key", "node", "parent")
        again = dense.select(F.col("key").alias("_region"), "node").join(members, "node").select(F.xxhash64("_region", "key").alias("key"), "node", F.lit(0).cast("long").alias("parent"))
        before, old = found, cells
        found = cut(before.unionAll(linked).unionAll(told.where("a is not null").select("a", "b")), "links")
        cells = cut(parts.unionByName(again), "cells")
        drop(before, comp, going, told, old)
        comp = cut(components(found), "components")


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key of a region, members of the cell it came from)."""
    for batch in batches:
        cells, many = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([x for k in cells for x in region_names(k, PIVOTS)], pa.int64()), pa.array([m for m in many for _ in range(PIVOTS + 1)], pa.int64())], names=["key", "parent"])


def _open(cells: DataFrame, comp: DataFrame, bodies: DataFrame) -> DataFrame:
    """key, node, comp, m, bytes, parent of cells whose members are not connected; of cells with equal members, one."""
    sized = bodies.select("node", F.octet_length("shingles").alias("_size"))
    labelled = cells.join(comp, "node", "left").join(sized, "node").select("key", "node", "parent", F.coalesce("component", "node").alias("comp"), "_size")
    mark = [F.sum(F.xxhash64(F.lit(salt), "node").cast("decimal(20,0)")).alias(f"_m{salt}") for salt in (1, 2)]
    state = labelled.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum("_size").alias("bytes"), F.max("parent").alias("_p"), *mark).where("lo <> hi")
    kept = state.groupBy("m", "_m1", "_m2").agg(F.min("key").alias("key"), F.max("bytes").alias("bytes"), F.max("_p").alias("parent"))
    return labelled.drop("parent", "_size").join(kept.select("key", "m", "bytes", "parent"), "key").select("key", "node", "comp", "m", "bytes", "parent")


def _distinct_cells(members: DataFrame) -> DataFrame:
    """key, node of cells; of those with equal members, one."""
    mark = [F.sum(F.xxhash64(F.lit(salt), "node").cast("decimal(20,0)")).alias(f"_m{salt}") for salt in (1, 2)]
    kept = members.groupBy("key").agg(F.count(F.lit(1)).alias("_m"), *mark).groupBy("_m", "_m1", "_m2").agg(F.min("key").alias("key"))
    return members.join(kept.select("key"), "key", "left_semi")


def possible_links(members: DataFrame, g: Geometry) -> DataFrame:
    """(a, b): pairs that connect what may link inside each cell. members: key, node, size, mark. Of a cell with more than CELL_BYTES of marks, all members are connected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, held, out = None, [], 0, []

        def close() -> None:
            if len(rows) > 1:
                out.extend(_forest(rows, g))

        def flush() -> pa.RecordBatch:
            cols = [pa.array([x[i] for x in out], pa.int64()) for i in range(2)]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, names=["a", "b"])

        for batch in batches:
            for k, node, size, mark in zip(*(batch.column(c).to_pylist() for c in ("key", "node", "size", "mark")), strict=True):
                if k != key:
                    close()
                    key, rows, held = k, [], 0
                held += len(mark)
                if held > CELL_BYTES:
                    out.extend((rows[0][0], r[0]) for r in [*rows[1:], (node,)])
                    del rows[1:]
                else:
                    rows.append((node, size, mark))
            yield flush()
        close()
        yield flush()

    dealt = members.select("key", "node", "size", "mark").repartition("key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _forest(rows: list[tuple[int, int, bytes]], g: Geometry) -> list[tuple[int, int]]:
    sizes = np.array([r[1] for r in rows], np.int64)
    raw = [np.frombuffer(r[2], np.uint8) for r in rows]
    least = min(map(len, raw))
    table = np.stack([fold(m, least) for m in raw])
    lab, out = np.arange(len(rows)), []
    for i in range(len(rows) - 1):
        at = np.flatnonzero((lab[i + 1 :] != lab[i]) & (g.den * np.minimum(sizes[i + 1 :], sizes[i]) >= g.num * np.maximum(sizes[i + 1 :], sizes[i]))) + i + 1
        if len(at):
            for j in at[(table[at] != table[i]).sum(1) <= (sizes[at] + sizes[i]) * (g.den - g.num) // (g.den + g.num)].tolist():
                if lab[i] != lab[j]:
                    out.append((rows[i][0], rows[j][0]))
                    lab[lab == lab[j]] = lab[i]
        elif (lab == lab[i]).all():
            break
    return out


def _bodies(body: DataFrame, able: DataFrame, n: int, whole: bool) -> DataFrame:
    """For the nodes of able one row each: node, shingles (its set, sorted); or, not whole, node, size, mark (its digest by classes). Of rows with that id, one of those whose set it is."""

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        known = run.__dict__.setdefault("known", WordHashes())
        got = [shingle_set(raw, n, known) for raw in batch.column("text").to_pylist()]
        fits = [i for i, (h, *mark) in enumerate(zip(got, *(batch.column(c).to_pylist() for c in ("s1", "s2")), strict=True)) if set_digest(h) == tuple(mark)]
        out = {"node": batch.column("node").take(pa.array(fits, pa.int64()))}
        return out | ({"shingles": [got[i].tobytes() for i in fits]} if whole else {"size": [len(got[i]) for i in fits], "mark": [sketch(got[i]) for i in fits]})

    able = able.select("node", "s1", "s2")
    few = F.broadcast(able) if able.count() <= BROADCAST_IDS else able
    chosen = body.join(few, F.col("doc_id") == F.col("node")).select("node", "s1", "s2", "text")
    columns = "shingles binary" if whole else "size long, mark binary"
    return map_texts(chosen, run, f"node long, {columns}").groupBy("node").agg(*[F.first(c.split()[0]).alias(c.split()[0]) for c in columns.split(", ")])


def _blocks(members: DataFrame) -> DataFrame:
    """Cells as one for every two of their blocks, each of CELL_BYTES at most but for chance; any two members share one."""
    n = F.greatest(F.lit(1), F.ceil(F.col("bytes") * 3 / CELL_BYTES)).cast("int")
    own = F.pmod(F.xxhash64(F.lit(3), "node"), n).cast("int")
    cut_up = members.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), n - 1)))
    return cut_up.select(F.xxhash64("key", F.least("_own", "_other"), F.greatest("_own", "_other")).alias("key"), "node", "comp")
