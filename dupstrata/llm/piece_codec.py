"""SentencePiece encoding and decoding with N-best segmentation.

A text's pieces form a lattice: an edge for every vocabulary piece that stands at a place, and a byte-fallback edge for a
character that no piece holds alone. The best segmentation is the path with the largest sum of piece scores. A forward
Viterbi pass gives the best score of every prefix; a backward A* search from the end of the lattice uses those scores as
exact heuristics and pops complete paths in order of score. As the heuristics are exact, each entry of the queue stands for
a complete path of just its cost, so entries beyond the n best are dropped and the queue holds n at most: memory grows with
the length of a word and not with its lattice, whatever the script. Of equal paths, the one with the longer last piece comes
first.

No piece crosses the start of a word, so the lattice of a text is a chain of the lattices of its words, each with the blanks
before it. A model with a piece that does cross one is refused when it is read: a limit of this operator. Viterbi runs over
many distinct words of up to LONG characters at once and word by word for longer ones, by the same rule for ties, and also
gives each word's distance to its second-best path. A text's N best paths differ from its best one only in the N - 1 words
that are nearest to their second-best path; A* runs on those words, and a best-first merge joins their lists. All N
segmentations are returned.

Scores are the model file's own. For a merge model (scores are the ranks of merges) the path of the largest sum is not what
merging by rank gives; own=True adds the merged ids, which equal the model's own encoder's for each word.

Ids decode to the very text: pieces' marks become blanks, bytes become bytes, and the blank put before the text goes. A
mark that stands in the text itself is written in bytes. Null text has null ids; an empty text has no ids and score 0.
Very long texts, and very long words, are encoded whole. Repeated ids stay repeated rows; an empty table gives an empty
result. Only the text and the kept columns are read, so further columns of any name do no harm. The model is read on the
driver from a path that is a parameter, and travels with the tasks; it is never trained.
"""

from __future__ import annotations

import heapq
import math
import re
from array import array
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dupstrata.llm.common import map_texts

MARK, OWN_MARK = "▁", "\udc81"  # a blank; a mark of the text's own, which is no character of any text
UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
UNKNOWN_COST = 10.0
NEVER = -1e8  # scores below this are not for ordinary text
LONG = 48  # longer words are segmented alone
#: Bytes of text handled together, and words that an encoder remembers: more of both let Viterbi run over more words at once
#: and less often, for some 60 MB a worker for each 100,000 words. They change no result.
SLICE, MEMORY = 3 << 20, 300_000


@dataclass
class PieceModel:
    pieces: list[str]
    scores: list[float]
    byte_ids: list[int]
    ids: dict[str, int]  # ordinary pieces
    unknown: float
    longest: int

    @classmethod
    def read(cls, path: str) -> PieceModel:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        scores = [sp.get_score(i) for i in range(n)]
        byte_ids = [0] * 256
        ids = {}
        for i, p in enumerate(pieces):
            if sp.is_byte(i):
                byte_ids[int(p[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                ids[p] = i
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in ids):
            raise ValueError("a piece crosses the start of a word")
        least = min((scores[i] for i in ids.values() if scores[i] > NEVER), default=0.0)
        return cls(pieces, scores, byte_ids, ids, least - UNKNOWN_COST, max(map(len, ids), default=1))

    def edges(self, unit: str, at: int) -> list[tuple[int, float, int]]:
        """(end, score, id) for the pieces that start there; id -1 is byte fallback."""
        found = []
        for end in range(at + 1, min(len(unit), at + self.longest) + 1):
            i = self.ids.get(unit[at:end])
            if i is not None:
                found.append((end, self.scores[i], i))
        if not found or found[0][0] != at + 1:
            found.append((at + 1, self.unknown, -1))
        return found

    def spell(self, unit: str, path: list[tuple[int, int]]) -> list[int]:
        """Ids of a path of (start, id)."""
        out = []
        for start, i in path:
            if i >= 0:
                out.append(i)
            else:
                out += [self.byte_ids[b] for b in (MARK if unit[start] == OWN_MARK else unit[start]).encode("utf-8", "replace")]
        return out

    def forward(self, unit: str) -> array:
        """Viterbi: the best score of every prefix."""
        best = array("d", [0.0]) + array("d", [-math.inf]) * len(unit)
        for at in range(len(unit)):
            here = best[at]
            for end, score, _ in self.edges(unit, at):
                if here + score > best[end]:
                    best[end] = here + score
        return best

    def back_edges(self, unit: str, end: int) -> list[tuple[int, float, int]]:
        """(start, score, id) for the pieces that end there, short ones first; id -1 is byte fallback."""
        found = []
        for start in range(end - 1, max(-1, end - self.longest - 1), -1):
            i = self.ids.get(unit[start:end])
            if i is not None:
                found.append((start, self.scores[i], i))
            elif start == end - 1:
                found.append((start, self.unknown, -1))
        return found

    def n_best(self, unit: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations (score, ids), by A* from the end; of equal ones, those with longer last pieces first."""
        best, serial = self.forward(unit), 0
        queue: list[tuple] = [(-best[-1], 0, len(unit), 0.0, None)]  # cost, order, place, score after it, (step, path after it)
        out = []
        while queue and len(out) < n:
            cost, _, at, after, path = queue.pop(0)
            if at == 0:
                steps = []
                while path:
                    steps.append(path[0])
                    path = path[1]
                out.append((-cost, self.spell(unit, steps)))
                continue
            for start, score, i in self.back_edges(unit, at):
                serial -= 1
                queue.append((-(best[start] + score + after), serial, start, score + after, ((start, i), path)))
            queue.sort(key=itemgetter(0, 1))
            del queue[n - len(out) :]
        return out

    def merge(self, unit: str) -> list[int]:
        """Ids by merging neighbours: time and again the pair whose joined piece has the best score, the leftmost of equals."""
        parts: list[str | None] = list(unit)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        queue: list[tuple[float, int, str]] = []

        def offer(k: int) -> None:
            if k >= 0 and after[k] < len(parts):
                both = parts[k] + parts[after[k]]
                if both in self.ids:
                    heapq.heappush(queue, (-self.scores[self.ids[both]], k, both))

        for k in range(len(parts)):
            offer(k)
        while queue:
            _, k, both = heapq.heappop(queue)
            if parts[k] is None or after[k] >= len(parts) or parts[k] + parts[after[k]] != both:
                continue
            gone = after[k]
            parts[k], parts[gone], after[k] = both, None, after[gone]
            if after[k] < len(parts):
                before[after[k]] = k
            offer(k)
            offer(before[k])
        return self.spell(unit, [(k, self.ids.get(p, -1)) for k, p in enumerate(parts) if p is not None])


class Trie:
    """Transitions (node, character) of all pieces in an open-addressed table, for many lookups at once."""

    def __init__(self, model: PieceModel):
        chars = sorted({c for p in model.ids for c in p})
        self.alphabet = np.array([ord(c) for c in chars], np.int64)
        step: dict[tuple[int, int], int] = {}
        code = {c: k + 1 for k, c in enumerate(chars)}
        self.width = len(chars) + 1
        final = [-1]
        for p, i in model.ids.items():
            node = 0
            for c in p:
                key = (node, code[c])
                node = step.get(key) or step.setdefault(key, len(final))
                if node == len(final):
                    final.append(-1)
            final[node] = i
        self.final = np.array(final)
        size = 1 << (len(step) * 4).bit_length()
        self.mask = size - 1
        self.keys, self.next, self.probes = np.full(size, -1, np.int64), np.zeros(size, np.int64), 1
        for (node, c), to in step.items():
            key = node * self.width + c
            h, k = self.slot(np.array([key]))[0], 1
            while self.keys[h] >= 0:
                h, k = (h + 1) & self.mask, k + 1
            self.keys[h], self.next[h], self.probes = key, to, max(self.probes, k)

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * 0x9E3779B97F4A7C1) >> 20) & self.mask

    def codes(self, points: np.ndarray) -> np.ndarray:
        """Characters as codes; 0 for those of no piece."""
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at + 1, 0)

    def move(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The next nodes, or -1."""
        key = node * self.width + code
        at = self.slot(key)
        out = np.where(self.keys[at] == key, self.next[at], -1)
        left = np.flatnonzero((out < 0) & (self.keys[at] >= 0) & (code > 0))
        for _ in range(self.probes - 1):
            if not len(left):
                break
            at[left] = (at[left] + 1) & self.mask
            hit = self.keys[at[left]] == key[left]
            out[left[hit]] = self.next[at[left[hit]]]
            left = left[~hit & (self.keys[at[left]] >= 0)]
        return out


class Encoder:
    """Segments words and texts; remembers so many words at most."""

    def __init__(self, model: PieceModel, n: int, trie: Trie | None = None, memory: int = MEMORY):
        self.model, self.n, self.trie, self.memory = model, n, trie or Trie(model), memory
        self.merged: dict[str, bytes] = {}
        self.words: dict[str, tuple[bytes, float, float]] = {}  # ids, score, distance to the second-best path
        self.lists: dict[str, list[tuple[float, list[int]]]] = {}
        self.scores = np.array(model.scores + [model.unknown])
        out = [p.replace(MARK, " ").encode() for p in model.pieces]
        for b, i in enumerate(model.byte_ids):
            out[i] = bytes([b])
        self.spelt = out

    def learn(self, words: list[str]) -> None:
        """Puts words into memory."""
        if len(self.words) + len(words) > self.memory:
            self.words.clear()
        short = sorted((w for w in words if len(w) <= LONG), key=len)
        begin = 0
        while begin < len(short):
            end, most = begin, max(4, len(short[begin]) * 5 // 4)
            while end < len(short) and end < begin + 8192 and len(short[end]) <= most:
                end += 1
            self._learn(short[begin:end])
            begin = end
        for w in words:
            if len(w) > LONG:
                got = self.model.n_best(w, 2)
                self.words[w] = (np.array(got[0][1], np.int32).tobytes(), got[0][0], got[0][0] - got[1][0] if len(got) > 1 else np.inf)

    def _learn(self, words: list[str]) -> None:
        n, width = len(words), len(words[-1])
        lengths = np.array([len(w) for w in words])
        points = np.zeros((n, width), np.int64)
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        points[np.arange(width)[None, :] < lengths[:, None]] = flat
        code = self.trie.codes(points)
        fwd = np.full((n, width + 1), -np.inf)
        fwd[:, 0] = 0
        back = np.zeros((n, width + 1), np.int64)  # length of the piece that ends here on the best path
        piece = np.full((n, width + 1), -1, np.int64)
        edges: list[tuple[int, int, np.ndarray, np.ndarray]] = []  # start, length, rows, ids
        for at in range(width):
            rows = np.flatnonzero(lengths > at)
            node = np.zeros(len(rows), np.int64)
            alone = np.ones(len(rows), bool)
            first = rows
            for size in range(1, min(self.model.longest, width - at) + 1):
                inside = lengths[rows] >= at + size
                rows, node = rows[inside], node[inside]
                node = self.trie.move(node, code[rows, at + size - 1])
                rows, node = rows[node >= 0], node[node >= 0]
                if not len(rows):
                    break
                i = self.trie.final[node]
                ends = i >= 0
                if size == 1:
                    alone[np.searchsorted(first, rows[ends])] = False
                if ends.any():
                    edges.append((at, size, rows[ends], i[ends]))
            if alone.any():
                edges.append((at, 1, first[alone], np.full(int(alone.sum()), -1)))
            for start, size, r, i in reversed(edges):
                if start != at:
                    break
                score = fwd[r, at] + self.scores[i]
                better = score > fwd[r, at + size]
                r, i, score = r[better], i[better], score[better]
                fwd[r, at + size], back[r, at + size], piece[r, at + size] = score, size, i
        bwd = np.full((n, width + 1), -np.inf)
        bwd[np.arange(n), lengths] = 0
        for at, size, r, i in reversed(edges):
            bwd[r, at] = np.maximum(bwd[r, at], self.scores[i] + bwd[r, at + size])
        used = np.zeros((n, width + 1), np.int64)
        where, live = lengths.copy(), np.arange(n)
        steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # rows, starts, ids of the best paths, last pieces first
        while len(live):
            ends = where[live]
            starts = ends - back[live, ends]
            used[live, starts] = ends - starts
            steps.append((live, starts, piece[live, ends]))
            where[live] = starts
            live = live[starts > 0]
        second = np.full(n, -np.inf)
        for at, size, r, i in edges:
            through = np.where(used[r, at] == size, -np.inf, fwd[r, at] + self.scores[i] + bwd[r, at + size])
            second[r] = np.maximum(second[r], through)
        best = fwd[np.arange(n), lengths]
        rows, starts, ids = (np.concatenate([x[j] for x in steps]) for j in range(3))
        order = np.lexsort((starts, rows))
        rows, starts, ids = rows[order], starts[order], ids[order]
        ends = np.cumsum(np.bincount(rows, minlength=n)).tolist()
        raw, begin = ids.astype(np.int32).tobytes(), 0
        spelt = set(rows[ids < 0].tolist())
        for k, (w, end, score, distance) in enumerate(zip(words, ends, best.tolist(), (best - second).tolist(), strict=True)):
            if k in spelt:
                path = zip(starts[begin:end].tolist(), ids[begin:end].tolist(), strict=True)
                self.words[w] = (np.array(self.model.spell(w, list(path)), np.int32).tobytes(), score, distance)
            else:
                self.words[w] = (raw[4 * begin : 4 * end], score, distance)
            begin = end

    def n_best_word(self, word: str) -> list[tuple[float, bytes]]:
        """The word's n best, the path that words holds first."""
        got = self.lists.get(word)
        if got is None:
            if len(self.lists) > self.memory // 10:
                self.lists.clear()
            got = [(s, np.array(ids, np.int32).tobytes()) for s, ids in self.model.n_best(word, self.n)]
            first = self.words[word][0]
            got = [(got[0][0], first), *[g for g in got if g[1] != first]][: self.n]
            self.lists[word] = got
        return got

    def split(self, text: str) -> list[str]:
        return UNIT.findall(MARK + text.replace(MARK, OWN_MARK).replace(" ", MARK)) if text else []

    def encode(self, texts: list[str | None]) -> list[list[tuple[float, bytes]] | None]:
        """For each text its n best segmentations: (score, ids); None for null."""
        split = [self.split(t or "") for t in texts]
        new = set().union(*split) if split else set()
        if not new <= self.words.keys():
            missing = [w for w in new if w not in self.words]
            if len(self.words) + len(missing) > self.memory:
                self.words.clear()
                missing = list(new)
            self.learn(missing)
        out = []
        for t, units in zip(texts, split, strict=True):
            if t is None:
                out.append(None)
                continue
            rows = [self.words[u] for u in units]
            ids = list(map(itemgetter(0), rows))
            best = (sum(map(itemgetter(1), rows)), b"".join(ids))
            out.append([best, *(self._merge(best, ids, list(map(itemgetter(2), rows)), units) if self.n > 1 else [])])
        return out

    def _merge(self, best: tuple[float, bytes], ids: list[bytes], distances: list[float], units: list[str]) -> list[tuple[float, bytes]]:
        """The second to n-th: best-first over the lists of the words nearest to their second-best path. Uses up distances."""
        near = []
        while distances and len(near) < self.n - 1 and (least := min(distances)) < np.inf:
            near.append(distances.index(least))
            distances[near[-1]] = np.inf
        near.sort()
        lists = []
        for k in near:
            got = self.n_best_word(units[k])
            lists.append([(got[0][0] - s, path) for s, path in got])
        queue, seen, out = [(0.0, (0,) * len(lists))], {(0,) * len(lists)}, []
        begins = None
        while queue and len(out) < self.n:
            cost, at = heapq.heappop(queue)
            if not any(at):
                out.append(best)
            else:
                if begins is None:
                    begins, place, last = {}, 0, 0
                    for k in near:
                        place += sum(map(len, ids[last:k]))
                        begins[k], last = place, k
                pieces, place = [], 0
                for k, every, i in zip(near, lists, at, strict=True):
                    if i:
                        pieces += [best[1][place : begins[k]], every[i][1]]
                        place = begins[k] + len(ids[k])
                out.append((best[0] - cost, b"".join([*pieces, best[1][place:]])))
            for k, i in enumerate(at):
                if i + 1 < len(lists[k]):
                    more = (*at[:k], i + 1, *at[k + 1 :])
                    if more not in seen:
                        seen.add(more)
                        heapq.heappush(queue, (cost + lists[k][i + 1][0] - lists[k][i][0], more))
        return out[1:]

    def merge(self, text: str) -> bytes:
        """Ids of a text by merges."""
        out = []
        for u in self.split(text):
            got = self.merged.get(u)
            if got is None:
                if len(self.merged) > self.memory // 4:
                    self.merged.clear()
                got = self.merged[u] = np.array(self.model.merge(u), np.int32).tobytes()
            out.append(got)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.spelt.__getitem__, np.frombuffer(ids, np.int32).tolist()))
        return raw.decode("utf-8", "replace").removeprefix(" ")


def encode(docs: DataFrame, model_path: str, n: int = 3, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), own: bool = False, slice_bytes: int = SLICE, memory: int = MEMORY) -> DataFrame:
    """The columns named in keep, then ids (32-bit integers, little-endian), scores (of the n best), others (ids of the second to n-th) and round_trip (whether the ids decode to the text; null for null); with own also own_ids, by merges."""
    model = PieceModel.read(model_path)
    trie = Trie(model)  # made once, here

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        encoder = run.__dict__.get("encoder") or run.__dict__.setdefault("encoder", Encoder(model, n, trie, memory))
        said = [None if raw is None else raw.decode("utf-8", "replace") for raw in batch.column("text").to_pylist()]
        got = encoder.encode(said)
        return {f"keep_{k}": batch.column(f"keep_{k}") for k in keep} | {
            "ids": [None if g is None else g[0][1] for g in got],
            "scores": [None if g is None else [s for s, _ in g] for g in got],
            "others": [None if g is None else [ids for _, ids in g[1:]] for g in got],
            "round_trip": [None if g is None else encoder.decode(g[0][1]) == t for g, t in zip(got, said, strict=True)],
        } | ({"own_ids": [None if t is None else encoder.merge(t) for t in said]} if own else {})

    kinds = dict(docs.dtypes)
    df = docs.select(F.col(f"`{text_col}`").cast("binary").alias("text"), *[F.col(f"`{k}`").alias(f"keep_{k}") for k in keep])
    more = ["own_ids"] if own else []
    out = map_texts(df, run, ", ".join([*[f"`keep_{k}` {kinds[k]}" for k in keep], "ids binary", "scores array<double>", "others array<binary>", "round_trip boolean", *[f"{c} binary" for c in more]]), slice_bytes)
    return out.select(*[F.col(f"keep_{k}").alias(k) for k in keep], "ids", "scores", "others", "round_trip", *more)


def decode(encoded: DataFrame, model_path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns named in keep, and the text that the ids spell."""
    model = PieceModel.read(model_path)
    trie = Trie(model)

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        encoder = run.__dict__.get("encoder") or run.__dict__.setdefault("encoder", Encoder(model, 1, trie))
        return {f"keep_{k}": batch.column(f"keep_{k}") for k in keep} | {"text": [None if ids is None else encoder.decode(ids) for ids in batch.column("text").to_pylist()]}

    kinds = dict(encoded.dtypes)
    df = encoded.select(F.col("ids").alias("text"), *[F.col(f"`{k}`").alias(f"keep_{k}") for k in keep])
    out = map_texts(df, run, ", ".join([*[f"`keep_{k}` {kinds[k]}" for k in keep], "text string"]), SLICE)
    return out.select(*[F.col(f"keep_{k}").alias(k) for k in keep], "text")


def digest(encoded: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """What a query shows of encoded texts."""
    own = [(F.octet_length("own_ids") / 4).cast("long").alias("own_pieces"), F.sha2("own_ids", 256).alias("own_ids_sha256")] if "own_ids" in encoded.columns else []
    return encoded.select(
        *keep, (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.get("scores", F.lit(0)).alias("best_score"),
        F.get("scores", F.lit(1)).alias("second_score"), F.get("scores", F.lit(2)).alias("third_score"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.get("others", F.lit(0)), 256).alias("second_sha256"), F.sha2(F.get("others", F.lit(1)), 256).alias("third_sha256"), "round_trip", *own,
    )
