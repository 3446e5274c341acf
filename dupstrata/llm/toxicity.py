"""Toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses, and each word of a clause is a symbol: its level in the insult lexicon (0 for none) and one of
the classes threat, target, negation, reported speech and other. Five transducers read clauses:

    insult      a word of level k as the mark of an insult of that level, or as its other class
    threat      a threat word as the mark of a threat
    negation    marks insults and threats in a clause with a negation
    reported    marks those in a clause with a reporting verb
    target      marks those in a clause with a target

The last three reach marks on both sides: each starts in two states, one that holds that the clause has such a word (and
accepts only if it came) and one that holds that it has none (and has no arc for it). A sixth, of one state, gives marks
their weights. The six are composed into one machine, and a clause's score is the weight of its best accepted path: a word
that is both an insult and a target is read as whichever makes the clause score more. Words of no class stand in no arc, as
all six pass over them. A text's clause scores (their sum, largest and share of words) become a probability by a logistic
fit.

The insult lexicon holds a few seed words and what training finds: whole words and word beginnings (4 to 8 letters) that
stand far more often in toxic than in other rows: in LEAST_DOCS toxic rows or more (twice that for beginnings), in at least
a quarter of the rows that hold them, with a lift of exp(LEAST_LIFT) or more. Every term that passes is kept, but for
beginnings that a shorter kept one implies with no less weight; the training rows bound their number. Training reads a
bounded sample of labelled rows (SAMPLE_ROWS, by hash of the id); every document is scored.

Texts that are null or empty get the score of a text without a match. Documents labelled twice train twice; repeated ids
stay repeated rows; an empty table gives an empty result, and without labelled rows of both kinds the seeds and default
weights score. Very long texts are read whole. Only id and text are read, so further columns of any name do no harm.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dupstrata.llm.common import bounded_sample, cut, drop, held_out, map_texts
from dupstrata.llm.transducers import Transducer, compose, trimmed

SAMPLE_ROWS = 12_000
HELD_PARTS, HELD_PART = 5, 0
#: Weights of insults are multiples of UNIT, at most LEVELS of them.
LEVELS, UNIT = 12, 0.125
LEAST_DOCS, LEAST_LIFT = 6, 4.0

# Seed words of each transducer.
INSULT = ("idiot", "moron", "stupid", "scum", "loser", "trash", "pathetic", "worthless", "disgusting", "clown")
THREAT = ("kill", "hurt", "destroy", "die", "shoot", "stab", "beat")
TARGET = ("you", "your", "he", "she", "they", "them", "him", "her", "this", "that", "du", "tu", "vous", "usted", "sie")
NEGATION = ("not", "no", "never", "nicht", "kein", "pas", "jamais", "nunca", "isn't", "aren't")
REPORTED = ("said", "says", "called", "quoted", "claimed", "wrote", "sagte", "dit", "dijo")

#: A-Z lowered; ASCII that ends a clause becomes a dot, what else isn't a letter, digit or apostrophe a blank.
FLAT = bytes(b + 32 if 65 <= b <= 90 else 46 if b in b".!?;:\n" else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 or b == 39 else 32 for b in range(256))
NO_DOT = bytes.maketrans(b".", b" ")
STEMS = (4, 5, 6, 7, 8)


OTHER, HURT, AIM, NOT, SAID = "other", "threat", "target", "negation", "reported"
CLASSES = {w.encode(): c for c, words in ((HURT, THREAT), (AIM, TARGET), (NOT, NEGATION), (SAID, REPORTED)) for w in words}
FLAGS = (NOT, SAID, AIM)
THREAT_WEIGHT, UNAIMED = 0.5, 0.25

Symbol = tuple[int, str]  # level in the insult lexicon, other class
#: A mark is (level, flags): level 0 for a threat.
MARKS = [(k, frozenset(f)) for k in range(LEVELS + 1) for n in range(len(FLAGS) + 1) for f in combinations(FLAGS, n)]
SYMBOLS: list[Symbol] = [(k, c) for k in range(LEVELS + 1) for c in (OTHER, HURT, AIM, NOT, SAID)]


def insult() -> Transducer:
    t = Transducer({0}, {0})
    for k, c in SYMBOLS:
        t.add(0, (k, c), c, 0.0, 0)
        if k:
            t.add(0, (k, c), (k, frozenset()), 0.0, 0)
    return t


def threat() -> Transducer:
    t = Transducer({0}, {0})
    for x in (OTHER, AIM, NOT, SAID, *MARKS):
        t.add(0, x, x, 0.0, 0)
    t.add(0, HURT, (0, frozenset()), 0.0, 0)
    return t


def context(flag: str) -> Transducer:
    """Marks insults and threats of clauses that hold a word of this class. States: 0 none will come, 1 one must come, 2 one has come."""
    t = Transducer({0, 1}, {0, 2})
    for state in (0, 1, 2):
        for x in (OTHER, *FLAGS):
            if x != flag:
                t.add(state, x, x, 0.0, state)
            elif state:
                t.add(state, x, x, 0.0, 2)
        for k, flags in MARKS:
            if flag not in flags:
                t.add(state, (k, flags), (k, flags | {flag}) if state else (k, flags), 0.0, state)
    return t


def weigh(negated: float, reported: float, aimed: float) -> Transducer:
    t = Transducer({0}, {0})
    for x in (OTHER, *FLAGS):
        t.add(0, x, x, 0.0, 0)
    for k, flags in MARKS:
        base = k * UNIT if k else THREAT_WEIGHT * (1.0 if AIM in flags else UNAIMED)
        t.add(0, (k, flags), (k, flags), base * (negated if NOT in flags else 1.0) * (reported if SAID in flags else 1.0) * (aimed if AIM in flags else 1.0), 0)
    return t


def machine(negated: float, reported: float, aimed: float) -> Transducer:
    """The composed grammar."""
    return trimmed(reduce(compose, (insult(), threat(), context(NOT), context(SAID), context(AIM), weigh(negated, reported, aimed))))


@dataclass
class Grammar:
    insult: dict[bytes, float]
    stems: dict[bytes, float] = field(default_factory=dict)  # word beginnings of the insult transducer
    weights: tuple[float, ...] = (-3.0, 1.0, 1.0, 1.0, 0.0)
    negated: float = 0.4
    reported: float = 0.5
    aimed: float = 1.25

    def symbol(self, word: bytes) -> Symbol:
        bad = self.insult.get(word, 0.0)
        if not bad and self.stems:
            text = word.decode("utf-8", "replace")
            bad = max((self.stems.get(text[:n].encode(), 0.0) for n in STEMS if len(text) >= n), default=0.0)
        return min(LEVELS, max(1, round(bad / UNIT))) if bad else 0, CLASSES.get(word, OTHER)


NEUTRAL: Symbol = (0, OTHER)


class Reader:
    """Scores texts; symbols of words and scores of clauses are kept for MEMORY of them at most."""

    MEMORY = 400_000

    def __init__(self, g: Grammar):
        self.g, self.known, self.clauses = g, {}, {}
        self.machine = machine(g.negated, g.reported, g.aimed)

    def clause(self, symbols: tuple[Symbol, ...]) -> float:
        got = self.clauses.get(symbols)
        if got is None:
            if len(self.clauses) >= self.MEMORY:
                self.clauses.clear()
            got = self.clauses[symbols] = self.machine.best(symbols)
        return got

    def measure(self, raw: bytes | None) -> list[float]:
        flat = (raw or b"").translate(FLAT)
        words = flat.translate(NO_DOT).split()
        known, g = self.known, self.g
        some, hot = {}, False
        for w in set(words):
            v = known.get(w)
            if v is None:
                if len(known) >= self.MEMORY:
                    known.clear()
                v = known[w] = g.symbol(w)
            if v != NEUTRAL:
                some[w] = v
                hot = hot or v[0] > 0 or v[1] == HURT
        total = best = 0.0
        n = 0
        if hot:
            for clause in flat.split(b"."):
                symbols = tuple([some[w] for w in clause.split() if w in some])
                k = sum(level > 0 or c == HURT for level, c in symbols)
                if k:
                    s = self.clause(symbols)
                    total, best, n = total + s, max(best, s), n + k
        return [math.log1p(total), best, math.log1p(n), 100.0 * total / (len(words) + 20)]


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 400) -> tuple[float, ...]:
    """Intercept and weights by Newton steps with a small ridge."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(min(steps, 60)):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = np.full(len(w), 0.05)
        move = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += move
        if np.abs(move).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def _words(batch: pa.RecordBatch) -> dict[str, list]:
    """For each text its distinct words and word beginnings: a beginning is marked by a star at its end."""
    out: dict[bytes, list[int]] = {}
    for raw, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
        terms = set((raw or b"").translate(FLAT).translate(NO_DOT).split())
        for text in [w.decode("utf-8", "replace") for w in terms]:
            terms.update(text[:n].encode() + b"*" for n in STEMS if len(text) >= n)
        for t in terms:
            c = out.setdefault(t, [0, 0])
            c[0] += toxic
            c[1] += 1
    keys = list(out)
    return {"term": keys, "toxic": [out[k][0] for k in keys], "docs": [out[k][1] for k in keys]}


def learn_lexicon(sample: DataFrame) -> tuple[dict[bytes, float], dict[bytes, float]]:
    """Whole words and beginnings with their weights; counted on the executors, those that pass come back."""
    total = sample.agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).first()
    bad, n = int(total["t"] or 0), int(total["n"])
    if not bad or bad == n:
        return {}, {}
    lift = (F.col("toxic") + 0.5) / (bad + 1.0) / ((F.col("docs") - F.col("toxic") + 0.5) / (n - bad + 1.0))
    counts = map_texts(sample, _words, "term binary, toxic long, docs long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("docs").alias("docs"))
    star = F.expr("endswith(term, X'2A')")
    fit = (4 * F.col("toxic") >= F.col("docs")) & (F.col("toxic") >= F.when(star, 2 * LEAST_DOCS).otherwise(LEAST_DOCS)) & (F.col("lift") >= F.when(star, math.exp(LEAST_LIFT - 0.5)).otherwise(math.exp(LEAST_LIFT)))
    words, stems = {}, {}
    for r in counts.withColumn("lift", lift).where(fit).select("term", "lift", star.alias("star")).collect():
        into = stems if r["star"] else words
        into[bytes(r["term"]).removesuffix(b"*") if r["star"] else bytes(r["term"])] = min(LEVELS * UNIT, math.log(r["lift"]) / 4)
    kept = {}
    for stem in sorted(stems, key=len):
        text = stem.decode()
        if stems[stem] > max((kept.get(text[:k].encode(), 0.0) for k in STEMS if k < len(text)), default=0.0):
            kept[stem] = stems[stem]
    return words, kept


def train(docs: DataFrame, labels: DataFrame, train_on: Column, rows: int = SAMPLE_ROWS) -> Grammar:
    """docs: doc_id, text. labels: doc_id, toxic."""
    marks = labels.where(F.col("toxic").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(train_on)
    chosen = bounded_sample(marks, "doc_id", rows, "toxicity")
    sample = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id"), "toxicity-sample")
    words, stems = learn_lexicon(sample)
    seeds = {w.encode(): 1.0 for w in INSULT}
    g = Grammar(insult=seeds | words, stems=stems)

    def measured(batch: pa.RecordBatch) -> dict[str, list]:
        reader = Reader(g)
        return {"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "x": [reader.measure(raw) for raw in batch.column("text").to_pylist()]}

    got = sorted((r["doc_id"], r["toxic"], list(r["x"])) for r in map_texts(sample, measured, "doc_id long, toxic int, x array<double>").collect())
    if len({t for _, t, _ in got}) > 1:
        g.weights = fit_logistic(np.array([x for *_, x in got]), np.array([float(t > 0) for _, t, _ in got]))
    drop(sample)
    return g


def score(docs: DataFrame, g: Grammar) -> DataFrame:
    """doc_id, score, predicted for each row of docs."""

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        reader = run.__dict__.setdefault("reader", Reader(g))
        x = np.array([reader.measure(raw) for raw in batch.column("text").to_pylist()]).reshape(batch.num_rows, 4)
        p = 1 / (1 + np.exp(-np.clip(g.weights[0] + x @ np.array(g.weights[1:]), -30, 30)))
        p = np.round(p, 6)
        return {"doc_id": batch.column("doc_id"), "score": list(p), "predicted": [int(v >= 0.5) for v in p]}

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")), run, "doc_id long, score double, predicted int")


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; learned from labelled rows that are not held out."""
    g = train(docs, labels, ~held_out("doc_id", HELD_PARTS, HELD_PART))
    return score(docs, g).select("doc_id", held_out("doc_id", HELD_PARTS, HELD_PART).alias("held_out"), "score", "predicted")
