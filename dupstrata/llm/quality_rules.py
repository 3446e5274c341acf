"""Quality rules judged by an isolation forest.

Rule statistics of each text (lengths, symbols, repeated lines, repeated 3-word windows, case, digits, punctuation) are
scored by an isolation forest: short mean path lengths over random splits mark odd documents. The forest is grown from a
bounded, documented sample (SAMPLE_ROWS rows by hash); every document is scored. The threshold is calibrated on labelled
rows: the score below which KEEP_GOOD of the rows of good quality lie. A document is kept if it passes the base rule and
scores at or below that threshold.

Null or empty text has no words, fails the base rule and is not kept. With no labelled good rows the threshold is 1 and
only the base rule decides. Repeated ids stay repeated rows; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dupstrata.llm.common import bounded_sample, cut, map_texts, texts

SAMPLE_ROWS = 8192
TREES, TREE_ROWS, SEED = 100, 256, 17
KEEP_GOOD = 0.99
LEAST_WORDS = 50

SYMBOLS = b"#*$%&|<>"
UPPER, DIGIT, PUNCT = bytes(range(65, 91)), b"0123456789", b".,;:!?\"'()-"
FEATURES = ("f_length", "f_word", "f_symbols", "f_lines", "f_repeat", "f_upper", "f_digit", "f_punct", "f_distinct")
STATS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, features array<double>"


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words that lie in a window of `window` words which the text holds twice or more, the first included."""
    if len(words) <= window:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    grams = codes[: len(codes) - window + 1]
    for k in range(1, window):
        grams = grams * len(ids) + codes[k : len(codes) - window + 1 + k]
        if k + 1 < window:
            grams = np.unique(grams, return_inverse=True)[1].astype(np.int64) if len(ids) > 1_000_000 else grams
    _, where, count = np.unique(grams, return_inverse=True, return_counts=True)
    again = count[where] > 1
    covered = np.zeros(len(words), bool)
    for k in range(window):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def statistics(raw: bytes | None) -> tuple[int, int, int, int, int, list[float]]:
    raw = raw or b""
    words = raw.split()
    n = len(words)
    chars = sum(map(len, words))
    chars -= len(raw) - len(raw.translate(None, bytes(range(0x80, 0xC0))))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    rep = repeated_words(words)
    share = lambda drop: (len(raw) - len(raw.translate(None, drop))) / max(1, chars)
    feats = [math.log1p(n), chars / max(1, n), symbols / max(1, n), dup / max(1, len(lines)), rep / max(1, n), share(UPPER), share(DIGIT), share(PUNCT), len(set(words)) / max(1, n) ** 0.8]
    return n, chars, symbols, dup, rep, feats


def _stats(batch: pa.RecordBatch) -> dict[str, list]:
    rows = [statistics(raw) for raw in batch.column("text").to_pylist()]
    cols = list(zip(*rows, strict=True)) or [[]] * 6
    return {"doc_id": batch.column("doc_id")} | dict(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "features"), cols, strict=True))


def rule_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return map_texts(texts(docs, id_col, text_col), _stats, STATS)


def mean_path(n: int) -> float:
    """Mean path length of an unsuccessful search among n points."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


class IsolationForest:
    """Trees as flat arrays: split feature (-1 in leaves), threshold, children, path length at leaves."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.size = min(tree_rows, len(rows))
        self.depth = max(1, math.ceil(math.log2(max(2, self.size))))
        self.trees = [self._grow(rows[rng.choice(len(rows), self.size, replace=False)], rng) for _ in range(trees)] if len(rows) else []

    def _grow(self, rows: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, threshold, child, length = [], [], [], []

        def node(at: np.ndarray, depth: int) -> int:
            me = len(feature)
            feature.append(-1), threshold.append(0.0), child.append((me, me)), length.append(depth + mean_path(len(at)))
            low, high = at.min(0), at.max(0)
            able = np.flatnonzero(high > low)
            if depth < self.depth and len(at) > 1 and len(able):
                f = int(rng.choice(able))
                t = float(rng.uniform(low[f], high[f]))
                left = at[:, f] <= t
                feature[me], threshold[me] = f, t
                child[me] = (node(at[left], depth + 1), node(at[~left], depth + 1))
            return me

        node(rows, 0)
        return np.array(feature), np.array(threshold), np.array(child), np.array(length)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1; higher is odder."""
        if not self.trees or not len(rows):
            return np.zeros(len(rows))
        total = np.zeros(len(rows))
        for feature, threshold, child, length in self.trees:
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                right = rows[np.arange(len(rows)), np.maximum(f, 0)] > threshold[at]
                at = child[at, right.astype(np.int64)]
            total += length[at]
        return 2.0 ** (-total / len(self.trees) / max(mean_path(self.size), 1e-9))


def fit(stats: DataFrame, rows: int = SAMPLE_ROWS) -> IsolationForest:
    """From about `rows` rows with words; only their few statistics come to the driver, sorted so that reruns agree."""
    chosen = bounded_sample(stats.where("n_words > 0").select("doc_id", "features"), "doc_id", rows, "forest").collect()
    at = sorted((r["doc_id"] if r["doc_id"] is not None else -1, list(r["features"])) for r in chosen)
    return IsolationForest(np.array([x for _, x in at]).reshape(len(at), len(FEATURES)))


def score(stats: DataFrame, forest: IsolationForest) -> DataFrame:
    """stats with a column oddness."""

    @F.pandas_udf("double")
    def oddness(features):
        return __import__("pandas").Series(forest.scores(np.stack(features.to_numpy())) if len(features) else np.zeros(0))

    return stats.withColumn("oddness", oddness("features"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_good: float = KEEP_GOOD) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and oddness for each document. labels: doc_id, quality."""
    stats = cut(rule_statistics(docs, id_col, text_col), "rule-statistics")
    scored = score(stats, fit(stats)).withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    limit = scored.where(~F.col("base_failed")).join(good, "doc_id", "left_semi").agg(F.percentile_approx("oddness", keep_good, 10_000)).first()[0]
    kept = ~F.col("base_failed") & (F.col("oddness") <= (1.0 if limit is None else float(limit)))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.round("oddness", 9).alias("oddness"))
