"""Language ID by hierarchical discrimination.

A linear classifier first picks the language family; inside a family, one-versus-one linear support vector machines
separate the languages, and the language with most pairwise wins (then the largest summed margin, then code point order)
is predicted. Features are counts of hashed byte trigrams of the whole text, with A-Z lowered and other ASCII
non-letters as blanks, scaled to length 1. The machines are trained by accelerated gradient descent on the squared hinge
loss, from a bounded sample of labelled rows (SAMPLE_ROWS, by hash of the id); every document is classified.

Only text and lang of the training rows are learned from. A language without a known family forms its own. A text that
is null or has no letter gets `und` with score 0; so does every text if nothing could be learned. Repeated ids stay
repeated rows; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dupstrata.llm.common import bounded_sample, held_out, map_texts

SAMPLE_ROWS = 3000
DIMS = 4096
UNKNOWN = "und"
HELD_PARTS, HELD_PART = 3, 1

# Families of common languages.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "pl", "cs", "uk", "bg", "sk", "sr", "hr", "sl"),
    "uralic": ("fi", "hu", "et"),
    "turkic": ("tr", "az", "kk"),
}
FAMILY = {lang: name for name, langs in FAMILIES.items() for lang in langs}

BLANKED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
LETTER = re.compile(r"[^\W\d_]")


def features(raw: bytes) -> np.ndarray:
    """Counts of hashed trigrams, scaled to length 1."""
    b = np.frombuffer(b" " + raw.translate(BLANKED) + b" ", np.uint8).astype(np.uint32)
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    code = code[b[1:-1] != 32]
    x = np.bincount((code * np.uint32(2654435761)) >> np.uint32(20), minlength=DIMS).astype(np.float32)
    np.sqrt(x, out=x)
    return x / max(float(np.sqrt((x * x).sum())), 1e-9)


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 150) -> np.ndarray:
    """Weights and bias (last) for y of +1 and -1, by accelerated gradient descent on the squared hinge loss; classes weigh alike."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = v = np.zeros(x.shape[1], np.float32)
    step = 1.0 / (1.0 / c + 2 * 2.0)
    for t in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v))
        after = v - step * (v / c - 2 * ((share * y * slack) @ x))
        v = after + t / (t + 3) * (after - w)
        w = after
    return w.astype(np.float32)


def squash(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-4 * np.clip(margin, -20, 20)))


@dataclass
class LanguageModel:
    langs: list[str]
    families: list[str]
    by_family: np.ndarray  # one row of weights for each family
    pairs: dict[str, list[tuple[int, int]]]  # of indexes into langs
    by_pair: dict[str, np.ndarray]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        margins = x @ self.by_family.T
        chosen = margins.argmax(1) if len(self.families) > 1 else np.zeros(len(x), int)
        sure = squash(margins) if len(self.families) > 1 else np.ones((len(x), 1))
        score = sure[np.arange(len(x)), chosen]
        said = np.empty(len(x), object)
        for f, name in enumerate(self.families):
            rows = np.flatnonzero(chosen == f)
            own = [i for i, lang in enumerate(self.langs) if FAMILY.get(lang, lang) == name]
            if not len(rows):
                continue
            if len(own) == 1:
                said[rows] = self.langs[own[0]]
                continue
            at = {lang: k for k, lang in enumerate(own)}
            votes, total, least = (np.zeros((len(rows), len(own))) for _ in range(3))
            least += np.inf
            for (a, b), m in zip(self.pairs[name], (x[rows] @ self.by_pair[name].T).T, strict=True):
                for lang, margin in ((a, m), (b, -m)):
                    k = at[lang]
                    votes[:, k] += margin > 0
                    total[:, k] += margin
                    least[:, k] = np.minimum(least[:, k], margin)
            best = (votes * 1e6 + total).argmax(1)
            said[rows] = np.array([self.langs[i] for i in own], object)[best]
            score[rows] *= squash(least[np.arange(len(rows)), best])
        return list(said), score


def train(rows: list[tuple[str, np.ndarray]]) -> LanguageModel | None:
    langs = sorted({lang for lang, _ in rows})
    if not langs:
        return None
    x = np.stack([v for _, v in rows])
    y = np.array([langs.index(lang) for lang, _ in rows])
    fam = [FAMILY.get(lang, lang) for lang in langs]
    families = sorted(set(fam))
    of = np.array([families.index(f) for f in fam])[y]
    by_family = np.stack([linear_svm(x, np.where(of == f, 1, -1).astype(np.float32)) for f in range(len(families))])
    pairs, by_pair = {}, {}
    for name in families:
        own = [i for i, f in enumerate(fam) if f == name]
        if len(own) > 1:
            pairs[name] = list(combinations(own, 2))
            by_pair[name] = np.stack([linear_svm(x[(y == a) | (y == b)], np.where(y[(y == a) | (y == b)] == a, 1, -1).astype(np.float32)) for a, b in pairs[name]])
    return LanguageModel(langs, families, by_family, pairs, by_pair)


def _featured(batch: pa.RecordBatch) -> dict[str, list]:
    return {"doc_id": batch.column("doc_id"), "lang": batch.column("lang"), "x": [features(raw).tobytes() for raw in batch.column("text").to_pylist()]}


def fit(docs: DataFrame, train_on: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS) -> LanguageModel | None:
    """From about `rows` of the rows that train_on admits. Their features are made on the executors, DIMS floats a row."""
    able = docs.where(train_on & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    able = able.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).cast("binary").alias("text"))
    got = map_texts(bounded_sample(able, "doc_id", rows, "language"), _featured, "doc_id long, lang string, x binary").collect()
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["lang"], bytes(r["x"])) for r in got)
    return train([(lang, np.frombuffer(x, np.float32)) for _, lang, x in got])


def classify(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score for every row, and the columns named in keep as they are."""

    def say(batch: pa.RecordBatch) -> dict[str, list]:
        raws = batch.column("text").to_pylist()
        able = [i for i, raw in enumerate(raws) if model and raw and LETTER.search(raw.decode("utf-8", "replace"))]
        lang, score = [UNKNOWN] * len(raws), [0.0] * len(raws)
        for begin in range(0, len(able), 512):
            some = able[begin : begin + 512]
            for i, said, sure in zip(some, *model.predict(np.stack([features(raws[i]) for i in some])), strict=True):
                lang[i], score[i] = said, float(sure)
        return {"key": batch.column("key"), "lang_pred": lang, "score": score} | {f"keep_{k}": batch.column(f"keep_{k}") for k in keep}

    kinds = dict(docs.dtypes)
    key = F.col(id_col)
    df = docs.select(key.alias("key"), F.col(text_col).cast("binary").alias("text"), *[F.col(f"`{k}`").alias(f"keep_{k}") for k in keep])
    out = map_texts(df, say, ", ".join([f"key {kinds[id_col]}", "lang_pred string", "score double", *[f"`keep_{k}` {kinds[k]}" for k in keep]]))
    return out.select(F.col("key").alias("doc_id"), "lang_pred", "score", *[F.col(f"keep_{k}").alias(k) for k in keep])


def identify(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows that are not held out."""
    out = held_out("doc_id", HELD_PARTS, HELD_PART)
    return classify(docs, fit(docs, ~out, rows=rows)).select("doc_id", held_out("doc_id", HELD_PARTS, HELD_PART).alias("held_out"), "lang_pred", F.round("score", 6).alias("score"))
