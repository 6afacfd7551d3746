"""Language identification: family first, then one-versus-one linear SVMs within the family.

A text is a vector of hashed byte n-grams (1 to 3 bytes of its lower-cased UTF-8), square-rooted and scaled to unit
length. A one-versus-rest linear SVM picks the family; inside it each pair of languages has its own linear SVM
and the language with most votes wins, the summed margin breaking ties. Training uses a bounded sample: at most
about ``SAMPLE`` documents a language and ``SHARES`` times as many in all, chosen by a hash of the id, from documents outside
the held-out third. Every language with a letter in one of them has one document in the sample at least.

Defined results: a null text or one without a letter is ``und`` with score 0, as is everything if no document can be
learned from; languages unknown to ``FAMILIES`` are families of their own; rows that repeat are predicted alike; an
empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 1 << 12
SAMPLE = 400
SHARES = 20
EPOCHS, REGULAR = 40, 1e-4
#: Bytes of a long text that are worked on at once.
SLICE = 1 << 20

# Language families of ISO 639-1 codes.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "uralic": "fi et hu",
    "baltic": "lt lv",
    "turkic": "tr az kk uz tk ky",
    "semitic": "ar he mt am",
    "indic": "hi bn ur mr gu pa ne",
    "celtic": "ga cy gd br",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_LETTER = re.compile(r"[^\W\d_]")


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def features(text: str) -> np.ndarray:
    """Unit vector of hashed byte n-grams of the whole text."""
    raw = np.frombuffer(text.lower().encode(), np.uint8).astype(np.uint32)
    counts = np.zeros(BINS, np.float64)
    for at in range(0, len(raw), SLICE):  # n-grams that begin in the slice
        b = raw[at : at + SLICE + 2]
        tri = ((b[:-2] << 16) | (b[1:-1] << 8) | b[2:]) * np.uint32(2654435761)
        two = ((b[:-1] << 8) | b[1:])[:SLICE] * np.uint32(2246822519)
        for code in (tri, two, b[:SLICE] * np.uint32(3266489917)):
            counts += np.bincount(code >> np.uint32(20), minlength=BINS)
    v = np.sqrt(counts)
    return (v / max(np.linalg.norm(v), 1e-12)).astype(np.float32)


def _svm(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and bias (last) of a linear SVM: averaged stochastic sub-gradients of the hinge loss, fixed order."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w, mean, rng, t = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.random.default_rng(7), 0
    weight = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    for epoch in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(x)), max(1, len(x) // 32)):
            t += 1
            rate = 10.0 / (1 + 0.02 * t)
            miss = part[y[part] * (x[part] @ w) < 1]
            w *= 1 - rate * REGULAR
            if len(miss):
                w += rate / len(part) * ((y[miss] * weight[miss]) @ x[miss])
            if epoch >= EPOCHS // 2:
                mean += w
    return (mean / np.linalg.norm(mean) if mean.any() else mean).astype(np.float32)


class LanguageModel:
    """Family weights, and for each family its languages and pair weights."""

    def __init__(self, x: np.ndarray, labels: list[str]) -> None:
        labels_ = np.array(labels)
        family = np.array([FAMILY_OF.get(c.lower(), f"={c}") for c in labels])
        self.families = sorted(set(family.tolist()))
        self.members = [sorted(set(labels_[family == f].tolist())) for f in self.families]
        two = len(self.families) > 1
        self.family_weights = np.stack([_svm(x, np.where(family == f, 1.0, -1.0)) for f in self.families]) if two else None
        self.pairs: list[list[tuple[int, int, np.ndarray]]] = []
        for names in self.members:
            own = []
            for i, j in combinations(range(len(names)), 2):
                rows = (labels_ == names[i]) | (labels_ == names[j])
                own.append((i, j, _svm(x[rows], np.where(labels_[rows] == names[i], 1.0, -1.0))))
            self.pairs.append(own)
        self.scale = 8.0

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not _LETTER.search(text):
            return "und", 0.0
        v = np.append(features(text), np.float32(1))
        score, at = 1.0, 0
        if self.family_weights is not None:
            margins = self.family_weights @ v
            at = int(np.argmax(margins))
            score = float(1 / (1 + np.exp(-self.scale * margins[at])))
        names, votes = self.members[at], np.zeros((len(self.members[at]), 2))
        for i, j, w in self.pairs[at]:
            m = float(w @ v)
            votes[i if m > 0 else j, 0] += 1
            votes[i, 1] += m
            votes[j, 1] -= m
        best = max(range(len(names)), key=lambda k: (votes[k, 0], votes[k, 1], -k))
        if len(names) > 1:
            score *= float(1 / (1 + np.exp(-self.scale * votes[best, 1] / (len(names) - 1))))
        return names[best], min(1.0, max(0.0, score))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> LanguageModel | None:
    """A model of the bounded sample, or None if there is nothing to learn from."""
    usable = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter(F.col("lang").isNotNull() & ~held_out("id"))
    place = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30))
    lettered = F.when(F.col("text").rlike(r"\p{L}"), place)
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(lettered).alias("least")).collect()
    if not counts:
        return None
    each = max(1, min(sample, SHARES * sample // len(counts)))
    ends = [(r["lang"], max(int(min(1.0, each / r["n"]) * (1 << 30)), -1 if r["least"] is None else r["least"])) for r in counts]
    ends = docs.sparkSession.createDataFrame(ends, "lang string, end long")

    def run(batches):
        for batch in batches:
            rows = [(c, features(t).tobytes()) for c, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t and _LETTER.search(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["lang", "vector"])

    rows = usable.join(F.broadcast(ends), "lang").filter(place <= F.col("end")).select("lang", "text").mapInArrow(run, "lang string, vector binary").collect()
    rows.sort(key=lambda r: (r["lang"], bytes(r["vector"])))
    if not rows:
        return None
    return LanguageModel(np.stack([np.frombuffer(bytes(r["vector"]), np.float32) for r in rows]), [r["lang"] for r in rows])


def identify(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per row. The text alone decides."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            rows = [shared.value.predict(t.as_py()) if shared.value else ("und", 0.0) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    source = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
