"""Language identification with string kernels.

A text's features are the byte n-grams of 1 to NGRAM bytes that it has (presence, whole text), hashed to
FEATURES buckets: the blended-spectrum presence kernel of two texts is the number of buckets both have,
divided by the root of the product of their own numbers. The Nystroem method maps a text to its kernel
values with LANDMARKS sampled texts, times the inverse root of the landmarks' own kernel matrix; kernel
ridge regression of one language against the rest is then a linear map of these. A batch is scored by
two matrix products.

The fit takes at most SAMPLE labelled texts, spread evenly over the languages by a hash of the id;
only their feature bits come to the driver. Statistics of languages count all training rows.

Defined results: null text, or one without a letter, is `und` with score 0; null ids and repeated rows
are judged like others; with no training text all is `und`; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit.llm import bytewords as B
from docaudit.llm.common import residue

NGRAM = 3
FEATURES = 1 << 13
LANDMARKS = 96
SAMPLE = 1200
RIDGE = 1e-2


def presence(texts: pa.Array) -> np.ndarray:
    """Texts by buckets, 1.0 where the text has an n-gram of the bucket. No n-gram spans two texts."""
    raw, offsets = B.bytes_of(texts)
    raw = B._FOLD[raw].astype(np.uint32)
    out = np.zeros((len(offsets) - 1, FEATURES), np.float32)
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64) * FEATURES, np.diff(offsets))
    last = np.repeat(offsets[1:], np.diff(offsets))
    key = np.zeros(len(raw), np.uint32)
    flat = out.reshape(-1)
    for n in range(1, NGRAM + 1):
        m = len(raw) - n + 1
        if m <= 0:
            break
        key = key[:m] * np.uint32(257) + raw[n - 1 :] + np.uint32(1)
        h = key * np.uint32(2654435761)
        h ^= h >> np.uint32(15)
        at = doc[:m] + ((h * np.uint32(2246822519)) >> np.uint32(32 - FEATURES.bit_length() + 1))
        flat[at[np.arange(m) + n <= last[:m]]] = 1.0
    return out


class Classifier:
    """weights: buckets x landmarks, then landmarks x languages."""

    def __init__(self, x: np.ndarray, y: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        self.langs = sorted(set(y))
        if not self.langs:
            return
        # landmarks: every so many of the sample, which is sorted by language
        chosen = np.unique(np.linspace(0, len(x) - 1, min(landmarks, len(x))).astype(int))
        self.marks = np.ascontiguousarray((x[chosen] / np.sqrt(np.maximum(x[chosen].sum(1), 1))[:, None]).T)
        values, vectors = np.linalg.eigh(self.marks.T @ self.marks + 1e-6 * np.eye(len(chosen)))
        self.root = (vectors / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
        z = np.c_[self.kernel(x) @ self.root, np.ones(len(x))]
        targets = np.where(np.array(y)[:, None] == np.array(self.langs)[None, :], 1.0, -1.0)
        a = z.T @ z + ridge * len(x) / len(z.T) * np.eye(z.shape[1])
        self.weights = np.linalg.solve(a, z.T @ targets)
        self.weights = np.r_[self.root @ self.weights[:-1], self.weights[-1:]].astype(np.float32)

    def kernel(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.marks) / np.sqrt(np.maximum(x.sum(1), 1))[:, None]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language and its score: one-versus-rest values taken to shares of 1."""
        v = self.kernel(x) @ self.weights[:-1] + self.weights[-1]
        e = np.exp(4 * (v - v.max(1, keepdims=True)))
        best = v.argmax(1)
        return best, (e / e.sum(1, keepdims=True))[np.arange(len(v)), best]


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in B.blocks(batch, "text"):
            x = presence(b.column("text")) > 0
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array([p.tobytes() for p in np.packbits(x, axis=1)], pa.binary())], names=["lang", "bits"])


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", sample: int = SAMPLE) -> Classifier:
    """Fits on rows of docs, of which all are training rows."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    counts = known.groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").collect()
    if not counts:
        return Classifier(np.zeros((0, FEATURES), np.float32), [])
    each = -(-sample // len(counts))
    # rows of a language are taken where a hash of the id falls under its share; twice what is needed, then
    # the first by hash, so the sample has its size whatever the spread
    share = F.create_map(*[y for r in counts for y in (F.lit(r["lang"]), F.lit(min(1.0, 2.0 * (each + 20) / r["n"])))])
    draw = F.pmod(F.xxhash64(F.col(key_col)), F.lit(1 << 30)) / float(1 << 30)
    some = known.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), draw.alias("u"), F.col(key_col).alias("k"))
    some = some.where(F.col("u") < F.coalesce(F.element_at(share, F.col("lang")), F.lit(0.0)))
    t = some.select("lang", "text").mapInArrow(_bits, "lang string, bits binary").toArrow().sort_by([("lang", "ascending"), ("bits", "ascending")])
    langs, bits = t["lang"].to_pylist(), t["bits"].to_pylist()
    kept: list[int] = []
    for r in counts:
        own = [i for i, x in enumerate(langs) if x == r["lang"]]
        step = max(1.0, len(own) / each)
        kept += [own[int(i * step)] for i in range(min(each, len(own)))]
    x = np.unpackbits(np.array([np.frombuffer(bits[i], np.uint8) for i in kept], np.uint8).reshape(len(kept), FEATURES // 8), axis=1).astype(np.float32)
    return Classifier(x, [langs[i] for i in kept])


def predict(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in B.blocks(batch, "text"):
                for lo in range(0, part.num_rows, 256):
                    b = part.slice(lo, 256)
                    letter = b.column("letter").to_numpy(zero_copy_only=False).astype(bool)
                    if m.langs:
                        best, score = m.predict(presence(b.column("text")))
                        names = np.where(letter, np.array(m.langs, object)[best], "und")
                        score = np.where(letter, score, 0.0)
                    else:
                        names, score = np.full(b.num_rows, "und", object), np.zeros(b.num_rows)
                    yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string()), pa.array(score.astype(np.float64))], names=["doc_id", "lang_pred", "score"])

    x = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    return x.mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """The contract's query: learns from rows whose id's CRC-32 mod 5 is not 0."""
    model = train(docs.where(residue("doc_id", 5) != 0))
    return predict(docs, model).select("doc_id", (residue("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
